"""Chat formatting: a compiler for a small sandboxed template language.

Template text is parsed into a syntax tree, constants are folded, and the tree becomes a Python closure, a generator
of (text, in loss) pairs. There is no eval and no attribute access: a template knows literals, variables, ``a.b`` on
plain mappings, ``+``, ``==``, ``!=``, ``and``, ``or``, ``not``, named filters, and the statements ``for``, ``if`` / ``else``
and ``generation`` (whose output is under the loss mask). Loops take any iterator, so a conversation streams through
its template turn by turn and is never held as a whole; a single conversation may have any number of turns.

Control strings inside texts are escaped with a backslash (every sign of a run of three or more), and so is the backslash; ``unescape`` reverses it. ``turns_of`` reads
the turns and the loss mask back from formatted output.

Defined cases: null role or text: empty; null conv_id: one conversation of its own; equal turn numbers: ordered by role, then
text; null turn: first; a template without a loop: its text once for each conversation; a second loop over the messages: TemplateError, as they
stream by; empty table: empty result; extra columns: ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, STOP = "### ", "</turn>\n"
TEMPLATE = (
    "{% for m in messages %}"
    "{{ '###' + ' ' }}{{ m.role | escape_name }}:\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "{{ '</turn>' + '\n' }}"
    "{% endfor %}"
)

_ESCAPED = re.compile(r"\\|#{3,}|</turn>")
_ESCAPED_NAME = re.compile(r"[\\:\n]|#{3,}|</turn>")
_UNESCAPED = re.compile(r"\\(.)", re.DOTALL)


def _marked(found: re.Match) -> str:
    """Every sign of a run of three or more is escaped, so that no three in a row are left."""
    return "\\" + ("\\".join(found[0]) if found[0][0] == "#" else found[0])


def escape(text: str) -> str:
    return _ESCAPED.sub(_marked, text)


def escape_name(text: str) -> str:
    return _ESCAPED_NAME.sub(_marked, text)


def unescape(text: str) -> str:
    return _UNESCAPED.sub(r"\1", text) if "\\" in text else text


FILTERS: dict[str, Callable[[str], str]] = {
    "escape": escape,
    "escape_name": escape_name,
    "trim": str.strip,
    "upper": str.upper,
    "lower": str.lower,
    "capitalize": str.capitalize,
}


class TemplateError(ValueError):
    pass


_TAGS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.DOTALL)
_WORDS = re.compile(r"""\s*(?:('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(\d+)|([A-Za-z_]\w*)|(==|!=|[+|.()]))""", re.DOTALL)
_SIGNS = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    """Recursive descent: or, and, not, comparison, sum, filters, names and literals. Yields tuples."""

    def __init__(self, source: str):
        self.words, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _WORDS.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:at + 20]!r}")
            kind = next(i for i in range(1, 5) if m[i] is not None)
            self.words.append((kind, m[kind]))
            at = m.end()
        self.at = 0

    def take(self, *wanted: str) -> str | None:
        if self.at < len(self.words) and self.words[self.at][0] > 2 and self.words[self.at][1] in wanted:
            self.at += 1
            return self.words[self.at - 1][1]
        return None

    def whole(self) -> tuple:
        tree = self.either()
        if self.at < len(self.words):
            raise TemplateError(f"unexpected {self.words[self.at][1]!r}")
        return tree

    def either(self) -> tuple:
        left = self.both()
        while self.take("or"):
            left = ("or", left, self.both())
        return left

    def both(self) -> tuple:
        left = self.negated()
        while self.take("and"):
            left = ("and", left, self.negated())
        return left

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        left = self.sum()
        while sign := self.take("==", "!="):
            left = (sign, left, self.sum())
        return left

    def sum(self) -> tuple:
        left = self.filtered()
        while self.take("+"):
            left = ("+", left, self.filtered())
        return left

    def filtered(self) -> tuple:
        left = self.single()
        while self.take("|"):
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            left = ("filter", left, name)
        return left

    def name(self) -> str:
        if self.at >= len(self.words) or self.words[self.at][0] != 3:
            raise TemplateError("a name is missing")
        self.at += 1
        return self.words[self.at - 1][1]

    def single(self) -> tuple:
        if self.take("("):
            tree = self.either()
            if not self.take(")"):
                raise TemplateError("a ) is missing")
            return tree
        if self.at < len(self.words) and self.words[self.at][0] in (1, 2):
            kind, word = self.words[self.at]
            self.at += 1
            return ("const", re.sub(r"\\(.)", lambda m: _SIGNS.get(m[1], m[1]), word[1:-1], flags=re.DOTALL) if kind == 1 else int(word))
        tree = ("name", self.name())
        while self.take("."):
            tree = ("item", tree, self.name())
        return tree


def parse(template: str) -> tuple:
    """The syntax tree: ("block", [nodes])."""
    stack: list[tuple[str, tuple, list]] = [("", (), [])]
    at = 0
    for m in _TAGS.finditer(template):
        if m.start() > at:
            stack[-1][2].append(("const", template[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            stack[-1][2].append(_Expression(m[1]).whole())
        elif m[2] is not None:
            _statement(m[2].strip(), stack)
    if at < len(template):
        stack[-1][2].append(("const", template[at:]))
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} isn't closed")
    return ("block", stack[0][2])


def _statement(words: str, stack: list) -> None:
    kind, _, rest = words.partition(" ")
    if kind == "for":
        m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.DOTALL)
        if not m:
            raise TemplateError(f"can't read {words!r}")
        stack.append(("for", (m[1], _Expression(m[2]).whole()), []))
    elif kind == "if":
        stack.append(("if", (_Expression(rest).whole(),), []))
    elif words == "else" and stack[-1][0] == "if":
        stack.append(("else", (), []))
    elif words == "generation":
        stack.append(("generation", (), []))
    elif words in ("endfor", "endgeneration", "endif"):
        _, _, other = stack.pop() if stack[-1][0] == "else" and words == "endif" else ("", (), [])
        opened, head, body = stack.pop()
        if opened != words[3:] or not stack:
            raise TemplateError(f"{words} closes nothing")
        tail = (("block", other),) if opened == "if" else ()
        stack[-1][2].append((opened, *head, ("block", body), *tail))
    else:
        raise TemplateError(f"no statement {words!r}")


def fold(tree: tuple) -> tuple:
    """The same tree with everything computed that holds no name, and neighbouring constants joined."""
    kind = tree[0]
    if kind == "block":
        out: list[tuple] = []
        for node in map(fold, tree[1]):
            for part in node[1] if node[0] == "block" else [node]:
                if part[0] == "const" and out and out[-1][0] == "const":
                    out[-1] = ("const", str(out[-1][1]) + str(part[1]))
                elif part != ("const", ""):
                    out.append(part)
        return ("block", out)
    tree = tuple(fold(x) if isinstance(x, tuple) else x for x in tree)
    if kind == "if" and tree[1][0] == "const":
        return tree[2] if tree[1][1] else tree[3]
    if kind in ("or", "and") and tree[1][0] == "const":
        return tree[2] if bool(tree[1][1]) == (kind == "and") else tree[1]
    if kind in ("+", "==", "!=", "not", "filter") and all(x[0] == "const" for x in tree[1:] if isinstance(x, tuple)):
        return ("const", _value(tree)({}))
    return tree


def _value(tree: tuple) -> Callable[[dict], object]:
    kind = tree[0]
    if kind == "const":
        return lambda env, x=tree[1]: x
    if kind == "name":
        return lambda env, x=tree[1]: env.get(x)
    parts = [_value(x) for x in tree[1:] if isinstance(x, tuple)]
    if kind == "item":
        def item(env, of=parts[0], key=tree[2]):
            value = of(env)
            return value.get(key) if isinstance(value, dict) else None
        return item
    if kind == "filter":
        return lambda env, of=parts[0], f=FILTERS[tree[2]]: f(_shown(of(env)))
    if kind == "not":
        return lambda env, a=parts[0]: not a(env)
    a, b = parts
    if kind == "+":
        def add(env):
            x, y = a(env), b(env)
            return x + y if isinstance(x, int) and isinstance(y, int) else _shown(x) + _shown(y)
        return add
    return {"==": lambda env: a(env) == b(env), "!=": lambda env: a(env) != b(env), "and": lambda env: a(env) and b(env), "or": lambda env: a(env) or b(env)}[kind]


def _shown(value: object) -> str:
    return "" if value is None else str(value)


Render = Callable[[dict], Iterator[tuple[str, bool]]]


def _closure(tree: tuple, loss: bool) -> Render:
    kind = tree[0]
    if kind == "block":
        parts = [_closure(x, loss) for x in tree[1]]

        def block(env):
            for part in parts:
                yield from part(env)
        return block
    if kind == "generation":
        return _closure(tree[1], True)
    if kind == "if":
        test, yes, no = _value(tree[1]), _closure(tree[2], loss), _closure(tree[3], loss)
        return lambda env: (yes if test(env) else no)(env)
    if kind == "for":
        name, items, body = tree[1], _value(tree[2]), _closure(tree[3], loss)

        def loop(env):
            inner = dict(env)
            for inner[name] in items(env) or ():
                yield from body(inner)
        return loop
    value = _value(tree)

    def show(env):
        yield _shown(value(env)), loss
    return show


def compiled(template: str = TEMPLATE) -> Render:
    """A closure that renders a template: mapping of names -> pieces of output, each with whether it is under the loss mask."""
    return _closure(fold(parse(template)), False)


_SCAN = re.compile(r"\\.|</turn>\n", re.DOTALL)
_HEAD = re.compile(r"### ((?:[^\\:]|\\.)*):\n", re.DOTALL)


def turns_of(pieces: Iterable[tuple[str, bool]]) -> Iterator[tuple[str, str, str]]:
    """(role, text, text under the loss mask) of each turn, read from formatted output as it comes; holds a turn at a time."""
    held, masked = [], []
    for piece, loss in pieces:
        held.append(piece)
        if loss:
            masked.append(piece)
        if not piece.endswith(STOP):
            continue
        whole = "".join(held)
        head = _HEAD.match(whole)
        end = next((m.end() for m in _SCAN.finditer(whole, head.end()) if m[0] == STOP), 0) if head else 0
        if not head:
            raise ValueError("a turn without its heading")
        if end == len(whole):
            yield unescape(head[1]), unescape(whole[head.end() : end - len(STOP)]), unescape("".join(masked))
            held, masked = [], []
    if held:
        raise ValueError("a turn isn't closed")


def formatted(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row for each piece of output, in order: conv_id, piece (0, 1, ...), text, loss; a piece is what a turn adds."""
    return _streamed(conversations, template, _pieces, "conv_id long, piece long, text string, loss boolean")


def digests(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: read back from the formatted output."""
    return _streamed(conversations, template, _digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _pieces(conv, out: Iterator[tuple[str, bool]]) -> Iterator[tuple]:
    for i, (text, loss) in enumerate(out):
        yield conv, i, text, loss


def _digest(conv, out: Iterator[tuple[str, bool]]) -> Iterator[tuple]:
    turns, masked, n, chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def counted():
        nonlocal size
        for text, loss in out:
            size += len(text)
            yield text, loss

    for role, text, loss in turns_of(counted()):
        n += 1
        chars += len(loss)
        turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        masked.update(loss.encode("utf-8", "surrogatepass"))
    yield conv, n, turns.hexdigest(), chars, masked.hexdigest(), size


def _streamed(conversations: DataFrame, template: str, made: Callable, schema: str) -> DataFrame:
    """Conversations meet whole and in order in one task's stream of rows, not in its memory."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    names, types = zip(*[(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compiled(template)
        stream = ((c, {"role": r, "text": t}) for b in batches for c, r, t in zip(*(b.column(i).to_pylist() for i in range(3))))
        row = next(stream, None)
        done: list[tuple] = []

        class Messages:
            """The turns of a conversation, once: they stream by and aren't held."""

            def __init__(self, conv):
                self.conv, self.begun = conv, False

            def __iter__(self):
                if self.begun:
                    raise TemplateError("a template can loop over messages once only")
                self.begun = True
                return self.turns()

            def turns(self):
                nonlocal row
                while row is not None and row[0] == self.conv:
                    yield row[1]
                    row = next(stream, None)

        def flushed():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], list(names))

        while row is not None:
            conv = row[0]
            messages = Messages(conv)
            for x in made(conv, render({"messages": messages})):
                done.append(x)
                if len(done) == 1000:
                    yield flushed()
                    done.clear()
            for _ in messages.turns():  # what the template has left
                pass
        if done:
            yield flushed()

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(run, schema)


#: digests() of the conversations and the extra one, conversation -7, in DuckDB.
SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n AS (SELECT *, len(text) + len(role) + len('### :') + 1 + len('</turn>') + 1
    + len(regexp_extract_all(text, '\\|</turn>')) + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: len(x))), 0)
    + len(regexp_extract_all(role, '[\\:\n]|</turn>')) + coalesce(list_sum(list_transform(regexp_extract_all(role, '#{3,}'), lambda x: len(x))), 0) AS size FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""
