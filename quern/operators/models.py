"""Steps that ask a language model: classification, tags, rewriting, triples, reranking.

A model is any callable from a prompt to its reply. Rows are asked about by content: equal contents are one item, items go to the model in
batches of one size within each task, and what it said is kept in a ``Memo``, so a later run asks only about contents that are new. A reply that can't be
read, or a model that fails, gives the step's default and isn't kept. ``stored`` makes the answers outlive executors: a lost task asks
again about its own items only.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import share_code, stored
from ..sources.tables import AppendTable

Generate = Callable[[str], str | None]

# How many items a call takes, how much of each it sees, and how many tags stay.
BATCH = 12
CALLS = 100  # calls whose answers go on to Spark together
QUESTION, ANSWER, DOCUMENT, TRIPLES = 1200, 2400, 6000, 8000
PAIR_TAGS, QUERY_TAGS = 10, 8

PAIRS_PROMPT = 'Which of these questions and answers are useful in a technical knowledge base?\nReturn a JSON array with one object for each: {"id", "keep", "tags", "reason"}.\n'
DOCUMENT_PROMPT = 'Give short lower-case tags for this document.\nReturn a JSON object: {"tags", "reason"}.\nName: '
QUERY_PROMPT = 'Give short lower-case tags to search for this question.\nReturn a JSON object: {"tags", "reason"}.\nQuestion:\n'
REWRITE_PROMPT = 'Rewrite this question as an English search query; keep names and commands.\nReturn a JSON object: {"query", "reason"}.\nQuestion:\n'
TRIPLES_PROMPT = 'Which relations does this text state?\nReturn a JSON array of objects: {"source", "relation", "target"}.\nText:\n'
RERANK_PROMPT = "Which passages answer the question best? Return a JSON array of their numbers, best first, at most "


# What a reply holds


def in_reply(reply: str | None, kind: type) -> list | dict | None:
    """The JSON array or object in a reply, from the first bracket to the last; None if there is none or it can't be read."""
    pattern = r"\[.*\]" if kind is list else r"\{.*\}"
    match = re.search(pattern, reply or "", re.S)
    try:
        value = json.loads(match.group(0)) if match else None
    except ValueError:
        return None
    return value if isinstance(value, kind) else None


def indices(reply: str | None, n: int) -> list[int]:
    """Places below n in the first bracketed list of a reply; negative ones count from the end."""
    match = re.search(r"\[.*?\]", reply or "")
    try:
        said = ast.literal_eval(match.group(0)) if match else []
    except (ValueError, SyntaxError):
        return []
    return [i % n for i in said if isinstance(i, int) and not isinstance(i, bool) and -n <= i < n] if isinstance(said, list) else []


def tags(value, most: int) -> list[str]:
    return [str(t).lower().replace("#", "").strip() for t in value if str(t).strip()][:most] if isinstance(value, list) else []


def _text(value) -> str:
    return "" if value is None else str(value)


# Asking


class Memo:
    """What a model has said, by step and content, in a folder that only grows. A new model or prompt takes a new folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, step: str) -> AppendTable:
        return AppendTable(self.spark, f"{self.path}/{step}")


def called(rows: DataFrame, key: list[str], ask: Callable[[list[dict]], list[dict | None]], schema: str, default: dict, step: str, size: int = 1, memo: Memo | None = None) -> DataFrame:
    """rows with the columns of ``schema``: what ``ask`` says of each different content of the columns ``key``.

    ask gets up to ``size`` items at a time and gives one answer each, None where it has none; those, and all of a batch in which it
    fails, get ``default``.
    """
    share_code(rows.sparkSession)
    fields = StructType.fromDDL(schema)
    names = fields.names
    types = [f.type for f in pa.schema(_arrow(fields))]
    asked = rows.withColumn("__content", F.sha2(F.to_json(F.struct(*key), {"ignoreNullFields": "false"}), 256))
    items = asked.select("__content", *key).dropDuplicates(["__content"])
    known = memo.table(step).read() if memo else None
    if known is not None:
        items = items.join(known.select("__content"), "__content", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        given: list[tuple[list, list, list]] = []  # contents, answers in full, whether they were read

        def answer() -> None:
            try:
                said = ask([{k: r[k] for k in key} for r in held])
            except Exception:  # whatever a model's client raises: these items get the default, the job goes on
                said = [None] * len(held)
            given.append(([r["__content"] for r in held], [x if x is not None else default for x in said], [x is not None for x in said]))
            held.clear()

        def batch_of() -> pa.RecordBatch:
            contents, full, read = ([x for part in given for x in part[i]] for i in range(3))
            given.clear()
            return pa.RecordBatch.from_arrays([pa.array(contents, pa.string()), *[pa.array([x[n] for x in full], t) for n, t in zip(names, types)], pa.array(read, pa.bool_())], ["__content", *names, "__read"])

        for batch in batches:
            # As Python objects, only the items of one call are held.
            for row in (row for at in range(0, batch.num_rows, size) for row in batch.slice(at, size).to_pylist()):
                held.append(row)
                if len(held) == size:
                    answer()
                # A batch for each answer would cost more than the answers.
                if len(given) == CALLS:
                    yield batch_of()
        if held:
            answer()
        if given:
            yield batch_of()

    new = stored(items.repartition("__content").sortWithinPartitions("__content").mapInArrow(run, f"__content string, {schema}, __read boolean"), f"said-{step}")
    if memo:
        memo.table(step).add(new.where("__read").drop("__read"))
    said = new.drop("__read") if known is None else known.select("__content", *names).unionByName(new.drop("__read"))
    return asked.join(said, "__content").drop("__content")


def _arrow(fields: StructType) -> list[tuple[str, pa.DataType]]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [(f.name, to_arrow_type(f.dataType)) for f in fields]


# Steps


def pairs_decided(qa: DataFrame, generate: Generate, memo: Memo | None = None, size: int = BATCH) -> DataFrame:
    """qa (question, answer; hint_tags if it has them) with keep, told (tags) and why, ``size`` pairs a call.

    Pairs of a reply that can't be read, or that it leaves out, aren't kept.
    """

    def ask(items: list[dict]) -> list[dict | None]:
        shown = [{"id": i, "question": _text(x["question"])[:QUESTION], "answer": _text(x["answer"])[:ANSWER], "hint_tags": x["hint_tags"] or []} for i, x in enumerate(items)]
        reply = in_reply(generate(PAIRS_PROMPT + json.dumps(shown, ensure_ascii=False)), list)
        if reply is None:
            return [None] * len(items)
        said = {}
        for x in reply:
            if isinstance(x, dict) and str(x.get("id")).lstrip("-").isdigit():
                said[int(x["id"])] = {"keep": bool(x.get("keep", False)), "told": tags(x.get("tags", []), PAIR_TAGS), "why": _text(x.get("reason", ""))}
        return [said.get(i, {"keep": False, "told": [], "why": "missing_llm_batch_decision"}) for i in range(len(items))]

    rows = qa if "hint_tags" in qa.columns else qa.withColumn("hint_tags", F.array().cast("array<string>"))
    default = {"keep": False, "told": [], "why": "failed_to_parse_llm_batch_response"}
    got = called(rows, ["question", "answer", "hint_tags"], ask, "keep boolean, told array<string>, why string", default, "pairs", size, memo)
    return got if "hint_tags" in qa.columns else got.drop("hint_tags")


def _tagged(rows: DataFrame, key: list[str], prompt: Callable[[dict], str], generate: Generate, most: int, step: str, memo: Memo | None) -> DataFrame:
    def ask(items: list[dict]) -> list[dict | None]:
        reply = in_reply(generate(prompt(items[0])), dict)
        return [{"told": tags(reply.get("tags", []), most), "why": _text(reply.get("reason", ""))} if reply else None]

    return called(rows, key, ask, "told array<string>, why string", {"told": [], "why": "failed_to_parse_llm_response"}, step, memo=memo)


def documents_tagged(docs: DataFrame, generate: Generate, memo: Memo | None = None) -> DataFrame:
    """docs (source, text) with told (tags) and why, from the first characters of a text and its name."""
    rows = docs.withColumn("__sample", F.left("text", F.lit(DOCUMENT)))
    got = _tagged(rows, ["source", "__sample"], lambda x: f"{DOCUMENT_PROMPT}{_text(x['source'])}\n{_text(x['__sample'])}", generate, PAIR_TAGS, "documents", memo)
    return got.drop("__sample")


def queries_tagged(queries: DataFrame, generate: Generate, memo: Memo | None = None) -> DataFrame:
    """queries (query) with told (tags to search with) and why."""
    return _tagged(queries, ["query"], lambda x: QUERY_PROMPT + _text(x["query"]), generate, QUERY_TAGS, "queries", memo)


def rewritten(queries: DataFrame, generate: Generate, memo: Memo | None = None) -> DataFrame:
    """queries (query) with wording: the query as the model puts it, or as it is."""

    def ask(items: list[dict]) -> list[dict | None]:
        reply = in_reply(generate(REWRITE_PROMPT + _text(items[0]["query"])), dict)
        return [{"wording": _text(reply.get("query", "")).strip(), "why": _text(reply.get("reason", ""))} if reply else None]

    got = called(queries, ["query"], ask, "wording string, why string", {"wording": "", "why": "failed_to_parse_llm_response"}, "rewrite", memo=memo)
    return got.withColumn("wording", F.when(F.col("wording") == "", F.col("query")).otherwise(F.col("wording")))


def sampled(docs: DataFrame) -> DataFrame:
    """docs (text) with only as much of a text as a model is shown of it for triples."""
    return docs.withColumn("text", F.left("text", F.lit(TRIPLES)))


def with_triples(docs: DataFrame, generate: Generate, memo: Memo | None = None) -> DataFrame:
    """docs (text) with triples: what the model reads from the first characters of a text; an element that is no object has null parts."""

    def ask(items: list[dict]) -> list[dict | None]:
        reply = in_reply(generate(TRIPLES_PROMPT + _text(items[0]["__sample"])), list)
        part = lambda x, k: _text(x.get(k)) if isinstance(x, dict) else None
        return [None if reply is None else {"triples": [{k: part(x, k) for k in ("source", "relation", "target")} for x in reply]}]

    rows = docs.withColumn("__sample", F.left("text", F.lit(TRIPLES)))
    schema = "triples array<struct<source:string,relation:string,target:string>>"
    return called(rows, ["__sample"], ask, schema, {"triples": []}, "triples", memo=memo).drop("__sample")


def model_reranked(hits: DataFrame, queries: DataFrame, generate: Generate, n: int = 6, most: int = 50, memo: Memo | None = None) -> DataFrame:
    """hits (query_id, ordinal, content, ...) with rank: the passages that the model names, in its order; the first n as they came where it
    names none. At most ``most`` hits of a query are shown."""
    some = hits.withColumn("__place", F.row_number().over(Window.partitionBy("query_id").orderBy("ordinal")) - 1).where(F.col("__place") < most)
    some = stored(some, "shown")
    shown = some.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("__place", "content"))), lambda x: F.coalesce(x.content, F.lit(""))).alias("passages"))

    def ask(items: list[dict]) -> list[dict | None]:
        passages = items[0]["passages"]
        prompt = f"{RERANK_PROMPT}{n}.\nQuestion:\n{_text(items[0]['query'])}\nPassages:\n" + "\n\n".join(f"[{i}] {p}" for i, p in enumerate(passages))
        named = indices(generate(prompt), len(passages))
        return [{"named": named[:n]} if named else None]

    rows = called(queries.select("query_id", "query").join(shown, "query_id"), ["query", "passages"], ask, "named array<int>", {"named": []}, "rerank", memo=memo)
    first = F.sequence(F.lit(0), F.least(F.size("passages"), F.lit(n)) - 1)
    order = rows.select("query_id", F.posexplode(F.when(F.size("named") > 0, F.col("named")).otherwise(first)).alias("rank", "__place"))
    return some.join(order.withColumn("rank", F.col("rank") + 1), ["query_id", "__place"]).drop("__place")
