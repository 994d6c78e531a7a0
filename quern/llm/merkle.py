"""Merkle manifest of a table: a postorder append log for each source, and proofs addressed in it by closed-form positions.

Every row is a leaf. A source's leaves, by doc_id, are the bottom of a tree in which every ``FAN`` consecutive nodes become one; what
remains of each source becomes, in order of the sources, the bottom of the tree of sources. The rank of a leaf in its source comes from
one range shuffle of digests (texts are hashed where they are read) and one count for each partition, so a source of any size is spread.

Builders are aligned: one takes ``FAN ** LEVELS`` nodes, hashes its subtree and appends the nodes in completion order (postorder) to its
segment of the log. Their tops are the bottom of the next round. A node's place in a segment follows from subtree sizes alone
(``position``), so the siblings on a leaf's path are read from the segment by number. Proofs are handed down from the root by groups: a
join has one row of a group for at most ``FAN ** LEVELS`` below it, however large a source is, and texts or proofs of single rows are never shuffled.

Defined cases: null values: ``-`` in the leaf; null source: a source of its own, first; null doc_id: first in its source, and never tampered;
equal ids: by leaf digest, and rows equal in all five columns are leaves next to each other; one row: its leaf is subroot and root, and its
proof is of nothing; extra columns: ignored; empty table: empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import maybe_broadcast, stored

FAN = 16
LEVELS = 2
BLOCK = FAN**LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED_ONE_IN = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def position(level: int, index: int, n: int, fan: int = FAN) -> int:
    """Where the node ``index`` of a level (0: leaves) stands in the postorder log of a tree of n leaves.

    Before it are all nodes of its own and lower levels up to its last leaf, and the higher nodes that ended before its first leaf.
    """
    ended = min((index + 1) * fan**level, n)
    own = sum(-(-ended // fan**j) for j in range(level + 1))
    higher, j = 0, fan
    while j <= index:
        higher += index // j
        j *= fan
    return own + higher - 1


def height(n: int, fan: int = FAN) -> int:
    """Levels above n leaves until one node remains."""
    h = 0
    while n > 1:
        n, h = -(-n // fan), h + 1
    return h


def _h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def segment(leaves: list[str], levels: int) -> list[str]:
    """The nodes over the leaves, up to ``levels`` above them, in completion order."""
    log: list[str] = []
    open_runs: list[list[str]] = [[] for _ in range(levels + 1)]

    def add(level: int, digest: str) -> None:
        log.append(digest)
        if level == levels:
            return
        run = open_runs[level]
        run.append(digest)
        if len(run) == FAN:
            done = _h(*run)
            run.clear()
            add(level + 1, done)

    for leaf in leaves:
        add(0, leaf)
    for level in range(levels):  # the last runs, which may be shorter
        if open_runs[level]:
            done = _h(*open_runs[level])
            open_runs[level].clear()
            add(level + 1, done)
    return log


def siblings(log: list[str], index: int, n: int, levels: int) -> tuple[list[str], list[str]]:
    """Level by level, what stands left and right of a leaf's path in its runs, read from the log by position."""
    left, right = [], []
    for level in range(levels):
        own = index // FAN**level
        first = own // FAN * FAN
        last = min(first + FAN, -(-n // FAN**level))
        left.append("".join(log[position(level, i, n)] for i in range(first, own)))
        right.append("".join(log[position(level, i, n)] for i in range(own + 1, last)))
    return left, right


def folded(digest: str, left: list[str], right: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    for x, y in zip(left, right):
        digest = _h(x, digest, y)
    return digest


# Leaves


def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column | None = None) -> Column:
    parts = [encoded(F.col(c) if c != "text" or text is None else text) for c in COLUMNS]
    return F.sha2(F.concat(*parts), 256)


def tampered_leaf() -> Column:
    """The leaf of the tampered row, null where a row isn't tampered."""
    chosen = F.crc32(F.col("doc_id").cast("string")) % TAMPERED_ONE_IN == 0
    return F.when(chosen, leaf(F.translate("text", _UPPER, _LOWER)))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, tampered): digests as hex text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"), F.col("text").cast("string").alias("text"))
    return docs.select("doc_id", "source", leaf().alias("leaf"), tampered_leaf().alias("tampered"))


def ranked(rows: DataFrame, by: list[str], *order: str) -> DataFrame:
    """rows (already stored) with idx, the rank in ``order`` among those equal in ``by``, and m, how many these are.

    Rows are range-partitioned and sorted; a partition's rows of one key follow those of earlier partitions, so one count for each key and
    partition is all that is brought together.
    """
    sorted_rows = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    at = F.monotonically_increasing_id()
    placed = stored(sorted_rows.withColumn("__at", at).withColumn("__part", F.shiftright("__at", 33)), "merkle-placed")
    runs = placed.groupBy("__part", *by).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    w = Window.partitionBy(*by)
    before = F.coalesce(F.sum("__n").over(w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = stored(runs.select("__part", *by, "__first", before.alias("__before"), F.sum("__n").over(w).alias("m")), "merkle-runs")
    runs = runs.select(F.col("__part").alias("__p"), *[F.col(c).alias(f"__by_{c}") for c in by], "__first", "__before", "m")
    same = F.col("__part") == F.col("__p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    return placed.join(maybe_broadcast(runs), same).select(*rows.columns, (F.col("__at") - F.col("__first") + F.col("__before")).alias("idx"), "m")


# Building


def segments(nodes: DataFrame, payload: bool) -> DataFrame:
    """One row for each builder: (tree, block, m, log, top), and with ``payload`` the ids and tampered leaves in order of the leaves.

    nodes: (tree, idx, m, digest) and, with payload, (doc_id, tampered).
    """
    extra = ["doc_id", "tampered"] if payload else []
    schema = "tree string, block long, m long, log array<string>, top string" + (", ids array<long>, tampered array<string>" if payload else "")
    types = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string()] + ([pa.list_(pa.int64()), pa.list_(pa.string())] if payload else [])
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []

        def close() -> None:
            if held:
                m = held[0][2]
                log = segment([r[3] for r in held], min(LEVELS, height(m)))
                out.append((*key, m, log, log[-1]) + (([r[4] for r in held], [r[5] for r in held]) if payload else ()))
                held.clear()

        def table() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
            out.clear()
            return batch

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[:2] != key:
                    close()
                    if len(out) >= 256:
                        yield table()
                    key = row[:2]
                held.append(row)
        close()
        if out:
            yield table()

    rows = nodes.withColumn("block", F.expr(f"idx div {BLOCK}")).repartition("tree", "block").sortWithinPartitions("tree", "block", "idx")
    return rows.select("tree", "block", "m", "digest", *extra).mapInArrow(run, schema)


def built(nodes: DataFrame, payload: bool = False) -> list[DataFrame]:
    """The rounds of segments, from the leaves up to one top for each tree."""
    rounds = [stored(segments(nodes, payload), "merkle-log")]
    while rounds[-1].where(F.col("m") > BLOCK).limit(1).count():
        tops = rounds[-1].where(F.col("m") > BLOCK)
        # A tree that is done has no row in later rounds; its last segment's top is what remains of it.
        tops = tops.select("tree", F.col("block").alias("idx"), F.expr(f"(m + {BLOCK - 1}) div {BLOCK}").alias("m"), F.col("top").alias("digest"))
        rounds.append(stored(segments(tops, False), "merkle-log"))
    return rounds


def tops(rounds: list[DataFrame]) -> DataFrame:
    """(tree, digest): what remains of each tree."""
    parts = [r.where(F.col("m") <= BLOCK).select("tree", F.col("top").alias("digest")) for r in rounds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_PATH = "left array<string>, right array<string>, subroot string, root string"


def handed_down(round_: DataFrame, above: DataFrame) -> DataFrame:
    """(tree, block, left, right, subroot, root) of each node below: its own siblings in its segment, then those of its group.

    above: (tree, block, left, right, subroot, root), one row for each segment of the round.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for tree, block, m, log, left, right, subroot, root in zip(*[c.to_pylist() for c in batch.columns]):
                n, levels = min(BLOCK, m - block * BLOCK), min(LEVELS, height(m))
                for i in range(n):
                    own_left, own_right = siblings(log, i, n, levels)
                    out.append((tree, block * BLOCK + i, own_left + left, own_right + right, subroot, root))
            if out:
                strings = pa.list_(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), strings, strings, pa.string(), pa.string()))], ["tree", "block", "left", "right", "subroot", "root"])

    return _with_above(round_.select("tree", "block", "m", "log"), above).mapInArrow(run, f"tree string, block long, {_PATH}")


def _with_above(rows: DataFrame, above: DataFrame) -> DataFrame:
    above = above.select(F.col("tree").alias("__tree"), F.col("block").alias("__block"), "left", "right", "subroot", "root")
    joined = rows.join(above, F.col("tree").eqNullSafe(F.col("__tree")) & (F.col("block") == F.col("__block")))
    return joined.select(*rows.columns, "left", "right", "subroot", "root")


def paths(rounds: list[DataFrame], last: DataFrame) -> DataFrame:
    """(tree, block, left, right, subroot, root) for each segment of the first round. last: the same for what remains of each tree (block 0)."""
    above = last
    for k in range(len(rounds) - 1, 0, -1):
        # Trees that ended below this round join their lower segment instead.
        ended = rounds[k - 1].where(F.col("m") <= BLOCK).select(F.col("tree").alias("__t"))
        ends = last.join(ended, F.col("tree").eqNullSafe(F.col("__t")), "left_semi")
        above = stored(handed_down(rounds[k], above).unionByName(ends), "merkle-paths")
    return above


def proofs(first: DataFrame, above: DataFrame) -> DataFrame:
    """A row for each leaf, from the segments of the first round and the paths above them."""
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    types = [pa.int64(), *[pa.string()] * 5, pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, block, m, log, ids, tampered, left, right, subroot, root in zip(*[c.to_pylist() for c in batch.columns]):
                n, levels, out = len(ids), min(LEVELS, height(m)), []
                rest = "".join(x + y for x, y in zip(left, right))
                ends: dict[str, str] = {}  # what a segment's top folds to; leaves that give the same top go on alike
                for i in range(n):
                    own_left, own_right = siblings(log, i, n, levels)
                    digest = log[position(0, i, n)]
                    top = folded(tampered[i] or digest, own_left, own_right)
                    if top not in ends:
                        ends[top] = folded(top, left, right)
                    proof = _h("".join(x + y for x, y in zip(own_left, own_right)), rest)
                    out.append((ids[i], digest, subroot, root, proof, ends[top], ends[top] == root))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    rows = _with_above(first.select("tree", "block", "m", "log", "ids", "tampered"), above)
    return rows.mapInArrow(run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def manifest(docs: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """The written logs: rounds of segments of the sources' trees, and of the tree of sources."""
    rows = ranked(stored(leaves(docs), "merkle-leaves"), ["source"], "doc_id", "leaf")
    rows = rows.select(F.col("source").alias("tree"), "idx", "m", F.col("leaf").alias("digest"), "doc_id", "tampered")
    own = built(rows, payload=True)
    subroots = stored(tops(own).withColumn("all", F.lit("sources")), "merkle-subroots")
    over = ranked(subroots, ["all"], "tree")
    over = stored(over.select(F.col("all").alias("tree"), "idx", "m", "digest", F.col("tree").alias("source")), "merkle-sources")
    return own, [*built(over.drop("source")), over]


def log(rounds: list[DataFrame]) -> DataFrame:
    """(tree, position, level, index, digest): all nodes by their place in the postorder log of their whole tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, block, m, nodes, n_leaves, base in zip(*[c.to_pylist() for c in batch.columns]):
                n, out = min(BLOCK, m - block * BLOCK), []
                for level in range(0 if base == 0 else 1, min(LEVELS, height(m)) + 1):
                    for i in range(-(-n // FAN**level)):
                        index = block * BLOCK // FAN**level + i
                        out.append((tree, position(base + level, index, n_leaves), base + level, index, nodes[position(level, i, n)]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string()))], ["tree", "position", "level", "index", "digest"])

    sizes = rounds[0].where("block = 0").select(F.col("tree").alias("__t"), F.col("m").alias("n_leaves"))
    out = None
    for k, r in enumerate(rounds):
        rows = r.join(maybe_broadcast(sizes), F.col("tree").eqNullSafe(F.col("__t"))).select("tree", "block", "m", "log", "n_leaves", F.lit(k * LEVELS).alias("base"))
        part = rows.mapInArrow(run, "tree string, position long, level int, index long, digest string")
        out = part if out is None else out.unionByName(part)
    return out


def audit(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of docs (doc_id, source, lang, n_chars, text)."""
    own, [*over, sources] = manifest(docs)
    root = tops(over).select(F.col("tree").alias("all"), F.col("digest").alias("root"))
    none = F.array().cast("array<string>")
    top = root.select(F.col("all").alias("tree"), F.lit(0).cast("long").alias("block"), none.alias("left"), none.alias("right"), F.lit(None).cast("string").alias("subroot"), "root")
    above = paths(over, top)
    each = handed_down(over[0], above).select(F.col("block").alias("idx"), "left", "right", "root")
    # One row for each source: its subroot, and the way from there to the root.
    last = sources.join(each, "idx").select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("block"), "left", "right", F.col("digest").alias("subroot"), "root")
    return proofs(own[0], paths(own, stored(last, "merkle-paths")))


def _levels_sql(name: str, levels: int) -> str:
    """CTEs for a tree's levels: nodes of n<level>, from <name>0 (tree, idx, m, d)."""
    out = []
    for k in range(levels):
        out.append(
            f"{name}{k + 1} AS MATERIALIZED (SELECT tree, idx // 16 AS idx, any_value((m + 15) // 16) AS m, sha256(string_agg(d, '' ORDER BY idx)) AS d FROM {name}{k} WHERE m > 1 GROUP BY tree, idx // 16 "
            f"UNION ALL SELECT tree, idx, m, d FROM {name}{k} WHERE m = 1)"
        )
        # Siblings of each node of level k (none where the tree is done).
        out.append(
            f"{name}s{k} AS MATERIALIZED (SELECT a.tree, a.idx, any_value(a.m) AS m, coalesce(string_agg(b.d, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx), '') AS l, coalesce(string_agg(b.d, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx), '') AS r "
            f"FROM {name}{k} a JOIN {name}{k} b ON a.tree IS NOT DISTINCT FROM b.tree AND a.idx // 16 = b.idx // 16 GROUP BY a.tree, a.idx)"
        )
    return ",\n".join(out)


def _climb_sql(name: str, levels: int, start: str, keep: str) -> str:
    """CTEs that carry rows (tree, idx, cur, proof) of ``start`` up a tree, folding cur and gathering the proof."""
    out, at = [], start
    for k in range(levels):
        to = f"{name}c{k + 1}"
        out.append(f"{to} AS (SELECT {keep}, c.tree, CASE WHEN s.m > 1 THEN c.idx // 16 ELSE c.idx END AS idx, CASE WHEN s.m > 1 THEN sha256(s.l || cur || s.r) ELSE cur END AS cur, proof || s.l || s.r AS proof FROM {at} c JOIN {name}s{k} s ON s.tree IS NOT DISTINCT FROM c.tree AND s.idx = c.idx)")
        at = to
    return ",\n".join(out)


_CRC_SQL = """xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: ord(substr(doc_id::VARCHAR, i, 1))::BIGINT),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"""
_ENC_SQL = "coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
_HEAD_SQL = " || ".join(_ENC_SQL.format(c=c) for c in COLUMNS[:-1])
_LOWER_SQL = f"translate(text, '{_UPPER}', '{_LOWER}')"
#: Six levels in a source and four above them: more than any table here needs.
SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, source, sha256({_HEAD_SQL} || {_ENC_SQL.format(c='text')}) AS leaf,
    CASE WHEN ({_CRC_SQL}) % 5 = 0 THEN sha256({_HEAD_SQL} || {_ENC_SQL.format(c=_LOWER_SQL)}) END AS tampered FROM documents),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS m FROM d),
a0 AS MATERIALIZED (SELECT source AS tree, idx, m, leaf AS d FROM r),
{_levels_sql('a', 6)},
b0 AS MATERIALIZED (SELECT 0 AS tree, row_number() OVER (ORDER BY encode(tree) NULLS FIRST) - 1 AS idx, count(*) OVER () AS m, d, tree AS source FROM a6),
{_levels_sql('b', 4)},
ac0 AS (SELECT doc_id, leaf, source AS tree, idx, coalesce(tampered, leaf) AS cur, '' AS proof FROM r),
{_climb_sql('a', 6, 'ac0', 'doc_id, leaf')},
bc0 AS (SELECT doc_id, leaf, b0.d AS subroot, 0 AS tree, b0.idx, cur, proof FROM ac6 JOIN b0 ON b0.source IS NOT DISTINCT FROM ac6.tree),
{_climb_sql('b', 4, 'bc0', 'doc_id, leaf, subroot')}
SELECT doc_id, leaf, subroot, b4.d AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = b4.d AS verified FROM bc4, b4
"""
