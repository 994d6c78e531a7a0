"""Near-duplicates by SuperMinHash signatures, banded, verified on whole sets and grouped by union-find.

SuperMinHash gives every shingle a random permutation of the ``HASHES`` slots; the shingle offers slot p its rank there plus a random
fraction, and a slot keeps its minimum. Ranks of one shingle are correlated, so slots are spread more evenly than by independent hashes and the estimate
has a lower variance. Permutations are drawn rank by rank, and a text stops as soon as all its slots hold less than the next rank: long
texts after one rank. A batch's texts are drawn together.

Texts with equal sets are one node. Nodes meet under a key if all four minima of one of ``BANDS`` bands agree; at similarity 0.8 a pair is
missed by (1 - 0.8^4)^32, 5 in 10^8. First, every node of a key is compared with the key's smallest, which joins groups of copies
with as many pairs as nodes. Keys whose nodes are still in different components are then looked at whole, by signature: nodes that agree in
``HOPE`` of the minima (4.5 standard deviations below 0.8) with one of another component go, with their sets, to one task, which links them exactly
by set intersections. So no pairs are emitted but those with a key's smallest and the links of a spanning forest. Keys with more than ``LIMIT`` nodes or ``SIZE`` shingles get finer
keys instead, of two bands, then of three and so on, which part what isn't alike: a pair is lost only if it agrees in no more bands than that.

Defined cases: null, empty or blank text: no shingles, a component of its own; one word: a set of that word; null doc_id: it
takes part, but is never a component_id while a row with an id is reachable (then null, and kept); repeated rows: kept, each with the same
result; extra columns: ignored; empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grouping
from .common import maybe_broadcast, stored

SEED = 42
#: A link: PERCENT * union <= 100 * intersection.
PERCENT = 80
BAND, BANDS = 4, 32
HASHES = BAND * BANDS
HOPE = 0.64
LIMIT, SIZE = 8192, 4 << 20
#: Shingles of one draw, and rows of copies from which a node's rows are joined by broadcast.
DRAWN, LARGE = 1 << 15, 1000
_CACHED = 1 << 19
_FRACTION = 24
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an array."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX[1]
        x = (x ^ (x >> np.uint64(27))) * _MIX[2]
        return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Word to hash; emptied before it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, SEED)
        return value


def shingles(text: bytes | None, known: dict | None = None) -> np.ndarray:
    """Sorted hashes of the different two-word shingles of a UTF-8 text; of its one word if it has no other."""
    words = (text or b"").lower().split()
    known = _Words() if known is None else known
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(h) < 2:
        return mixed(h ^ _MIX[0])
    with np.errstate(over="ignore"):
        return np.unique(mixed(mixed(h[:-1] + _MIX[0]) + h[1:]))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The SuperMinHash signature of each set, one row each: rank and fraction in a 32-bit number. Empty sets have no minima."""
    out = np.full((len(sets), HASHES), 0xFFFFFFFF, np.uint32)
    at = 0
    while at < len(sets):
        end, n = at, 0
        while end < len(sets) and (n == 0 or n + len(sets[end]) <= DRAWN):
            n += len(sets[end])
            end += 1
        _draw(sets[at:end], out[at:end])
        at = end
    return out


def _draw(sets: list[np.ndarray], out: np.ndarray) -> None:
    """Fills the rows of ``out`` with the signatures of the sets."""
    item = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat, order = out.reshape(-1), None
    for rank in range(HASHES):
        if not len(item):
            break
        with np.errstate(over="ignore"):
            x = mixed(item + np.uint64(rank + 1) * _MIX[0])
        pick = rank + ((x & np.uint64(0xFFFFFFFF)) * np.uint64(HASHES - rank) >> np.uint64(32)).astype(np.int64)
        if order is None:
            slot = pick
        else:
            each = np.arange(len(item))
            slot = order[each, pick].astype(np.int64)
            order[each, pick] = order[:, rank]
        value = (np.uint64(rank) << np.uint64(_FRACTION) | x >> np.uint64(64 - _FRACTION)).astype(np.uint32)
        np.minimum.at(flat, row * HASHES + slot, value)
        # A row whose slots all hold ranks up to this one is done.
        open_rows = out.max(axis=1) >> np.uint32(_FRACTION) > rank
        go_on = open_rows[row]
        if order is None:
            item, row, pick = item[go_on], row[go_on], pick[go_on]
            order = np.tile(np.arange(HASHES, dtype=np.uint8), (len(item), 1))
            order[np.arange(len(item)), pick] = 0
        elif not go_on.all():
            item, row, order = item[go_on], row[go_on], order[go_on]


def _plain(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n, digest, sig): the number of shingles, a digest of their set and its signature (null without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for b in batches:
            sets = [shingles(t.as_py(), known) for t in b.column(2)]
            sigs = signatures(sets)
            cols = [b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64())]
            cols.append(pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()))
            cols.append(pa.array([g.tobytes() if len(s) else None for s, g in zip(sets, sigs)], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_hash", "n", "digest", "sig"])

    return _plain(docs).mapInArrow(run, "doc_id long, text_hash long, n long, digest binary, sig binary")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, set): the sorted hashes of the nodes ``wanted`` (node, doc_id, text_hash), as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py(), known).tobytes() for t in b.column(1)], pa.binary())], ["node", "set"])

    of = maybe_broadcast(wanted.select("node", F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")))
    rows = _plain(docs).join(of, (F.col("text_hash") == F.col("__hash")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    return rows.select("node", "text").mapInArrow(run, "node long, set binary")


def keyed(nodes: DataFrame) -> DataFrame:
    """(key, node, last, n) for each band; last is its number."""
    salts = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, BAND).astype(np.uint64)
            key = np.broadcast_to(salts, sig.shape[:2])
            for i in range(BAND):
                key = mixed(key ^ sig[:, :, i])
            node, n = np.repeat(b.column(0).to_numpy(), BANDS), np.repeat(b.column(2).to_numpy(), BANDS)
            last = np.tile(np.arange(BANDS, dtype=np.int32), len(sig))
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(node), pa.array(last), pa.array(n)], ["key", "node", "last", "n"])

    return nodes.select("node", "sig", "n").mapInArrow(run, "key long, node long, last int, n long")


def finer(rows: DataFrame, bands: DataFrame) -> DataFrame:
    """(key, node, last, n): every key together with each of the node's later bands. bands: as keyed() gives them."""
    later = bands.select("node", F.col("key").alias("__key"), F.col("last").alias("__last"))
    both = rows.select("key", "node", "last", "n").join(later, "node").where("__last > last")
    return both.select(F.xxhash64("key", "__key").alias("key"), "node", F.col("__last").alias("last"), "n")


def _linked(n: np.ndarray, m: np.ndarray | int, both: np.ndarray | int) -> np.ndarray | bool:
    return 100 * both >= PERCENT * (n + m - both)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links, by their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for i, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if _linked(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))):
                    good.append(i)
            yield b.select([0, 1]).take(pa.array(good, pa.int64()))

    of = lambda i, s: sets.select(F.col("node").alias(i), F.col("set").alias(s))
    return pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def by_key(rows: DataFrame, key: str, columns: list[str], work, schema: str) -> DataFrame:
    """work(list of rows) for each key's rows, a key at a time; rows that it returns have the schema's columns, all longs."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, []

        def table(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(len(names))], names)

        for b in batches:
            for k, *row in zip(*[c.to_pylist() for c in b.columns]):
                if k != own:
                    if len(held) > 1 and (found := work(held)):
                        yield table(found)
                    own, held = k, []
                held.append(row)
        if len(held) > 1 and (found := work(held)):
            yield table(found)

    return rows.repartition(key).sortWithinPartitions(key).select(key, *columns).mapInArrow(run, schema)


def alike(rows: list) -> list[tuple[int, int]]:
    """(group, node) from one key's rows (node, label, sig): the nodes that agree in ``HOPE`` of the minima with one of another label.

    Nodes of the most frequent label are compared with the others only, so a group of copies costs as many rows as it has outliers.
    """
    node, label = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    sig = np.frombuffer(b"".join(r[2] for r in rows), np.uint32).reshape(-1, HASHES)
    names, own, many = np.unique(label, return_inverse=True, return_counts=True)
    marked = np.zeros(len(node), bool)
    for i in np.flatnonzero(own != np.argmax(many)):
        others = np.flatnonzero(own != own[i])
        near = others[(sig[others] == sig[i]).sum(axis=1) >= HOPE * HASHES]
        marked[near] = True
        marked[i] |= len(near) > 0
    members = np.sort(node[marked])
    name = xxhash.xxh64_intdigest(members.tobytes()) - (1 << 63)
    return [(name, int(x)) for x in members]


def links_within(rows: list) -> list[tuple[int, int]]:
    """(a, b): links that connect what is linked among one group's rows (node, label, set), exactly.

    Sets become bits over the shingles that two nodes share at least, as no other is in an intersection.
    """
    node, label = [r[0] for r in rows], np.array([r[1] for r in rows])
    sets = [np.frombuffer(r[2], np.uint64) for r in rows]
    size = np.array([len(s) for s in sets])
    names, at, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    slot = np.cumsum(many > 1) - 1
    bits = np.zeros((len(sets), (int((many > 1).sum()) + 63) // 64 or 1), np.uint64)
    for i, part in enumerate(np.split(at, np.cumsum(size)[:-1])):
        own = np.zeros(bits.shape[1] * 64, np.uint8)
        own[slot[part[many[part] > 1]]] = 1
        bits[i] = np.packbits(own, bitorder="little").view(np.uint64)
    rest, found = np.arange(len(sets)), []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            seed = queue.pop()
            both = np.bitwise_count(bits[rest] & bits[seed]).sum(axis=1).astype(np.int64)
            # What is in one component already goes along without a link of its own.
            known = label[rest] == label[seed]
            near = known | _linked(size[rest], size[seed], both)
            found += [(node[seed], node[x]) for x, k in zip(rest[near], known[near]) if not k]
            queue += list(rest[near])
            rest = rest[~near]
    return found


def links(docs: DataFrame, nodes: DataFrame, limit: int = LIMIT, size: int = SIZE) -> DataFrame:
    """(a, b): links that connect all nodes that are linked, directly or by way of others. nodes: (node, doc_id, text_hash, n, sig)."""
    bands = stored(keyed(nodes), "super-keys")
    rows, sets, found = bands, None, None
    while True:
        heads = rows.groupBy("key").agg(F.count("*").alias("__n"), F.min("node").alias("a"), F.min_by("n", "node").alias("a_n")).where("__n > 1")
        met = stored(rows.join(heads.drop("__n"), "key"), "super-met")
        if sets is None:
            wanted = stored(nodes.join(met.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "text_hash"), "super-wanted")
            sets = stored(sets_of(docs, wanted).dropDuplicates(["node"]), "super-sets")
        # Sets whose sizes alone rule a link out aren't compared.
        pairs = met.where((F.col("a") != F.col("node")) & (100 * F.least("n", "a_n") >= PERCENT * F.greatest("n", "a_n")))
        new = stored(verified(pairs.select("a", F.col("node").alias("b")).distinct(), sets), "super-links")
        found = new if found is None else found.unionByName(new)
        label = labels(nodes, found)
        # Keys whose nodes aren't all in one component yet.
        open_rows = met.drop("a", "a_n").join(label, "node")
        sums = open_rows.groupBy("key").agg(F.min("label").alias("__a"), F.max("label").alias("__z"), F.count("*").alias("__n"), F.sum("n").alias("__size")).where("__a <> __z")
        still = stored(open_rows.join(sums.drop("__a", "__z"), "key"), "super-open")
        large = (F.col("__n") > limit) | (F.col("__size") > size)
        groups = by_key(still.where(~large).select("key", "node", "label").join(nodes.select("node", "sig"), "node"), "key", ["node", "label", "sig"], alike, "group long, node long")
        groups = stored(groups.distinct(), "super-groups")
        whole = groups.join(label, "node").join(sets, "node")
        new = stored(by_key(whole, "group", ["node", "label", "set"], links_within, "a long, b long"), "super-links")
        found = found.unionByName(new)
        rest = still.where(large).where(F.col("last") < BANDS - 1)
        if rest.isEmpty():
            return found
        rows = stored(finer(rest, bands), "super-finer")


def labels(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable."""
    linked = grouping.components(nodes.select("node", F.col("node").alias("root")), found)
    return stored(nodes.select("node").join(linked, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "super-label")


def near_duplicates(docs: DataFrame, limit: int = LIMIT, size: int = SIZE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs (doc_id, text)."""
    rows = stored(signed(docs), "super-rows")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("text_hash").alias("text_hash")))
    sized = rows.where("n > 0").groupBy("digest").agg(rep.alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.count("*").alias("copies"))
    nodes = stored(sized.select(F.monotonically_increasing_id().alias("node"), "digest", "rep.doc_id", "rep.text_hash", "n", "sig", "copies"), "super-nodes")
    label = labels(nodes, links(docs, nodes, limit, size))
    of = stored(nodes.select("node", "digest", "doc_id", "copies").join(label, "node"), "super-of")
    least = stored(of.groupBy("label").agg(F.min("doc_id").alias("component_id")), "super-least")
    of = stored(of.join(maybe_broadcast(least), "label").select("digest", "component_id", "copies"), "super-components")
    # Nodes of many copies are few, so the copies' rows needn't meet.
    many = F.col("copies") > max(LARGE, (of.agg(F.sum("copies")).first()[0] or 0) // LARGE)
    whole = rows.where("n > 0").select("doc_id", "n", "digest")
    hot = F.broadcast(of.where(many).drop("copies"))
    found = whole.join(hot, "digest").unionByName(whole.join(hot, "digest", "left_anti").join(of.where(~many).drop("copies"), "digest")).drop("digest")
    found = found.unionByName(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


#: By brute force: all pairs that share a shingle, and the smallest id reachable step by step.
SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
s AS MATERIALIZED (SELECT row, doc_id, list_distinct(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE coalesce(ws, []) END) AS g FROM d),
x AS MATERIALIZED (SELECT row, doc_id, len(g) AS n, unnest(g) AS h FROM s),
p AS MATERIALIZED (SELECT a.row AS a, b.row AS b FROM x a JOIN x b USING (h) WHERE a.row <> b.row AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.row, b.row HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
r(row, reach) AS (SELECT row, row FROM s UNION SELECT r.row, p.b FROM r JOIN p ON p.a = r.reach)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id, s.doc_id IS NOT DISTINCT FROM min(o.doc_id) AS kept
FROM s JOIN r USING (row) JOIN s o ON o.row = r.reach GROUP BY s.row, s.doc_id, s.g
"""
