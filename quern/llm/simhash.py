"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two halves. Of two fingerprints that differ in at most 3 bits, one
half differs in at most one. Each half is indexed under its 32 one-wildcard variants (one bit
blanked), so such a pair meets under an equal key, and the exact distance is then checked.

Copies are no problem, as equal fingerprints are one row. A key under which more than ``LIMIT``
different fingerprints meet isn't compared all with all: its rows get finer keys from the bits not
yet used, by the same rule (16, 8, 4 bits). After three such steps at most 256 different fingerprints can
share a key, so every comparison is bounded and no link is lost.

Defined cases: null or empty text: fingerprint zero, which links like any other; null doc_id: it takes
part, but is never a component_id while a row with an id is reachable; repeated rows: kept, each
with the same result (one_of_each keeps one); extra columns: ignored; empty table: empty result.
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

BITS = 3
SEED = 42
LIMIT = 2048
#: A fingerprint or component of more rows than this, and than this part of all rows, is joined by broadcast: LARGE of them at most.
LARGE = 1000
CHUNK = 1 << 15


def fingerprint(text: str | None, words: int = 3) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text."""
    got = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not got:
        return 0
    size = np.fromiter(map(len, got), np.int64, len(got))
    end = np.cumsum(size + 1) - 1
    start = end - size
    n = max(1, len(got) - words + 1)
    first, last = start[:n].tolist(), end[min(words, len(got)) - 1 :].tolist()
    line, digest = b" ".join(got), xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = [digest(line[s:e], SEED) for s, e in zip(first[at : at + CHUNK], last[at : at + CHUNK])]
        bits = np.unpackbits(np.array(part, np.uint64).view(np.uint8), bitorder="little")
        total += bits.reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp): fp is the fingerprint as a signed long; text_hash tells texts under one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def text_hash():
    return F.xxhash64("text").alias("text_hash")


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp, low, width): 64 keys for each fp; the bits [low, low + width) aren't in the key yet."""
    half = F.expr("shiftright(tag, 5)")
    bits = F.expr("shiftright(fp, 32 * shiftright(tag, 5)) & 4294967295L")
    return (
        fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("tag"))
        .select(
            F.expr("shiftleft(cast(tag as long), 32)")
            .bitwiseOR(bits.bitwiseAND(F.expr("~shiftleft(1L, tag & 31)")))
            .alias("key"),
            "fp",
            (32 - 32 * half).alias("low"),
            F.lit(32).alias("width"),
        )
    )


def finer(rows: DataFrame) -> DataFrame:
    """Finer keys: the unused bits are halved again, and one of the halves goes, with a wildcard, into the key."""
    return (
        rows.select("*", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("tag"))
        .withColumn("w", F.expr("width div 2"))
        .withColumn("s", F.expr("cast(tag div w as int)"))
        .withColumn("at", F.expr("cast(low + w * s as int)"))
        .withColumn(
            "part",
            F.expr("shiftright(fp, at) & (shiftleft(1L, cast(w as int)) - 1) & ~shiftleft(1L, cast(tag % w as int))"),
        )
        .select(
            F.xxhash64("key", "tag", "part").alias("key"),
            "fp",
            F.expr("cast(low + w * (1 - s) as int)").alias("low"),
            F.col("w").cast("int").alias("width"),
        )
    )


def forest(fps: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    """Edges that join what is linked among different fingerprints: n - 1 at most, not all links."""
    rest, edges = fps, []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            seed = queue.pop()
            near = np.bitwise_count(rest ^ seed) <= bits
            found = rest[near]
            rest = rest[~near]
            edges += [(int(seed), int(x)) for x in found]
            queue += list(found)
    return edges


def edges_of(rows: DataFrame, limit: int, last: bool) -> DataFrame:
    """(a, b, key, low, width) from rows (key, fp, low, width): links, or rows put off to finer keys (b null)."""
    schema = "a long, b long, key long, low int, width int"
    names = ["a", "b", "key", "low", "width"]

    def table(a, b, key, low, width):
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(key, pa.int64()), pa.array(low, pa.int32()), pa.array(width, pa.int32())],
            names,
        )

    def put_off(key, fp, low, width):
        return table(fp.view(np.int64), pa.nulls(len(fp), pa.int64()), key, low, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        over = None  # the key whose rows are being put off

        def close(cols) -> Iterator[pa.RecordBatch]:
            """Whole groups only, sorted by key."""
            if over is not None:  # whatever is left of that key, be it one row
                late = cols[0] == over
                if late.any():
                    yield put_off(*[x[late] for x in cols])
                    cols = [x[~late] for x in cols]
            key, fp, low, width = cols
            if not len(key):
                return
            cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            size = np.diff(cut)
            found: list[tuple[int, int]] = []
            two = cut[:-1][size == 2]
            near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= BITS
            a, b = fp[two][near], fp[two + 1][near]
            for s, n in zip(cut[:-1][size > 2].tolist(), size[size > 2].tolist()):
                part = slice(s, s + n)
                if n > limit and not last:
                    yield put_off(key[part], fp[part], low[part], width[part])
                else:
                    found += forest(np.unique(fp[part]))
            if found:
                e = np.array(found, np.uint64)
                a, b = np.r_[a, e[:, 0]], np.r_[b, e[:, 1]]
            if len(a):
                none = pa.nulls(len(a), pa.int64())
                yield table(a.view(np.int64), b.view(np.int64), none, pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.int32()))

        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            cols[1] = cols[1].view(np.uint64)
            if not len(cols[0]):
                continue
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            open_at = int(np.searchsorted(cols[0], cols[0][-1]))
            yield from close([x[:open_at] for x in cols])
            held = [x[open_at:] for x in cols]
            if len(held[0]) > limit and not last:
                over = held[0][0]
                yield put_off(*held)
                held = [x[:0] for x in held]
        if held is not None:
            yield from close(held)

    return (
        rows.repartition("key")
        .sortWithinPartitions("key", "fp")
        .select("key", "fp", "low", "width")
        .mapInArrow(run, schema)
    )


def links(fps: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(a, b): edges that connect all fingerprints within 3 bits of each other, directly or by way of others."""
    rows, parts = variants(fps), []
    for step in range(4):
        got = stored(edges_of(rows, limit, step == 3), "simhash-links")
        parts.append(got.where("b is not null").select("a", "b"))
        late = got.where("b is null")
        if late.isEmpty():
            break
        rows = finer(late.select(F.col("a").alias("fp"), "key", "low", "width"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def labelled(nodes: DataFrame, limit: int) -> DataFrame:
    """(fp, component_id): the smallest root reachable, of every node (fp, root); root may be null or repeated.

    Fingerprints are what is linked, so a component's label is its smallest fingerprint. Roots are aggregated by label before the
    shuffle, and labels of large components are few and joined by broadcast: no task gets all nodes of one.
    """
    linked = grouping.components(nodes.select(F.col("fp").alias("node"), F.col("fp").alias("root")), links(nodes.select("fp"), limit))
    linked = stored(nodes.join(linked.withColumnRenamed("node", "fp"), "fp"), "simhash-linked")
    least = stored(linked.groupBy("label").agg(F.min("root").alias("component_id"), F.count("*").alias("n")), "simhash-components")
    of = by_size(linked, least, "label").select("fp", "component_id")
    return nodes.join(of, "fp", "left").select("fp", F.coalesce("component_id", "root").alias("component_id"))


def by_size(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """rows joined with groups (key, n, ..) by key, where n says how many rows a group has: large groups by broadcast, others by a shuffle."""
    large = F.broadcast(groups.where(F.col("n") > max(LARGE, (groups.agg(F.sum("n")).first()[0] or 0) // LARGE)).drop("n"))
    return rows.join(large, key).unionByName(rows.join(large, key, "left_anti").join(groups.drop("n"), key))


def near_duplicates(docs: DataFrame, words: int = 3, limit: int = LIMIT) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of docs (doc_id, text).

    Fingerprints that a large group of copies shares are few, and are joined by broadcast, so no task gets all rows of one.
    """
    all_fps = stored(fingerprints(docs, words).drop("text_hash"), "simhash-fps")
    sized = stored(all_fps.groupBy("fp").agg(F.min("doc_id").alias("root"), F.count("*").alias("n")), "simhash-nodes")
    root = stored(labelled(sized.select("fp", "root"), limit).join(sized.select("fp", "n"), "fp"), "simhash-roots")
    rows = by_size(all_fps, root, "fp")
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int = 3, limit: int = LIMIT) -> DataFrame:
    """docs, all columns, with one row of each component: that of smallest doc_id (null last), then smallest hash of its text.

    Rows equal in id and text are one row. Different texts under one id are different documents. The choice is made among fingerprints:
    copies are aggregated before and after the shuffle, and no rows meet by component.
    """
    all_fps = stored(fingerprints(docs, words), "simhash-fps")
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "text_hash")
    first = stored(all_fps.groupBy("fp").agg(F.min(row).alias("first")), "simhash-nodes")
    # A node's root is a fingerprint here: ids may be missing or repeated.
    of = labelled(first.select("fp", F.col("fp").alias("root")), limit)
    chosen = first.join(of, "fp").groupBy("component_id").agg(F.min("first").alias("first"))
    chosen = stored(chosen.select(F.col("first.id").alias("__own_id"), F.col("first.text_hash").alias("__own_hash")), "simhash-chosen")
    rows = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__hash": text_hash()})
    same = F.col("__id").eqNullSafe(F.col("__own_id")) & (F.col("__hash") == F.col("__own_hash"))
    kept = rows.join(maybe_broadcast(chosen), same, "left_semi")
    # Rows equal in id and text: none in a table with a key, else one of them stays.
    twice = stored(all_fps.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("__own_id"), F.col("text_hash").alias("__own_hash")), "simhash-twice")
    if not twice.isEmpty():
        again = kept.join(maybe_broadcast(twice), same, "left_semi").dropDuplicates(["__id", "__hash"])
        kept = kept.join(maybe_broadcast(twice), same, "left_anti").unionByName(again)
    return kept.select(*docs.columns)
