"""Near copies by word shingles: MinHash bands find pairs, their exact Jaccard similarity decides.

A text's signature has ``HASHES`` minima of its five-word shingles. Texts meet under a key if all minima of one of the bands agree: at
similarity 0.8 a pair is missed by (1 - 0.8^4)^20, 3 in 100,000. First, all under a key are compared with the text of smallest id
only, so there are fewer pairs than keys, and what is like it goes: a group of copies is gone after that. What is left of a key, up to
``LIMIT`` texts, then meets in one task by its signatures: a text that agrees in ``SURE`` of the minima with an earlier one is compared
with that one only, others with all that agree in ``HOPE`` of them (at similarity 0.8, 4.5 standard deviations off). As such a text may be
less like that one than it seems, this is repeated in other orders until nothing more goes. Under larger keys the first step is repeated with keys that have another eight minima added, which part what isn't alike.
Only the texts of pairs are shuffled, as hashes of their shingles, once.

So every document that goes is similar to one of smaller id. Two that stay can be similar only by those misses, or where both were set
aside in every order.

Defined cases: null, empty or blank text: no shingles, always kept; fewer words than a shingle: one shingle of all words; rows without an
id: kept; extra columns: kept; empty table: empty result; different texts under one id: their rows stay, as an id has to name one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, stored
from .simhash import CHUNK, SEED

WORDS = 5
SIMILAR = 0.8
BAND, BANDS = 4, 20
HASHES = BAND * BANDS
HOPE, SURE = 0.6, 0.78
LIMIT = 1024
#: Minima, and how many sets of them, that part a larger key.
FINER, SETS = 8, 10
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, (2, HASHES), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of the different word shingles of a text."""
    got = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not got:
        return np.zeros(0, np.uint64)
    n, digest = max(1, len(got) - words + 1), xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(got[i : i + words]), SEED) for i in range(n)), np.uint64, n))


def signature(hashes: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    step = CHUNK // HASHES
    for at in range(0, len(hashes), step):
        least = np.minimum(least, ((hashes[at : at + step, None] ^ _ODD[0]) * _ODD[1]).min(axis=0))
    # The upper bits of a minimum are mostly zero.
    return least.astype(np.uint32).view(np.int32)


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, sig) of each text with shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py(), words) for t in b.column(1)]
            keep = [i for i, s in enumerate(sets) if len(s)]
            sigs = pa.array([signature(sets[i]) for i in keep], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), sigs], ["doc_id", "sig"])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, sig array<int>")


def hashed(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, set): the hashes of a text's shingles, sorted, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py(), words).tobytes() for t in b.column(1)], pa.binary())], ["doc_id", "set"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, set binary")


def keyed(sigs: DataFrame) -> DataFrame:
    """(key, doc_id) for each band."""
    bands = [F.xxhash64(F.lit(j), *[F.get("sig", F.lit(j * BAND + i)) for i in range(BAND)]) for j in range(BANDS)]
    return sigs.select(F.explode(F.array(*bands)).alias("key"), "doc_id")


def finer(rows: DataFrame, step: int) -> DataFrame:
    """(key, doc_id) of rows (key, doc_id, sig): keys within the key, of ``FINER`` minima each."""
    order = np.random.default_rng(step).permutation(HASHES)
    keys = [F.xxhash64("key", F.lit(j), *[F.get("sig", F.lit(int(i))) for i in order[j * FINER : (j + 1) * FINER]]) for j in range(SETS)]
    return rows.select(F.explode(F.array(*keys)).alias("key"), "doc_id")


def hopeful(rows: DataFrame, turn: int) -> DataFrame:
    """Different pairs (a, b), a < b, of rows (key, doc_id, sig) that meet under a key and may be similar. Keys have ``LIMIT`` rows at most."""

    def run(key, table):
        ids = table.column("doc_id").to_numpy()
        sig = table.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, HASHES)
        order = np.argsort(ids)
        order = order if turn == 0 else order[np.random.default_rng(turn).permutation(len(ids))]
        ids, sig, out = ids[order], sig[order], []
        while len(ids) > 1:
            agree = (sig[1:] == sig[0]).sum(axis=1)
            near = agree >= HOPE * HASHES
            out += [(min(ids[0], x), max(ids[0], x)) for x in ids[1:][near]]
            rest = agree < SURE * HASHES
            ids, sig = ids[1:][rest], sig[1:][rest]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return rows.groupBy("key").applyInArrow(run, "a long, b long").distinct()


def similar(pairs: DataFrame, sets: DataFrame, least: float = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose shingles (doc_id, set) have a Jaccard similarity of at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= least * (len(x) + len(y) - both) - 1e-9:
                    good.append(i)
            yield batch.select([0, 1]).take(pa.array(good, pa.int64()))

    of = lambda i, s: sets.select(F.col("doc_id").alias(i), F.col("set").alias(s))
    return pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


class _Found:
    """What has been compared and what goes, in written tables."""

    def __init__(self, docs: DataFrame, words: int, least: float):
        self.docs, self.words, self.least = docs, words, least
        self.sets = self.gone = self.compared = None

    def compare(self, pairs: DataFrame) -> bool:
        """Whether more goes by these pairs."""
        pairs = pairs if self.compared is None else pairs.join(self.compared, ["a", "b"], "left_anti")
        pairs = stored(pairs, "near-pairs")
        wanted = pairs.select(F.col("a").alias("__id")).union(pairs.select("b")).distinct()
        if self.sets is not None:
            wanted = wanted.join(self.sets.select(F.col("doc_id").alias("__id")), "__id", "left_anti")
        wanted = stored(wanted, "near-wanted")
        few = stored(hashed(self.docs.join(maybe_broadcast(wanted), F.col("doc_id").cast("long") == F.col("__id"), "left_semi"), self.words), "near-sets")
        self.sets = few if self.sets is None else self.sets.unionByName(few)
        found = similar(pairs, self.sets, self.least).select(F.col("b").alias("doc_id")).distinct()
        found = stored(found if self.gone is None else found.join(self.gone, "doc_id", "left_anti"), "near-gone")
        self.gone = found if self.gone is None else self.gone.unionByName(found)
        self.compared = pairs if self.compared is None else self.compared.unionByName(pairs)
        return not found.isEmpty()


def one_of_each(docs: DataFrame, words: int = WORDS, least: float = SIMILAR, limit: int = LIMIT) -> DataFrame:
    """docs, all columns, without the near copies of documents of smaller id."""
    sigs = stored(signatures(docs, words), "near-signatures")
    twice = stored(sigs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "near-twice")
    if not twice.isEmpty():
        sigs = sigs.join(maybe_broadcast(twice), "doc_id", "left_anti")
    agree = F.aggregate(F.zip_with("x", "y", lambda p, q: (p == q).cast("int")), F.lit(0), lambda n, z: n + z)
    one = lambda i, s: sigs.select(F.col("doc_id").alias(i), F.col("sig").alias(s))
    found, rows, step = _Found(docs, words, least), keyed(sigs), 0
    while True:
        # Written, so that the join doesn't deal a large key's rows out as the counting did.
        heads = stored(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("a")).where("n > 1"), "near-heads")
        met = stored(rows.join(maybe_broadcast(heads), "key").where("a <> doc_id").select("key", "a", F.col("doc_id").alias("b")), "near-met")
        pairs = met.select("a", "b").distinct().join(one("a", "x"), "a").join(one("b", "y"), "b")
        found.compare(pairs.where(agree >= HOPE * HASHES).select("a", "b"))
        rest = met.select("key", F.col("b").alias("doc_id")).join(found.gone, "doc_id", "left_anti")
        rest = stored(rest, "near-left")
        sizes = stored(rest.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "near-sizes")
        sized = stored(rest.join(maybe_broadcast(sizes), "key"), "near-rest")
        few = sized.where(F.col("n") <= limit).select("key", "doc_id")
        for turn in count():
            more = found.compare(hopeful(few.join(found.gone, "doc_id", "left_anti").join(sigs, "doc_id"), turn))
            if turn and not more:
                break
        large = sized.where(F.col("n") > limit).select("key", "doc_id")
        if large.isEmpty():
            break
        step += 1
        rows = finer(large.join(found.gone, "doc_id", "left_anti").join(sigs, "doc_id"), step)
    gone = stored(found.gone.withColumnRenamed("doc_id", "__gone"), "near-all")
    return docs.join(maybe_broadcast(gone), F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")
