"""Substring dedup by level-wise doubling.

A window of ``window`` words can only repeat if the shorter windows inside it repeat. Level by level (4, 8, then 13 words for a cut at 13,
which is two overlapping windows of 8), only windows that the level before leaves are asked about; most of the text drops out at
once. Below the last level, of a window's inner windows only the one of smallest hash is asked about, the same in every copy of that window.
``repeat_levels`` asks about all windows and goes on doubling until no candidates survive.

Texts are split into words once, into blocks of about ``BLOCK_BYTES`` of neighbouring rows, as numbers into the block's own list of words. A
block asks about each different hash once, however often it has it; questions are shuffled by the upper bits of the hash, as an array for each of
``fan`` parts, and laid out as rows behind the shuffle; a hash is repeated if smallest
and largest doc_id of all who ask differ. Only the places of repeated hashes are sent back. So a passage in a third of all documents is
one question a block.

Hashes are 64 bits below the last level (a collision only adds candidates) and 96 bits there.

Defined cases: null text: no words; a null doc_id counts as larger than all others and not as smaller
than another null; rows that share a doc_id don't remove each other's words; shorter texts than a
window stay whole; a text longer than a block: a block of its own; empty table: empty result; extra columns: ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BLOCK_BYTES = 8 << 20
FIRST = 4
LAST = np.iinfo(np.int64).max
LEAST = np.iinfo(np.int64).min
RATES = np.random.default_rng(20).integers(1, 2**62, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Places(dict):
    """Numbers words in the order in which they first come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        return at


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


#: A block: doc_ids (8 bytes each, LAST for null), which are null (bits), words of each document, all words as numbers, the list of words and
#: how many bytes that has. Numbers and list are compressed.
BLOCK = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("missing", pa.binary()), ("sizes", pa.binary()), ("codes", pa.binary()), ("words", pa.binary()), ("bytes", pa.int64())])
BLOCK_SQL = "block long, ids binary, missing binary, sizes binary, codes binary, words binary, bytes long"


def zipped(data: bytes) -> bytes:
    return pa.Codec("zstd").compress(data, asbytes=True)


def blocks(docs: DataFrame, size: int) -> DataFrame:
    """Blocks of neighbouring rows (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, n = TaskContext.get().partitionId() << 32, 0
        places, ids, missing, codes, held = Places(), [], [], [], 0

        def closed() -> pa.RecordBatch:
            sizes = np.array([len(c) for c in codes], np.int64)
            row = (first + n, np.array(ids, np.int64).tobytes(), np.packbits(np.array(missing, bool)).tobytes(), sizes.tobytes(), zipped(np.concatenate(codes).astype("<i4").tobytes()), zipped(listed := b" ".join(places)), len(listed))
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, BLOCK)], schema=BLOCK)

        for b in batches:
            for i, text in zip(b.column(0), b.column(1)):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if ids and held + len(raw) > size:
                    yield closed()
                    places, ids, missing, codes, held, n = Places(), [], [], [], 0, n + 1
                words = raw.split()
                ids.append(i.as_py() if i.is_valid else LAST)
                missing.append(not i.is_valid)
                codes.append(np.fromiter(map(places.__getitem__, words), np.int32, len(words)))
                held += len(raw)
        if ids:
            yield closed()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, BLOCK_SQL)


class Block:
    """The words of some documents, and hashes of their windows. Windows that cross a document's end aren't ok."""

    def __init__(self, row: dict):
        self.block = row["block"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.missing = np.unpackbits(np.frombuffer(row["missing"], np.uint8), count=len(self.ids)).astype(bool)
        self.size = np.frombuffer(row["sizes"], np.int64)
        unzipped = lambda name, n: pa.Codec("zstd").decompress(row[name], n, asbytes=True)
        self.at = np.frombuffer(unzipped("codes", 4 * int(self.size.sum())), "<i4")
        self.words = unzipped("words", row["bytes"]).split(b" ") if row["bytes"] else []
        self.doc = np.repeat(np.arange(len(self.ids)), self.size)
        self.lanes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, self.words)), "<u8").reshape(-1, 2)

    def ok(self, length: int) -> np.ndarray:
        m = max(0, len(self.at) - length + 1)
        return self.doc[:m] == self.doc[length - 1 :][:m]

    def rolled(self, length: int, lane: int) -> np.ndarray:
        m = max(0, len(self.at) - length + 1)
        word, out = self.lanes[self.at, lane], np.zeros(m, np.uint64)
        for j in range(length):
            out += word[j : j + m] * RATES[j % len(RATES)]
        return mixed(out)

    def least(self, window: int, inner: int, start: np.ndarray) -> np.ndarray:
        """For each window at start the smallest hash of its inner windows."""
        h = self.rolled(inner, 0)
        m = max(0, len(self.at) - window + 1)
        out = h[:m].copy()
        for j in range(1, window - inner + 1):
            np.minimum(out, h[j : j + m], out=out)
        return out[start]


def distinct(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (low, high) pairs in order, and each pair's place there."""
    order = np.lexsort((high, low))
    a, b = low[order], high[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    place = np.empty(len(a), np.int64)
    place[order] = np.cumsum(new) - 1
    return a[new], b[new], place


def levels(window: int, first: int = FIRST) -> list[int]:
    """first, twice that and so on while it is shorter than window, then window."""
    out = []
    while first < window:
        out.append(first)
        first *= 2
    return [*out, window]


ASK_TYPES = {"block": pa.int64(), "bucket": pa.int32(), "low": pa.list_(pa.int64()), "high": pa.list_(pa.int32()), "first": pa.list_(pa.int64()), "last": pa.list_(pa.int64())}
ASK_SQL = "block long, bucket int, low array<long>, high array<int>, first array<long>, last array<long>"
FEWEST, MOST, BUCKET_BYTES = 512, 1 << 16, 64 << 20


def parts_of(total: int) -> int:
    """Into how many parts the hashes of a block are dealt, by the bytes of all texts.

    A part is one task's sort, which spills. A block writes a row a part: FEWEST up to 32 GB of texts, and at most MOST, when a row still
    holds some 16 hashes.
    """
    return min(MOST, max(FEWEST, -(-total // BUCKET_BYTES)))


def fan(docs: DataFrame) -> int:
    return parts_of(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


class Asked:
    """The different hashes of the windows at start, dealt into buckets."""

    def __init__(self, block: Block, hashes: tuple[np.ndarray, np.ndarray], start: np.ndarray, fan: int):
        self.block = block
        self.low, self.high, self.place = distinct(*hashes)
        ids = block.ids[block.doc[start]]
        self.first, self.last = np.full(len(self.low), LAST), np.full(len(self.low), LEAST)
        np.minimum.at(self.first, self.place, ids)
        np.maximum.at(self.last, self.place, ids)
        bucket = ((self.low >> np.uint64(32)) * np.uint64(fan)) >> np.uint64(32)
        self.edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, np.int64)
        self.bucket = bucket[self.edge[:-1]].astype(np.int32)

    def table(self) -> pa.Table:
        lists = [pa.ListArray.from_arrays(self.edge.astype(np.int32), pa.array(x)) for x in (self.low.view(np.int64), self.high.view(np.int32), self.first, self.last)]
        return pa.table([pa.array(np.full(len(self.bucket), self.block.block)), pa.array(self.bucket), *lists], names=list(ASK_TYPES))

    def answered(self, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """For each window whether it is repeated, and the smallest doc_id that has it."""
        hit, least = np.zeros(len(self.low), bool), np.full(len(self.low), LAST)
        begin = dict(zip(self.bucket.tolist(), self.edge[:-1].tolist()))
        answers = answers.combine_chunks()
        size = np.diff(answers.column("at").combine_chunks().offsets.to_numpy()) if answers.num_rows else np.zeros(0, np.int64)
        if size.sum():
            base = np.repeat([begin[b] for b in answers.column("bucket").to_pylist()], size)
            at = base + answers.column("at").combine_chunks().flatten().to_numpy()
            hit[at], least[at] = True, answers.column("first").combine_chunks().flatten().to_numpy()
        return hit[self.place], least[self.place]


def told(asks: DataFrame, ids: bool = True) -> DataFrame:
    """block, bucket, at, first: of the questions those that several doc_ids share, and the smallest of all doc_ids if ``ids``."""
    rows = asks.repartition("bucket").select("block", "bucket", F.posexplode(F.arrays_zip("low", "high", "first", "last")).alias("at", "x"))
    of = Window.partitionBy("bucket", "x.low", "x.high")
    rows = rows.withColumns({"least": F.min("x.first").over(of), "most": F.max("x.last").over(of)}).where("least < most")
    first = F.col("least") if ids else F.lit(0).cast("long")
    rows = rows.groupBy("bucket", "block").agg(F.collect_list(F.struct("at", first.alias("first"))).alias("y"))
    return rows.select("block", "bucket", F.col("y.at").alias("at"), F.col("y.first").alias("first"))


def joined(parts: list[pa.Table], types: dict[str, pa.DataType]) -> pa.Table:
    return pa.concat_tables(parts) if parts else pa.schema(list(types.items())).empty_table()


def repeats(docs: DataFrame, window: int = 13, first: int = FIRST) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept has the words not covered by a window that also starts in a document of smaller id.

    ``docs``: (doc_id, text). ``first``: words of a window of the first level.
    """
    held, steps, parts = blocks(docs, BLOCK_BYTES).groupBy("block"), levels(window, first), fan(docs)

    def questions(block: Block, level: int, start: np.ndarray) -> Asked:
        """What a level asks about for the windows at start."""
        length = steps[level]
        if length < window:
            return Asked(block, (block.least(window, length, start), np.zeros(len(start), np.uint32)), start, parts)
        return Asked(block, (block.rolled(window, 0)[start], (block.rolled(window, 1)[start] >> np.uint64(32)).astype(np.uint32)), start, parts)

    def left(block: Block, answers: list[pa.Table]) -> np.ndarray:
        """Windows that may repeat, by the answers of all levels before."""
        start = np.flatnonzero(block.ok(window))
        for level, table in enumerate(answers):
            start = start[questions(block, level, start).answered(table)[0]]
        return start

    def split(answers: pa.Table, levels: int) -> list[pa.Table]:
        return [answers.filter(pa.compute.equal(answers.column("level"), i)) for i in range(levels)]

    def ask(level: int):
        def run(keys, table, answers=None):
            out = []
            for row in table.to_pylist():
                block = Block(row)
                out.append(questions(block, level, left(block, split(answers, level) if level else [])).table())
            return joined(out, ASK_TYPES)

        return (lambda keys, table: run(keys, table)) if level == 0 else (lambda keys, table, answers: run(keys, table, answers))

    def remove(keys, table, answers):
        out = []
        for row in table.to_pylist():
            block = Block(row)
            told = split(answers, len(steps))
            start = left(block, told[:-1])
            hit, least = questions(block, len(steps) - 1, start).answered(told[-1])
            gone = start[hit & (block.ids[block.doc[start]] > least)]
            step = np.zeros(len(block.at) + 1, np.int64)
            np.add.at(step, gone, 1)
            np.add.at(step, gone + window, -1)
            keep = np.cumsum(step)[:-1] <= 0
            end = np.cumsum(block.size)
            kept = [b" ".join([block.words[i] for i in block.at[e - n : e][keep[e - n : e]].tolist()]).decode("utf-8", "surrogatepass") for e, n in zip(end, block.size)]
            removed = [int(n - keep[e - n : e].sum()) for e, n in zip(end, block.size)]
            ids = pa.array(block.ids, mask=block.missing)
            out.append(pa.table({"doc_id": ids, "n_words": pa.array(block.size), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string())}))
        return pa.concat_tables(out) if out else pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.string())})

    # What a level's places count is what the levels before have left, so their answers come along.
    answers = told(held.applyInArrow(ask(0), ASK_SQL), len(steps) == 1).withColumn("level", F.lit(0))
    for level in range(1, len(steps)):
        new = told(held.cogroup(answers.groupBy("block")).applyInArrow(ask(level), ASK_SQL), level == len(steps) - 1)
        answers = answers.unionByName(new.withColumn("level", F.lit(level)))
    return held.cogroup(answers.groupBy("block")).applyInArrow(remove, "doc_id long, n_words long, n_removed long, kept string")


def doubled(block: Block, window: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``length`` words, from those of half the length."""
    if length == window:
        return block.rolled(window, 0), block.rolled(window, 1)
    half = length // 2
    out = []
    for h in doubled(block, window, half):
        m = max(0, len(h) - half)
        out.append(mixed(h[:m] * RATES[-1] + h[half:][:m] * RATES[-2]))
    return out[0], out[1]


NOTE_TYPES = {**ASK_TYPES, "starts": pa.binary(), "doc_id": pa.int64(), "n": pa.int64()}
NOTE_SQL = f"{ASK_SQL}, starts binary, doc_id long, n long"


def repeat_levels(docs: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, length, n_windows): how many windows of window, 2 window, 4 window, ... words of a document also come in another one.

    Only where both halves of a window repeat is it asked about, and the loop ends when nothing repeats. Rows without a doc_id are one document.
    """
    spark = docs.sparkSession
    held, parts = stored(blocks(docs, BLOCK_BYTES), "substring-blocks"), fan(docs)
    answers, found, length = spark.createDataFrame([], "block long, bucket int, at array<int>, first array<long>, starts binary"), None, window
    while True:

        def ask(keys, table, answers):
            out = []
            for row in table.to_pylist():
                block = Block(row)

                def questions(length: int, start: np.ndarray) -> Asked:
                    low, high = (h[start] for h in doubled(block, window, length))
                    return Asked(block, (low, (high >> np.uint64(32)).astype(np.uint32)), start, parts)

                start = np.flatnonzero(block.ok(length))
                names, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if length > window:
                    half = length // 2
                    marks = next(x for x in answers.column("starts").to_pylist() if x is not None)
                    before = np.flatnonzero(np.unpackbits(np.frombuffer(marks, np.uint8), count=max(0, len(block.at) - half + 1)))
                    rest = answers.filter(pa.compute.is_valid(answers.column("bucket")))
                    again = before[questions(half, before).answered(rest)[0]]
                    names, counts = np.unique(block.doc[again], return_counts=True)
                    mark = np.zeros(len(block.at) + length, bool)
                    mark[again] = True
                    start = start[mark[start] & mark[start + half]]
                asks = questions(length, start).table()
                mark = np.zeros(max(0, len(block.at) - length + 1), bool)
                mark[start] = True
                told = {"block": [block.block], "starts": [np.packbits(mark).tobytes()], "n": [None], "doc_id": [None]}
                told = {k: v + ([block.block] * len(names) if k == "block" else [None] * len(names)) for k, v in told.items()}
                told["n"] = [None, *counts.tolist()]
                told["doc_id"] = [None, *[None if block.missing[d] else int(block.ids[d]) for d in names]]
                for columns, n in (({c: asks.column(c) for c in ASK_TYPES}, asks.num_rows), (told, 1 + len(names))):
                    out.append(pa.table({c: columns.get(c, pa.nulls(n, t)) if not isinstance(columns.get(c), list) else pa.array(columns[c], t) for c, t in NOTE_TYPES.items()}))
            return joined(out, NOTE_TYPES)

        notes = stored(held.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(ask, NOTE_SQL), "substring-notes")
        if length > window:
            level = notes.where("n is not null").groupBy("doc_id").agg(F.sum("n").alias("n_windows")).select("doc_id", F.lit(length // 2).cast("long").alias("length"), "n_windows")
            found = level if found is None else found.unionByName(level)
        asks = notes.where("bucket is not null").select("block", "bucket", "low", "high", "first", "last")
        if asks.isEmpty():
            return found if found is not None else spark.createDataFrame([], "doc_id long, length long, n_windows long")
        starts = notes.where("starts is not null").select("block", "starts")
        answers = stored(told(asks).unionByName(starts, allowMissingColumns=True), "substring-answers")
        length *= 2


#: repeats() with a window of 13, in DuckDB.
SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT s, min(doc_id) AS first_id FROM g GROUP BY s),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM g JOIN f USING (s), range(0, 13) AS r(k) WHERE first_id < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
