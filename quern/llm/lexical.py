"""Ranked lexical search, reversed: the items are the index, and the documents stream through it.

The items' terms are an inverted index (term to items), broadcast in blocks of at most ``ITEM_BYTES`` of item texts, so any number of items
is taken in more than one block. One pass over the texts counts each document's terms that items have and writes (doc_id, n, terms, counts);
the corpus statistics N, L and df are sums of that. A second pass over these short rows scores every item for each document and keeps a heap of ``TOP``
for each item and task; the heaps, a few rows a task and item, are merged by a window.

Scores are whole numbers: ``w * ((10^9 tf) div (1000 tf + 8 m))`` over an item's terms, with ``w = floor(1000 ln((2N + 2) / (2 df + 1)))`` and
``m = 10 + (90 n N) div L``. Terms are runs of ASCII letters and digits and of anything beyond ASCII; only A-Z are lower-cased.

Defined cases: null or empty text: no terms, neither a document in N nor an item with results; null doc_id: takes part, last among equal
scores; repeated documents: each is a document; equal items: one; different texts under one item_id: each ranked for itself; ties:
by doc_id; fewer than ``TOP`` with a score above 0: all of them; extra columns: ignored; empty tables: empty result.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

TOP = 10
#: Bytes of item texts in one broadcast index; more items are taken in more blocks.
ITEM_BYTES = 4 << 20
#: Documents scored at once.
ROWS = 64
_SPACE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order and with repeats."""
    return text.translate(_SPACE).split()


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Index:
    """A block of items: numbers of terms, and of the items that each term is in."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.ids = [i for i, _ in items]
        own = [dict.fromkeys(terms(t.encode("utf-8", "surrogatepass"))) for _, t in items]
        self.number = {t: k for k, t in enumerate(dict.fromkeys(t for x in own for t in x))}
        pairs = sorted((self.number[t], i) for i, x in enumerate(own) for t in x)
        self.items = np.array([i for _, i in pairs], np.int64)
        self.first = np.searchsorted(np.array([t for t, _ in pairs], np.int64), np.arange(len(self.number) + 1))
        self.most = max((len(x) for x in own), default=0)


def counted(docs: DataFrame, index: Index) -> DataFrame:
    """(doc_id, n, terms, counts): each document's number of terms, and how often it has those of the index."""
    held = docs.sparkSession.sparkContext.broadcast(index.number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = held.value.get
        for batch in batches:
            ns, all_terms, all_counts = [], [], []
            for text in batch.column(1):
                words = terms(text.as_py() or b"")
                found = Counter(map(number, words))
                found.pop(None, None)
                ns.append(len(words))
                all_terms.append(list(found))
                all_counts.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(all_terms, pa.list_(pa.int32())), pa.array(all_counts, pa.list_(pa.int32()))], ["doc_id", "n", "terms", "counts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>").where("n > 0")


def frequencies(rows: DataFrame, size: int) -> np.ndarray:
    """df of each term of the index, of which there are ``size``. Tasks add up their own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        own = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(df[own])], ["term", "df"])

    out = np.zeros(size, np.int64)
    for r in rows.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df
    return out


class Heaps:
    """The best of each item so far: (score, smaller id first), ``top`` at most. Ids may be null."""

    def __init__(self, items: int, top: int):
        self.top, self.rows, self.least = top, [[] for _ in range(items)], np.ones(items, np.int64)

    def update(self, scores: np.ndarray, ids: list[int | None]) -> None:
        """scores: a row for each document, a column for each item."""
        for row, item in zip(*np.nonzero(scores >= self.least)):
            heap, doc = self.rows[item], ids[row]
            entry = (int(scores[row, item]), doc is not None, 0 if doc is None else -doc)
            if len(heap) < self.top:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.top:
                self.least[item] = heap[0][0]


def scored(rows: DataFrame, index: Index, weights: np.ndarray, n_docs: int, n_terms: int, top: int = TOP) -> DataFrame:
    """(item, doc_id, score): each task's best of every item. rows: as counted() gives them."""
    # Sums of whole numbers below 2^53 are exact in doubles, which bincount adds in; beyond, they are added as integers.
    exact = float(weights.max(initial=0)) * 1e6 * index.most < 2**53
    held = rows.sparkSession.sparkContext.broadcast((index.first, index.items, weights, len(index.ids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, items, weights, size = held.value
        heaps, width = Heaps(size, top), np.diff(first)

        def points(tf: np.ndarray, t: np.ndarray, n: int) -> np.ndarray:
            m = 10 + (90 * n * n_docs) // n_terms
            return weights[t] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))

        def spread(t: np.ndarray, value: np.ndarray) -> np.ndarray:
            """Each term's value, added to all items that have it."""
            many = width[t]
            ends = np.cumsum(many)
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[t] - (ends - many), many)
            if exact:
                return np.bincount(items[at], np.repeat(value, many), minlength=size).astype(np.int64)
            out = np.zeros(size, np.int64)
            np.add.at(out, items[at], np.repeat(value, many))
            return out

        for batch in batches:
            ids, ns = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(ids), ROWS):
                block = []
                for k in range(at, min(at + ROWS, len(ids))):
                    t = batch.column(2)[k].values.to_numpy().astype(np.int64)
                    tf = batch.column(3)[k].values.to_numpy().astype(np.int64)
                    block.append(spread(t, points(tf, t, ns[k])))
                heaps.update(np.array(block), ids[at : at + ROWS])
        best = [(i, -neg if known else None, score) for i, heap in enumerate(heaps.rows) for score, known, neg in heap]
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in best], pa.int64()) for c in range(3)], ["item", "doc_id", "score"])

    return rows.select("doc_id", "n", "terms", "counts").mapInArrow(run, "item long, doc_id long, score long")


def merged(best: DataFrame, top: int = TOP) -> DataFrame:
    """The heaps of all tasks as one: (item, rank, doc_id, score)."""
    w = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("item", "rank", "doc_id", "score")


def blocks(items: DataFrame, size: int = ITEM_BYTES) -> Iterator[list[tuple[int | None, str]]]:
    """The different items, a block of at most ``size`` bytes of texts (or one item) at a time."""
    held, n = [], 0
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        if held and n + len(r.text.encode("utf-8", "surrogatepass")) > size:
            yield held
            held, n = [], 0
        held.append((r.item_id, r.text))
        n += len(r.text.encode("utf-8", "surrogatepass"))
    if held:
        yield held


def ranking(docs: DataFrame, items: DataFrame, top: int = TOP, size: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of docs (doc_id, text) for each of items (item_id, text)."""
    spark, out = docs.sparkSession, None
    for block in blocks(items, size):
        index = Index(block)
        rows = stored(counted(docs, index), "lexical-counts")
        total = rows.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
        if not index.number or not total.n:
            continue
        df = frequencies(rows, len(index.number))
        weights = np.array([weight(total.n, int(x)) for x in df], np.int64)
        best = merged(stored(scored(rows, index, weights, total.n, total.l, top), "lexical-heaps"), top)
        names = spark.createDataFrame([(k, i) for k, i in enumerate(index.ids)], "item long, item_id long")
        part = stored(best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "lexical-best")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


_TERMS_SQL = r"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {_TERMS_SQL.format(t="text")} AS ws FROM documents),
c AS (SELECT count(*) AS n, sum(len(ws))::BIGINT AS l FROM d WHERE len(ws) > 0),
tf AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(ws) AS term FROM d) GROUP BY row, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
i AS (SELECT DISTINCT item_id, text, unnest({_TERMS_SQL.format(t="text")}) AS term FROM benchmark),
s AS (SELECT item_id, text, row, any_value(doc_id) AS doc_id, sum(CAST(floor(1000 * ln((2 * c.n + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * len(ws) * c.n) // c.l)))))::BIGINT AS score
  FROM i JOIN tf USING (term) JOIN df USING (term) JOIN d USING (row), c GROUP BY item_id, text, row)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
