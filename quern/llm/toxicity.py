"""Toxicity: logistic regression with counterfactual regularisation.

A document's features are the words of its whole text and their beginnings (3 to 5 letters), each present or not. From a
bounded sample of labelled documents the ``FEATURES`` most telling are chosen, beside all identity terms. The loss has, beside the
log loss and a ridge, a counterfactual term: in labelled texts each identity term is swapped for the others of its line, the features of
the changed text are taken anew (what another word still gives stays), and a neutral mention is added to texts that have none;
squared changes of the score (before the sigmoid) are penalised, so that a mention alone moves no score. Equal changes are counted, not
repeated: there is no bound on how many count.

``SAMPLE`` bounds the labelled documents that are fitted on (those of smallest hash). Features are counted and chosen by Spark;
the driver gets the chosen ones only. Scoring reads every whole text, in one narrow pass.

Defined cases: null or empty text: the score of no features; null doc_id: scored, never fitted on, not held out; several labels for
a doc_id: the highest; no labelled rows: every score 0.5; empty table: empty result; extra columns: ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

SAMPLE = 8000
FEATURES = 1024
THRESHOLD = 0.7
KEEP = 100_000
WORD = re.compile(r"[^\W\d_]+")
CHANGES = pa.list_(pa.struct([("lost", pa.list_(pa.int64())), ("gained", pa.list_(pa.int64()))]))

# Terms for groups of people; a term is swapped for the others of its line.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "deaf", "blind", "elderly"),
    ("mujeres", "hombres", "musulmanes", "cristianos"),
    ("frauen", "männer", "muslime", "christen"),
    ("femmes", "hommes", "musulmans", "chrétiens"),
)


def parts_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in (3, 4, 5) if len(word) > n)]


def hashed(part: str) -> int:
    return zlib.crc32(part.encode("utf-8", "surrogatepass"))


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


@dataclass
class Model:
    bias: float = 0.0
    weights: dict[int, float] = field(default_factory=dict)  # by feature hash
    _seen: dict[str, tuple] = field(default_factory=dict, repr=False)

    def parts(self, word: str) -> tuple:
        got = self._seen.get(word)
        if got is None:
            if len(self._seen) > KEEP:
                self._seen.clear()
            got = self._seen[word] = tuple(h for h in map(hashed, parts_of(word)) if h in self.weights)
        return got

    def raw(self, text: str | None) -> float:
        return self.raw_words(words_of(text))

    def raw_words(self, words: set[str]) -> float:
        found: set[int] = set()
        for word in words:
            found.update(self.parts(word))
        return self.bias + sum(self.weights[h] for h in sorted(found))

    def score(self, text: str | None) -> float:
        return self.score_words(words_of(text))

    def score_words(self, words: set[str]) -> float:
        return 1 / (1 + np.exp(-np.clip(self.raw_words(words), -30, 30)))


def identity_features() -> np.ndarray:
    return np.array(sorted({hashed(p) for line in IDENTITY for t in line for p in parts_of(t)}), np.int64)


def telling(rows: DataFrame, features: int) -> list[int]:
    """Hashes of the parts that tell most (by log-likelihood ratio) among rows (toxic, parts); counted where the rows are."""
    sizes = rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()
    size = {r.toxic: float(r.n) for r in sizes}
    if len(size) < 2:
        return []
    counts = rows.select("toxic", F.explode("parts").alias("part")).groupBy("part").agg(F.count_if(F.col("toxic") == 1).alias("n1"), F.count_if(F.col("toxic") == 0).alias("n0"))
    share = (F.col("n1") + F.col("n0")) / (size[0] + size[1])
    term = lambda n, expected: F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)
    g = sum((term(F.col(f"n{y}").cast("double"), size[y] * share) + term(size[y] - F.col(f"n{y}"), size[y] * (1 - share)) for y in (0, 1)), F.lit(0.0))
    best = counts.where("n1 + n0 >= 3").withColumn("g", F.round(g, 6)).where("g > 3").orderBy(F.col("g").desc(), "part").limit(features)
    return [r.part for r in best.select("part").collect()]


def changes(words: set[str]) -> Iterator[tuple[list[int], list[int]]]:
    """(features lost, features gained) for each identity term swapped for another of its line, or, without one, for each that is added."""
    mine = [(t, line) for line in IDENTITY for t in line if t in words]
    before = {h for w in words for h in map(hashed, parts_of(w))} if mine else set()
    for term, line in mine:
        for other in line:
            if other != term:
                after = {h for w in (words - {term}) | {other} for h in map(hashed, parts_of(w))}
                yield sorted(before - after), sorted(after - before)
    if not mine:
        for line in IDENTITY:
            for term in line:
                yield [], sorted({*map(hashed, parts_of(term))})


@dataclass
class Sample:
    """Labelled rows (label, hashes of chosen features) and the different changes (lost, gained, how often)."""

    rows: list[tuple[int, np.ndarray]]
    swaps: list[tuple[np.ndarray, np.ndarray, int]]


def sample_features(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> Sample:
    """The sampled labelled documents: doc_id, text; doc_id, toxic.

    The driver gets the chosen features only: at most ``features`` and those of identity terms for each of ``sample`` rows, and each
    different change once.
    """
    picked = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [words_of(t.as_py()) for t in b.column(2)]
            found = [np.unique(np.array([hashed(p) for w in ws for p in parts_of(w)], np.int64)) for ws in words]
            # All rows without a mention have the same changes: they are counted, and made once below.
            swapped = [[{"lost": x, "gained": y} for x, y in changes(ws)] if any(t in ws for line in IDENTITY for t in line) else None for ws in words]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int64())), pa.array(swapped, CHANGES)], ["doc_id", "toxic", "parts", "changes"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", "text")
    rows = stored(rows.mapInArrow(run, "doc_id long, toxic int, parts array<long>, changes array<struct<lost:array<long>,gained:array<long>>>"), "toxicity-sample")
    chosen = np.union1d(np.array(telling(rows, features), np.int64), identity_features())

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [np.intersect1d(np.array(p, np.int64), chosen, assume_unique=True).tobytes() for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(kept, pa.binary())], ["doc_id", "toxic", "parts"])

    got = rows.select("doc_id", "toxic", "parts").mapInArrow(keep, "doc_id long, toxic int, parts binary").collect()
    few = F.array(*[F.lit(int(h)) for h in chosen])
    of = lambda c: F.array_intersect(f"x.{c}", few).alias(c)
    told = rows.select(F.explode("changes").alias("x")).select(of("lost"), of("gained")).groupBy("lost", "gained").agg(F.count("*").alias("n")).orderBy("lost", "gained").collect()
    swaps = [(np.array(r.lost, np.int64), np.array(r.gained, np.int64), int(r.n)) for r in told]
    plain = rows.where("changes is null").count()
    swaps += [(np.array(x, np.int64), np.array(y, np.int64), plain) for x, y in changes(set()) if plain]
    return Sample([(r.toxic, np.frombuffer(bytes(r.parts), np.int64)) for r in sorted(got, key=lambda r: (r.doc_id, bytes(r.parts)))], swaps)


def fitted(sample: Sample, ridge: float = 0.02, fairness: float = 5.0, steps: int = 300) -> Model:
    """Full-batch Adam on log loss + ridge + counterfactual term."""
    rows = sample.rows
    if not rows or len({y for y, _ in rows}) < 2:
        return Model()
    columns = np.union1d(np.concatenate([p for _, p in rows]), identity_features())
    x = np.zeros((len(rows), len(columns)), np.float32)
    for i, (_, parts) in enumerate(rows):
        x[i, np.isin(columns, parts, assume_unique=True)] = 1
    y = np.array([r[0] for r in rows], np.float32)
    d, often = np.zeros((len(sample.swaps), len(columns)), np.float32), np.array([n for _, _, n in sample.swaps], np.float32)
    for i, (lost, gained, _) in enumerate(sample.swaps):
        d[i] = np.isin(columns, gained).astype(np.float32) - np.isin(columns, lost)
    often /= max(1.0, float(often.sum()))
    w, b = np.zeros(len(columns), np.float32), float(np.log(y.mean() / (1 - y.mean())))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        e = (p - y) / len(y)
        gw = x.T @ e + ridge * w / len(columns) + 2 * fairness * (d.T @ (often * (d @ w)))
        gb = float(e.sum())
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix = np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w -= 0.1 * fix * m / (np.sqrt(v) + 1e-8)
        b -= 0.1 * fix * mb / (np.sqrt(vb) + 1e-8)
    return Model(b, {int(h): float(a) for h, a in zip(columns, w) if a})


def mention_report(rows: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(term, n, flagged, flagged_with): of rows (text, toxic) that aren't toxic, how many the model flags as they are and with a neutral mention of a term.

    One row for each identity term; give held-out rows.
    """
    terms = [t for line in IDENTITY for t in line]
    neutral = rows.where("toxic = 0").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, flagged, hit = b.num_rows, 0, np.zeros(len(terms), np.int64)
            for text in b.column(0):
                words = words_of(text.as_py())
                flagged += int(model.score_words(words) >= threshold)
                hit += np.array([model.score_words(words | {t}) >= threshold for t in terms], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array([n] * len(terms), pa.int64()), pa.array([flagged] * len(terms), pa.int64()), pa.array(hit)], ["term", "n", "flagged", "flagged_with"])

    counted = neutral.mapInArrow(run, "term string, n long, flagged long, flagged_with long")
    return counted.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("n", "flagged", "flagged_with")])


def scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs with two more columns, which take the place of columns of the same names."""
    docs, added = docs.drop(*names), names
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([model.score(t.as_py()) for t in b.column(at)], float)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got), pa.array((got >= threshold).astype(np.int32))], [*names, *added])

    schema = T.StructType([*docs.schema.fields, T.StructField(added[0], T.DoubleType()), T.StructField(added[1], T.IntegerType())])
    return docs.mapInArrow(run, schema)


def held_out() -> Column:
    """Whether a row is kept from fitting: crc32 of doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, fairness: float = 5.0) -> Model:
    """A model from the labelled documents that aren't held out."""
    return fitted(sample_features(docs, labels.where(~held_out()), sample), fairness=fairness)
