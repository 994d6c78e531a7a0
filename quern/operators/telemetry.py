"""Telemetry, feedback and golden tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .search import in_blocks, in_place

#: Rows of a few words or numbers that are broadcast at once.
FEW = 500_000
#: Inner words of an item that are counted.
LONGEST = 4


def summary(records: DataFrame) -> DataFrame:
    """One row: n, avg_elapsed, avg_chars (cut to whole numbers), used. records: elapsed_ms, chars, used."""
    whole = lambda c: F.coalesce(F.avg(c), F.lit(0.0)).cast("long")
    return records.agg(F.count("*").alias("n"), whole("elapsed_ms").alias("avg_elapsed"), whole("chars").alias("avg_chars"), F.count_if("used").alias("used"))


def types_total(records: DataFrame, types: str = "types") -> DataFrame:
    """type, n: sums of the counts in a map column."""
    return records.select(F.explode(types).alias("type", "c")).groupBy("type").agg(F.sum("c").cast("long").alias("n"))


def tail(records: DataFrame, n: int = 1000, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The last n records, latest first. A top-n, so only n rows of each task are kept and merged."""
    return records.orderBy(*[F.col(c).desc() for c in order]).limit(max(1, n))


def first_sources(items: DataFrame, n: int = 20) -> DataFrame:
    """query_id, sources: the first n different sources in order of ordinal."""
    first = items.groupBy("query_id", "source").agg(F.min("ordinal").alias("ordinal"))
    w = Window.partitionBy("query_id").orderBy("ordinal")
    first = first.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    return first.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "source"))), lambda x: x.source).alias("sources"))


def golden(tests: DataFrame, results: DataFrame) -> DataFrame:
    """query_id, passed, missing: expected sources (parts of a source's name) and types that no result has.

    tests: query_id, expected_sources, expected_types; results: query_id, source, type.
    """
    got = results.groupBy("query_id").agg(F.collect_set(F.lower("source")).alias("sources"), F.collect_set("type").alias("types"))
    rows = tests.join(got, "query_id", "left")
    empty = F.array().cast("array<string>")
    rows = rows.withColumns({"sources": F.coalesce("sources", empty), "types": F.coalesce("types", empty)})
    sources = F.filter("expected_sources", lambda e: ~F.exists("sources", lambda s: F.contains(s, F.lower(e))))
    missing = F.concat(sources, F.array_except("expected_types", "types"))
    return rows.select("query_id", (F.size(missing) == 0).alias("passed"), missing.alias("missing"))


def pass_counts(judged: DataFrame) -> DataFrame:
    return judged.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


def _broadcast(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= FEW else rows


def inner_words(text: str) -> Column:
    """The words of a text that neither of its ends can cut: a text that contains it has them as whole words."""
    parts = F.split(text, "[^A-Za-z0-9]+")
    return F.array_distinct(F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), lambda w: w != ""))


def containing(items: DataFrame, docs: DataFrame) -> DataFrame:
    """item_id, n_documents: how many rows of docs (doc_id, text) contain the text of each item (item_id, wanted), zero included.

    Of an item's ``LONGEST`` longest inner words the one that the fewest documents have looks it up: texts are split once, (document, word)
    pairs of such words are written, and texts are read again for the documents found. Items without an inner word are compared with every text, in blocks.

    Defined cases: null text, or a document without an id: not counted; null item: in no document; empty item: in every text; repeated
    documents: every row counts; an item_id names one text.
    """
    items = stored(items.select("item_id", "wanted", inner_words("wanted").alias("words")), "items")
    longest = F.slice(F.array_sort(F.transform("words", lambda w: F.struct((-F.length(w)).alias("n"), w.alias("word")))), 1, LONGEST)
    words = items.select("item_id", F.explode(longest).alias("w")).select("item_id", "w.word")
    of_doc = docs.where("doc_id is not null").select("doc_id", F.explode(F.array_distinct(F.split("text", "[^A-Za-z0-9]+"))).alias("word"))
    of_doc = stored(of_doc.join(_broadcast(words.select("word").distinct()), "word", "left_semi").select("doc_id", "word"), "items-words")
    seen = of_doc.groupBy("word").agg(F.count("*").alias("n"))
    chosen = words.join(seen, "word", "left").groupBy("item_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("least"))
    # A word that no document has: its item is in none.
    chosen = stored(chosen.where("least.n > 0").select("item_id", "least.word"), "items-by-word")
    pairs = stored(of_doc.join(_broadcast(chosen), "word").select("item_id", "doc_id").distinct(), "items-met")
    wanted = items.select("item_id", "wanted")
    met = docs.select("doc_id", "text").join(_broadcast(pairs), "doc_id").join(in_place(wanted.withColumnRenamed("item_id", "query_id")), F.col("item_id") == F.col("query_id"))
    rest = items.where("coalesce(size(words), 0) <= 0").select(F.col("item_id").alias("query_id"), "wanted")
    others = in_blocks(docs.where("doc_id is not null").select("text"), rest, "wanted").where(F.contains("text", F.col("wanted")))
    hits = met.where(F.contains("text", F.col("wanted"))).select("item_id").unionByName(others.select(F.col("query_id").alias("item_id")))
    found = hits.groupBy("item_id").agg(F.count("*").alias("n_documents"))
    return items.select("item_id").join(found, "item_id", "left").select("item_id", F.coalesce("n_documents", F.lit(0)).cast("long").alias("n_documents"))
