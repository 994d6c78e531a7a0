"""Ingest: chunk, normalise, validate, tag, hash, drop known chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import stored as written
from .chunking import chunks


def prepared(docs: DataFrame, source: str = "source", text: str = "text", tags: Column | None = None, name: str | None = None) -> DataFrame:
    """(source, chunk_no, content, valid, hash, tags, page) of every chunk of docs."""
    rows = chunks(docs.select(F.col(source).alias("source"), F.col(text).alias("text"), *([F.col(name).alias("name")] if name else [])), name="name" if name else None)
    rows = rows.withColumn("content", X.normalized(F.col("chunk")))
    found = X.merged_tags(tags if tags is not None else F.array().cast("array<string>"), X.hash_tags(F.col("content")), X.command_tags(F.col("content")))
    return rows.select("source", "chunk_no", "content", X.is_valid_chunk(F.col("content")).alias("valid"), X.content_hash(F.col("content")).alias("hash"), found.alias("tags"), X.page_number(F.col("chunk")).alias("page"))


def first_by_hash(rows: DataFrame, *order: str) -> DataFrame:
    """One row for each hash, the first in the given order: an aggregate with map-side combine, not a window."""
    rest = [c for c in rows.columns if c != "hash"]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("first")
    return rows.groupBy("hash").agg(first).select(*[F.col("hash") if c == "hash" else F.col(f"first.{c}").alias(c) for c in rows.columns])


def ingested(docs: DataFrame, stored: DataFrame | None = None, embed: Callable[[Column], Column] | None = None, **kw) -> tuple[DataFrame, DataFrame]:
    """(new chunks, counts by source). ``stored``: chunks that exist, with their hash. ``embed``: makes a vector column from content.

    Counts are made from what identifies a chunk, which is written, so no text, tag or page is made or shuffled for them.
    """
    made = prepared(docs, **kw)
    known = None if stored is None else stored.select("hash").distinct()
    new = lambda rows: rows if known is None else rows.join(known, "hash", "left_anti")
    fresh = new(first_by_hash(made.where("valid"), "source", "chunk_no")).drop("valid")
    if embed is not None:
        fresh = fresh.withColumn("embedding", embed(F.col("content")))
    rows = written(made.select("source", "valid", "hash"), "chunk-hashes")
    # The first chunk of a hash is of the smallest source, null being the smallest.
    first = rows.where("valid").groupBy("hash").agg(F.min(F.struct("source")).alias("first"))
    added = new(first).groupBy("first.source").agg(F.count("*").alias("inserted"))
    counts = rows.groupBy("source").agg(F.count("*").alias("chunks"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"))
    counts = counts.join(added, "source", "left").withColumn("inserted", F.coalesce("inserted", F.lit(0)))
    return fresh, counts.withColumn("duplicates", F.col("valid") - F.col("inserted"))


def without_source(stored: DataFrame, source: str) -> DataFrame:
    return stored.where(~F.col("source").eqNullSafe(source))


def new_sources(docs: DataFrame, stored: DataFrame, reindex: bool = False) -> tuple[DataFrame, DataFrame]:
    """(docs to ingest, stored chunks to keep): known sources are passed over, or replaced when reindexing."""
    known = stored.select("source").distinct()
    if reindex:
        return docs, stored.join(docs.select("source").distinct(), "source", "left_anti")
    return docs.join(known, "source", "left_anti"), stored
