"""Incremental ingest with Structured Streaming: state by content hash, files committed by batch.

Which hashes are known is state, kept by hash in a RocksDB store: a batch looks up its own hashes only, so its cost doesn't grow with what
has been ingested. The file sink lists a batch's files in its log once all are written, and readers go by that log: a batch that fails
half-way leaves nothing, and one that is run again appends nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import prepared
from ..session import share_code

STATE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def document_stream(spark: SparkSession, path: str, schema: str, files_at_once: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def fresh_chunks(docs: DataFrame, text: str = "text", source: str = "source", known: DataFrame | None = None) -> DataFrame:
    """The valid chunks of a stream of documents, each content once. ``known``: chunks (hash) that were ingested before the stream began.

    Of equal chunks in one batch any one is taken.
    """
    rows = prepared(docs, source=source, text=text).where("valid").drop("valid")
    if known is not None:
        rows = rows.join(known.select("hash").distinct(), "hash", "left_anti").select(*rows.columns)
    return rows.dropDuplicates(["hash"])


def ingest_stream(docs: DataFrame, out: str, checkpoint: str, text: str = "text", source: str = "source", known: DataFrame | None = None) -> StreamingQuery:
    """Appends to ``out`` the chunks of each micro-batch that haven't come before. ``out`` is the stream's own: read it as a table of Parquet files."""
    spark = docs.sparkSession
    share_code(spark)
    before = spark.conf.get(STATE, None)
    spark.conf.set(STATE, ROCKS)
    try:
        rows = fresh_chunks(docs, text, source, known)
        return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.unset(STATE) if before is None else spark.conf.set(STATE, before)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An extension: events (ts, event_type, value) by window and type, for streams with late rows."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("avg_value"))
