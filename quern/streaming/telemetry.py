"""Telemetry as a stream: running totals, and the last records kept in a log that never grows beyond them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import telemetry
from ..sources.tables import VersionedTable


class TelemetryLog:
    """The last ``n`` records by ``order``: an addition writes the new last n as the next version, so the log is compact at any time."""

    def __init__(self, spark: SparkSession, path: str, n: int = 1000, order: tuple[str, ...] = ("ts", "event_id")):
        self.table, self.n, self.order = VersionedTable(spark, path), n, order

    def read(self, n: int | None = None) -> DataFrame | None:
        """The last n records, latest first."""
        rows = self.table.read()
        return None if rows is None else telemetry.tail(rows.drop("__batch"), min(n or self.n, self.n), self.order)

    def add(self, records: DataFrame, batch: int | None = None) -> None:
        """Adds records; those of a batch that was added before take the place of its earlier ones."""
        new = telemetry.tail(records, self.n, self.order).withColumn("__batch", F.lit(batch).cast("long"))
        old = self.table.read()
        if old is not None:
            if batch is not None:
                old = old.where(F.col("__batch").isNull() | (F.col("__batch") != batch))
            new = old.unionByName(new)
        self.table.replace(telemetry.tail(new, self.n, self.order))


def log_stream(records: DataFrame, path: str, checkpoint: str, n: int = 1000, order: tuple[str, ...] = ("ts", "event_id")) -> StreamingQuery:
    """Keeps the last n records of a stream in a TelemetryLog. What a batch brings is cut to its own last n in the tasks that read it."""

    def add(batch: DataFrame, number: int) -> None:
        TelemetryLog(batch.sparkSession, path, n, order).add(batch, number)

    return records.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals_stream(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the totals of all records of a stream (elapsed_ms, chars, used), the row that telemetry.summary() gives, as the newest version of
    a table. The state is one row of sums and counts."""

    def put(batch: DataFrame, _: int) -> None:
        VersionedTable(batch.sparkSession, path).replace(batch)

    return telemetry.summary(records).writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
