"""What the operators share: bounded broadcasts and batches; the shared folder and written tables are the library's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path, share_code, shared_dir, stored

__all__ = ["BROADCAST_ROWS", "arrow_batches", "fresh_path", "maybe_broadcast", "shared_dir", "stored"]

#: Rows up to which a table of a few longs a row (some 16 MB) may be broadcast.
BROADCAST_ROWS = 500_000


def maybe_broadcast(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df (already stored, so counting is cheap) with a broadcast hint if it has few enough rows."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def arrow_batches(spark: SparkSession, rows: int = 500, size: int = 16 << 20) -> None:
    """Arrow batches of at most ``rows`` rows and about ``size`` bytes, as a row may hold a long text; and workers that find this package."""
    share_code(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
