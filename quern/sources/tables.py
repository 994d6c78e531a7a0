"""Versioned Parquet tables: Parquet has no MERGE, so a change writes a new version and then moves the pointer."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class _Folder:
    """A folder on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        at = self._path(path)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []


class VersionedTable(_Folder):
    """A folder with versions and numbered pointers, of which the highest counts: none is ever deleted or changed, so a reader always finds one."""

    def _pointer(self) -> int:
        return max((int(n.split("-")[1]) for n in self._names(self.path) if n.startswith("CURRENT-")), default=0)

    def version(self) -> str | None:
        at = self._pointer()
        return self.spark.read.text(f"{self.path}/CURRENT-{at}").first()[0] if at else None

    def read(self) -> DataFrame | None:
        version = self.version()
        return self.spark.read.parquet(f"{self.path}/{version}") if version else None

    def replace(self, df: DataFrame) -> str:
        """Writes df, which may read the current version, as the new one. Readers see the old one until the next pointer is there.

        Of two writers at once, the one whose pointer comes second fails.
        """
        after = self._pointer()
        version = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{version}")
        draft = self._path(f"{self.path}/draft-{version}")
        out = self._fs.create(draft)
        out.write(bytearray(version.encode()))
        out.close()
        # A rename doesn't replace what is there.
        if not self._fs.rename(draft, self._path(f"{self.path}/CURRENT-{after + 1}")):
            raise RuntimeError(f"{self.path} was replaced by another writer")
        return version


class AppendTable(_Folder):
    """A folder of additions, each a whole Parquet write of its own. An addition counts once its mark of success is there, so one that fails
    half-way leaves nothing; one of a name that is there already is not made again."""

    def additions(self) -> list[str]:
        return sorted(n for n in self._names(self.path) if "_SUCCESS" in self._names(f"{self.path}/{n}"))

    def read(self) -> DataFrame | None:
        parts = [f"{self.path}/{n}" for n in self.additions()]
        return self.spark.read.parquet(*parts) if parts else None

    def add(self, df: DataFrame, name: str | None = None) -> None:
        name = name or uuid.uuid4().hex
        if name not in self.additions():
            df.write.mode("overwrite").parquet(f"{self.path}/{name}")
