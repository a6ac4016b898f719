"""Snapshots of collections: Parquet versions behind a pointer, or in memory.

A version is a folder that is never changed. A commit writes the next one and then
renames a new pointer into place, so readers see one version or the other. All
paths go through Hadoop's file systems.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from ..schema import CollectionConfig


class SnapshotStore(Protocol):
    backend_type: str

    def read(self) -> tuple[DataFrame, CollectionConfig] | None: ...

    def commit(self, df: DataFrame, config: CollectionConfig) -> bool: ...

    def disk_size(self) -> int: ...


class MemoryStore:
    """Holds the frame itself; nothing survives the session."""

    backend_type = "memory"

    def __init__(self):
        self.held: tuple[DataFrame, CollectionConfig] | None = None

    def read(self):
        return self.held

    def commit(self, df: DataFrame, config: CollectionConfig) -> bool:
        self.held = (df, config)
        return False

    def disk_size(self) -> int:
        return 0


class ParquetStore:
    """<root>/<name>/v=N/ with data and config, and <root>/<name>/_CURRENT."""

    backend_type = "parquet"

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark = spark
        self.base = f"{root.rstrip('/')}/{name}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self.base}/{name}")

    def _text(self, name: str) -> str | None:
        if not self.fs.exists(self._at(name)):
            return None
        stream = self.fs.open(self._at(name))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, name: str, text: str) -> None:
        stream = self.fs.create(self._at(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    @property
    def version(self) -> int:
        return int(self._text("_CURRENT") or 0)

    def read(self, version: int | None = None):
        n = version or self.version
        if not n:
            return None
        return self.spark.read.parquet(f"{self.base}/v={n}/data"), CollectionConfig.from_json(self._text(f"v={n}/_config.json"))

    def commit(self, df: DataFrame, config: CollectionConfig) -> bool:
        n = self.version + 1
        while self.fs.exists(self._at(f"v={n}")):  # left by a commit that did not end
            n += 1
        df.write.parquet(f"{self.base}/v={n}/data")
        self._write(f"v={n}/_config.json", config.to_json())
        self._write(f"_CURRENT.{n}", str(n))
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri())
        overwrite = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self._at(f"_CURRENT.{n}"), self._at("_CURRENT"), overwrite)
        return True

    def disk_size(self) -> int:
        return self.fs.getContentSummary(self._path(self.base)).getLength() if self.fs.exists(self._path(self.base)) else 0

    def vacuum(self, keep: int = 1) -> None:
        """Deletes versions older than the last `keep`."""
        last = self.version
        for status in self.fs.listStatus(self._path(self.base)):
            name = status.getPath().getName()
            if name.startswith("v=") and int(name[2:]) <= last - keep:
                self.fs.delete(status.getPath(), True)


def open_store(spark: SparkSession, kind: str, root: str | None = None, name: str | None = None) -> SnapshotStore:
    if kind == "memory":
        return MemoryStore()
    if kind == "parquet" and root and name:
        return ParquetStore(spark, root, name)
    raise ValueError(f"no store {kind!r} of {root!r}, {name!r}")
