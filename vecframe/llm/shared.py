"""What the operators share: the shared folder, written tables, documents in a defined shape."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Broadcast joins are asked for only when a side takes at most so many bytes, as summed over its rows.
BROADCAST_BYTES = 48 << 20

#: Bytes of an Arrow batch between Spark and Python, so that long texts don't pile up in a batch of many rows.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

_written: list[str] = []
_state: dict = {}


def worker_state(key, make=lambda: None):
    """What make() gives, kept by this Python worker until another key is asked for.

    Workers are reused, so that an operator's tables would else stay while others run.
    """
    if key not in _state:
        _state.clear()
        release()
        _state[key] = make()
        release()
    return _state[key]


def beside(key, make):
    """What make() gives, kept beside the tables of worker_state, and gone with them."""
    if key not in _state:
        _state[key] = make()
    return _state[key]


def release() -> None:
    """Gives back to the system what this Python worker has freed; allocators else keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(batches: Iterable) -> Iterator:
    """The batches; what was freed while one was worked on goes back to the system before the next."""
    for batch in batches:
        yield batch
        del batch
        release()


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's bound of bytes in an Arrow batch to BATCH_BYTES, for what the operators run and return."""
    now = str(spark.conf.get(BATCH_SETTING)).lower().removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def hadoop_path(spark: SparkSession, path: str):
    """path as Hadoop's Path with scheme, and its file system; without a scheme it is in the default one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(p), fs


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI below spark.checkpoint.dir, which driver and executors share.

    A folder without a scheme is in Hadoop's default file system. Where the setting is unset,
    a local session gets a temporary folder; any other session is an error, as a
    machine-local folder would lose files on a cluster. Folders go when the session ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="vecframe-")
        spark.sparkContext.setCheckpointDir(base)
    path, fs = hadoop_path(spark, f"{base.rstrip('/')}/vecframe/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}")
    fs.deleteOnExit(path)
    uri = path.toString()
    return "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors.

    With keep, the table outlives scratch().
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    if not keep:
        _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside go at its end; what is built on them must be written, to be kept, by then."""
    before = len(_written)
    try:
        yield
    finally:
        for p in _written[before:]:
            path, fs = hadoop_path(spark, p)
            fs.delete(path, True)
        del _written[before:]


def width(c: Column, kind: T.DataType) -> Column:
    """About the bytes that a value takes in a broadcast table."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("long") + 16
    if isinstance(kind, T.StructType):
        return sum((width(c[f.name], f.dataType) for f in kind.fields), F.lit(24).cast("long"))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.aggregate(c, F.lit(0).cast("long"), lambda n, x: n + width(x, kind.elementType)), F.lit(0).cast("long")) + 24
    return F.lit(8).cast("long")


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its rows take at most so many bytes (summed), else df as it is.

    Give it written tables, as they are read once more. Without the hint the join is by
    shuffle, where Spark splits the partitions of hot keys (spark.sql.adaptive.skewJoin).
    """
    total = df.agg(F.sum(sum((width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(32).cast("long"))).alias("n")).first()["n"] or 0
    return F.broadcast(df) if total <= most else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that no further column of docs can clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About `rows` rows of df (all, if it has no more), chosen by a hash of key.

    The same rows each time; the number strays from `rows` by a few square roots of it.
    """
    total = df.count()
    if total <= rows:
        return df
    return df.filter(F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1 << 30)) < int(rows / total * (1 << 30)))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32(doc_id as text) mod folds is fold; a document without an id is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(True))
