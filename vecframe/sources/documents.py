"""Any table as documents of a collection: pk, vector and string fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(df: DataFrame, pk: str, vector: str | None = None, fields: Sequence[str] | None = None, tags: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """pk as string, vector as floats (null if none), fields as strings, and columns of joined tags."""
    fields = [c for c in df.columns if c not in (pk, vector)] if fields is None else fields
    v = F.col(vector).cast("array<float>") if vector else F.lit(None).cast("array<float>")
    joined = [F.concat_ws(",", *(F.col(c).cast("string") for c in cs)).alias(n) for n, cs in (tags or {}).items()]
    return df.select(F.col(pk).cast("string").alias("pk"), v.alias("vector"), *(F.col(c).cast("string").alias(c) for c in fields), *joined)


def read(spark: SparkSession, path: str, kind: str = "parquet", schema=None, **options) -> DataFrame:
    """A table of any of Spark's file formats."""
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)
