"""Distances of dense vectors (arrays of floats), summed in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..schema import Metric
from . import let

Vector = Column | Sequence[float]


def vector(v: Vector) -> Column:
    """A column as doubles; a sequence as a literal array."""
    return v.cast("array<double>") if isinstance(v, Column) else F.array(*(F.lit(float(x)) for x in v))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def l2_squared(a: Vector, b: Vector) -> Column:
    """The squared distance, not its root."""
    return _sum(F.zip_with(vector(a), vector(b), lambda x, y: (x - y) * (x - y)))


def inner_product(a: Vector, b: Vector) -> Column:
    return _sum(F.zip_with(vector(a), vector(b), lambda x, y: x * y))


def squared_norm(a: Vector) -> Column:
    return _sum(F.transform(vector(a), lambda x: x * x))


def cosine_similarity(a: Vector, b: Vector) -> Column:
    """0 where either vector is zero."""
    scale = F.sqrt(squared_norm(a) * squared_norm(b))
    return F.when(scale == 0, 0.0).otherwise(inner_product(a, b) / scale)


def l2_normalize(a: Vector) -> Column:
    """A zero vector stays as it is."""
    return let(vector(a), lambda v: let(F.sqrt(squared_norm(v)), lambda n: F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))))


def distance(metric: Metric, a: Vector, b: Vector) -> Column:
    return {Metric.L2: l2_squared, Metric.IP: inner_product, Metric.MIPS: inner_product, Metric.COSINE: cosine_similarity}[metric](a, b)


def best_first(metric: Metric, score: Column) -> Column:
    return score.desc() if metric.higher_is_better else score.asc()


def register(spark: SparkSession) -> None:
    """l2_squared, inner_product and cosine_similarity for spark.sql, as SQL functions that Catalyst inlines."""
    pair = "(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN"
    dot = "aggregate(zip_with({}, {}, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION l2_squared{pair} aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION inner_product{pair} {dot.format('a', 'b')}")
    norm = f"sqrt({dot.format('a', 'a')} * {dot.format('b', 'b')})"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION cosine_similarity{pair} CASE WHEN {norm} = 0 THEN 0D ELSE {dot.format('a', 'b')} / {norm} END")
