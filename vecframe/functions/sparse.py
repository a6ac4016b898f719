"""Sparse vectors: STRUCT<indices ARRAY<BIGINT>, values ARRAY<DOUBLE>>, indices ascending."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sparse(indices: Column, values: Column) -> Column:
    """Sorted by index; raises on arrays of different length and on repeated indices."""
    pairs = F.array_sort(F.arrays_zip(indices.cast("array<bigint>").alias("i"), values.cast("array<double>").alias("v")))
    bad = (F.size(indices) != F.size(values)) | (F.size(F.array_distinct(indices)) != F.size(indices))
    made = F.struct(F.transform(pairs, lambda p: p["i"]).alias("indices"), F.transform(pairs, lambda p: p["v"]).alias("values"))
    return F.when(~bad, made).otherwise(F.raise_error(F.lit("indices and values differ in length, or an index is repeated")))


def from_dense(v: Column, threshold: float = 0.0) -> Column:
    """The components of at least the threshold in absolute value."""
    pairs = F.filter(F.transform(v.cast("array<double>"), lambda x, i: F.struct(i.cast("bigint").alias("i"), x.alias("v"))), lambda p: F.abs(p["v"]) >= threshold)
    return F.struct(F.transform(pairs, lambda p: p["i"]).alias("indices"), F.transform(pairs, lambda p: p["v"]).alias("values"))


def to_dense(s: Column, dims: int) -> Column:
    """An array of dims doubles; indices from dims on are dropped."""
    m = as_map(s)
    return F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(dims - 1).cast("bigint")), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0)))


def as_map(s: Column) -> Column:
    return F.map_from_arrays(s["indices"], s["values"])


def nnz(s: Column) -> Column:
    return F.size(s["indices"])


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def _merged(a: Column, b: Column, f) -> Column:
    zero = F.lit(0.0)
    return _sum(F.map_values(F.map_zip_with(as_map(a), as_map(b), lambda _, x, y: f(F.coalesce(x, zero), F.coalesce(y, zero)))))


def dot(a: Column, b: Column) -> Column:
    return _merged(a, b, lambda x, y: x * y)


def l2_squared(a: Column, b: Column) -> Column:
    return _merged(a, b, lambda x, y: (x - y) * (x - y))


def cosine(a: Column, b: Column) -> Column:
    norm = lambda s: _sum(F.transform(s["values"], lambda x: x * x))
    scale = F.sqrt(norm(a) * norm(b))
    return F.when(scale == 0, 0.0).otherwise(dot(a, b) / scale)
