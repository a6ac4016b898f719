"""Changes of collections as new DataFrames: upsert, delete, merge, schema evolution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_of_each(rows: DataFrame, seq: str, pk: str = "pk") -> DataFrame:
    """One row for each key: that of the highest seq."""
    return rows.groupBy(pk).agg(F.max_by(F.struct(*rows.columns), seq).alias("row")).select("row.*")


def upsert(old: DataFrame, new: DataFrame, pk: str = "pk") -> DataFrame:
    """new replaces whole rows of old by key."""
    return old.join(new.select(pk), pk, "left_anti").select(*old.columns).unionByName(new, allowMissingColumns=True)


def upsert_batch(old: DataFrame, new: DataFrame, seq: str, pk: str = "pk") -> DataFrame:
    """As upsert; of repeated keys in new the last by seq wins."""
    return upsert(old, last_of_each(new, seq, pk).drop(seq), pk)


def remove(df: DataFrame, keys, pk: str = "pk") -> DataFrame:
    return df.filter(~F.col(pk).isin(list(keys)))


def delete(df: DataFrame, rest: Column) -> DataFrame:
    """The rows that stay: rest is the condition of the negated filter."""
    return df.filter(rest)


def merge(first: DataFrame, *others: DataFrame, pk: str = "pk") -> DataFrame:
    """All rows; of equal keys the row of the latest frame, in one shuffle."""
    if not others:
        return first
    numbered = [df.withColumn("_source", F.lit(n)) for n, df in enumerate((first, *others))]
    return last_of_each(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered), "_source", pk).drop("_source")


def add_field(df: DataFrame, name: str, extra: str = "_extra") -> DataFrame:
    """A column of the undeclared values of that name."""
    if extra not in df.columns:
        return df.withColumn(name, F.lit(None).cast("string"))
    return df.withColumn(name, F.try_element_at(extra, F.lit(name))).withColumn(extra, F.map_filter(extra, lambda k, _: k != name))


def postings(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """field, value, pk: each value of each filtered field, each distinct tag of each tags field."""
    from ..filters.compile import tags

    def values(name: str, role: str) -> Column:
        v = F.col(name)
        return F.when(v.isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(tags(v), lambda t: t != "")) if role == "tags" else F.array(v))

    pairs = F.flatten(F.array(*(_named(values(n, r), n) for n, r in fields.items())))
    return df.select("pk", F.explode(pairs).alias("p")).select("p.field", "p.value", "pk")


def _named(values: Column, name: str) -> Column:
    return F.transform(values, lambda x: F.struct(F.lit(name).alias("field"), x.alias("value")))


def posting_stats(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """field, terms, avg_posting, max_posting."""
    sizes = postings(df, fields).groupBy("field", "value").agg(F.count("*").alias("n"))
    return sizes.groupBy("field").agg(F.count("*").alias("terms"), F.avg("n").alias("avg_posting"), F.max("n").alias("max_posting"))
