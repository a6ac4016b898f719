"""Fusion of ranked lists and reranking.

Lists are rows (list_name, pk, score). A list's order is by score, best first, then by pk,
unless it has a column rank from 0.
"""

from __future__ import annotations

import asyncio
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import Metric

RRF_CONSTANT = 60


class EmptyInput(ValueError):
    """There are no lists to rerank."""


def _ranked(lists: DataFrame, higher_is_better: bool) -> DataFrame:
    if "rank" in lists.columns:
        return lists
    s = F.col("score")
    order = Window.partitionBy("list_name").orderBy(s.desc() if higher_is_better else s.asc(), "pk")
    return lists.withColumn("rank", F.row_number().over(order) - 1)


def _top(scored: DataFrame, k: int, higher_is_better: bool = True) -> DataFrame:
    s = F.col("score")
    return scored.orderBy(s.desc() if higher_is_better else s.asc(), "pk").limit(k)


def rrf(lists: DataFrame, k: int, higher_is_better: bool = True) -> DataFrame:
    """Sum of 1 / (60 + rank from 0)."""
    return _top(_ranked(lists, higher_is_better).groupBy("pk").agg(F.sum(F.lit(1.0) / (F.lit(RRF_CONSTANT) + F.col("rank"))).alias("score")), k)


def weighted_sum(lists: DataFrame, k: int, weights: dict[str, float] | None = None) -> DataFrame:
    """Scores scaled to 0..1 in each list (1 where all are equal), times the list's weight (1 if not given)."""
    w = Window.partitionBy("list_name")
    low, high = F.min("score").over(w), F.max("score").over(w)
    unit = F.when(high - low < 1e-12, 1.0).otherwise((F.col("score") - low) / (high - low))
    weight = F.lit(1.0)
    for name, x in (weights or {}).items():
        weight = F.when(F.col("list_name") == name, F.lit(float(x))).otherwise(weight)
    return _top(lists.withColumn("unit", unit).groupBy("pk").agg(F.sum(F.col("unit") * weight).alias("score")), k)


def intersect(lists: DataFrame, k: int, n_lists: int, higher_is_better: bool = True) -> DataFrame:
    """Keys in all n_lists lists, with their best score."""
    best = F.max("score") if higher_is_better else F.min("score")
    found = lists.groupBy("pk").agg(F.countDistinct("list_name").alias("n"), best.alias("score")).filter(F.col("n") == n_lists)
    return _top(found.select("pk", "score"), k, higher_is_better)


def union(lists: DataFrame, k: int, higher_is_better: bool = True) -> DataFrame:
    """All keys, with their best score."""
    best = F.max("score") if higher_is_better else F.min("score")
    return _top(lists.groupBy("pk").agg(best.alias("score")), k, higher_is_better)


def _reranked(lists: DataFrame, unit: Column, top_n: int) -> DataFrame:
    """The top_n keys by the sum of unit, with the further columns of the list first by name, in one aggregation."""
    rest = [c for c in lists.columns if c not in ("list_name", "pk", "score", "rank")]
    fields = [F.min_by(F.struct(*rest), "list_name").alias("f")] if rest else []
    scored = lists.groupBy("pk").agg(F.sum(unit).alias("score"), *fields)
    return _top(scored.select("pk", "score", *(["f.*"] if rest else [])), top_n)


def _some(lists: DataFrame) -> DataFrame:
    """Refuses lists that are known to be empty without running them; others that turn out empty give no rows."""
    most = lists._jdf.queryExecution().optimizedPlan().maxRows()
    if most.isDefined() and str(most.get()) == "0":
        raise EmptyInput("nothing to rerank")
    return lists


@dataclass(frozen=True)
class RrfReranker:
    """Sum of 1 / (constant + rank from 0 + 1)."""

    top_n: int = 10
    rank_constant: int = RRF_CONSTANT
    higher_is_better: bool = True

    def rerank(self, lists: DataFrame) -> DataFrame:
        one = F.lit(1.0) / (F.lit(self.rank_constant) + F.col("rank") + 1)
        return _reranked(_ranked(_some(lists), self.higher_is_better), one, self.top_n)


@dataclass(frozen=True)
class WeightedReranker:
    """Weighted sum of scores mapped to 0..1: distances by 1 - 2 atan(s) / pi, products by
    1/2 + atan(s) / pi, cosine distances by 1 - s / 2."""

    metric: Metric
    top_n: int = 10
    weights: dict[str, float] = field(default_factory=dict)

    def rerank(self, lists: DataFrame) -> DataFrame:
        s = F.col("score")
        unit = {Metric.L2: 1 - 2 * F.atan(s) / math.pi, Metric.COSINE: 1 - s / 2}.get(self.metric, 0.5 + F.atan(s) / math.pi)
        weight = F.lit(1.0)
        for name, x in self.weights.items():
            weight = F.when(F.col("list_name") == name, F.lit(float(x))).otherwise(weight)
        return _reranked(_some(lists), unit * weight, self.top_n)


class AsyncReranker:
    """Awaitable calls of a reranker; hits(lists) also runs the plan, in a thread of its own."""

    def __init__(self, inner: RrfReranker | WeightedReranker):
        self.inner = inner

    async def rerank(self, lists: DataFrame) -> DataFrame:
        return await asyncio.to_thread(self.inner.rerank, lists)

    async def hits(self, lists: DataFrame) -> list:
        return await asyncio.to_thread(lambda: self.inner.rerank(lists).collect())  # top_n rows
