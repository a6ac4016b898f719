"""Exact nearest neighbours: one query, many queries, within a radius, by group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dense, sparse
from ..schema import Metric

#: Queries of one block of the Arrow kernel; a block of scores stays at this times a batch of rows.
QUERY_BLOCK = 256
#: Above this many queries the query set is split in parts, each broadcast on its own.
BROADCAST_QUERIES = 10_000


def rounded(score: Column, digits: int | None) -> Column:
    return score if digits is None else F.round(score, digits)


def knn(df: DataFrame, query: dense.Vector, k: int, metric: Metric, condition: Column | None = None, keep: Sequence[str] | None = None, pk: str = "pk", vector: str = "vector", digits: int | None = None) -> DataFrame:
    """The k best rows as pk, score and the kept columns; ties by pk. The filter comes before the ranking."""
    if condition is not None:
        df = df.filter(condition)
    keep = [c for c in df.columns if c not in (pk, vector)] if keep is None else list(keep)
    scored = df.filter(F.col(vector).isNotNull()).select(pk, rounded(dense.distance(metric, F.col(vector), query), digits).alias("score"), *keep)
    return scored.orderBy(dense.best_first(metric, F.col("score")), pk).limit(k)


def within(df: DataFrame, query: dense.Vector, radius: float, metric: Metric, pk: str = "pk", vector: str = "vector", digits: int | None = None) -> DataFrame:
    """All rows at least as good as radius."""
    scored = df.filter(F.col(vector).isNotNull()).select(pk, rounded(dense.distance(metric, F.col(vector), query), digits).alias("score"))
    return scored.filter(F.col("score") >= radius if metric.higher_is_better else F.col("score") <= radius)


def products(metric: Metric, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Losses (less is better) of every query with every row, up to rounding."""
    dot = q @ x.T
    if metric is Metric.L2:
        return (q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * dot
    if metric is Metric.COSINE:
        scale = np.sqrt((q * q).sum(1)[:, None] * (x * x).sum(1)[None])
        return -np.divide(dot, scale, out=np.zeros_like(dot), where=scale > 0)
    return -dot


def losses(metric: Metric, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact losses along the last axis."""
    if metric is Metric.L2:
        return ((x - q) ** 2).sum(-1)
    dot = (x * q).sum(-1)
    if metric is Metric.COSINE:
        scale = np.sqrt((x * x).sum(-1) * (q * q).sum(-1))
        dot = np.divide(dot, scale, out=np.zeros_like(dot), where=scale > 0)
    return -dot


def matrix_of(column: pa.Array) -> np.ndarray:
    """Vectors without nulls as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(column), -1)


class Nearest:
    """The k best of the rows seen, for each of many queries; products choose the rows that are scored exactly."""

    SPARE = 4  # rows beyond k that are scored exactly for each query and block
    HELD = 1 << 21

    def __init__(self, matrix: np.ndarray, k: int, metric: Metric, digits: int | None):
        self.matrix, self.k, self.metric, self.digits = matrix, k, metric, digits
        self.pks: list = []
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, which: np.ndarray, x: np.ndarray, pks: list) -> None:
        """Meets the queries `which` with rows x."""
        base = len(self.pks)
        self.pks += pks
        for a in range(0, len(which), QUERY_BLOCK):
            own = which[a : a + QUERY_BLOCK]
            loss = products(self.metric, self.matrix[own], x)
            most = self.k + self.SPARE
            if len(x) <= most:
                at = np.broadcast_to(np.arange(len(x)), loss.shape)
                q, rows = np.repeat(own, len(x)), at.reshape(-1)
            else:
                at = np.argpartition(loss, most - 1, axis=1)[:, :most]
                cut = np.take_along_axis(loss, at, 1).max(1)
                cut += 1e-9 * (1 + abs(cut)) + (0 if self.digits is None else 10.0**-self.digits)
                tied = np.flatnonzero((loss <= cut[:, None]).sum(1) > most)  # more rows than taken may belong to the best
                q, rows = np.repeat(own, most), at.reshape(-1)
                if len(tied):
                    i, more = np.nonzero(loss[tied] <= cut[tied, None])
                    keep = ~np.isin(q, own[tied])
                    q, rows = np.concatenate([q[keep], own[tied][i]]), np.concatenate([rows[keep], more])
            score = losses(self.metric, self.matrix[q], x[rows])
            self.held.append((q, score if self.digits is None else np.round(score, self.digits), rows + base))
            self.size += len(q)
        if self.size > self.HELD:
            self.cut()

    def cut(self) -> None:
        """Keeps the k best of each query, ties by key, and the keys that they need."""
        if not self.held:
            return
        q, score, row = (np.concatenate(c) for c in zip(*self.held, strict=True))
        used, row = np.unique(row, return_inverse=True)
        keys = np.empty(len(used), object)
        keys[:] = [self.pks[i] for i in used.tolist()]
        rank = np.unique(keys, return_inverse=True)[1] if len(keys) else row
        order = np.lexsort([rank[row], score, q])
        q, score, row = q[order], score[order], row[order]
        starts = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        best = place < self.k
        self.held, self.pks, self.size = [(q[best], score[best], row[best])], keys.tolist(), int(best.sum())

    def batches(self, names: list) -> Iterator[pa.RecordBatch]:
        self.cut()
        for q, score, row in self.held:
            pks = [self.pks[i] for i in row.tolist()]
            score = -score + 0.0 if self.metric.higher_is_better else score
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in q.tolist()]), pa.array(pks), pa.array(score)], ["qid", "pk", "score"])


def query_block(queries: DataFrame) -> tuple[list, np.ndarray]:
    """qid and the matrix of qvec; at most BROADCAST_QUERIES rows."""
    table = queries.select("qid", F.col("qvec").cast("array<double>")).filter(F.col("qvec").isNotNull()).toArrow().combine_chunks()
    if not len(table):
        return [], np.zeros((0, 0))
    return table.column(0).to_pylist(), matrix_of(table.column(1).combine_chunks())


def _block_top(metric: Metric, names: list, matrix: np.ndarray, k: int, digits: int | None):
    """For mapInArrow: the k best rows of each task for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Nearest(matrix, k, metric, digits)
        for batch in batches:
            if len(batch) and names:
                best.add(np.arange(len(names)), matrix_of(batch.column(1)), batch.column(0).to_pylist())
        yield from best.batches(names)

    return run


def batch_knn(df: DataFrame, queries: DataFrame, k: int, metric: Metric, condition: Column | None = None, kernel: str = "auto", pk: str = "pk", vector: str = "vector", digits: int | None = None) -> DataFrame:
    """qid, rank, pk, score of the k best rows for each query (qid, qvec).

    kernel "expression" joins rows with the broadcast queries and ranks in a window, of
    which Spark keeps k rows a partition before the shuffle. kernel "arrow" multiplies
    blocks of rows and queries in numpy and shuffles k rows a query and task. "auto"
    takes the second from 8 queries on. Queries are counted; beyond BROADCAST_QUERIES
    they are searched in parts of that size.
    """
    spark = df.sparkSession
    if condition is not None:
        df = df.filter(condition)
    rows = df.filter(F.col(vector).isNotNull()).select(F.col(pk).alias("pk"), F.col(vector).alias("vector"))
    queries = queries.select("qid", "qvec")
    total = queries.count()
    order = Window.partitionBy("qid").orderBy(dense.best_first(metric, F.col("score")), "pk")
    if total > BROADCAST_QUERIES:
        parts = -(-total // BROADCAST_QUERIES)
        split = queries.withColumn("part", F.pmod(F.xxhash64("qid"), F.lit(parts)))
        out = None
        for p in range(parts):
            found = batch_knn(rows, split.filter(F.col("part") == p).drop("part"), k, metric, kernel=kernel, digits=digits)
            out = found if out is None else out.unionByName(found)
        return out
    if kernel == "arrow" or (kernel == "auto" and total >= 8):
        kinds = dict(queries.dtypes)["qid"], dict(rows.dtypes)["pk"]
        shared = spark.sparkContext.broadcast(query_block(queries))

        def run(batches):
            yield from _block_top(metric, *shared.value, k, digits)(batches)

        found = rows.mapInArrow(run, f"qid {kinds[0]}, pk {kinds[1]}, score double")
    else:
        found = rows.crossJoin(F.broadcast(queries)).select("qid", "pk", rounded(dense.distance(metric, F.col("vector"), F.col("qvec")), digits).alias("score"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("qid", "rank", "pk", "score")


def grouped_knn(df: DataFrame, query: dense.Vector, group: Column, groups: int, per_group: int, metric: Metric, condition: Column | None = None, candidate_pool: int | None = None, pk: str = "pk", vector: str = "vector", digits: int | None = None) -> DataFrame:
    """group_key, group_rank, rank, pk, score: the best rows of the groups with the best rows.

    Rows without a group are left out. With candidate_pool, groups are formed of so many
    best rows alone. Groups are ordered by their best score, then by key.
    """
    if condition is not None:
        df = df.filter(condition)
    scored = df.filter(F.col(vector).isNotNull()).select(F.col(pk).alias("pk"), group.alias("group_key"), rounded(dense.distance(metric, F.col(vector), query), digits).alias("score"))
    best = dense.best_first(metric, F.col("score"))
    if candidate_pool is not None:
        scored = scored.orderBy(best, "pk").limit(candidate_pool)
    scored = scored.filter(F.col("group_key").isNotNull())
    kept = scored.withColumn("rank", F.row_number().over(Window.partitionBy("group_key").orderBy(best, "pk"))).filter(F.col("rank") <= per_group)
    leaders = scored.groupBy("group_key").agg((F.max if metric.higher_is_better else F.min)("score").alias("best"))
    leaders = leaders.orderBy(dense.best_first(metric, F.col("best")), "group_key").limit(groups)
    ranked = leaders.withColumn("group_rank", F.row_number().over(Window.orderBy(dense.best_first(metric, F.col("best")), "group_key")))  # of `groups` rows
    return kept.join(F.broadcast(ranked), "group_key").select("group_key", "group_rank", "rank", "pk", "score")


def _sparse_score(metric: Metric, row: Column, terms: Column, qq: Column) -> Column:
    """Score of a sparse row with a query, given as a map of its terms and its squared norm; terms are looked up in the row's order."""
    zero = F.lit(0.0)
    pairs = F.zip_with(row["indices"], row["values"], lambda i, v: v.cast("double") * F.coalesce(F.try_element_at(terms, i), zero))
    dot = F.aggregate(pairs, zero, lambda a, x: a + x)
    vv = F.aggregate(row["values"], zero, lambda a, x: a + x.cast("double") * x.cast("double"))
    return {
        Metric.L2: vv + qq - 2 * dot,
        Metric.COSINE: F.when(vv * qq == 0, 0.0).otherwise(dot / F.sqrt(vv * qq)),
    }.get(metric, dot)


def _sparse_queries(queries: DataFrame) -> DataFrame:
    square = F.aggregate(F.col("sv")["values"], F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    terms = F.transform_values(sparse.as_map(F.col("sv")), lambda _, v: v.cast("double"))
    return queries.withColumn("terms", terms).withColumn("qq", square).drop("sv")


def sparse_knn(df: DataFrame, query: DataFrame, k: int, metric: Metric, pk: str = "pk", digits: int | None = None) -> DataFrame:
    """The k best rows of df (pk, sv) for a query of one row (sv), which goes to every task; rows are not shuffled.

    A row that shares no index scores 0 by product and cosine.
    """
    one = F.broadcast(_sparse_queries(query.select("sv").limit(1)))
    scored = df.select(pk, "sv").crossJoin(one).select(pk, rounded(_sparse_score(metric, F.col("sv"), F.col("terms"), F.col("qq")), digits).alias("score"))
    return scored.orderBy(dense.best_first(metric, F.col("score")), pk).limit(k)


def sparse_batch_knn(df: DataFrame, queries: DataFrame, k: int, metric: Metric, pk: str = "pk", digits: int | None = None) -> DataFrame:
    """qid, rank, pk, score of the k best rows for each sparse query (qid, sv).

    Queries are counted and broadcast in parts of at most BROADCAST_QUERIES; of a
    partition's rows, k a query reach the shuffle.
    """
    total = queries.count()
    if total > BROADCAST_QUERIES:
        parts = -(-total // BROADCAST_QUERIES)
        part = F.pmod(F.xxhash64("qid"), F.lit(parts))
        found = [sparse_batch_knn(df, queries.filter(part == p), k, metric, pk, digits) for p in range(parts)]
        return reduce(DataFrame.unionByName, found)
    rows = df.select(F.col(pk).alias("pk"), "sv").crossJoin(F.broadcast(_sparse_queries(queries.select("qid", "sv"))))
    scored = rows.select("qid", "pk", rounded(_sparse_score(metric, F.col("sv"), F.col("terms"), F.col("qq")), digits).alias("score"))
    order = Window.partitionBy("qid").orderBy(dense.best_first(metric, F.col("score")), "pk")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("qid", "rank", "pk", "score")
