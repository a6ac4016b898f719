"""k-means on vectors in a DataFrame. Rows stay distributed; only centroids are on the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dense, let
from ..schema import Metric
from .search import losses, matrix_of, products

Centroids = list[list[float]]
#: Components of all centroids up to which they are written into an expression.
EXPRESSION_SIZE = 1_024
#: Vectors that seeds of k-means are drawn from, about.
SEED_ROWS = 20_000


def literal(centroids: Centroids) -> Column:
    return F.array(*(F.array(*(F.lit(float(x)) for x in c)) for c in centroids))


def nearest_rows(metric: Metric, x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the loss and place of the best row of c, the first of equals."""
    loss = products(metric, x, c)
    best = loss.argmin(1)
    least = loss[np.arange(len(x)), best]
    row, at = np.nonzero(loss <= (least + 1e-9 * (1 + abs(least)))[:, None])  # products round: near ones are compared exactly
    exact = losses(metric, x[row], c[at])
    order = np.lexsort([at, exact, row])
    first = order[np.append(True, row[order][1:] != row[order][:-1])] if len(order) else order
    return exact[first], at[first]


def assign(vector: Column, centroids: Centroids, metric: Metric = Metric.L2) -> Column:
    """STRUCT<d, cluster>: the nearest centroid, the first of equals; d ascends to the better (similarities are negated).

    Few centroids are literals of one expression; beyond EXPRESSION_SIZE components they
    travel once as a matrix and rows meet them in matrix products.
    """
    if sum(map(len, centroids)) > EXPRESSION_SIZE:
        matrix = np.array(centroids, "f8")

        @F.arrow_udf("d double, cluster int")
        def by_products(v: pa.Array) -> pa.Array:
            there = pc.is_valid(v)
            d, cluster = np.zeros(len(v)), np.zeros(len(v), "i4")
            at = np.flatnonzero(there.to_numpy(zero_copy_only=False))
            for a in range(0, len(at), 4096):
                rows = at[a : a + 4096]
                d[rows], cluster[rows] = nearest_rows(metric, matrix_of(v.take(pa.array(rows))), matrix)
            return pa.StructArray.from_arrays([pa.array(d), pa.array(cluster)], names=["d", "cluster"], mask=pc.invert(there))

        return by_products(vector.cast("array<double>"))

    def nearest(v: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            d = dense.distance(metric, v, c)
            return F.named_struct(F.lit("d"), -d if metric.higher_is_better else d, F.lit("cluster"), i)

        return F.array_min(F.transform(literal(centroids), one))

    return let(dense.vector(vector), nearest)


def lists(rows: np.ndarray, there: pa.Array) -> pa.Array:
    """A list of each row of a matrix; null where not there."""
    offsets = pa.array(np.arange(len(rows) + 1, dtype="i4") * rows.shape[1])
    return pa.ListArray.from_arrays(offsets, pa.array(rows.reshape(-1)), mask=pc.invert(there))


def picked(centroids: Centroids, at: Column) -> Column:
    """The centroid at a place, as literals or, beyond EXPRESSION_SIZE, from a matrix."""
    if sum(map(len, centroids)) <= EXPRESSION_SIZE:
        return F.get(literal(centroids), at)
    matrix = np.array(centroids, "f8")

    @F.arrow_udf("array<double>")
    def by_place(places: pa.Array) -> pa.Array:
        there = pc.is_valid(places)
        return lists(matrix[pc.fill_null(places, 0).to_numpy()], there)

    return by_place(at.cast("int"))


def assigned(df: DataFrame, centroids: Centroids, metric: Metric = Metric.L2, vector: str = "vector") -> DataFrame:
    """df with cluster and d; no shuffle."""
    return df.withColumn("_a", assign(F.col(vector), centroids, metric)).withColumn("cluster", F.col("_a.cluster")).withColumn("d", F.col("_a.d")).drop("_a")


def inertia(df: DataFrame, centroids: Centroids, metric: Metric = Metric.L2, vector: str = "vector") -> DataFrame:
    """One row: the sum of distances, or of negated similarities, to the nearest centroids."""
    return df.select(F.sum(assign(F.col(vector), centroids, metric)["d"]).alias("inertia"))


def means(df: DataFrame, centroids: Centroids, metric: Metric = Metric.L2, vector: str = "vector") -> DataFrame:
    """cluster, i, x, n: the mean of each component over each cluster with members. A task sends one sum a component."""
    k, dims = len(centroids), len(centroids[0])

    def add(batches):
        sums, n = np.zeros((k, dims)), np.zeros(k, "i8")
        for batch in batches:
            own, x = batch.column(0).to_numpy(), matrix_of(batch.column(1))
            np.add.at(sums, own, x)
            n += np.bincount(own, minlength=k)
        at = np.flatnonzero(n)
        columns = [np.repeat(at, dims), np.tile(np.arange(dims), len(at)), sums[at].reshape(-1), np.repeat(n[at], dims)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(columns, ("i4", "i4", "f8", "i8"), strict=True)], ["cluster", "i", "s", "n"])

    rows = df.select(F.col(vector).cast("array<double>").alias("v")).filter("v IS NOT NULL")
    parts = assigned(rows, centroids, metric, "v").select("cluster", "v").mapInArrow(add, "cluster int, i int, s double, n long")
    return parts.groupBy("cluster", "i").agg((F.sum("s") / F.sum("n")).alias("x"), F.sum("n").alias("n"))


def lloyd_step(df: DataFrame, centroids: Centroids, metric: Metric = Metric.L2, vector: str = "vector") -> Centroids:
    """New centroids; a cluster without members keeps its own."""
    new = [list(c) for c in centroids]
    for r in means(df, centroids, metric, vector).collect():  # clusters * dims numbers
        new[r.cluster][r.i] = r.x
    return new


def sampled(df: DataFrame, rows: int, seed: int, vector: str, key: str) -> np.ndarray:
    """About `rows` vectors (all, if there are no more), chosen and ordered by a hash of key and seed."""
    chosen = df.filter(F.col(vector).isNotNull()).select(F.xxhash64(F.lit(seed), F.col(key)).alias("h"), F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    total = chosen.count()
    if total > rows:
        chosen = chosen.filter(F.pmod(F.xxhash64("h", F.lit(1)), F.lit(1 << 30)) < int(rows / total * (1 << 30)))
    table = chosen.orderBy("h", "key").select("v").toArrow().combine_chunks()
    if not len(table):
        raise ValueError("no vectors to cluster")
    return matrix_of(table.column(0).combine_chunks())


def plus_plus(df: DataFrame, k: int, metric: Metric = Metric.L2, seed: int = 0, vector: str = "vector", key: str = "pk") -> Centroids:
    """k-means++ seeds from a sample of at most about SEED_ROWS vectors, in one pass over the data.

    Each next seed is drawn with the squared distance as weight, and uniformly where all
    weights are 0. The same seeds for the same rows, key and seed.
    """
    x = sampled(df, SEED_ROWS, seed, vector, key)
    rng = np.random.default_rng(seed)
    out = [int(rng.integers(len(x)))]
    least = np.full(len(x), np.inf)
    while len(out) < min(k, len(x)):
        d = losses(metric, x, x[out[-1]])
        least = np.minimum(least, d if metric is Metric.L2 else np.maximum(1 + d, 0.0))
        weight = least**2
        weight[out] = 0
        total = weight.sum()
        rest = np.ones(len(x)) if total == 0 else weight
        if total == 0:
            rest[out] = 0
        out.append(int(rng.choice(len(x), p=rest / rest.sum())))
    return x[out].tolist()


def kmeans(df: DataFrame, k: int, metric: Metric = Metric.L2, max_iters: int = 20, seed: int = 0, vector: str = "vector", key: str = "pk", init: Centroids | None = None) -> Centroids:
    """Lloyd's iterations from k-means++ seeds until nothing moves. k is cut to the number of rows."""
    if k <= 0:
        raise ValueError("k must be positive")
    total = df.filter(F.col(vector).isNotNull()).count()
    if not total:
        raise ValueError("no vectors to cluster")
    centroids = init or plus_plus(df, min(k, total), metric, seed, vector, key)
    for _ in range(max_iters):
        new = lloyd_step(df, centroids, metric, vector)
        if np.allclose(new, centroids, rtol=0, atol=1e-12):
            break
        centroids = new
    return centroids


def minibatch_step(df: DataFrame, centroids: Centroids, counts: list[int], batch: int, step: int = 0, metric: Metric = Metric.L2, seed: int = 0, vector: str = "vector", key: str = "pk") -> tuple[Centroids, list[int]]:
    """One mini-batch: members found with the old centroids move them as a running mean."""
    chosen = df.orderBy(F.xxhash64(F.lit(seed), F.lit(step), F.col(key)), key).limit(batch)
    new, counts = [list(c) for c in centroids], list(counts)
    rows = means(chosen, centroids, metric, vector).collect()
    for r in rows:
        old = counts[r.cluster]
        new[r.cluster][r.i] = (centroids[r.cluster][r.i] * old + r.x * r.n) / (old + r.n)
    for cluster, n in {(r.cluster, r.n) for r in rows}:
        counts[cluster] += n
    return new, counts


def minibatch_kmeans(df: DataFrame, k: int, batch: int = 256, steps: int = 20, metric: Metric = Metric.L2, seed: int = 0, vector: str = "vector", key: str = "pk") -> Centroids:
    if k <= 0:
        raise ValueError("k must be positive")
    centroids = plus_plus(df, min(k, df.count()), metric, seed, vector, key)
    counts = [0] * len(centroids)
    for step in range(steps):
        centroids, counts = minibatch_step(df, centroids, counts, batch, step, metric, seed, vector, key)
    return centroids


def elbow(df: DataFrame, ks, seed: int = 0, max_iters: int = 10, vector: str = "vector", key: str = "pk") -> list[tuple[int, float]]:
    """(k, inertia) for each k from 1."""
    return [(k, inertia(df, kmeans(df, k, Metric.L2, max_iters, seed, vector, key), Metric.L2, vector).collect()[0].inertia) for k in ks if k > 0]
