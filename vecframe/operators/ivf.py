"""Inverted files: rows in buckets of their nearest centroid, of which a query reads a few."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dense
from ..schema import Metric
from . import cluster, search
from .quantize import ProductQuantizer


#: Files of a saved bucket at most.
BUCKET_FILES = 8


@dataclass(frozen=True)
class IvfParams:
    n_list: int = 100
    n_probe: int = 10
    n_iters: int = 10
    pq_m: int = 8


def _np_distance(metric: Metric, a: list[float], b: list[float]) -> float:
    dot = sum(x * y for x, y in zip(a, b, strict=True))
    if metric is Metric.L2:
        return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    if metric is Metric.COSINE:
        norm = (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
        return dot / norm if norm else 0.0
    return dot


@dataclass(frozen=True)
class IvfIndex:
    """Rows keep their columns and get bucket; saved, they are partitioned by it, so probes prune files."""

    centroids: cluster.Centroids
    metric: Metric = Metric.L2
    params: IvfParams = IvfParams()

    @classmethod
    def train(cls, df: DataFrame, metric: Metric = Metric.L2, params: IvfParams = IvfParams(), seed: int = 0, vector: str = "vector", key: str = "pk") -> IvfIndex:
        """Lloyd's rounds from distinct random rows."""
        first = df.filter(F.col(vector).isNotNull()).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(params.n_list)
        centroids = [list(r.v) for r in first.select(F.col(vector).cast("array<double>").alias("v")).collect()]
        if not centroids:
            raise ValueError("no vectors to train on")
        return cls(cluster.kmeans(df, len(centroids), metric, params.n_iters, seed, vector, key, init=centroids), metric, params)

    def bucketed(self, df: DataFrame, vector: str = "vector") -> DataFrame:
        return df.withColumn("bucket", cluster.assign(F.col(vector), self.centroids, self.metric)["cluster"])

    def save(self, df: DataFrame, path: str, vector: str = "vector", key: str = "pk") -> None:
        """Writes buckets as partitions; a hot bucket is dealt over BUCKET_FILES tasks."""
        salt = F.pmod(F.xxhash64(key), F.lit(BUCKET_FILES))
        self.bucketed(df, vector).repartition("bucket", salt).write.partitionBy("bucket").parquet(path)

    def insert(self, bucketed: DataFrame, rows: DataFrame, vector: str = "vector", key: str = "pk") -> DataFrame:
        """bucketed with rows in their buckets; rows replace those of the same key."""
        return self.remove(bucketed, rows.select(key), key).unionByName(self.bucketed(rows, vector))

    def remove(self, bucketed: DataFrame, keys: DataFrame, key: str = "pk") -> DataFrame:
        return bucketed.join(keys.select(key), key, "left_anti").select(*bucketed.columns)

    @staticmethod
    def size(bucketed: DataFrame) -> int:
        return bucketed.count()

    def statistics(self, bucketed: DataFrame) -> DataFrame:
        """bucket, n of every bucket, empty ones too: how evenly the index is filled."""
        every = bucketed.sparkSession.range(len(self.centroids)).select(F.col("id").cast("int").alias("bucket"))
        counted = bucketed.groupBy("bucket").agg(F.count("*").alias("n"))
        return every.join(counted, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))

    def probes_for(self, candidates: int, rows: int) -> int:
        """The number of buckets that hold about so many candidates: a search budget given in rows."""
        return max(1, min(len(self.centroids), -(-candidates * len(self.centroids) // max(rows, 1))))

    def probes(self, query: list[float], n_probe: int | None = None) -> list[int]:
        """The buckets to read, best first."""
        n = min(n_probe or self.params.n_probe, len(self.centroids))
        d = [_np_distance(self.metric, c, query) for c in self.centroids]
        return sorted(range(len(d)), key=lambda i: (-d[i] if self.metric.higher_is_better else d[i], i))[:n]

    def search(self, bucketed: DataFrame, query: list[float], k: int, n_probe: int | None = None, **options) -> DataFrame:
        """Exact within the probed buckets."""
        return search.knn(bucketed.filter(F.col("bucket").isin(self.probes(query, n_probe))), query, k, self.metric, **options)

    def batch_search(self, bucketed: DataFrame, queries: DataFrame, k: int, n_probe: int | None = None, pk: str = "pk", vector: str = "vector", digits: int | None = None) -> DataFrame:
        """qid, rank, pk, score for many queries (qid, qvec).

        Queries are counted and broadcast in parts of at most search.BROADCAST_QUERIES. The
        rows of a bucket meet the queries that read it in matrix products, where they lie;
        a task sends k rows a query to the shuffle.
        """
        n = min(n_probe or self.params.n_probe, len(self.centroids))
        total = queries.count()
        if total > search.BROADCAST_QUERIES:
            parts = -(-total // search.BROADCAST_QUERIES)
            part = F.pmod(F.xxhash64("qid"), F.lit(parts))
            return reduce(DataFrame.unionByName, [self.batch_search(bucketed, queries.filter(part == p), k, n_probe, pk, vector, digits) for p in range(parts)])
        names, matrix = search.query_block(queries)
        kinds = dict(queries.dtypes)["qid"], dict(bucketed.dtypes)[pk]
        readers: dict[int, list[int]] = {}
        centers = np.array(self.centroids, "f8")
        for a in range(0, len(names), 1024):
            block = matrix[a : a + 1024]
            exact = np.stack([search.losses(self.metric, block, c) for c in centers], 1)
            for q, buckets in enumerate(exact.argsort(1, kind="stable")[:, :n].tolist(), a):
                for b in buckets:
                    readers.setdefault(b, []).append(q)
        metric = self.metric
        shared = bucketed.sparkSession.sparkContext.broadcast((names, matrix, {b: np.array(q) for b, q in readers.items()}))

        def run(batches):
            names, matrix, readers = shared.value
            best = search.Nearest(matrix, k, metric, digits)
            for batch in batches:
                x, pks, own = search.matrix_of(batch.column(1)), batch.column(0).to_pylist(), batch.column(2).to_numpy()
                for b in np.unique(own).tolist():
                    if b in readers:
                        at = np.flatnonzero(own == b)
                        best.add(readers[b], x[at], [pks[i] for i in at.tolist()])
            yield from best.batches(names)

        rows = bucketed.select(F.col(pk).alias("pk"), F.col(vector).cast("array<double>").alias("v"), F.col("bucket").cast("int")).filter("v IS NOT NULL")
        found = rows.mapInArrow(run, f"qid {kinds[0]}, pk {kinds[1]}, score double")
        w = Window.partitionBy("qid").orderBy(dense.best_first(self.metric, F.col("score")), "pk")
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("qid", "rank", "pk", "score")


@dataclass(frozen=True)
class IvfPqIndex:
    """Buckets hold product codes of the differences to their centroids. L2 alone."""

    ivf: IvfIndex
    pq: ProductQuantizer

    def __post_init__(self):
        if self.ivf.metric is not Metric.L2:
            raise ValueError("product codes measure L2 alone")

    @classmethod
    def train(cls, df: DataFrame, dims: int, params: IvfParams = IvfParams(), k: int = 256, seed: int = 0, vector: str = "vector", key: str = "pk") -> IvfPqIndex:
        ivf = IvfIndex.train(df, Metric.L2, params, seed, vector, key)
        rest = ivf.bucketed(df, vector).withColumn("residual", residual(F.col(vector), F.col("bucket"), ivf))
        return cls(ivf, ProductQuantizer.train(rest, dims, params.pq_m, k, params.n_iters, seed, "residual", key))

    def encoded(self, df: DataFrame, vector: str = "vector") -> DataFrame:
        """df with bucket and codes instead of the vector."""
        b = self.ivf.bucketed(df, vector)
        return b.withColumn("codes", self.pq.encode(residual(F.col(vector), F.col("bucket"), self.ivf))).drop(vector)

    def search(self, encoded: DataFrame, query: list[float], k: int, n_probe: int | None = None, pk: str = "pk", digits: int | None = None) -> DataFrame:
        """pk, score: a distance table for each probed bucket, made once on the driver."""
        probes = self.ivf.probes(query, n_probe)
        score = F.lit(None).cast("double")
        for b in probes:
            rest = [q - c for q, c in zip(query, self.ivf.centroids[b], strict=True)]
            score = F.when(F.col("bucket") == b, self.pq.adc(F.col("codes"), rest)).otherwise(score)
        rows = encoded.filter(F.col("bucket").isin(probes)).select(pk, search.rounded(score, digits).alias("score"))
        return rows.orderBy("score", pk).limit(k)


def residual(v, bucket, ivf: IvfIndex):
    return F.zip_with(dense.vector(v), cluster.picked(ivf.centroids, bucket), lambda x, c: x - c)
