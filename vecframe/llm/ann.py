"""Approximate nearest neighbours by an inverted multi-index.

The two halves of the vectors are quantised separately; a cell is a pair of centroids.
A query walks the pairs by summed distance with a heap until the cells met hold a
given share of all rows, and those rows are ranked by the exact distance. Every row is
in the index; only the centroids come from a bounded sample.

Cells are laid on shelves of bounded size, large ones cut into blocks by a hash of the
key, so that one group holds a bounded number of rows, whatever cell is crowded. Queries
go to the shelves on which they have cells, in bounded blocks too.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_batches, bounded_sample

FIT_ROWS = 20_000
#: Centroids of a half at most, and so the root of the number of cells.
CENTROIDS = 128
#: The share of all rows that the cells of a query hold together.
SHARE = 0.5
SHELF_ROWS = (256, 20_000)
QUERY_BLOCK = 4_096


def usable(column: str, dims: int):
    """Whether a vector takes part: it has dims components, all finite, one of them not zero."""
    c = F.col(column)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return c.isNotNull() & (F.size(c) == dims) & ~F.exists(c, bad) & F.exists(c, lambda x: x != 0)


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centers)
        n = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, x[:, j], k) for j in range(x.shape[1])], 1)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
    return centers


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.concatenate([((centers**2).sum(1) - 2 * x[a : a + 8192] @ centers.T).argmin(1) for a in range(0, len(x), 8192)] or [np.empty(0, "i8")])


class MultiIndex:
    """Centroids of both halves, the rows of each cell and the shelf of each block of a cell."""

    def __init__(self, sample: np.ndarray, k: int, seed: int = 5):
        self.half = sample.shape[1] // 2
        self.k = min(k, len(sample))
        self.a = k_means(sample[:, : self.half], self.k, seed)
        self.b = k_means(sample[:, self.half :], self.k, seed + 1)

    def cells(self, x: np.ndarray) -> np.ndarray:
        return nearest(x[:, : self.half], self.a) * self.k + nearest(x[:, self.half :], self.b)

    def lay(self, counts: np.ndarray, shelf_rows: int) -> None:
        """Fills shelves with blocks of cells in order; counts has the rows of each cell."""
        self.counts = counts
        self.blocks = np.maximum(1, -(-counts // shelf_rows))
        self.first = np.concatenate([[0], np.cumsum(self.blocks)])
        sizes = np.repeat(counts / self.blocks, self.blocks)
        self.shelf = (np.cumsum(sizes) - sizes / 2) // shelf_rows
        self.shelf = np.unique(self.shelf, return_inverse=True)[1].astype("i8")

    def walk(self, query: np.ndarray, rows: float) -> list[int]:
        """Cells in the order of summed distance until they hold so many rows."""
        da, db = ((self.a - query[: self.half]) ** 2).sum(1), ((self.b - query[self.half :]) ** 2).sum(1)
        oa, ob = da.argsort(kind="stable"), db.argsort(kind="stable")
        da, db = da[oa].tolist(), db[ob].tolist()
        heap, met, total = [(da[0] + db[0], 0, 0)], [], 0
        while heap and total < rows:
            _, i, j = heapq.heappop(heap)
            cell = int(oa[i]) * self.k + int(ob[j])
            if n := int(self.counts[cell]):
                met.append(cell)
                total += n
            if j + 1 < self.k:
                heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
            if j == 0 and i + 1 < self.k:
                heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))
        return met


def rerank(queries: np.ndarray, own: np.ndarray, probes: list[np.ndarray], ids: np.ndarray, x: np.ndarray, cells: np.ndarray, k: int):
    """For each query the k nearest ids of its cells, each by its nearest row: (query's place, row's place, distance)."""
    out = []
    repeated = len(np.unique(ids)) < len(ids)
    for q in range(len(queries)):
        at = np.flatnonzero(np.isin(cells, probes[q]) & (ids != own[q]))
        if not len(at):
            continue
        d = np.sqrt(((x[at] - queries[q]) ** 2).sum(1))
        if repeated:
            order = np.lexsort([d, ids[at]])
            at, d = at[order], d[order]
            nearest_row = np.append(True, ids[at][1:] != ids[at][:-1])
            at, d = at[nearest_row], d[nearest_row]
        if len(at) > k:
            keep = d <= np.partition(d, k - 1)[k - 1]
            at, d = at[keep], d[keep]
        order = np.lexsort([ids[at], d])[:k]
        out.append((np.full(len(order), q), at[order], d[order]))
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0)]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, dims)


def search(vectors: DataFrame, is_query, k: int = 10, share: float = SHARE, centroids: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each row that is_query selects.

    vectors needs vec_id and embedding; further columns are ignored. Vectors take no part
    if null, all zero, with null or non-finite components, or of another length than most
    (the longest in ties); nor do rows without vec_id. Components are compared as doubles.
    Rows of a query's own vec_id are no candidates. Rows with the same vec_id are one
    vector in several places: a query or candidate counts once, by its nearest row. Ties
    go to the smaller vec_id. Too few candidates: all of them. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    out = "query_id long, rank int, vec_id long, score double"
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id IS NOT NULL AND embedding IS NOT NULL")
    lengths = base.groupBy(F.size("embedding").alias("d")).count().filter("d > 0").orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], out)
    dims = lengths[0].d
    base = base.filter(usable("embedding", dims))
    total, ids = base.agg(F.count("*"), F.count_distinct("vec_id")).first()
    if not total:
        return spark.createDataFrame([], out)
    sample = bounded_sample(base, "vec_id", FIT_ROWS).toArrow()
    fitted = _matrix(sample.column("embedding").combine_chunks(), dims)[np.argsort(sample.column("vec_id").to_numpy(), kind="stable")].astype("f8")
    index = MultiIndex(fitted, centroids or int(np.clip(round(5 * total**0.5), 2, CENTROIDS)))
    shared = spark.sparkContext.broadcast(index)

    def place(batches):
        for batch in batches:
            cells = shared.value.cells(_matrix(batch.column(1), dims).astype("f8")) if len(batch) else np.empty(0, "i8")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.astype("i8"))], ["vec_id", "embedding", "cell"])

    placed = base.mapInArrow(place, "vec_id long, embedding array<double>, cell long")
    counts = np.zeros(index.k**2, "i8")
    for r in placed.groupBy("cell").count().collect():  # at most centroids ** 2 rows
        counts[r.cell] = r["count"]
    shelf_rows = int(np.clip(total // 32, *SHELF_ROWS))
    index.lay(counts, shelf_rows)
    laid = spark.sparkContext.broadcast(index)
    rows = max(share * total, k + 1 + total - ids)  # as many at least as hold k ids besides the query's
    queries = base.filter(is_query)
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))

    def shelve(batches):
        for batch in batches:
            m = laid.value
            ids = batch.column(0).to_numpy()
            cells = batch.column(2).to_numpy()
            mixed = (ids.astype("u8") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            shelf = m.shelf[m.first[cells] + (mixed % m.blocks[cells].astype("u8")).astype("i8")]
            for b in range(blocks):
                yield pa.RecordBatch.from_arrays([pa.array(shelf), pa.array(np.full(len(ids), b)), *batch.columns], ["shelf", "block", "vec_id", "embedding", "cell"])

    def route(batches):
        for batch in batches:
            m = laid.value
            cols: list[list] = [[], [], [], [], []]
            x = _matrix(batch.column(1), dims).astype("f8")
            for n, (q, raw) in enumerate(zip(batch.column(0).to_pylist(), x, strict=True)):
                by: dict[int, list[int]] = {}
                for c in m.walk(x[n], rows):
                    for s in set(m.shelf[m.first[c] : m.first[c + 1]].tolist()):
                        by.setdefault(s, []).append(c)
                for s, cells in by.items():
                    for c, v in zip(cols, (s, (q // 100) % blocks, q, raw, cells), strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["shelf", "block", "query_id", "embedding", "cells"])

    shelves = placed.mapInArrow(shelve, "shelf long, block long, vec_id long, embedding array<double>, cell long")
    routed = queries.mapInArrow(route, "shelf long, block long, query_id long, embedding array<double>, cells array<long>")

    def near(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": pd.Series(dtype="i8"), "vec_id": pd.Series(dtype="i8"), "score": pd.Series(dtype="f8")})
        own, ids = left["query_id"].to_numpy(), right["vec_id"].to_numpy()
        q, v, d = rerank(np.stack(left["embedding"]), own, list(left["cells"]), ids, np.stack(right["embedding"]), right["cell"].to_numpy(), k)
        return pd.DataFrame({"query_id": own[q], "vec_id": ids[v], "score": d})

    found = routed.groupBy("shelf", "block").cogroup(shelves.groupBy("shelf", "block")).applyInPandas(near, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
