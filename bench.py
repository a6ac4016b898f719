"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["knn_l2", "knn_filtered_l2", "knn_batch", "knn_batch_all", "grouped_knn", "ivf_batch", "fuse_rrf", "rerank_weighted_ip", "group_count", "merge_many", "int8_codes", "sparse_ip_knn"]


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from vecframe.operators.search import batch_knn
    from vecframe.queries import QUERIES
    from vecframe.schema import Metric

    took: dict[str, float] = {}
    for name in HEADLINE:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()  # compiles code
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 4)

    # throughput of batches: 1, 100 and 10 000 queries against all embeddings
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("pk"), F.col("embedding").alias("vector")).cache()
    n, rate = rows.count(), {}
    for size in (1, 100, 10_000):
        ids = spark.range(size).select(F.col("id").alias("qid"), (F.col("id") % n).alias("pk"))
        queries = ids.join(rows, "pk").select("qid", F.col("vector").alias("qvec")).cache()
        queries.count()
        began = time.time()
        batch_knn(rows, queries, 10, Metric.L2).write.format("noop").mode("overwrite").save()
        s = time.time() - began
        rate[str(size)] = {"queries_per_s": round(size / s, 1), "pairs_per_s": round(size * n / s)}

    # recall at 10 and throughput of inverted files that read 3 and 8 of 32 buckets
    from vecframe.operators.ivf import IvfIndex, IvfParams

    index = IvfIndex.train(rows, Metric.L2, IvfParams(32, 8, 5))
    bucketed = index.bucketed(rows).cache()
    bucketed.count()
    queries = rows.select(F.col("pk").alias("qid"), F.col("vector").alias("qvec")).cache()
    exact = {(r.qid, r.pk) for r in batch_knn(rows, queries, 10, Metric.L2).collect()}
    ivf = {}
    for probes in (3, 8):
        began = time.time()
        hits = {(r.qid, r.pk) for r in index.batch_search(bucketed, queries, 10, probes).collect()}
        ivf[f"{probes} of 32"] = {"recall_at_10": round(len(hits & exact) / len(exact), 4), "queries_per_s": round(queries.count() / (time.time() - began), 1)}
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "batch_search": rate, "ivf": ivf, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
