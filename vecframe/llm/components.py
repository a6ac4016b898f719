"""Connected components of a graph held in a DataFrame, with no step on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a < b) with the same components: each node's least lower neighbour, and that one's distinct links
    to the other lower neighbours. Of many nodes that share their lower neighbours, few edges are left."""
    lower = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    least = lower.groupBy("b").agg(F.min("a").alias("parent"))
    rest = lower.join(least, "b").filter("parent <> a").select(F.col("parent").alias("a"), F.col("a").alias("b"))
    return least.select(F.col("parent").alias("a"), "b").union(rest.distinct())


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node of it) for every node of edges (a long, b long).

    Each round a node takes the least label of its neighbours and then its label's
    label, so that chains shrink by halves; labels are written each round. Joins on
    hot labels and hubs have no operator after them that needs their keys together, so that
    Spark can split them (spark.sql.adaptive.skewJoin).
    """
    pairs = written(contracted(edges.select("a", "b")), "edges")
    both = pairs.union(pairs.select("b", "a"))
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "low").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        new = written(lower.join(up, "label").select("node", "old", F.least("label", "higher").alias("label")), "labels")
        moved = new.filter("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not moved:
            return labels.withColumnRenamed("label", "component")
