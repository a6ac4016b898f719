"""Structured Streaming into collections and through them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..collection import Collection
from ..functions import dense


#: Documents that a stream is matched with without a key, at most.
MATCH_DOCUMENTS = 100_000


def upsert_stream(stream: DataFrame, collection: Collection, seq: str, checkpoint: str) -> DataStreamWriter:
    """Upserts each micro-batch, the last by seq of each key, and commits a snapshot. A batch that runs again changes nothing."""

    def apply(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            collection.upsert(batch, seq)
            collection.flush()

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def match_stream(stream: DataFrame, collection: Collection, radius: float, key: str = "qid", vector: str = "qvec") -> DataFrame:
    """A stream of (key, pk, score): for each streamed vector the documents at least as good as radius.

    Stream and documents are joined without a key, so the documents are counted and may be
    MATCH_DOCUMENTS at most; larger collections are searched with batch_search in foreachBatch.
    """
    if collection.df.limit(MATCH_DOCUMENTS + 1).count() > MATCH_DOCUMENTS:
        raise ValueError(f"a stream is matched with at most {MATCH_DOCUMENTS} documents")
    m = collection.config.metric
    joined = stream.join(F.broadcast(collection.df.filter("vector IS NOT NULL").select("pk", "vector")), F.lit(True))
    scored = joined.select(key, "pk", dense.distance(m, F.col("vector"), F.col(vector)).alias("score"))
    return scored.filter(F.col("score") >= radius if m.higher_is_better else F.col("score") <= radius)


def windowed_counts(stream: DataFrame, time: str, group: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts of each value of group in tumbling windows; rows later than `late` are dropped by the watermark."""
    counted = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), group).agg(F.count("*").alias("count"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), group, "count")
