"""Pieces of DuckDB SQL and views that the queries share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..collection import Collection
from ..schema import CollectionConfig, Metric, Schema
from ..sources.documents import documents

DIGITS = 4
#: Searches take as queries every row whose id is divisible by this.
EVERY = 50


def l2(a: str, b: str) -> str:
    return f"coalesce(list_sum(list_transform(list_zip(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 0.0)"


def ip(a: str, b: str) -> str:
    return f"coalesce(list_sum(list_transform(list_zip(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), lambda x: x[1] * x[2])), 0.0)"


def cos(a: str, b: str) -> str:
    return f"CASE WHEN {ip(a, a)} * {ip(b, b)} = 0 THEN 0.0 ELSE {ip(a, b)} / sqrt({ip(a, a)} * {ip(b, b)}) END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector_of(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    """One row's vector."""
    return [float(x) for x in table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").head()[0]]


def embeddings(spark: SparkSession, sf_dir: str, metric: Metric = Metric.L2, scaled: bool = False) -> Collection:
    """pk, vector and category of the embeddings; scaled by 1 + vec_id mod 7, so that products and cosines differ."""
    df = table(spark, sf_dir, "embeddings")
    if scaled:
        df = df.withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("vec_id") % 7)))
        docs = df.select(F.col("vec_id").cast("string").alias("pk"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("category"))
    else:
        docs = documents(df.withColumnRenamed("label", "category"), "vec_id", "embedding")
    return Collection(spark, CollectionConfig(64, metric, Schema.of(category="filtered")), docs)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pk (long), vector and category."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pk"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("category"))


def texts(spark: SparkSession, sf_dir: str) -> Collection:
    """documents with the labels that they have: absent ones are missing fields."""
    df = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    docs = documents(df, "doc_id", fields=["text", "lang", "source", "quality", "toxic"], tags={"tags": ["lang", "source"]})
    schema = Schema.of(text="string", lang="filtered", source="filtered", quality="filtered", toxic="filtered", tags="tags")
    return Collection(spark, CollectionConfig(64, Metric.IP, schema), docs)


def events(spark: SparkSession, sf_dir: str) -> Collection:
    docs = documents(table(spark, sf_dir, "events"), "event_id", fields=["event_type", "user_id", "props"])
    return Collection(spark, CollectionConfig(64, Metric.IP, Schema.of(event_type="filtered", user_id="filtered", props="string")), docs)


#: The same as views in DuckDB.
TEXTS = "docs AS (SELECT CAST(doc_id AS VARCHAR) AS pk, text, lang, source, CAST(quality AS VARCHAR) AS quality, CAST(toxic AS VARCHAR) AS toxic, concat_ws(',', lang, source) AS tags FROM documents LEFT JOIN labels USING (doc_id))"
EMB = "emb AS (SELECT vec_id AS pk, embedding AS vector, CAST(label AS VARCHAR) AS category FROM embeddings)"
SCALED = "emb AS (SELECT vec_id AS pk, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * (1 + vec_id % 7)) AS vector, CAST(label AS VARCHAR) AS category FROM embeddings)"


def q(vec_id: int) -> str:
    return f"(SELECT vector FROM emb WHERE pk = {vec_id})"


class Initials:
    """A model for the embedding queries: counts of the first letters of words."""

    def dimension(self) -> int:
        return 26

    def embed(self, text: str) -> list[float]:
        out = [0.0] * 26
        for w in text.lower().split():
            if "a" <= w[0] <= "z":
                out[ord(w[0]) - 97] += 1
        return out

    def embed_batch(self, texts) -> list[list[float]]:
        return [self.embed(t) for t in texts]

    def embed_sparse(self, text: str) -> tuple[list[int], list[float]]:
        found = [(i, x) for i, x in enumerate(self.embed(text)) if x]
        return [i for i, _ in found], [x for _, x in found]

    def embed_sparse_batch(self, texts) -> list[tuple[list[int], list[float]]]:
        return [self.embed_sparse(t) for t in texts]


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for a query that stores: below spark.checkpoint.dir, which all executors share, or temporary in a local session."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="vecframe-")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(path)
    return fs.makeQualified(path).toString()
