"""A collection: documents with a key, a vector and string fields, as an immutable DataFrame behind a store."""

from __future__ import annotations

import asyncio
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .embed import AsyncEmbedding, DenseEmbedding
from .filters import parse_filter, to_column
from .filters.tree import Not
from .operators import dml, search
from .operators.fusion import AsyncReranker
from .plans.query import Query, execute
from .schema import CollectionConfig, Schema
from .sources.store import MemoryStore, ParquetStore, SnapshotStore

BASE = ("pk", "vector", "_extra")


class Collection:
    """pk STRING, vector ARRAY<FLOAT>, declared fields as STRING columns, others in _extra MAP<STRING, STRING>.

    A change replaces the frame by a new one; flush() commits it as a snapshot.
    """

    def __init__(self, spark: SparkSession, config: CollectionConfig, df: DataFrame | None = None, store: SnapshotStore | None = None):
        self.spark, self.config, self.store = spark, config, store or MemoryStore()
        self.df = self.shaped(df) if df is not None else spark.createDataFrame([], self.ddl())

    def ddl(self) -> str:
        return ", ".join(["pk string", "vector array<float>", *(f"`{n}` string" for n in self.config.schema.names), "_extra map<string,string>"])

    @classmethod
    def open(cls, spark: SparkSession, root: str, name: str, config: CollectionConfig | None = None) -> Collection:
        """The current snapshot, or an empty collection. A given schema is used where it indexes fields, else the stored one."""
        store = ParquetStore(spark, root, name)
        held = store.read()
        if held is None:
            if config is None:
                raise FileNotFoundError(store.base)
            return cls(spark, config, store=store)
        df, stored = held
        if config is None:
            config = stored
        elif not config.schema.has_indexed_fields:
            config = config.with_schema(stored.schema)
        if config.dims != stored.dims:
            raise ValueError(f"{config.dims} dimensions, stored are {stored.dims}")
        out = cls(spark, config, store=store)
        out.df = out.redeclared(df)
        return out

    def __enter__(self) -> Collection:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.flush()

    def shaped(self, df: DataFrame) -> DataFrame:
        """df as documents: columns that the schema does not name go to _extra; vectors are checked."""
        names = self.config.schema.names
        loose = [c for c in df.columns if c not in (*BASE, *names)]
        entries = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, loose)), F.array(*(F.col(c).cast("string") for c in loose))), lambda _, v: v.isNotNull()) if loose else F.create_map().cast("map<string,string>")
        extra = F.coalesce("_extra", F.create_map().cast("map<string,string>")) if "_extra" in df.columns else None
        extra = entries if extra is None else F.map_concat(F.map_filter(extra, lambda k, _: ~k.isin(loose)) if loose else extra, entries)
        v = F.col("vector").cast("array<float>")
        checked = F.when(v.isNull() | (F.size(v) == self.config.dims), v).otherwise(F.raise_error(F.lit(f"a vector does not have {self.config.dims} components")))
        fields = [(F.col(n).cast("string") if n in df.columns else F.try_element_at(extra, F.lit(n))).alias(n) for n in names]
        return df.select(F.col("pk").cast("string").alias("pk"), checked.alias("vector"), *fields, F.map_filter(extra, lambda k, _: ~k.isin(names)).alias("_extra") if names else extra.alias("_extra"))

    def redeclared(self, df: DataFrame) -> DataFrame:
        return self.shaped(df)

    def field(self, name: str) -> Column:
        return F.col(name) if name in self.df.columns else F.try_element_at("_extra", F.lit(name))

    def condition(self, text: str | None) -> Column | None:
        return None if text is None else to_column(parse_filter(text), self.field)

    # documents

    def upsert(self, docs: DataFrame, seq: str | None = None) -> None:
        """Replaces whole documents by pk. With seq, the last of repeated keys wins; without, keys are taken to be unique."""
        if seq is not None:
            docs = dml.last_of_each(docs, seq).drop(seq)
        self.df = dml.upsert(self.df, self.shaped(docs))

    def upsert_one(self, pk: str, vector: Sequence[float], **fields: str) -> None:
        names = list(fields)
        row = self.spark.createDataFrame([(pk, list(map(float, vector)), *fields.values())], ", ".join(["pk string", "vector array<float>", *(f"`{n}` string" for n in names)]))
        self.upsert(row)

    def remove(self, pk: str) -> bool:
        """True if the document was there."""
        there = self.df.filter(F.col("pk") == pk).limit(1).count() > 0
        if there:
            self.df = dml.remove(self.df, [pk])
        return there

    def delete_by_filter(self, text: str) -> int:
        e = parse_filter(text)
        gone = self.df.filter(to_column(e, self.field)).count()
        self.df = dml.delete(self.df, to_column(Not(e), self.field))
        return gone

    def fetch(self, pk: str) -> dict[str, str] | None:
        rows = self.df.filter(F.col("pk") == pk).drop("vector").limit(1).collect()
        if not rows:
            return None
        r = rows[0].asDict()
        found = {**(r.pop("_extra") or {}), **r}
        return {k: v for k, v in found.items() if k != "pk" and v is not None}

    def doc_count(self) -> int:
        return self.df.count()

    @property
    def is_trained(self) -> bool:
        return True

    # search

    def _names(self, fields: Sequence[str] | None) -> list[str]:
        return [c for c in self.df.columns if c not in ("pk", "vector")] if not fields else list(fields)

    def search(self, vector: Sequence[float], k: int, condition: str | None = None, fields: Sequence[str] | None = None, digits: int | None = None) -> DataFrame:
        """pk, score and fields of the k best documents that meet the condition; all fields if none are named."""
        names = self._names(fields)
        rows = self.df if condition is None else self.df.filter(self.condition(condition))
        rows = rows.select("pk", "vector", *((F.col(n) if n in self.df.columns else self.field(n)).alias(n) for n in names))
        return search.knn(rows, vector, k, self.config.metric, keep=names, digits=digits)

    def batch_search(self, queries: DataFrame, k: int, condition: str | None = None, **options) -> DataFrame:
        return search.batch_knn(self.df, queries, k, self.config.metric, self.condition(condition), **options)

    def group_by_search(self, vector: Sequence[float], field: str, groups: int, per_group: int, condition: str | None = None, candidate_pool: int | None = None) -> DataFrame:
        return search.grouped_knn(self.df, vector, self.field(field), groups, per_group, self.config.metric, self.condition(condition), candidate_pool)

    def search_text(self, model: DenseEmbedding, text: str, k: int, condition: str | None = None) -> DataFrame:
        return self.search(model.embed(text), k, condition)

    def search_with_reranker(self, queries: dict[str, Sequence[float]], k: int, reranker, condition: str | None = None) -> DataFrame:
        """Searches with each named vector and reranks the lists. Cosine similarities reach the reranker as distances."""
        from .schema import Metric

        lists = [self.search(v, k, condition).withColumn("list_name", F.lit(name)) for name, v in queries.items()]
        if not lists:
            raise ValueError("no queries")
        order = F.col("score").desc() if self.config.metric.higher_is_better else F.col("score").asc()
        from pyspark.sql import Window

        every = reduce(DataFrame.unionByName, lists).withColumn("rank", F.row_number().over(Window.partitionBy("list_name").orderBy(order, "pk")) - 1)
        if self.config.metric is Metric.COSINE:
            every = every.withColumn("score", 1 - F.col("score"))
        return reranker.rerank(every.drop("_extra"))

    def search_text_with_reranker(self, model: DenseEmbedding, text: str, k: int, reranker, condition: str | None = None) -> DataFrame:
        return self.search_with_reranker({"dense": model.embed(text)}, k, reranker, condition)

    async def search_text_with_reranker_async(self, model: AsyncEmbedding, text: str, k: int, reranker: AsyncReranker, condition: str | None = None) -> DataFrame:
        return await asyncio.to_thread(self.search_with_reranker, {"dense": await model.embed(text)}, k, reranker.inner, condition)

    def query(self, q: str | Query, vector: Sequence[float] | None = None, digits: int | None = None) -> DataFrame:
        q = Query.parse(q) if isinstance(q, str) else q
        return execute(q, self.df, self.field, [c for c in self.df.columns if c not in ("pk", "vector")], self.config.metric, vector, digits)

    # schema

    def add_field(self, name: str, role: str = "filtered") -> None:
        schema = self.config.schema.add(name, role)
        self.df = dml.add_field(self.df, name)
        self.config = self.config.with_schema(schema)

    def drop_field(self, name: str) -> None:
        schema = self.config.schema.drop(name)
        self.df = self.df.drop(name)
        self.config = self.config.with_schema(schema)

    def rename_field(self, old: str, new: str) -> None:
        schema = self.config.schema.rename(old, new)
        self.df = self.df.withColumnRenamed(old, new)
        self.config = self.config.with_schema(schema)

    # merging

    def merge_from(self, other: Collection) -> None:
        """The other's documents win; fields of both schemas, this one's roles first."""
        if (other.config.dims, other.config.metric) != (self.config.dims, self.config.metric):
            raise ValueError("dimension and metric must be the same")
        self.config = self.config.with_schema(self.config.schema.union(other.config.schema))
        self.df = dml.merge(self.shaped(self.df), self.shaped(other.df))

    @staticmethod
    def merge_many(collections: Sequence[Collection]) -> Collection:
        """A new collection in memory with the first one's configuration; later documents overwrite earlier ones."""
        if not collections:
            raise ValueError("nothing to merge")
        out = Collection(collections[0].spark, collections[0].config, collections[0].df)
        schema: Schema = reduce(Schema.union, (c.config.schema for c in collections))
        for c in collections:
            if (c.config.dims, c.config.metric) != (out.config.dims, out.config.metric):
                raise ValueError("dimension and metric must be the same")
        out.config = out.config.with_schema(schema)
        out.df = dml.merge(*(out.shaped(c.df) for c in collections))
        return out

    # storage

    def flush(self) -> bool:
        """Commits a snapshot and reads it again; false in memory."""
        saved = self.store.commit(self.df, self.config)
        if saved:
            self.df = self.redeclared(self.store.read()[0])
        return saved

    def optimize(self) -> bool:
        """As flush, with rows ranged and sorted by the first indexed field, so that files can be skipped."""
        by = [*self.config.schema.indexed_fields[:1], "pk"]
        self.df = self.df.repartitionByRange(*by).sortWithinPartitions(*by)
        return self.flush()

    def diagnostics(self) -> dict:
        fields = {n: r for n, r in self.config.schema.fields if r != "string"}
        stats = {r.field: (r.terms, r.avg_posting, r.max_posting) for r in dml.posting_stats(self.df, fields).collect()} if fields else {}
        return {
            "vectors": self.doc_count(),
            "dims": self.config.dims,
            "metric": self.config.metric.value,
            "storage": self.store.backend_type,
            "disk_size": self.store.disk_size(),
            "schema": dict(self.config.schema.fields),
            "indexed_fields": len(fields),
            "postings": stats,
        }
