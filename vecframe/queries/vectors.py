"""Queries on vectors: nearest neighbours, groups, fusion, reranking, kernels, sparse vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..collection import Collection
from ..embed import embed_column
from ..functions import dense, sparse
from ..operators import fusion, search
from ..schema import CollectionConfig, Metric, Schema
from .common import DIGITS, EMB, EVERY, SCALED, Initials, cos, embeddings, ip, l2, q, table, vector_of, vectors

SPARSE_FROM = 0.15


def scaled(spark, d) -> DataFrame:
    df = vectors(spark, d)
    return df.withColumn("vector", F.transform("vector", lambda x: x.cast("double") * (1 + F.col("pk") % 7)))


def scaled_query(spark, d, vec_id) -> list[float]:
    return [x * (1 + vec_id % 7) for x in vector_of(spark, d, vec_id)]


def knn(metric: Metric):
    def run(spark, d):
        return search.knn(scaled(spark, d), scaled_query(spark, d, 3), 10, metric, keep=[], digits=DIGITS)

    s = {"l2": l2, "ip": ip, "mips": ip, "cosine": cos}[metric.value]("vector", q(3))
    way = "DESC" if metric.higher_is_better else "ASC"
    return run, f"WITH {SCALED} SELECT pk, round({s}, {DIGITS}) AS score FROM emb ORDER BY score {way}, pk LIMIT 10"


def knn_filtered(spark, d):
    """The flagship: a filter in the filter language, then the ten nearest with their field."""
    c = embeddings(spark, d)
    return c.search(vector_of(spark, d, 0), 10, "category IN ('1', '2')", ["category"], DIGITS)


KNN_FILTERED = f"WITH {EMB} SELECT CAST(pk AS VARCHAR) AS pk, category, round({l2('vector', q(0))}, {DIGITS}) AS score FROM emb WHERE category IN ('1', '2') ORDER BY score, pk LIMIT 10"


def batch(metric: Metric, k: int = 10, kernel: str = "auto"):
    """Every row whose id is divisible by EVERY is a query against all rows."""

    def run(spark, d):
        df = vectors(spark, d)
        queries = df.filter(F.col("pk") % EVERY == 0).select(F.col("pk").alias("qid"), F.col("vector").alias("qvec"))
        return search.batch_knn(df, queries, k, metric, kernel=kernel, digits=DIGITS)

    s = {"l2": l2, "ip": ip, "cosine": cos}[metric.value]("b.vector", "a.vector")
    way = "DESC" if metric.higher_is_better else "ASC"
    sql = f"""WITH {EMB}, s AS (SELECT a.pk AS qid, b.pk AS pk, round({s}, {DIGITS}) AS score FROM emb a, emb b WHERE a.pk % {EVERY} = 0)
        SELECT qid, CAST(rank AS INTEGER) AS rank, pk, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score {way}, pk) AS rank FROM s) WHERE rank <= {k}"""
    return run, sql


def within(spark, d):
    return search.within(vectors(spark, d), vector_of(spark, d, 1), 1.6, Metric.L2, digits=DIGITS)


def grouped(pool: int | None):
    def run(spark, d):
        df = vectors(spark, d)
        return search.grouped_knn(df, vector_of(spark, d, 0), F.col("category"), 3, 2, Metric.L2, candidate_pool=pool, digits=DIGITS)

    sql = f"""WITH {EMB}, s0 AS (SELECT pk, category AS group_key, round({l2('vector', q(0))}, {DIGITS}) AS score FROM emb),
        s AS (SELECT * FROM s0 ORDER BY score, pk {f'LIMIT {pool}' if pool else ''}),
        r AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY score, pk) AS rank, min(score) OVER (PARTITION BY group_key) AS best FROM s),
        g AS (SELECT *, dense_rank() OVER (ORDER BY best, group_key) AS group_rank FROM r)
        SELECT group_key, CAST(group_rank AS INTEGER) AS group_rank, CAST(rank AS INTEGER) AS rank, pk, score FROM g WHERE group_rank <= 3 AND rank <= 2"""
    return run, sql


def two_lists(spark, d, metric: Metric = Metric.IP, n: int = 50) -> DataFrame:
    """The n best of each of two query vectors, with ranks from 0."""
    df = scaled(spark, d)
    parts = []
    for name, vec_id in (("a", 3), ("b", 8)):
        hits = search.knn(df, scaled_query(spark, d, vec_id), n, metric, keep=["category"], digits=DIGITS)
        parts.append(hits.withColumn("list_name", F.lit(name)))
    s = F.col("score").desc() if metric.higher_is_better else F.col("score").asc()
    every = reduce(DataFrame.unionByName, parts)
    return every.withColumn("rank", F.row_number().over(Window.partitionBy("list_name").orderBy(s, "pk")) - 1)


def lists_sql(f, way: str, n: int = 50) -> str:
    one = lambda name, vec_id: f"(SELECT '{name}' AS list_name, pk, category, round({f('vector', q(vec_id))}, {DIGITS}) AS score FROM emb ORDER BY score {way}, pk LIMIT {n})"
    return f"WITH {SCALED}, l0 AS ({one('a', 3)} UNION ALL {one('b', 8)}), l AS (SELECT *, row_number() OVER (PARTITION BY list_name ORDER BY score {way}, pk) - 1 AS rank FROM l0)"


def digits(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 8))


def rrf(spark, d):
    return digits(fusion.rrf(two_lists(spark, d), 20))


def weighted(spark, d):
    return digits(fusion.weighted_sum(two_lists(spark, d), 20, {"a": 2.0}))


def intersect(spark, d):
    return fusion.intersect(two_lists(spark, d, n=200), 20, 2)


def union(spark, d):
    return fusion.union(two_lists(spark, d), 20)


def rerank_rrf(spark, d):
    return digits(fusion.RrfReranker(15).rerank(two_lists(spark, d)))


def rerank(metric: Metric):
    def run(spark, d):
        lists = two_lists(spark, d, metric)
        if metric is Metric.COSINE:
            lists = lists.withColumn("score", 1 - F.col("score"))
        return digits(fusion.WeightedReranker(metric, 15, {"a": 3.0}).rerank(lists))

    f, way, unit = {
        Metric.L2: (l2, "ASC", "1 - 2 * atan(score) / pi()"),
        Metric.IP: (ip, "DESC", "0.5 + atan(score) / pi()"),
        Metric.COSINE: (cos, "DESC", "1 - (1 - score) / 2"),
    }[metric]
    sql = f"{lists_sql(f, way)} SELECT pk, round(sum(({unit}) * CASE list_name WHEN 'a' THEN 3.0 ELSE 1.0 END), 8) AS score, arg_min(category, list_name) AS category FROM l GROUP BY pk ORDER BY score DESC, pk LIMIT 15"
    return run, sql


def sparse_rows(spark, d) -> DataFrame:
    return vectors(spark, d).select("pk", sparse.from_dense(F.col("vector"), SPARSE_FROM).alias("sv"))


def sparse_knn(metric: Metric):
    def run(spark, d):
        df = sparse_rows(spark, d)
        return search.sparse_knn(df, df.filter("pk = 5").select("sv"), 10, metric, digits=DIGITS)

    zeroed = f"sp AS (SELECT pk, list_transform(CAST(vector AS DOUBLE[]), lambda x: CASE WHEN abs(x) >= {SPARSE_FROM} THEN x ELSE 0.0 END) AS v FROM emb)"
    s = {Metric.L2: l2, Metric.IP: ip, Metric.COSINE: cos}[metric]("v", "(SELECT v FROM sp WHERE pk = 5)")
    way = "DESC" if metric.higher_is_better else "ASC"
    return run, f"WITH {EMB}, {zeroed} SELECT pk, round({s}, {DIGITS}) AS score FROM sp ORDER BY score {way}, pk LIMIT 10"


def sparse_pairs(spark, d):
    """Products and distances of each sparse vector with the next."""
    df = sparse_rows(spark, d)
    return df.alias("x").join(df.select((F.col("pk") - 1).alias("pk"), F.col("sv").alias("sw")).alias("y"), "pk").select(
        "pk", sparse.nnz(F.col("sv")).alias("nnz"), F.round(sparse.dot(F.col("sv"), F.col("sw")), DIGITS).alias("dot"), F.round(sparse.l2_squared(F.col("sv"), F.col("sw")), DIGITS).alias("l2"), F.round(sparse.cosine(F.col("sv"), F.col("sw")), DIGITS).alias("cosine")
    )


ZEROED = f"sp AS (SELECT pk, list_transform(CAST(vector AS DOUBLE[]), lambda x: CASE WHEN abs(x) >= {SPARSE_FROM} THEN x ELSE 0.0 END) AS v FROM emb)"
SPARSE_PAIRS = f"""WITH {EMB}, {ZEROED} SELECT x.pk, CAST(len(list_filter(x.v, lambda e: e <> 0)) AS INTEGER) AS nnz, round({ip('x.v', 'y.v')}, {DIGITS}) AS dot, round({l2('x.v', 'y.v')}, {DIGITS}) AS l2, round({cos('x.v', 'y.v')}, {DIGITS}) AS cosine
    FROM sp x JOIN sp y ON y.pk = x.pk + 1"""


def to_dense(spark, d):
    df = sparse_rows(spark, d).select("pk", sparse.to_dense(F.col("sv"), 32).alias("v"))
    return df.select("pk", F.size("v").alias("dims"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), DIGITS).alias("total"))


def normalize(spark, d):
    v = dense.l2_normalize(F.col("vector"))
    return scaled(spark, d).select("pk", F.round(dense.squared_norm(F.col("vector")), DIGITS).alias("before"), F.round(dense.squared_norm(v), DIGITS).alias("after"), F.round(v[0], DIGITS).alias("first"))


def sql_functions(spark, d):
    """The kernels as SQL functions, in spark.sql."""
    dense.register(spark)
    vectors(spark, d).createOrReplaceTempView("vecframe_vectors")
    return spark.sql(f"""SELECT a.pk, round(l2_squared(a.vector, b.vector), {DIGITS}) AS l2, round(inner_product(a.vector, b.vector), {DIGITS}) AS ip, round(cosine_similarity(a.vector, b.vector), {DIGITS}) AS cosine
        FROM vecframe_vectors a JOIN vecframe_vectors b ON b.pk = a.pk + 1""")


def search_rerank(spark, d):
    """Two named queries on one collection, cosine, reranked by RRF."""
    c = embeddings(spark, d, Metric.COSINE)
    return digits(c.search_with_reranker({"a": vector_of(spark, d, 0), "b": vector_of(spark, d, 1)}, 30, fusion.RrfReranker(10)))


SEARCH_RERANK = f"""WITH {EMB}, s AS (SELECT n.name, CAST(e.pk AS VARCHAR) AS pk, e.category, {cos('e.vector', 'n.vector')} AS score FROM emb e, (SELECT CASE pk WHEN 0 THEN 'a' ELSE 'b' END AS name, vector FROM emb WHERE pk IN (0, 1)) n),
    r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, pk) AS rank FROM s)
    SELECT pk, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score, any_value(category) AS category FROM r WHERE rank <= 30 GROUP BY pk ORDER BY round(sum(1.0::DOUBLE / (60 + rank)), 12) DESC, pk LIMIT 10"""



def sparse_batch(spark, d):
    df = sparse_rows(spark, d)
    return search.sparse_batch_knn(df, df.filter(F.col("pk") % EVERY == 0).select(F.col("pk").alias("qid"), "sv"), 5, Metric.IP, digits=DIGITS)


SPARSE_BATCH = f"""WITH {EMB}, sp AS (SELECT pk, list_transform(CAST(vector AS DOUBLE[]), lambda x: CASE WHEN abs(x) >= {SPARSE_FROM} THEN x ELSE 0.0 END) AS v FROM emb),
    s AS (SELECT a.pk AS qid, b.pk AS pk, round({ip('b.v', 'a.v')}, {DIGITS}) AS score FROM sp a, sp b WHERE a.pk % {EVERY} = 0)
    SELECT qid, CAST(rank AS INTEGER) AS rank, pk, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pk) AS rank FROM s) WHERE rank <= 5"""


def by_distance(spark, d):
    """The dialect's order by distance, with a condition."""
    return embeddings(spark, d).query("SELECT category FROM e WHERE category != '3' ORDER BY _distance LIMIT 20", vector_of(spark, d, 2), DIGITS)


BY_DISTANCE = f"WITH {EMB} SELECT CAST(pk AS VARCHAR) AS _pk, category, round({l2('vector', q(2))}, {DIGITS}) AS _distance FROM emb WHERE category <> '3' OR category IS NULL ORDER BY _distance, _pk LIMIT 20"
PHRASE = "a plain question about data and the people who keep it"


def text_search(spark, d):
    """Documents embedded by a model, searched by a text in the same model."""
    df = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("pk"), embed_column(Initials, F.col("text")).alias("vector"), "lang").filter("vector IS NOT NULL")
    c = Collection(spark, CollectionConfig(26, Metric.COSINE, Schema.of(lang="filtered")), df)
    return digits(c.search_text(Initials(), PHRASE, 15, "lang IN ('en', 'fr')").select("pk", "score", "lang"))


TEXT_SEARCH = rf"""WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS pk, lang, regexp_extract_all(lower(text), '(?:^|\s)([a-z])', 1) AS w FROM documents WHERE text <> '' AND lang IN ('en', 'fr')),
    v AS (SELECT pk, lang, list_transform(range(26), lambda i: CAST(len(list_filter(w, lambda x: x = chr(CAST(97 + i AS INTEGER)))) AS DOUBLE)) AS v FROM t)
    SELECT pk, lang, round({cos('v', f'CAST({Initials().embed(PHRASE)} AS DOUBLE[])')}, 8) AS score FROM v ORDER BY score DESC, pk LIMIT 15"""

REGISTRY = {
    "knn_filtered_l2": (knn_filtered, KNN_FILTERED),
    **{f"knn_{m.value}": knn(m) for m in Metric},
    "knn_batch": batch(Metric.L2, 5, "expression"),
    "knn_batch_arrow": batch(Metric.L2, 5, "arrow"),
    "knn_batch_all": batch(Metric.L2),
    "knn_batch_ip": batch(Metric.IP),
    "knn_batch_cosine": batch(Metric.COSINE),
    "range_within": (within, f"WITH {EMB} SELECT pk, round({l2('vector', q(1))}, {DIGITS}) AS score FROM emb WHERE round({l2('vector', q(1))}, {DIGITS}) <= 1.6"),
    "grouped_knn": grouped(None),
    "grouped_knn_pool": grouped(24),
    "fuse_rrf": (rrf, f"{lists_sql(ip, 'DESC')} SELECT pk, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM l GROUP BY pk ORDER BY score DESC, pk LIMIT 20"),
    "fuse_weighted": (
        weighted,
        f"""{lists_sql(ip, 'DESC')}, n AS (SELECT *, min(score) OVER (PARTITION BY list_name) AS lo, max(score) OVER (PARTITION BY list_name) AS hi FROM l)
        SELECT pk, round(sum(CASE WHEN hi - lo < 1e-12 THEN 1.0 ELSE (score - lo) / (hi - lo) END * CASE list_name WHEN 'a' THEN 2.0 ELSE 1.0 END), 8) AS score FROM n GROUP BY pk ORDER BY score DESC, pk LIMIT 20""",
    ),
    "fuse_intersect": (intersect, f"{lists_sql(ip, 'DESC', 200)} SELECT pk, max(score) AS score FROM l GROUP BY pk HAVING count(DISTINCT list_name) = 2 ORDER BY score DESC, pk LIMIT 20"),
    "fuse_union": (union, f"{lists_sql(ip, 'DESC')} SELECT pk, max(score) AS score FROM l GROUP BY pk ORDER BY score DESC, pk LIMIT 20"),
    "rerank_rrf": (rerank_rrf, f"{lists_sql(ip, 'DESC')} SELECT pk, round(sum(1.0::DOUBLE / (61 + rank)), 8) AS score, arg_min(category, list_name) AS category FROM l GROUP BY pk ORDER BY score DESC, pk LIMIT 15"),
    **{f"rerank_weighted_{m.value}": rerank(m) for m in (Metric.L2, Metric.IP, Metric.COSINE)},
    "search_with_reranker": (search_rerank, SEARCH_RERANK),
    **{f"sparse_{m.value}_knn": sparse_knn(m) for m in (Metric.IP, Metric.L2, Metric.COSINE)},
    "sparse_batch_knn": (sparse_batch, SPARSE_BATCH),
    "order_by_distance": (by_distance, BY_DISTANCE),
    "text_search": (text_search, TEXT_SEARCH),
    "sparse_pairs": (sparse_pairs, SPARSE_PAIRS),
    "to_dense": (to_dense, f"WITH {EMB}, {ZEROED} SELECT pk, 32 AS dims, round(list_sum(v[1:32]), {DIGITS}) AS total FROM sp"),
    "normalize": (normalize, f"WITH {SCALED} SELECT pk, round({ip('vector', 'vector')}, {DIGITS}) AS before, round(1.0::DOUBLE, {DIGITS}) AS after, round(vector[1] / sqrt({ip('vector', 'vector')}), {DIGITS}) AS first FROM emb"),
    "sql_functions": (sql_functions, f"WITH {EMB} SELECT a.pk, round({l2('a.vector', 'b.vector')}, {DIGITS}) AS l2, round({ip('a.vector', 'b.vector')}, {DIGITS}) AS ip, round({cos('a.vector', 'b.vector')}, {DIGITS}) AS cosine FROM emb a JOIN emb b ON b.pk = a.pk + 1"),
}
