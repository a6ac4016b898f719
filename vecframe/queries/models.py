"""Queries on clustering, inverted files and quantization. Centroids and codebooks are rows of lowest vec_id, or trained with a seed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..embed import embed_column, embed_sparse_column
from ..operators import cluster, ivf, quantize
from ..schema import Metric
from .common import DIGITS, EMB, EVERY, Initials, ip, l2, q, table, vector_of, vectors

K, M, CODES = 8, 8, 16
WIDTH = 64 // M


def centroids(spark, d, k: int = K) -> cluster.Centroids:
    rows = vectors(spark, d).orderBy("pk").limit(k).collect()
    return [[float(x) for x in r.vector] for r in rows]


#: The nearest of the K lowest rows, the first of equals.
ASSIGNED = f"c AS (SELECT pk AS cid, vector AS cv FROM emb ORDER BY pk LIMIT {K}), n AS (SELECT cid, cv, row_number() OVER (ORDER BY cid) - 1 AS cluster FROM c), a AS (SELECT e.pk, e.vector, arg_min(n.cluster, struct_pack(d := {l2('e.vector', 'n.cv')}, k := n.cluster)) AS cluster, min({l2('e.vector', 'n.cv')}) AS d FROM emb e, n GROUP BY e.pk, e.vector)"


def assign(spark, d):
    return cluster.assigned(vectors(spark, d), centroids(spark, d)).select("pk", F.col("cluster").cast("bigint").alias("cluster"), F.round("d", DIGITS).alias("d"))


def lloyd(spark, d):
    return cluster.means(vectors(spark, d), centroids(spark, d)).select(F.col("cluster").cast("bigint").alias("cluster"), F.col("i").cast("bigint").alias("i"), (F.round("x", DIGITS) + 0.0).alias("x"), "n")


def inertia(spark, d):
    return cluster.inertia(vectors(spark, d), centroids(spark, d)).select(F.round("inertia", DIGITS).alias("inertia"))


def minibatch(spark, d):
    """One mini-batch as large as the table, so that the draw takes every row; all counts are 1 before it."""
    df = vectors(spark, d)
    new, counts = cluster.minibatch_step(df, centroids(spark, d), [1] * K, df.count())
    rows = [(c, i, float(x), int(counts[c])) for c, v in enumerate(new) for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "cluster long, i long, x double, n long").withColumn("x", F.round("x", DIGITS) + 0.0)


MINIBATCH = f"""WITH {EMB}, {ASSIGNED},
    p AS (SELECT cluster, unnest(range(len(vector))) AS i, CAST(unnest(vector) AS DOUBLE) AS x FROM a), s AS (SELECT cluster, i, sum(x) AS x, count(*) AS n FROM p GROUP BY cluster, i),
    o AS (SELECT cluster, unnest(range(len(cv))) AS i, CAST(unnest(cv) AS DOUBLE) AS x FROM n)
    SELECT o.cluster, o.i, round((o.x + coalesce(s.x, 0)) / (1 + coalesce(s.n, 0)), {DIGITS}) + 0.0 AS x, 1 + coalesce(s.n, 0) AS n FROM o LEFT JOIN s USING (cluster, i)"""


def index(spark, d) -> ivf.IvfIndex:
    return ivf.IvfIndex(centroids(spark, d), Metric.L2, ivf.IvfParams(K, 3))


def ivf_probe(n: int):
    def run(spark, d):
        i = index(spark, d)
        return i.search(i.bucketed(vectors(spark, d)), vector_of(spark, d, 9), 10, n, keep=[], digits=DIGITS)

    sql = f"""WITH {EMB}, {ASSIGNED}, pr AS (SELECT cluster FROM n ORDER BY {l2('cv', q(9))}, cluster LIMIT {n})
        SELECT pk, round({l2('vector', q(9))}, {DIGITS}) AS score FROM a WHERE cluster IN (SELECT cluster FROM pr) ORDER BY score, pk LIMIT 10"""
    return run, sql


def ivf_batch(spark, d):
    i, df = index(spark, d), vectors(spark, d)
    queries = df.filter(F.col("pk") % EVERY == 0).select(F.col("pk").alias("qid"), F.col("vector").alias("qvec"))
    return i.batch_search(i.bucketed(df), queries, 5, digits=DIGITS)


IVF_BATCH = f"""WITH {EMB}, {ASSIGNED}, o AS (SELECT e.pk AS qid, e.vector AS qvec, n.cluster, row_number() OVER (PARTITION BY e.pk ORDER BY {l2('e.vector', 'n.cv')}, n.cluster) AS r FROM emb e, n WHERE e.pk % {EVERY} = 0),
    s AS (SELECT qid, pk, round({l2('vector', 'qvec')}, {DIGITS}) AS score FROM a JOIN o USING (cluster) WHERE r <= 3)
    SELECT qid, CAST(rank AS INTEGER) AS rank, pk, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, pk) AS rank FROM s) WHERE rank <= 5"""


def two_rounds(spark, d) -> cluster.Centroids:
    """Lloyd's rounds from the K lowest rows, two of them."""
    return cluster.kmeans(vectors(spark, d), K, Metric.L2, 2, init=centroids(spark, d))


def round_sql(n: int, before: str) -> str:
    """Centroids (cluster, cv) of one round after those of `before`."""
    return f"""a{n} AS (SELECT e.pk, e.vector, arg_min(n.cluster, struct_pack(d := {l2('e.vector', 'n.cv')}, k := n.cluster)) AS cluster FROM emb e, {before} n GROUP BY e.pk, e.vector),
        p{n} AS (SELECT cluster, unnest(range(len(vector))) AS i, CAST(unnest(vector) AS DOUBLE) AS x FROM a{n}), m{n} AS (SELECT cluster, i, avg(x) AS x FROM p{n} GROUP BY cluster, i),
        c{n} AS (SELECT n.cluster, coalesce(list(m.x ORDER BY m.i) FILTER (m.x IS NOT NULL), any_value(CAST(n.cv AS DOUBLE[]))) AS cv FROM {before} n LEFT JOIN m{n} m USING (cluster) GROUP BY n.cluster)"""


START = f"c0 AS (SELECT row_number() OVER (ORDER BY pk) - 1 AS cluster, CAST(vector AS DOUBLE[]) AS cv FROM (SELECT * FROM emb ORDER BY pk LIMIT {K}))"
TWO_ROUNDS = f"{START}, {round_sql(1, 'c0')}, {round_sql(2, 'c1')}"


def kmeans_rounds(spark, d):
    return as_rows(spark, two_rounds(spark, d)).withColumn("x", F.round("x", DIGITS) + 0.0)


def trained(spark, d) -> ivf.IvfIndex:
    return ivf.IvfIndex(two_rounds(spark, d), Metric.L2, ivf.IvfParams(K, 3))


def ivf_trained(spark, d):
    """An index trained on the rows, searched for many queries."""
    i, df = trained(spark, d), vectors(spark, d)
    queries = df.filter(F.col("pk") % EVERY == 0).select(F.col("pk").alias("qid"), F.col("vector").alias("qvec"))
    return i.batch_search(i.bucketed(df), queries, 5, digits=DIGITS)


IVF_TRAINED = f"""WITH {EMB}, {TWO_ROUNDS}, a AS (SELECT e.pk, e.vector, arg_min(n.cluster, struct_pack(d := {l2('e.vector', 'n.cv')}, k := n.cluster)) AS cluster FROM emb e, c2 n GROUP BY e.pk, e.vector),
    o AS (SELECT e.pk AS qid, e.vector AS qvec, n.cluster, row_number() OVER (PARTITION BY e.pk ORDER BY {l2('e.vector', 'n.cv')}, n.cluster) AS r FROM emb e, c2 n WHERE e.pk % {EVERY} = 0),
    s AS (SELECT qid, pk, round({l2('vector', 'qvec')}, {DIGITS}) AS score FROM a JOIN o USING (cluster) WHERE r <= 3)
    SELECT qid, CAST(rank AS INTEGER) AS rank, pk, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, pk) AS rank FROM s) WHERE rank <= 5"""


def ivf_changes(spark, d):
    """Buckets after inserts, some over rows that are there, and removals; with empty ones."""
    i, df = index(spark, d), vectors(spark, d)
    held = i.insert(i.bucketed(df.filter("pk % 3 < 2")), df.filter("pk % 3 > 0"))
    return i.statistics(i.remove(held, df.filter("pk % 5 = 0").select("pk"))).select(F.col("bucket").cast("bigint").alias("bucket"), "n")


def ivfpq_trained(spark, d):
    """Codes of residuals from the trained index's centroids; the codebook is that of the lowest rows."""
    i = ivf.IvfPqIndex(trained(spark, d), book(spark, d))
    return i.search(i.encoded(vectors(spark, d)), vector_of(spark, d, 20), 10, 3, digits=DIGITS)


def book(spark, d) -> quantize.ProductQuantizer:
    rows = centroids(spark, d, CODES)
    return quantize.ProductQuantizer([[r[s * WIDTH : (s + 1) * WIDTH] for r in rows] for s in range(M)])


SUBS = f"subs AS (SELECT pk, s, vector[s * {WIDTH} + 1 : (s + 1) * {WIDTH}] AS v FROM emb, range({M}) t(s))"
CODED = f"""{SUBS}, b AS (SELECT s, pk AS code, v AS c FROM subs WHERE pk < {CODES}),
    e AS (SELECT x.pk, x.s, arg_min(b.code, struct_pack(d := {l2('x.v', 'b.c')}, k := b.code)) AS code, min({l2('x.v', 'b.c')}) AS d FROM subs x JOIN b USING (s) GROUP BY x.pk, x.s)"""


def pq_encode(spark, d):
    return vectors(spark, d).select("pk", F.posexplode(book(spark, d).encode(F.col("vector"))).alias("s", "code")).select("pk", F.col("s").cast("bigint").alias("s"), F.col("code").cast("bigint").alias("code"))


def pq_error(spark, d):
    pq = book(spark, d)
    return vectors(spark, d).select("pk", F.round(quantize.squared_error(F.col("vector"), pq.decode(pq.encode(F.col("vector")))), DIGITS).alias("error"))


def pq_adc(spark, d):
    pq = book(spark, d)
    codes = vectors(spark, d).select("pk", pq.encode(F.col("vector")).alias("codes"))
    return codes.select("pk", F.round(pq.adc(F.col("codes"), vector_of(spark, d, 20)), DIGITS).alias("score")).orderBy("score", "pk").limit(10)


PQ_ADC = f"WITH {EMB}, {CODED}, t AS (SELECT b.s, b.code, {l2('b.c', 'x.v')} AS d FROM b JOIN subs x ON x.s = b.s AND x.pk = 20) SELECT e.pk, round(sum(t.d), {DIGITS}) AS score FROM e JOIN t USING (s, code) GROUP BY e.pk ORDER BY score, pk LIMIT 10"


def ivfpq(spark, d):
    """Buckets of the K lowest rows; codes of the differences from a codebook of the lowest rows' sub-vectors."""
    i = ivf.IvfPqIndex(index(spark, d), book(spark, d))
    return i.search(i.encoded(vectors(spark, d)), vector_of(spark, d, 20), 10, 3, digits=DIGITS)


IVFPQ = f"""WITH {EMB}, {ASSIGNED}, r AS (SELECT a.pk, a.cluster, list_transform(list_zip(CAST(a.vector AS DOUBLE[]), CAST(n.cv AS DOUBLE[])), lambda x: x[1] - x[2]) AS r FROM a JOIN n USING (cluster)),
    {SUBS}, b AS (SELECT s, pk AS code, v AS c FROM subs WHERE pk < {CODES}),
    rs AS (SELECT pk, cluster, s, r[s * {WIDTH} + 1 : (s + 1) * {WIDTH}] AS v FROM r, range({M}) t(s)),
    e AS (SELECT x.pk, x.cluster, x.s, arg_min(b.code, struct_pack(d := {l2('x.v', 'b.c')}, k := b.code)) AS code FROM rs x JOIN b USING (s) GROUP BY ALL),
    pr AS (SELECT cluster, list_transform(list_zip(CAST({q(20)} AS DOUBLE[]), CAST(cv AS DOUBLE[])), lambda x: x[1] - x[2]) AS qr FROM n ORDER BY {l2('cv', q(20))}, cluster LIMIT 3),
    t AS (SELECT pr.cluster, b.s, b.code, {l2(f'qr[b.s * {WIDTH} + 1 : (b.s + 1) * {WIDTH}]', 'b.c')} AS d FROM pr, b)
    SELECT e.pk, round(sum(t.d), {DIGITS}) AS score FROM e JOIN t USING (cluster, s, code) GROUP BY e.pk ORDER BY score, pk LIMIT 10"""


#: The same search with the centroids of two rounds.
IVFPQ_TRAINED = IVFPQ.replace(ASSIGNED, f"{TWO_ROUNDS}, n AS (SELECT cluster, cv FROM c2), a AS (SELECT e.pk, e.vector, arg_min(n.cluster, struct_pack(d := {l2('e.vector', 'n.cv')}, k := n.cluster)) AS cluster FROM emb e, n GROUP BY e.pk, e.vector)")


def total(codes):
    return F.aggregate(codes, F.lit(0).cast("bigint"), lambda s, x: s + x)


def int8_codes(spark, d):
    c = quantize.int8(F.col("vector"))
    return vectors(spark, d).select("pk", total(c["codes"]).alias("codes"), F.round(quantize.squared_error(F.col("vector"), quantize.int8_decode(c)), 6).alias("error"))


INT8 = "i8 AS (SELECT pk, vector, list_min(v) AS lo, CASE WHEN list_max(v) = list_min(v) THEN 1.0 ELSE (list_max(v) - list_min(v)) / 255 END AS sc, v FROM (SELECT pk, vector, CAST(vector AS DOUBLE[]) AS v FROM emb)), c8 AS (SELECT *, list_transform(v, lambda x: greatest(-128, least(127, CAST(round((x - lo) / sc) AS BIGINT) - 128))) AS codes FROM i8)"


def int8_dot(spark, d):
    df = vectors(spark, d).select("pk", quantize.int8(F.col("vector")).alias("c"))
    return df.join(df.select((F.col("pk") - 1).alias("pk"), F.col("c").alias("e")), "pk").select("pk", F.round(quantize.int8_dot(F.col("c"), F.col("e")), DIGITS).alias("dot"))


def decoded(x: str) -> str:
    return f"list_transform({x}.codes, lambda k: (k + 128) * {x}.sc + {x}.lo)"


def int4_pack(spark, d):
    c = quantize.int4(F.col("vector"))
    return vectors(spark, d).select("pk", total(c["packed"]).alias("packed"), F.size(c["packed"]).alias("bytes"), F.round(quantize.squared_error(F.col("vector"), quantize.int4_decode(c)), DIGITS).alias("error"))


INT4 = "i4 AS (SELECT pk, list_min(v) AS lo, CASE WHEN list_max(v) = list_min(v) THEN 1.0 ELSE (list_max(v) - list_min(v)) / 15 END AS sc, v FROM (SELECT pk, CAST(vector AS DOUBLE[]) AS v FROM emb)), c4 AS (SELECT *, list_transform(v, lambda x: greatest(0, least(15, CAST(round((x - lo) / sc) AS BIGINT)))) AS codes FROM i4)"


def fp16(spark, d):
    v = quantize.fp16(F.col("vector"))
    return vectors(spark, d).select("pk", F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(quantize.squared_error(F.col("vector"), v) * 1e6, 3).alias("error"))


FP16 = f"""WITH {EMB}, h AS (SELECT pk, vector, list_transform(CAST(vector AS DOUBLE[]), lambda x: CASE WHEN abs(x) < 6.103515625e-05 THEN 0.0 ELSE sign(x) * floor(abs(x) / pow(2.0, floor(log2(abs(x))) - 10)) * pow(2.0, floor(log2(abs(x))) - 10) END) AS w FROM emb)
    SELECT pk, round(list_sum(w), 6) AS total, round({l2('vector', 'w')} * 1e6, 3) AS error FROM h"""


def fp16_codes(spark, d):
    codes = quantize.fp16_codes(F.col("vector"))
    return vectors(spark, d).select("pk", total(F.transform(codes, lambda c: c.cast("bigint"))).alias("codes"), F.round(quantize.squared_error(F.col("vector"), quantize.fp16_decode(codes)) * 1e6, 3).alias("error"))


FP16_CODES = FP16.replace("SELECT pk, round(list_sum(w), 6) AS total,", "SELECT pk, CAST(list_sum(list_transform(w, lambda x: CASE WHEN x = 0 THEN 0 ELSE (floor(log2(abs(x))) + 15) * 1024 + abs(x) / pow(2.0, floor(log2(abs(x))) - 10) - 1024 + CASE WHEN x < 0 THEN 32768 ELSE 0 END END)) AS BIGINT) AS codes,")


def as_rows(spark, centers):
    return spark.createDataFrame([(c, i, float(x)) for c, v in enumerate(centers) for i, x in enumerate(v)], "cluster long, i long, x double")


def embedded(spark, d):
    df = table(spark, d, "documents").select("doc_id", embed_column(Initials, F.col("text")).alias("v"))
    return df.select("doc_id", F.aggregate("v", F.lit(0.0), lambda s, x: s + x).cast("bigint").alias("words"), F.element_at("v", 1).cast("bigint").alias("a"))


EMBEDDED = r"WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '(?:^|\s)([a-z])', 1) AS w FROM documents) SELECT doc_id, CAST(len(w) AS BIGINT) AS words, CAST(len(list_filter(w, lambda x: x = 'a')) AS BIGINT) AS a FROM w"

def embedded_sparse(spark, d):
    df = table(spark, d, "documents").select("doc_id", embed_sparse_column(Initials, F.col("text")).alias("v"))
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    return df.select("doc_id", F.size("v.indices").cast("bigint").alias("letters"), add(F.col("v.indices").cast("array<double>")).cast("bigint").alias("places"), add(F.col("v.values")).cast("bigint").alias("words"))


EMBEDDED_SPARSE = r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '(?:^|\s)([a-z])', 1) AS w FROM documents)
    SELECT doc_id, CAST(len(list_distinct(w)) AS BIGINT) AS letters, CAST(coalesce(list_sum(list_transform(list_distinct(w), lambda x: ascii(x) - 97)), 0) AS BIGINT) AS places, CAST(len(w) AS BIGINT) AS words FROM w"""

REGISTRY = {
    "assign_centroids": (assign, f"WITH {EMB}, {ASSIGNED} SELECT pk, cluster, round(d, {DIGITS}) AS d FROM a"),
    "lloyd_step": (lloyd, f"WITH {EMB}, {ASSIGNED}, p AS (SELECT cluster, unnest(range(len(vector))) AS i, CAST(unnest(vector) AS DOUBLE) AS x FROM a) SELECT cluster, i, round(avg(x), {DIGITS}) + 0.0 AS x, count(*) AS n FROM p GROUP BY cluster, i"),
    "inertia": (inertia, f"WITH {EMB}, {ASSIGNED} SELECT round(sum(d), {DIGITS}) AS inertia FROM a"),
    "minibatch_step": (minibatch, MINIBATCH),
    "ivf_probe": ivf_probe(3),
    "ivf_exhaustive": ivf_probe(K),
    "ivf_batch": (ivf_batch, IVF_BATCH),
    "kmeans_rounds": (kmeans_rounds, f"WITH {EMB}, {TWO_ROUNDS} SELECT cluster, CAST(unnest(range(len(cv))) AS BIGINT) AS i, round(unnest(cv), {DIGITS}) + 0.0 AS x FROM c2"),
    "ivf_trained": (ivf_trained, IVF_TRAINED),
    "ivf_changes": (ivf_changes, f"WITH {EMB}, {ASSIGNED} SELECT n.cluster AS bucket, count(a.pk) AS n FROM n LEFT JOIN (SELECT * FROM a WHERE pk % 5 <> 0) a USING (cluster) GROUP BY n.cluster"),
    "ivfpq_trained": (ivfpq_trained, IVFPQ_TRAINED),
    "pq_encode": (pq_encode, f"WITH {EMB}, {CODED} SELECT pk, s, code FROM e"),
    "pq_decode_error": (pq_error, f"WITH {EMB}, {CODED} SELECT pk, round(sum(d), {DIGITS}) AS error FROM e GROUP BY pk"),
    "pq_adc_topk": (pq_adc, PQ_ADC),
    "ivfpq_topk": (ivfpq, IVFPQ),
    "int8_codes": (int8_codes, f"WITH {EMB}, {INT8} SELECT pk, CAST(list_sum(codes) AS BIGINT) AS codes, round({l2('v', decoded('c8'))}, 6) AS error FROM c8"),
    "int8_dot": (int8_dot, f"WITH {EMB}, {INT8} SELECT x.pk, round({ip(decoded('x'), decoded('y'))}, {DIGITS}) AS dot FROM c8 x JOIN c8 y ON y.pk = x.pk + 1"),
    "int4_pack": (int4_pack, f"WITH {EMB}, {INT4} SELECT pk, CAST(list_sum(list_transform(range(1, len(codes), 2), lambda k: codes[k] * 16 + codes[k + 1])) AS BIGINT) AS packed, CAST((len(codes) + 1) // 2 AS INTEGER) AS bytes, round({l2('v', 'list_transform(codes, lambda k: k * sc + lo)')}, {DIGITS}) AS error FROM c4"),
    "fp16_decode": (fp16, FP16),
    "fp16_codes": (fp16_codes, FP16_CODES),
    "kmeans_full": (lambda s, d: as_rows(s, cluster.kmeans(vectors(s, d), 5, max_iters=6, seed=1)), None),
    "kmeans_minibatch": (lambda s, d: as_rows(s, cluster.minibatch_kmeans(vectors(s, d), 5, 64, 5, seed=1)), None),
    "elbow": (lambda s, d: s.createDataFrame(cluster.elbow(vectors(s, d), range(1, 4), max_iters=3), "k long, inertia double"), None),
    "pq_train": (lambda s, d: as_rows(s, [c for sub in quantize.ProductQuantizer.train(vectors(s, d), 64, 4, 8, 3).codebook for c in sub]), None),
    "embed_udf": (embedded, EMBEDDED),
    "embed_sparse_udf": (embedded_sparse, EMBEDDED_SPARSE),
}
