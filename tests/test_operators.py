import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecframe.embed import DimensionMismatch, EmptyInput, HttpEmbedding, ParseError
from vecframe.functions import dense, sparse
from vecframe.operators import cluster, fusion, ivf, quantize, search
from vecframe.schema import Metric


def lists(spark, **named):
    return spark.createDataFrame([(n, str(pk), float(s)) for n, hits in named.items() for pk, s in hits], "list_name string, pk string, score double")


def pairs(df):
    return {r.pk: r.score for r in df.collect()}


def test_fusion(spark):
    two = lists(spark, a=[(1, 0.9), (2, 0.8), (3, 0.7)], b=[(2, 0.95), (1, 0.85), (4, 0.6)])
    got = pairs(fusion.rrf(two, 10))
    assert got["1"] == got["2"] == pytest.approx(1 / 60 + 1 / 61)  # Q20
    assert pairs(fusion.weighted_sum(lists(spark, a=[(1, 1), (2, 0)], b=[(2, 1), (1, 0)]), 10, {"a": 10.0})) == {"1": 10.0, "2": 1.0}
    assert pairs(fusion.weighted_sum(lists(spark, a=[(1, 5)], b=[(2, 3)]), 10)) == {"1": 1.0, "2": 1.0}
    assert pairs(fusion.union(two, 10)) == {"1": 0.9, "2": 0.95, "3": 0.7, "4": 0.6}
    assert pairs(fusion.intersect(two, 10, 2)) == {"1": 0.9, "2": 0.95} and pairs(fusion.intersect(two, 10, 3)) == {}
    assert fusion.rrf(two, 0).count() == 0
    assert next(iter(pairs(fusion.union(two, 1, higher_is_better=False)))) == "4"  # Q3


def test_rerankers(spark):
    two = lists(spark, dense=[("a", 0.9), ("b", 0.5)], sparse=[("b", 0.95), ("c", 0.6)])
    got = pairs(fusion.RrfReranker(10, 1).rerank(two))
    assert got == {"b": pytest.approx(1 / 3 + 1 / 2), "a": 0.5, "c": pytest.approx(1 / 3)}
    best = lambda metric, **n: fusion.WeightedReranker(metric, 5, {"dense": 10.0, "sparse": 0.1}).rerank(lists(spark, **n)).collect()[0].pk
    assert best(Metric.COSINE, dense=[("a", 0), ("b", 1)], sparse=[("b", 0), ("a", 1)]) == "a"
    assert best(Metric.L2, dense=[("a", 0), ("b", 100)]) == "a" and best(Metric.IP, dense=[("a", 10), ("b", -5)]) == "a"
    with pytest.raises(fusion.EmptyInput):
        fusion.RrfReranker().rerank(two.limit(0))


def test_kernels(spark):
    r = spark.range(1).select(
        dense.inner_product([1, 2, 3], [4, 5, 6]).alias("ip"), dense.l2_squared([1, 0, 0], [0, 1, 0]).alias("l2"), dense.l2_normalize([3, 4]).alias("n"), dense.cosine_similarity([0, 0], [1, 1]).alias("c")
    ).head()
    assert (r.ip, r.l2, r.c) == (32, 2, 0) and r.n == pytest.approx([0.6, 0.8])


def test_sparse(spark):
    df = spark.createDataFrame([([4, 0, 2], [3.0, 1.0, 2.0], [1, 2, 4], [10.0, 20.0, 30.0])], "i array<bigint>, v array<double>, j array<bigint>, w array<double>")
    a, b = sparse.sparse(F.col("i"), F.col("v")), sparse.sparse(F.col("j"), F.col("w"))
    r = df.select(a.alias("a"), sparse.dot(a, b).alias("dot"), sparse.to_dense(a, 4).alias("d"), sparse.from_dense(F.array(*map(F.lit, [0.0, 1.5, 0.01])), 0.05).alias("s")).head()
    assert r.a.indices == [0, 2, 4] and r.dot == 130 and r.d == [1, 0, 2, 0] and r.s.indices == [1]
    with pytest.raises(Exception, match="repeated"):
        df.select(sparse.sparse(F.array(F.lit(1), F.lit(1)), F.array(F.lit(1.0), F.lit(2.0)))).collect()


@pytest.mark.parametrize("metric", list(Metric))
def test_batch_kernels_agree(spark, metric):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(f"p{i}", [float(x) for x in rng.normal(size=8)]) for i in range(60)] + [("z", [0.0] * 8), ("n", None)], "pk string, vector array<float>").repartition(3)
    queries = df.limit(9).filter("vector IS NOT NULL").select(F.col("pk").alias("qid"), F.col("vector").alias("qvec"))
    got = [{(r.qid, r["rank"]): (r.pk, round(r.score, 9)) for r in search.batch_knn(df, queries, 4, metric, kernel=k).collect()} for k in ("arrow", "expression")]
    assert got[0] == got[1] and len(got[0]) == 4 * queries.count()


def test_quantization(spark):
    values = [0.0, 1.0, -1.0, 0.5, 65504.0, -65504.0, 0.001, 3.14, 1e-6, 1e6, float("inf"), float("nan")]
    with np.errstate(over="ignore"):
        half = np.array(values).astype("f2").astype("f8")
    got = spark.range(1).select(quantize.fp16(F.array(*map(F.lit, values)), "nearest").alias("v")).head().v
    want = [0.0 if abs(v) < 2**-14 else v for v in half]
    assert all(a == b or (math.isnan(a) and math.isnan(b)) for a, b in zip(got, want, strict=True))
    trunc = spark.range(1).select(quantize.fp16(F.array(*map(F.lit, values[:8]))).alias("v")).head().v
    assert all(abs(a - b) <= 0.002 * abs(b) + 1e-4 for a, b in zip(trunc, values, strict=False))  # Q19
    ramp = [i / 255 for i in range(256)]
    r = spark.range(1).select(*(quantize.int8_decode(quantize.int8(F.array(*map(F.lit, v)))).alias(n) for n, v in (("ramp", ramp), ("same", [42.0] * 3))), quantize.int4_decode(quantize.int4(F.array(*map(F.lit, [float(i) for i in range(15)])))).alias("four")).head()
    assert max(abs(a - b) for a, b in zip(r.ramp, ramp, strict=True)) < 0.01 and r.same == [42.0] * 3
    assert r.four == pytest.approx(list(range(15)), abs=1.0) and len(r.four) == 15


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(2)
    rows = [(f"{b}-{i}", [float(x) for x in c + rng.uniform(-0.5, 0.5, 2)]) for b, c in enumerate(np.array([[0.0, 0.0], [10.0, 10.0], [20.0, 0.0]])) for i in range(30)]
    return spark.createDataFrame(rows, "pk string, vector array<float>").cache()


def test_clustering(spark, blobs):
    found = cluster.kmeans(blobs, 3, seed=4)
    assert sorted(tuple(round(x / 10) for x in c) for c in found) == [(0, 0), (1, 1), (2, 0)]
    small = sorted(tuple(round(x / 10) for x in c) for c in cluster.minibatch_kmeans(blobs, 3, 45, 8, seed=4))
    assert len(small) == 3
    same = blobs.limit(5).withColumn("vector", F.array(F.lit(1.0), F.lit(2.0)))
    assert cluster.inertia(same, cluster.kmeans(same, 9)).head()[0] == pytest.approx(0)
    for bad, k in ((blobs, 0), (blobs.limit(0), 3)):
        with pytest.raises(ValueError):
            cluster.kmeans(bad, k)
    curve = cluster.elbow(blobs, range(0, 4), max_iters=4)
    assert [k for k, _ in curve] == [1, 2, 3] and curve[0][1] > curve[2][1]


def test_minibatch_step_draws_from_the_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("pk"), F.col("embedding").alias("vector"))
    rows = df.select("pk", "vector", F.xxhash64(F.lit(7), F.lit(2), F.col("pk")).alias("h")).collect()
    x = {r.pk: np.array(r.vector, "f8") for r in rows}
    start = [x[k] for k in sorted(x)[:4]]
    drawn = [r.pk for r in sorted(rows, key=lambda r: (r.h, r.pk))[:100]]
    assert drawn != sorted(x)[:100]
    want, n = [c.copy() for c in start], [3] * 4
    for k in range(4):
        own = [x[pk] for pk in drawn if np.argmin([((x[pk] - c) ** 2).sum() for c in start]) == k]
        want[k], n[k] = (start[k] * 3 + sum(own)) / (3 + len(own)), 3 + len(own)
    got, counts = cluster.minibatch_step(df, [c.tolist() for c in start], [3] * 4, 100, step=2, seed=7)
    assert counts == n and np.allclose(got, want, rtol=0, atol=1e-9)


def test_ivf(spark, blobs, tmp_path):
    index = ivf.IvfIndex.train(blobs, params=ivf.IvfParams(3, 3))
    index.save(blobs, str(tmp_path / "ivf"))
    saved = spark.read.parquet(str(tmp_path / "ivf"))
    exact = [r.pk for r in search.knn(blobs, [0.1, 0.2], 7, Metric.L2).collect()]
    assert [r.pk for r in index.search(saved, [0.1, 0.2], 7).collect()] == exact
    one = index.search(saved, [0.1, 0.2], 7, 1)
    assert [r.pk for r in one.collect()] == exact
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan[plan.index("PartitionFilters: [") :].split("]")[0]
    with pytest.raises(ValueError):  # Q18
        ivf.IvfPqIndex(ivf.IvfIndex([[0.0]], Metric.IP), quantize.ProductQuantizer([[[0.0]]]))
    with pytest.raises(ValueError):  # Q25
        ivf.IvfIndex.train(blobs.limit(0))


def test_product_codes(spark, blobs):
    pq = quantize.ProductQuantizer.train(blobs, 2, 2, 8, 4)
    q = [3.0, 4.0]
    rows = blobs.select(pq.encode(F.col("vector")).alias("c")).select(pq.adc(F.col("c"), q).alias("adc"), dense.l2_squared(pq.decode(F.col("c")), q).alias("d"), F.size("c").alias("m")).collect()
    assert all(r.adc == pytest.approx(r.d) and r.m == 2 for r in rows)
    with pytest.raises(ValueError):
        quantize.ProductQuantizer.train(blobs, 2, 3, 8)


def test_embedding_client():
    calls = []

    def transport(url, headers, body, timeout):
        calls.append((url, headers))
        return {"data": [{"index": i, "embedding": [float(i), 1.0]} for i in reversed(range(len(body["input"])))]}

    client = HttpEmbedding("http://host/v1/embeddings", "m", api_key="k", transport=transport)
    assert client.dimension() == 2 and client.embed_batch(["a", "b"]) == [[0.0, 1.0], [1.0, 1.0]]
    assert calls[0][1] == {"Authorization": "Bearer k"}
    with pytest.raises(EmptyInput):
        client.embed("")
    with pytest.raises(DimensionMismatch):
        HttpEmbedding("u", "m", 3, transport=transport).embed("a")
    with pytest.raises(ParseError):
        HttpEmbedding("u", "m", transport=lambda *_: {"oops": 1}).embed("a")


def test_streams(spark, tmp_path):
    from vecframe.collection import Collection
    from vecframe.schema import CollectionConfig
    from vecframe.streaming import ingest

    src = str(tmp_path / "in")
    rows = [("a", [1.0, 0.0], "x", 1), ("a", [0.0, 1.0], "y", 2), ("b", [1.0, 1.0], "z", 1)]
    schema = "pk string, vector array<float>, name string, seq int"
    spark.createDataFrame(rows, schema).write.parquet(src)
    c = Collection.open(spark, f"file://{tmp_path}", "c", CollectionConfig(2, Metric.L2))
    ingest.upsert_stream(spark.readStream.schema(schema).parquet(src), c, "seq", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    assert c.doc_count() == 2 and c.fetch("a") == {"name": "y"}
    near = ingest.match_stream(spark.readStream.schema(schema).parquet(src).select(F.col("name").alias("qid"), F.col("vector").alias("qvec")), c, 0.5)
    near.writeStream.format("memory").queryName("near").trigger(availableNow=True).start().awaitTermination(120)
    assert {(r.qid, r.pk) for r in spark.table("near").collect()} == {("y", "a"), ("z", "b")}


def test_half_precision_codes(spark):
    x = [0.0, 1.0, -1.0, 0.5, 65504.0, 70000.0, -3.14, 0.001, 6.2e-5, 1e-9, float("nan"), float("-inf")]
    frame = spark.createDataFrame([(x,)], "v array<double>")
    r = frame.select(quantize.fp16_codes(F.col("v"), "nearest").alias("c"), quantize.fp16_decode(quantize.fp16_codes(F.col("v"), "nearest")).alias("d")).head()
    want = np.array(x).astype("f2")
    want[9] = 0
    assert [c for k, c in enumerate(r.c) if k != 10] == [int(c) for k, c in enumerate(want.view("u2")) if k != 10]
    assert np.array_equal(np.array(r.d), want.astype("f8"), equal_nan=True)


def test_many_centroids_agree_with_few(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x, c = rng.normal(size=(300, 6)).round(1), rng.normal(size=(20, 6)).round(1)
    c[7] = c[3]  # ties go to the first
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(900, None)], "pk long, vector array<double>").repartition(3)
    for metric in (Metric.L2, Metric.IP, Metric.COSINE):
        few = {r.pk: (r.cluster, r.d) for r in cluster.assigned(frame.filter("vector IS NOT NULL"), c.tolist(), metric).collect()}
        monkeypatch.setattr(cluster, "EXPRESSION_SIZE", 0)
        many = {r.pk: (r.cluster, r.d) for r in cluster.assigned(frame, c.tolist(), metric).collect()}
        monkeypatch.undo()
        assert many.pop(900) == (None, None)
        assert few.keys() == many.keys() and all(few[k][0] == many[k][0] and abs(few[k][1] - many[k][1]) < 1e-9 for k in few)


def test_batch_search_with_ties_and_many_batches(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 3, size=(700, 4)).astype("f8")
    best = search.Nearest(x[:9], 5, Metric.L2, None)
    best.HELD = 50
    for a in range(0, 700, 37):
        best.add(np.arange(9), x[a : a + 37], [f"k{n:04}" for n in range(a, min(700, a + 37))])
    got = {}
    for b in best.batches(list(range(9))):
        for q, pk in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            got.setdefault(q, []).append(pk)
    for q in range(9):
        d = ((x - x[q]) ** 2).sum(1)
        assert got[q] == [f"k{n:04}" for n in np.lexsort([np.arange(700), d])[:5]]


def test_index_maintenance(spark, blobs):
    index = ivf.IvfIndex.train(blobs, params=ivf.IvfParams(3, 3))
    held = index.bucketed(blobs)
    n = index.size(held)
    some = blobs.limit(4)
    assert index.size(index.remove(held, some)) == n - 4
    assert index.size(index.insert(held, some)) == n
    assert sum(r.n for r in index.statistics(held).collect()) == n
    assert index.probes_for(1, n) == 1 and index.probes_for(n, n) == 3


def test_awaitable_twins(spark):
    import asyncio

    from vecframe.embed import AsyncEmbedding
    from vecframe.queries.common import Initials

    model = AsyncEmbedding(Initials())
    assert model.dimension() == 26 and asyncio.run(model.embed("a b a"))[:2] == [2.0, 1.0]
    assert asyncio.run(model.embed_sparse_batch(["b"])) == [([1], [1.0])] and asyncio.run(model.embed_batch(["a"]))[0][0] == 1
    lists = spark.createDataFrame([("x", "a", 0.9), ("x", "b", 0.5), ("y", "b", 0.95)], "list_name string, pk string, score double")
    assert [r.pk for r in asyncio.run(fusion.AsyncReranker(fusion.RrfReranker(1)).hits(lists))] == ["b"]


def test_large_codebooks_agree_with_small(spark, blobs, monkeypatch):
    i = ivf.IvfPqIndex.train(blobs, 2, ivf.IvfParams(3, 3, 3, 2), 4)
    want = {r.pk: r.score for r in i.search(i.encoded(blobs), [0.1, 0.2], 20).collect()}
    monkeypatch.setattr(cluster, "EXPRESSION_SIZE", 0)
    got = {r.pk: r.score for r in i.search(i.encoded(blobs), [0.1, 0.2], 20).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    codes = i.encoded(blobs)
    decoded = codes.select("pk", i.pq.decode(F.col("codes")).alias("v")).collect()
    monkeypatch.undo()
    assert {r.pk: r.v for r in codes.select("pk", i.pq.decode(F.col("codes")).alias("v")).collect()} == {r.pk: r.v for r in decoded}


def test_seeds_are_distinct_rows(spark, blobs):
    seeds = cluster.plus_plus(blobs, 5, seed=3)
    assert seeds == cluster.plus_plus(blobs.repartition(5), 5, seed=3)
    assert len({tuple(x) for x in seeds}) == 5
    same = spark.createDataFrame([(k, [1.0, 1.0]) for k in range(4)], "pk long, vector array<double>")
    assert cluster.plus_plus(same, 9) == [[1.0, 1.0]] * 4
