"""Queries on collections: filters, the dialect, changes, schema evolution, diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dml
from ..schema import CollectionConfig, Metric, Schema
from ..collection import Collection
from ..plans.query import Query
from ..sources.documents import documents
from .common import TEXTS, events, folder, table, texts

FILTERS = {
    "filter_eq": ("lang = 'en'", "lang = 'en'"),
    "filter_ne": ("quality != '1'", "quality <> '1' OR quality IS NULL"),
    "filter_range": ("source >= 'src10' AND source < 'src2'", "source >= 'src10' AND source < 'src2'"),
    "filter_in": ("lang IN ('de', 'fr')", "lang IN ('de', 'fr')"),
    "filter_contains": ("tags CONTAINS 'src3'", "list_contains(list_transform(string_split(tags, ','), lambda x: trim(x)), 'src3')"),
    "filter_like_prefix": ("source LIKE 'src1%'", "starts_with(source, 'src1')"),
    "filter_like_suffix": ("source LIKE '%7'", "suffix(source, '7')"),
    "filter_like_infix": ("text LIKE '%token%'", "contains(text, 'token')"),
    "filter_like_exact": ("source LIKE 'src1'", "source = 'src1'"),
    "filter_null": ("quality IS NULL", "quality IS NULL"),
    "filter_notnull": ("toxic IS NOT NULL", "toxic IS NOT NULL"),
    "filter_not": ("NOT (quality = '0' OR lang LIKE 'e%')", "NOT (coalesce(quality = '0', false) OR coalesce(starts_with(lang, 'e'), false))"),
    "filter_nested": ("lang = 'en' OR quality = '0' AND NOT toxic = '1' AND NOT source IN ('src1', 'src2')", "lang = 'en' OR (coalesce(quality = '0', false) AND NOT coalesce(toxic = '1', false) AND NOT coalesce(source IN ('src1', 'src2'), false))"),
}


def filtered(name: str):
    text, sql = FILTERS[name]

    def run(spark, d):
        c = texts(spark, d)
        return c.df.filter(c.condition(text)).select("pk", "lang", "source", "quality", "toxic")

    return run, f"WITH {TEXTS} SELECT pk, lang, source, quality, toxic FROM docs WHERE {sql}"


def dialect(query: str, of, sql: str):
    return (lambda spark, d: of(spark, d).query(query)), sql


EVENTS = "evt AS (SELECT CAST(event_id AS VARCHAR) AS pk, event_type, CAST(user_id AS VARCHAR) AS user_id, props FROM events)"


def star(spark, d):
    return events(spark, d).query("SELECT * FROM e WHERE event_type != 'click' LIMIT 25").drop("_extra")


def fetch(spark, d):
    return texts(spark, d).df.filter("pk = '7'").select("pk", "lang", "source")


def reopened(spark, d):
    """Two flushes, a second opening and an optimised snapshot; then a count on what is stored."""
    old, new = pieces(spark, d)
    root, config = folder(spark, "collections"), old.config
    with Collection.open(spark, root, "docs", config) as c:
        c.upsert(old.df)
    with Collection.open(spark, root, "docs") as c:
        c.upsert(new.df)
    stored = Collection.open(spark, root, "docs")
    stored.optimize()
    return Collection.open(spark, root, "docs").query("SELECT lang, COUNT(*) FROM c GROUP BY lang WHERE source LIKE 'src1%'")


def built(spark, d):
    """A query from the builder, two conditions and all."""
    return texts(spark, d).query(Query.select("lang", "source").where("lang IN ('de', 'es')").where("quality IS NOT NULL").order_by("source", True).limit(30))


def halves(spark, d):
    """Documents of doc_id mod 3 = 0 or 1, and a second version of those of 1 or 2."""
    df = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("pk"), "lang", "source", "doc_id")
    old = df.filter("doc_id % 3 < 2").drop("doc_id")
    new = df.filter("doc_id % 3 > 0").withColumn("lang", F.concat(F.lit("new-"), "lang")).drop("doc_id")
    return old, new


HALVES = "d AS (SELECT CAST(doc_id AS VARCHAR) AS pk, lang, source, doc_id FROM documents), old AS (SELECT pk, lang, source FROM d WHERE doc_id % 3 < 2), new AS (SELECT pk, 'new-' || lang AS lang, source FROM d WHERE doc_id % 3 > 0)"
MERGED = f"WITH {HALVES} SELECT * FROM new UNION ALL SELECT * FROM old WHERE pk NOT IN (SELECT pk FROM new)"


def pieces(spark, d) -> tuple[Collection, Collection]:
    schema = Schema.of(lang="filtered", source="filtered")
    return tuple(Collection(spark, CollectionConfig(64, Metric.IP, schema), documents(x, "pk")) for x in halves(spark, d))


def upsert(spark, d):
    old, new = pieces(spark, d)
    old.upsert(new.df)
    return old.df.select("pk", "lang", "source")


def upsert_batch(spark, d):
    """Each key twice in the batch; the second wins."""
    old, new = halves(spark, d)
    twice = new.withColumn("seq", F.lit(1)).unionByName(new.withColumn("lang", F.upper("lang")).withColumn("seq", F.lit(2)))
    return dml.upsert_batch(old, twice, "seq")


def deleted(spark, d):
    c = texts(spark, d)
    n = c.delete_by_filter("lang = 'en' AND quality = '1'")
    return c.df.groupBy("lang").agg(F.count("*").alias("rest")).withColumn("gone", F.lit(n).cast("bigint"))


def removed(spark, d):
    c = texts(spark, d)
    assert c.remove("7") and not c.remove("7")
    return c.df.select("pk", "lang")


def merge_two(spark, d):
    a, b = pieces(spark, d)
    a.merge_from(b)
    return a.df.select("pk", "lang", "source")


def merge_many(spark, d):
    a, b = pieces(spark, d)
    third = Collection(spark, a.config, a.df.filter("lang = 'de'").withColumn("source", F.lit("third")))
    return Collection.merge_many([a, b, third]).df.select("pk", "lang", "source")


def loose(spark, d) -> Collection:
    """Documents whose source is not declared."""
    df = table(spark, d, "documents").select("doc_id", "lang", "source")
    return Collection(spark, CollectionConfig(64, Metric.IP, Schema.of(lang="filtered")), documents(df, "doc_id"))


def schema_add(spark, d):
    c = loose(spark, d)
    c.add_field("source", "filtered")
    return c.df.filter(c.condition("source = 'src1'")).select("pk", "lang", "source")


def schema_drop(spark, d):
    c = loose(spark, d)
    c.drop_field("lang")
    return c.query("SELECT COUNT(*) FROM c WHERE lang IS NULL")


def schema_rename(spark, d):
    c = loose(spark, d)
    c.rename_field("lang", "language")
    return c.query("SELECT language, COUNT(*) FROM c GROUP BY language")


def undeclared(spark, d):
    return loose(spark, d).query("SELECT source, COUNT(*) FROM c GROUP BY source WHERE source LIKE 'src1%'")


def diagnostics(spark, d):
    c = texts(spark, d)
    return dml.posting_stats(c.df, {n: r for n, r in c.config.schema.fields if r != "string"}).withColumn("avg_posting", F.round("avg_posting", 6))


DIAGNOSTICS = f"""WITH {TEXTS}, v AS (
        SELECT DISTINCT pk, 'tags' AS field, unnest(list_filter(list_transform(string_split(tags, ','), lambda x: trim(x)), lambda x: x <> '')) AS value FROM docs
        UNION ALL SELECT pk, 'lang', lang FROM docs WHERE lang IS NOT NULL UNION ALL SELECT pk, 'source', source FROM docs WHERE source IS NOT NULL
        UNION ALL SELECT pk, 'quality', quality FROM docs WHERE quality IS NOT NULL UNION ALL SELECT pk, 'toxic', toxic FROM docs WHERE toxic IS NOT NULL),
    n AS (SELECT field, value, count(*) AS n FROM v GROUP BY ALL)
    SELECT field, count(*) AS terms, round(avg(n), 6) AS avg_posting, max(n) AS max_posting FROM n GROUP BY field"""

REGISTRY = {
    **{name: filtered(name) for name in FILTERS},
    "reopened": (reopened, f"WITH {HALVES}, m AS ({MERGED.split(' ', 1)[1].removeprefix(HALVES).strip()}) SELECT lang, count(*) AS count FROM m WHERE starts_with(source, 'src1') AND lang IS NOT NULL GROUP BY lang"),
    "query_builder": (built, f"WITH {TEXTS} SELECT pk AS _pk, lang, source FROM docs WHERE lang IN ('de', 'es') AND quality IS NOT NULL ORDER BY coalesce(source, '') DESC, pk LIMIT 30"),
    "point_lookup": (fetch, f"WITH {TEXTS} SELECT pk, lang, source FROM docs WHERE pk = '7'"),
    "select_fields": dialect("SELECT lang, source FROM d WHERE lang = 'es'", texts, f"WITH {TEXTS} SELECT pk AS _pk, lang, source FROM docs WHERE lang = 'es'"),
    "select_star_limit": (star, f"WITH {EVENTS} SELECT pk AS _pk, event_type, user_id, props FROM evt WHERE event_type <> 'click' OR event_type IS NULL ORDER BY _pk LIMIT 25"),
    "order_by_field": dialect("SELECT source, lang FROM d WHERE lang != 'en' ORDER BY source LIMIT 40", texts, f"WITH {TEXTS} SELECT pk AS _pk, source, lang FROM docs WHERE lang <> 'en' OR lang IS NULL ORDER BY coalesce(source, ''), pk LIMIT 40"),
    "order_by_missing": dialect("SELECT quality FROM d ORDER BY quality DESC LIMIT 500", texts, f"WITH {TEXTS} SELECT pk AS _pk, quality FROM docs ORDER BY coalesce(quality, '') DESC, pk LIMIT 500"),
    "order_by_unselected": dialect("SELECT lang FROM d ORDER BY source LIMIT 30", texts, f"WITH {TEXTS} SELECT pk AS _pk, lang FROM docs ORDER BY coalesce(source, ''), pk LIMIT 30"),
    "count_all": dialect("SELECT COUNT(*) FROM e", events, "SELECT count(*) AS count FROM events"),
    "count_where": dialect("SELECT COUNT(*) FROM d WHERE quality != '1' AND tags CONTAINS 'en'", texts, f"WITH {TEXTS} SELECT count(*) AS count FROM docs WHERE (quality <> '1' OR quality IS NULL) AND list_contains(string_split(tags, ','), 'en')"),
    "group_count": dialect("SELECT event_type, COUNT(*) FROM e GROUP BY event_type", events, "SELECT event_type, count(*) AS count FROM events WHERE event_type IS NOT NULL GROUP BY event_type"),
    "group_count_where": dialect("SELECT quality, COUNT(*) FROM d GROUP BY quality WHERE lang = 'en'", texts, f"WITH {TEXTS} SELECT quality, count(*) AS count FROM docs WHERE lang = 'en' AND quality IS NOT NULL GROUP BY quality"),
    "undeclared_field": (undeclared, "SELECT source, count(*) AS count FROM documents WHERE starts_with(source, 'src1') GROUP BY source"),
    "upsert": (upsert, MERGED),
    "upsert_batch_lastwins": (upsert_batch, f"WITH {HALVES} SELECT pk, upper(lang) AS lang, source FROM new UNION ALL SELECT * FROM old WHERE pk NOT IN (SELECT pk FROM new)"),
    "remove_by_key": (removed, f"WITH {TEXTS} SELECT pk, lang FROM docs WHERE pk <> '7'"),
    "delete_by_filter": (deleted, f"WITH {TEXTS} SELECT lang, count(*) AS rest, (SELECT count(*) FROM docs WHERE lang = 'en' AND quality = '1') AS gone FROM docs WHERE NOT coalesce(lang = 'en' AND quality = '1', false) GROUP BY lang"),
    "merge_two": (merge_two, MERGED),
    "merge_many": (merge_many, f"WITH {HALVES}, m AS (SELECT 1 AS n, * FROM old UNION ALL SELECT 2, * FROM new UNION ALL SELECT 3, pk, lang, 'third' FROM old WHERE lang = 'de') SELECT pk, arg_max(lang, n) AS lang, arg_max(source, n) AS source FROM m GROUP BY pk"),
    "schema_add": (schema_add, "SELECT CAST(doc_id AS VARCHAR) AS pk, lang, source FROM documents WHERE source = 'src1'"),
    "schema_drop": (schema_drop, "SELECT count(*) AS count FROM documents"),
    "schema_rename": (schema_rename, "SELECT lang AS language, count(*) AS count FROM documents GROUP BY lang"),
    "diagnostics_postings": (diagnostics, DIAGNOSTICS),
}
