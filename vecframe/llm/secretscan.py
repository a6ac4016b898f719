"""Secret scans with corpus-wide ownership frequency, in DataFrame expressions alone.

Base spans come from three patterns. Besides, every long run of credential letters that
mixes letters and digits is a candidate. Candidates' hashes are counted over the corpus
by distinct repositories and owners: a value that few of them hold looks live and is
added as an `owned` span; one that many hold is a widely copied example and is not.

Spark gives matches without places, so places are the running lengths of the pieces
between matches and of the matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontaminate import let, row_keys
from .shared import written

#: The patterns of the contract. Runs below their least length cannot match in `access` and `hex`.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Candidates: runs of 20 and more, with a digit and a letter among them.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
MAX_OWNERS = MAX_REPOS = 2
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"
CHUNK = 128


def running(values: Column) -> Column:
    """Sums of the first, the first two, ... of an array of longs; in chunks, so that long arrays are not copied time and again."""

    def sums(xs: Column, start: Column) -> Column:
        return F.slice(F.aggregate(xs, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))), 2, F.size(xs))

    zero = F.lit(0).cast("long")
    count = F.floor((F.size(values) + CHUNK - 1) / CHUNK).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), count - 1), lambda c: F.slice(values, c * CHUNK + 1, CHUNK))
    starts = lambda cs: F.concat(F.array(zero), sums(F.transform(cs, lambda c: F.aggregate(c, zero, lambda a, x: a + x)), zero))
    return let(chunks, lambda cs: let(starts(cs), lambda at: F.flatten(F.transform(cs, lambda c, k: sums(c, F.get(at, k))))))


def places(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """The spans of the pattern's matches, leftmost and not overlapping; keep(k) says whether match k from 0 counts."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)

    def spans(f: Column) -> Column:
        lengths = F.transform(f, lambda m: F.length(m).cast("long"))
        return let(lengths, lambda n: let(before(n), lambda at: F.transform(at, lambda s, k: F.struct(s.alias("start"), F.lit(kind).alias("kind"), (s + F.get(n, k)).alias("end")))))

    def before(n: Column) -> Column:
        return let(pieces, lambda p: running(F.transform(n, lambda _, k: F.length(F.get(p, k)).cast("long") + F.when(k > 0, F.get(n, k - 1)).otherwise(0))))

    out = let(found, lambda f: F.when(F.size(f) > 0, spans(f)))
    if keep is not None:
        out = let(out, lambda o: let(keep, lambda ok: F.filter(o, lambda s, k: F.get(ok, k))))
    return F.when(F.regexp_like(text, F.lit(pattern)), out).otherwise(F.array().cast(SPAN))


def named(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scanned(docs: DataFrame, repo: str, owner: str) -> DataFrame:
    """doc_id, k1, k2, base spans, candidates with their hashes, repo and owner of each document; written once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.col(repo).cast("string").alias("repo"), F.col(owner).cast("string").alias("owner"))
    t = F.col("text")
    long_value = F.transform(F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(1)), lambda v: F.length(v) >= ASSIGN_VALUE)
    candidates = let(places(t, CANDIDATE, 3), lambda c: let(F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0)), lambda v: F.transform(c, lambda s, k: F.struct(F.xxhash64(F.get(v, k)).alias("h1"), F.xxhash64(F.lit("value"), F.get(v, k)).alias("h2"), s.alias("span")))))
    return written(
        base.select(
            "doc_id",
            *row_keys("doc_id", "text"),
            "repo",
            "owner",
            places(t, ASSIGN, 0, long_value).alias("assign"),
            places(t, ACCESS, 1).alias("access"),
            places(t, HEX, 2).alias("hex"),
            F.when(F.regexp_like(t, F.lit(CANDIDATE)), candidates).alias("candidates"),
        ),
        "scanned",
    )


def secret_spans(docs: DataFrame, repo: str = "source", owner: str = "source", max_repos: int = MAX_REPOS, max_owners: int = MAX_OWNERS) -> DataFrame:
    """doc_id, k1, k2, assign, access, hex, owned (arrays of spans) of each document.

    docs needs doc_id, text and the columns of repositories and owners; a null repository
    or owner counts as none. By default both are the column source, so that the two counts
    are one and copies within a single source count once. A null text counts as empty; texts of any length are read whole. Every row keeps a row, also
    where doc_ids are null or repeated; equal rows have equal spans. k1 and k2 name a
    row by doc_id and text. An empty table gives no rows.
    """
    scan = scanned(docs, repo, owner)
    held = scan.select("k1", "k2", "repo", "owner", F.explode("candidates").alias("c")).select("k1", "k2", "repo", "owner", "c.*")
    counts = held.groupBy("h1", "h2", "repo", "owner").agg(F.lit(1).alias("one"))  # first by place, so that a common value does not meet in one task
    counts = counts.groupBy("h1", "h2", "repo").agg(F.collect_set("owner").alias("owners"))
    each = counts.select("h1", "h2", F.lit(0).alias("what"), F.col("repo").alias("name")).union(counts.select("h1", "h2", F.lit(1), F.explode("owners"))).distinct()
    few = each.groupBy("h1", "h2").agg(F.count(F.when(F.col("what") == 0, F.col("name"))).alias("repos"), F.count(F.when(F.col("what") == 1, F.col("name"))).alias("owners")).filter((F.col("repos") <= max_repos) & (F.col("owners") <= max_owners)).select("h1", "h2")
    live = held.select("k1", "k2", "h1", "h2", "span").distinct().join(few, ["h1", "h2"], "left_semi")
    owned = live.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("span")).alias("owned"))
    return scan.drop("candidates", "repo", "owner").join(owned, ["k1", "k2"], "left").withColumn("owned", F.coalesce("owned", F.array().cast(SPAN)))


def scan_secrets(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_owned of each document; as secret_spans otherwise."""
    found = secret_spans(docs, **options)
    base = F.concat("assign", "access", "hex")
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(named(base).cast("binary"), 256).alias("base_sha256"),
        named(F.concat(base, "owned")).alias("spans"),
        F.size("owned").cast("long").alias("n_owned"),
    )


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with the union of the spans replaced, each run by one mark."""
    runs = F.aggregate(
        F.array_sort(spans),
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda acc, s: F.when((F.size(acc) > 0) & (s["start"] <= F.element_at(acc, -1)["end"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))))).otherwise(
            F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))
        ),
    )
    piece = lambda start, end: F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))
    kept = let(runs, lambda r: F.concat(F.array_join(F.transform(r, lambda s, k: F.concat(piece(F.when(k > 0, F.get(r, k - 1)["end"]).otherwise(0), s["start"]), F.lit(mark))), ""), piece(F.element_at(r, -1)["end"], F.length(text).cast("long"))))
    return F.when(F.size(spans) > 0, kept).otherwise(text)
