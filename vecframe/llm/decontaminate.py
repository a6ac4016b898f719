"""Benchmark decontamination by winnowing, in DataFrame expressions alone.

Of the hashes of K consecutive words, the least in every stretch of SPAN words is kept.
Two equal stretches keep the same hash, so each stretch of SPAN words that a document
shares with a benchmark item shows as a common fingerprint. Documents with a common
fingerprint are read again, each hit is extended to the stretches that it stands for, and
those are compared by a 128-bit hash of all their words. An item of fewer than SPAN
words is one stretch, with a fingerprint of all of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small, written

#: The words of the contract, in lower case.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS, SMALLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPAN, K = 13, 5
SHARE = 20  # contaminated: one word in so many


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, not once for each use inside a lambda."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, CAPITALS, SMALLS))


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(0))


def runs(w: Column, k: int, of: Callable[[Column], Column]) -> Column:
    """of(place) for each place from 1 at which k items start; none if there are fewer."""
    n = F.size(w) - (k - 1)
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), of))


def winnowed(w: Column, span: int, k: int) -> Column:
    """For each stretch of span words the least hash of k words in it; null if there is none."""
    grams = runs(w, k, lambda i: F.xxhash64(F.slice(w, i, k)))
    return let(grams, lambda h: runs(h, span - k + 1, lambda i: F.array_min(F.slice(h, i, span - k + 1))))


def short_print(w: Column, m: int) -> Column:
    """The fingerprint of a stretch of m words, apart from those of other lengths."""
    return F.xxhash64(F.lit(m), w)


def short_prints(w: Column, m: int) -> Column:
    return runs(w, m, lambda i: short_print(F.slice(w, i, m), F.lit(m)))


def stretch_hash(w: Column) -> list[Column]:
    return [F.xxhash64(w).alias("h1"), F.xxhash64(F.lit("stretch"), w).alias("h2")]


def row_keys(*columns: str) -> list[Column]:
    """128 bits that name a row by its id and text; equal rows share them."""
    return [F.xxhash64(*columns).alias("k1"), F.xxhash64(F.lit("row"), *reversed(columns)).alias("k2")]


def stretches(benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """item_id (text), w (words) and m (how many) for each stretch of each item, once."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))
    w = let(words(F.col("text")), lambda x: F.when(F.size(x) >= span, runs(x, span, lambda i: F.slice(x, i, span))).when(F.size(x) >= 1, F.array(x)))
    return items.select("item_id", F.explode(w).alias("w")).withColumn("m", F.size("w")).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K, keys: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each document.

    With keys, also k1 and k2, which name a row by doc_id and text as row_keys does. docs
    needs doc_id and text, benchmark item_id and text; further columns are ignored. A
    null or empty text has no words and is clean; texts of any length are read whole. Each
    row of docs has a row, also where doc_ids are null or repeated. Rows of the benchmark with the same item_id are one item;
    a null item_id is the item named "". Empty tables give clean documents or no rows.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = written(stretches(benchmark, span).select("item_id", "m", *stretch_hash(F.col("w")), F.when(F.col("m") == span, winnowed(F.col("w"), span, k)[0]).otherwise(short_print(F.col("w"), F.col("m"))).alias("print")), "stretches")
    lengths = sorted(r.m for r in parts.filter(F.col("m") < span).select("m").distinct().collect())  # below span
    prints = small(parts.select("print").distinct())

    def fingerprints(w: Column) -> Column:
        kinds = [F.coalesce(winnowed(w, span, k), F.array().cast("array<long>"))]
        kinds += [F.coalesce(short_prints(w, m), F.array().cast("array<long>")) for m in lengths]
        return F.array_distinct(F.concat(*kinds))

    read = let(words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), fingerprints(w).alias("prints")))
    scan = written(base.select("doc_id", *row_keys("doc_id", "text"), read.alias("read")).select("doc_id", "k1", "k2", "read.*"), "fingerprints")  # texts are split into words once
    printed = scan.select("k1", "k2", F.explode("prints").alias("print"))
    hits = written(printed.join(prints, "print", "left_semi").groupBy("k1", "k2").agg(F.collect_set("print").alias("prints")), "hits")

    def extended(w: Column) -> Column:
        """Places of the stretches that a common fingerprint stands for."""
        def kept(m: int, print_at: Column) -> Column:
            at = F.transform(print_at, lambda p, i: F.when(F.array_contains(F.col("prints"), p), F.struct((i + 1).alias("at"), F.lit(m).alias("m"))))
            return F.coalesce(F.filter(at, lambda x: x.isNotNull()), F.array().cast("array<struct<at:int,m:int>>"))

        kinds = [kept(span, winnowed(w, span, k))]
        kinds += [kept(m, short_prints(w, m)) for m in lengths]
        return F.transform(F.concat(*kinds), lambda x: let(F.slice(w, x["at"], x["m"]), lambda s: F.struct(x["at"].alias("at"), x["m"].alias("m"), *stretch_hash(s))))

    again = base.filter("text IS NOT NULL").select(*row_keys("doc_id", "text"), "text").join(small(hits), ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    found = again.select("k1", "k2", F.explode(let(words(F.col("text")), extended)).alias("s")).select("k1", "k2", "s.*")
    known = small(parts.select("m", "h1", "h2").distinct())
    found = written(found.join(known, ["m", "h1", "h2"], "left_semi"), "found")
    reach = F.aggregate(
        F.array_sort(F.collect_list(F.struct("at", "m"))),
        F.struct(F.lit(1).alias("next"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(F.greatest(acc["next"], x["at"] + x["m"]).alias("next"), (acc["n"] + F.greatest(F.lit(0), x["at"] + x["m"] - F.greatest(acc["next"], x["at"]))).alias("n")),
        lambda acc: acc["n"],
    )
    covered = found.groupBy("k1", "k2").agg(reach.alias("n_hit"))
    named = found.select("k1", "k2", "m", "h1", "h2").distinct().join(small(parts.select("item_id", "m", "h1", "h2")), ["m", "h1", "h2"]).select("k1", "k2", "item_id").distinct()
    named = named.groupBy("k1", "k2").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item_id")), ",").cast("binary"), 256).alias("items_sha256"))
    marks = small(written(covered.join(named, ["k1", "k2"]), "marks"))
    hit, items = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("n_items", F.lit(0).cast("long"))
    return scan.drop("prints").join(marks, ["k1", "k2"], "left").select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        items.alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        ((hit > 0) & (SHARE * hit >= F.col("n_words"))).alias("contaminated"),
        *(["k1", "k2"] if keys else []),
    )
