"""Stages of a corpus pipeline: documents in, documents of the same columns out.

docs needs doc_id and text, and lang and source where a stage says so; all columns, whatever
their names, are carried on as they are. Texts are read whole, of any length.
An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bagminhash, bpe, decontaminate, langid, secretscan
from .shared import small, written


def keyed(docs: DataFrame) -> DataFrame:
    """docs in one struct beside the keys of doc_id and text, so that no column can clash."""
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return row.select("row", *decontaminate.row_keys("doc_id", "text"))


def known_languages(docs: DataFrame) -> DataFrame:
    """Drops documents that language identification rejects.

    Null, empty and letterless texts go. Repeated rows stay or go together; ties and null
    doc_ids are as in langid.identify. Columns may have any names; an empty table stays empty.
    """
    return langid.accepted(docs)


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """Keeps the least doc_id of each group of near duplicates, in one row; rows without doc_id stay.

    Null and empty texts are alone and stay. Of rows with the same doc_id the one with the
    least text stays, by a hash of the row in ties.
    """
    classes = bagminhash.near_duplicates(docs)
    gone = written(classes.filter("doc_id <> class_id").select("doc_id").distinct(), "gone")
    kept = docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)
    again = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").limit(1).count()
    if again:
        rows = kept.select(F.struct(*docs.columns).alias("row"))
        one = rows.filter("row.doc_id IS NOT NULL").groupBy("row.doc_id").agg(F.min_by("row", F.struct(F.col("row.text"), F.xxhash64("row"))).alias("row")).select("row")
        kept = one.union(rows.filter("row.doc_id IS NULL")).select("row.*")
    return kept


def uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Drops documents that the contamination rule marks. Null and empty texts stay; equal rows stay or go together."""
    bad = decontaminate.contamination(docs, benchmark, keys=True).filter("contaminated").select("k1", "k2").distinct()
    return keyed(docs).join(small(written(bad, "bad")), ["k1", "k2"], "left_anti").select("row.*")


def without_secrets(docs: DataFrame) -> DataFrame:
    """Replaces secrets in texts by a mark; every document stays. n_chars, if there, follows.

    docs needs source too. Null texts stay null; equal rows are redacted alike.
    """
    found = secretscan.secret_spans(docs).select("k1", "k2", F.concat("assign", "access", "hex", "owned").alias("spans")).filter(F.size("spans") > 0)
    found = small(written(found.dropDuplicates(["k1", "k2"]), "spans"))
    text = F.when(F.col("spans").isNotNull(), secretscan.redacted(F.col("row.text").cast("string"), F.col("spans"))).otherwise(F.col("row.text"))
    out = keyed(docs).join(found, ["k1", "k2"], "left").select(*(text.alias(c) if c == "text" else F.col(f"row.{c}") for c in docs.columns))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast(dict(docs.dtypes)["n_chars"]))
    return out


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Ids and decoded text of each document, as digests; as bpe.encode_decode."""
    return bpe.encode_decode(docs, tokenizer)
