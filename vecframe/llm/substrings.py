"""Exact substring dedup: bytes of repeated spans go, found by suffix arrays of shards.

Which texts have to meet is found by anchors: of the hashes of GRAM bytes, the least in
each stretch of `span` bytes. Equal stretches have equal anchors, so the stretches of one
anchor in one document, a context, need comparing only with contexts of the same anchor.

* Contexts that are equal as a whole repeat as a whole; a count by hash finds them.
* Of the others, one of each kind goes to the shard of its anchor, where a suffix array
  and common prefixes give the repeated stretches.
* An anchor with very many kinds of contexts is cut into several shards. Their stretches
  meet as sorted hashes, in ranges, where binary search finds those of several shards.

The same search over texts coded as two bytes a word finds passages of so many words that
several documents share, whatever their case, spacing and punctuation.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, small, worker_state, written
from .suffixes import repeats
from .textbytes import SpanHash, groups, mix, utf8, words

SPAN, GRAM = 400, 64
PASSAGE, PASSAGE_GRAM = 50, 8  # words
PIECE = 1 << 19  # bytes of a text that are searched for anchors at once
SHARD = 3 << 19  # bytes of a suffix array
HOT = 2_000  # kinds of contexts of an anchor in one shard
BITS = 9  # of left and width in a place; so span - GRAM is below 512


def contexts(data: np.ndarray, offsets: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchor, hash, text, first place, anchor's distance and number of stretches of each context."""
    n, width = len(data), span - gram + 1
    if n < span:
        return tuple(np.empty(0, t) for t in ("u8", "u8", "i8", "i8", "i8", "i8"))
    span_hash = SpanHash(data)
    i = np.arange(n - gram + 1)
    h = span_hash(i, i + gram)
    low = np.uint64((1 << 20) - 1)
    least, size = (h & ~low) | i.astype("u8"), 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if width > size:
        least = np.minimum(least[: size - width], least[width - size :])
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = np.flatnonzero(doc[: n - span + 1] == doc[span - 1 :])
    if not len(whole):
        return contexts(data[:0], offsets[:1], span, gram)
    at = (least[whole] & low).astype("i8")
    first = np.ones(len(whole), bool)
    first[1:] = (at[1:] != at[:-1]) | (whole[1:] != whole[:-1] + 1)
    first = np.flatnonzero(first)
    last = np.append(first[1:], len(whole)) - 1
    start, anchor = whole[first], at[first]
    wide, left = whole[last] - start + 1, anchor - start
    own = mix(span_hash(start, whole[last] + span) + left.astype("u8") * np.uint64(0x9E3779B97F4A7C15))
    return h[anchor], own, doc[start], start - offsets[doc[start]], left, wide


def anchored(units: DataFrame, span: int, gram: int) -> DataFrame:
    """key (anchor), own (hash of the context), k (document) and at (place, distance, width) of every context."""

    def find(batches):
        worker_state("anchors")
        for batch in batches:
            names = batch.column(0).to_numpy()
            data, offsets = utf8(batch.column(1))
            for a, b in groups(offsets, PIECE):
                size = int(offsets[b] - offsets[a])
                for s in range(0, max(size, 1), PIECE) if b == a + 1 else (0,):
                    to = min(size, s + PIECE + span - 1) if b == a + 1 else size
                    piece = data[offsets[a] + s : offsets[a] + to]
                    bounds = np.array([0, to - s]) if b == a + 1 else offsets[a : b + 1] - offsets[a]
                    key, own, doc, start, left, wide = contexts(piece, bounds, span, gram)
                    at = ((start + s) << (2 * BITS)) | (left << BITS) | wide
                    yield pa.RecordBatch.from_arrays([pa.array(key.view("i8")), pa.array(own.view("i8")), pa.array(names[a + doc]), pa.array(at)], ["key", "own", "k", "at"])

    return units.select("k", "data").mapInArrow(find, "key long, own long, k long, at long")


def interval(start, stop):
    """A span of a document in one long: texts are below 2 ** 31 bytes."""
    return F.shiftleft(start, 31).bitwiseOR(stop)


def of_context(at, span: int):
    start = F.shiftright(at, 2 * BITS)
    return interval(start, start + at.bitwiseAND((1 << BITS) - 1) + F.lit(span - 1))


def cut(chosen: DataFrame, units: DataFrame, span: int) -> DataFrame:
    """The bytes of chosen contexts (k, key, shard, at, n)."""

    def take(batches):
        for batch in batches:
            keep: list[list] = [[], [], [], [], [], []]
            cols = [batch.column(c).to_pylist() for c in range(5)]
            data, offsets = utf8(batch.column(5))
            for row, (k, keys, shards, ats, ns) in enumerate(zip(*cols, strict=True)):
                raw = data[offsets[row] : offsets[row + 1]]
                for values in zip(keys, shards, ats, ns, strict=True):
                    start, wide = values[2] >> (2 * BITS), values[2] & ((1 << BITS) - 1)
                    for c, v in zip(keep, (*values[:2], k, *values[2:], raw[start : start + wide + span - 1].tobytes()), strict=True):
                        c.append(v)
            kinds = (pa.int64(),) * 5 + (pa.binary(),)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(keep, kinds, strict=True)], ["key", "shard", "k", "at", "n", "bytes"])

    wanted = chosen.groupBy("k").agg(*(F.collect_list(c).alias(c) for c in ("key", "shard", "at", "n")))  # all lists in one order; a document's contexts
    joined = units.select("k", "data").join(wanted, "k").select("k", "key", "shard", "at", "n", "data")
    return joined.mapInArrow(take, "key long, shard long, k long, at long, n long, bytes binary")


def found_in(rows: list[tuple], span: int, across: bool) -> tuple[list[int], list[int]]:
    """Documents and intervals of the stretches that repeat among contexts (key, shard, k, at, n, bytes); across: in another document."""
    owner, place, run = repeats([r[5] for r in rows], span)
    k = np.array([r[2] for r in rows], "i8")[owner] if len(owner) else np.empty(0, "i8")
    start = (np.array([r[3] for r in rows], "i8") >> (2 * BITS))[owner] + place if len(owner) else k
    many = np.array([r[4] for r in rows], "i8")[owner] > 1 if len(owner) else np.empty(0, bool)
    if not len(owner):
        return [], []
    # a stretch repeats if its run has two places in the corpus: contexts of one document can overlap
    order = np.lexsort([start, k, run])
    k, start, run, many = k[order], start[order], run[order], many[order]
    same_run = run[1:] == run[:-1]
    other = np.zeros(len(run), bool)
    other[1:] = same_run & ((k[1:] != k[:-1]) | ((start[1:] != start[:-1]) & (not across)))
    ids = np.cumsum(np.concatenate([[0], ~same_run]))
    good = np.bincount(ids, other | many) > 0
    keep = good[ids]
    return merged(k[keep], start[keep], span)


def merged(k: np.ndarray, start: np.ndarray, span: int) -> tuple[list[int], list[int]]:
    """Stretches as maximal intervals of each document."""
    if not len(k):
        return [], []
    order = np.lexsort([start, k])
    k, start = k[order], start[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (start[1:] > start[:-1] + span)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(k)) - 1
    return k[first].tolist(), ((start[first] << 31) | (start[last] + span)).tolist()


def in_shards(cuts: DataFrame, span: int, across: bool) -> DataFrame:
    """k, span of what repeats within each shard (key, shard); a suffix array covers whole shards."""

    def search(batches):
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= SHARD and row[:2] != last:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found_in(held, span, across)], ["k", "span"])
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
                last = row[:2]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found_in(held, span, across)], ["k", "span"])

    return cuts.repartition("key", "shard").sortWithinPartitions("key", "shard").mapInArrow(search, "k long, span long")


def stretch_hashes(raw: bytes, span: int) -> np.ndarray:
    i = np.arange(len(raw) - span + 1)
    return SpanHash(np.frombuffer(raw, "u1"))(i, i + span)


def between_shards(cuts: DataFrame, span: int, across: bool) -> DataFrame:
    """k, span of what repeats between the shards of one key. cuts has shards: the number for the key."""
    unsigned = lambda xs: np.frombuffer(b"".join(xs), "u8")
    signed = lambda xs: np.frombuffer(b"".join(xs), "i8")

    def export(pdf: pd.DataFrame) -> pd.DataFrame:
        each = [stretch_hashes(b, span) for b in pdf["bytes"]]
        hashes, owner = np.concatenate(each), np.repeat(pdf["k"].to_numpy(), [len(h) for h in each])
        order = np.lexsort([owner, hashes])
        hashes, owner = hashes[order], owner[order]
        first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        last = np.append(first[1:], len(hashes)) - 1
        hashes, low, high = hashes[first], owner[first], owner[last]  # the least and the last document with it
        ranges = int(pdf["shards"].iloc[0])
        bounds = np.searchsorted(hashes >> np.uint64(32), np.arange(ranges + 1, dtype="u8") * np.uint64(1 << 32) // np.uint64(ranges))
        return pd.DataFrame([(pdf["key"].iloc[0], pdf["shard"].iloc[0], r, *(x[bounds[r] : bounds[r + 1]].tobytes() for x in (hashes, low, high))) for r in range(ranges)], columns=["key", "shard", "range", "hashes", "low", "high"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        every, low, high = unsigned(pdf["hashes"]), signed(pdf["low"]), signed(pdf["high"])
        order = np.argsort(every)
        every, low, high = every[order], low[order], high[order]
        first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.empty(0, "i8")
        if across and len(first):
            twice = every[first][np.minimum.reduceat(low, first) != np.maximum.reduceat(high, first)]
        else:
            twice = every[first][np.diff(np.append(first, len(every))) > 1]
        out = []
        for key, shard, raw in zip(pdf["key"], pdf["shard"], pdf["hashes"], strict=True):
            own = np.frombuffer(raw, "u8")
            at = np.searchsorted(own, twice)
            hit = twice[(at < len(own)) & (own[np.minimum(at, len(own) - 1)] == twice)] if len(own) else own
            if len(hit):
                out.append((key, shard, hit.tobytes()))
        return pd.DataFrame(out, columns=["key", "shard", "hashes"])

    def mark(rows: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(hits):
            return pd.DataFrame({"k": pd.Series(dtype="i8"), "span": pd.Series(dtype="i8")})
        wanted = np.sort(unsigned(hits["hashes"]))
        ks, starts = [], []
        for k, at, raw in zip(rows["k"], rows["at"], rows["bytes"], strict=True):
            h = stretch_hashes(raw, span)
            i = np.searchsorted(wanted, h)
            place = np.flatnonzero((i < len(wanted)) & (wanted[np.minimum(i, len(wanted) - 1)] == h))
            ks.append(np.full(len(place), k))
            starts.append((at >> (2 * BITS)) + place)
        return pd.DataFrame(dict(zip(("k", "span"), merged(np.concatenate(ks).astype("i8"), np.concatenate(starts).astype("i8"), span), strict=True)), dtype="int64")

    exported = cuts.groupBy("key", "shard").applyInPandas(export, "key long, shard long, range long, hashes binary, low binary, high binary")
    met = exported.groupBy("key", "range").applyInPandas(meet, "key long, shard long, hashes binary")
    return cuts.groupBy("key", "shard").cogroup(met.groupBy("key", "shard")).applyInPandas(mark, "k long, span long")


def repeated(units: DataFrame, span: int, gram: int, hot: int, across: bool = False) -> DataFrame:
    """k, spans: the intervals of the strings of `span` bytes that start anywhere else, for each of units (k, data).

    With across, of those that another unit holds; of equal contexts in one unit alone, one place is given."""
    every = written(anchored(units, span, gram), "anchors")
    several = F.min("k") != F.max("k") if across else F.count("*") > 1
    known = every.groupBy("key").agg(several.alias("several"), F.min("own").alias("a"), F.max("own").alias("b")).filter("several").select("key", (F.col("a") != F.col("b")).alias("mixed"))
    shared = written(every.join(small(written(known, "known")), "key"), "shared")
    mixed = shared.filter("mixed").select("key", "own", "k", "at")
    kinds = written(mixed.groupBy("key", "own").agg(F.when(several, 2).otherwise(1).cast("long").alias("n"), F.min(F.struct("k", "at")).alias("one")), "kinds")
    twice = mixed.join(small(written(kinds.filter("n > 1").select("key", "own"), "twice")), ["key", "own"], "left_semi")
    spans = [shared.filter("NOT mixed"), twice]
    found = [x.select("k", of_context(F.col("at"), span).alias("span")) for x in spans]
    shards = small(written(kinds.groupBy("key").agg(F.ceil(F.count("*") / hot).alias("shards")), "shards"))
    chosen = kinds.join(shards, "key").select("key", "one.k", "one.at", "n", "shards", F.pmod(F.xxhash64("own"), F.col("shards")).alias("shard"))
    cuts = written(cut(chosen, units, span), "contexts")
    found.append(in_shards(cuts, span, across))
    crowded = shards.filter("shards > 1")
    if crowded.limit(1).count():
        found.append(between_shards(cuts.join(crowded, "key"), span, across))
    intervals = found[0]
    for more in found[1:]:
        intervals = intervals.union(more)
    return written(intervals.groupBy("k").agg(F.collect_set("span").alias("spans")), "marks")


def coded_words(docs: DataFrame) -> DataFrame:
    """k, data of docs (k, text): two bytes of a hash for each word, in lower case."""

    def code(batches):
        worker_state("words")
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in groups(offsets):
                h, _, ends = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                cuts = np.concatenate([[0], 2 * ends]).astype("i4")
                values = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer((h >> np.uint64(48)).astype("<u2").tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], values], ["k", "data"])

    return docs.select("k", "text").mapInArrow(code, "k long, data binary")


def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, hot: int = HOT, keep_text: bool = False, passage: int = PASSAGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and shares_passage of each document, and what is kept of its
    bytes if asked for.

    A byte goes if a string of `span` bytes that covers it also starts anywhere else, in
    the same document or another; strings are judged on the input and never cross
    documents. shares_passage says whether another document holds `passage` consecutive words
    of this one, in any case, spacing and punctuation (words by 16 bits of their hashes,
    so that runs which differ in one word are taken as equal once in 65536); nothing is
    removed for that.

    docs needs doc_id and text; further columns are ignored. A null text is empty; texts
    may be of any length. Every row is a document of its own, also where doc_ids are null or
    repeated: two equal rows of `span` bytes or more lose all of them (but share no
    passage with each other, being one document by id). An empty table gives no rows.
    """
    if not gram < span < gram + (1 << BITS) - 1:
        raise ValueError("span must be above gram, by less than 511")
    if not PASSAGE_GRAM < passage < PASSAGE_GRAM + (1 << BITS) // 2 - 1:
        raise ValueError("a passage has 9 to 262 words")
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("k", F.xxhash64("doc_id", "text"))
    marks = repeated(base.filter(F.octet_length("text") >= span).select("k", F.col("text").alias("data")), span, gram, hot)
    coded = written(coded_words(base.filter(F.octet_length("text") >= 2 * passage - 1)).filter(F.octet_length("data") >= 2 * passage), "words")
    shared = repeated(coded, 2 * passage, 2 * PASSAGE_GRAM, hot, across=True).select("k", F.lit(True).alias("shares"))

    def digest(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            cols: list[list] = [[], [], [], [], []]
            for row, spans in enumerate(batch.column(2).to_pylist()):
                raw = data[offsets[row] : offsets[row + 1]].tobytes()
                kept, at, removed, runs = [], 0, 0, 0
                end = -1
                for s in sorted(spans or ()):
                    start, stop = s >> 31, s & ((1 << 31) - 1)
                    if start > end:
                        runs += 1
                        kept.append(raw[at:start])
                    if stop > end:
                        removed += stop - max(start, end, 0)
                        end = at = stop
                kept.append(raw[at:])
                left = b"".join(kept)
                for c, v in zip(cols, (len(raw), removed, runs, hashlib.sha256(left).hexdigest(), left), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            made = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
            out = [batch.column(0), *made[:4], batch.column(3), made[4]]
            yield pa.RecordBatch.from_arrays(out[: 6 + keep_text], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "shares_passage", "kept"][: 6 + keep_text])

    joined = base.join(marks, "k", "left").join(shared, "k", "left").select("doc_id", "text", "spans", F.coalesce("shares", F.lit(False)))
    return joined.mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, shares_passage boolean" + ", kept binary" * keep_text)
