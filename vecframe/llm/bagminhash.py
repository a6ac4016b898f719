"""Near duplicates by BagMinHash signatures of word shingles.

A text is the multiset of its shingles of K words. For each shingle, the weights from
nothing upwards are cut into dyadic nodes [0, 1), [1, 2), [2, 4), ...; a node is a
Poisson process in time whose rate is the node's length. Each of its points falls on one
register and on one level within the node, and counts for a text if that level is
below the shingle's count there. A register keeps its earliest point. Two texts keep the
same point with the probability of their weighted Jaccard similarity. Points are made in
order of time and only while they can still be the earliest somewhere.

Registers are joined in bands, and texts that share a band are candidates. Texts that
share many bands with the least text of these bands are compared with it exactly, and the
links found make components. Where the texts of a band are then of several components,
those outside its largest component meet all texts of the band in blocks: first as
shingle counts folded to FOLD buckets, from which no text can look less similar than it is,
then, where these leave it possible, as texts. So a group of copies costs its size, not the
square of it, and no pair of candidates between components is left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import bounded_batches, id_and_text, lean, small, worker_state, written
from .textbytes import BASE, counted, groups, mix, shingles, utf8

K, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 5
SLICE = 1 << 19
BLOCK = 1_000  # texts of a band that meet in one group with as many others
BLOCK_BYTES = 8 << 20  # of their texts
FOLD = 256  # buckets to which shingle counts are folded; the first bits of a hash name one
FULL = 0xFFFF  # the most that a bucket holds


def uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype("f8") + 0.5) * 2.0**-53


def signatures(doc: np.ndarray, element: np.ndarray, count: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """The point that each register of each text keeps, as 32 bits of its hash; texts without elements have zeros."""
    nodes = np.ceil(np.log2(np.maximum(count, 1))).astype("i8") + 1
    who = np.repeat(np.arange(len(doc)), nodes)
    level = np.arange(len(who)) - np.repeat(np.cumsum(nodes) - nodes, nodes)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    length = np.maximum(low, 1)
    seed = mix(element[who] * np.uint64(BASE) + level.astype("u8"))
    owner, weight = doc[who], count[who]
    kept = np.full(texts * registers, np.iinfo("u8").max, "u8")
    time = np.zeros(len(who))
    live, made = np.arange(len(who)), 0
    while len(live):
        many = 1 if made < 2 else 8
        for _ in range(many):
            made += 1
            h = mix(seed[live] + np.uint64(made * 0x632BE59BD9B4E019 % (1 << 64)))
            time[live] -= np.log(uniform(h)) / length[live]
            g = mix(h + np.uint64(BASE))
            register = ((g >> np.uint64(40)) * np.uint64(registers) >> np.uint64(24)).astype("i8")
            ok = np.ones(len(live), bool)
            wide = length[live] > 1
            if wide.any():
                at = low[live] + (uniform(mix(g)) * length[live]).astype("i8")
                ok = ~wide | (at < weight[live])
            point = (time[live].astype("f4").view("u4").astype("u8") << np.uint64(32)) | (g & np.uint64(0xFFFFFFFF))
            np.minimum.at(kept, (owner[live] * registers + register)[ok], point[ok])
        latest = kept.reshape(texts, registers).max(1)
        live = live[(time[live].astype("f4").view("u4").astype("u8") << np.uint64(32)) <= latest[owner[live]]]
    kept = kept.reshape(texts, registers)
    return np.where(kept == np.iinfo("u8").max, 0, kept & np.uint64(0xFFFFFFFF))


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    rows = signature.shape[1] // bands
    out = np.zeros((len(signature), bands), "u8") + np.arange(bands, dtype="u8") * np.uint64(0xA24BAED4963EE407)
    parts = signature.reshape(len(signature), bands, rows)
    for j in range(rows):
        out = mix((out + parts[:, :, j]) * np.uint64(BASE))
    return out


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], pairs: int) -> np.ndarray:
    """Of the multisets of shingles (hash, pair) on both sides; 0 where either is empty."""
    key_a, n_a = np.unique((a[1].astype("u8") << np.uint64(48)) | (a[0] >> np.uint64(16)), return_counts=True)
    key_b, n_b = np.unique((b[1].astype("u8") << np.uint64(48)) | (b[0] >> np.uint64(16)), return_counts=True)
    common, i, j = np.intersect1d(key_a, key_b, assume_unique=True, return_indices=True)
    least = np.bincount((common >> np.uint64(48)).astype("i8"), np.minimum(n_a[i], n_b[j]), pairs)
    total = np.bincount(a[1], minlength=pairs) + np.bincount(b[1], minlength=pairs)
    return least / np.maximum(total - least, 1)


def folded(h: np.ndarray, doc: np.ndarray, texts: int) -> np.ndarray:
    """How many shingles each text has in each of FOLD buckets, up to FULL."""
    bucket = (h >> np.uint64(64 - (FOLD - 1).bit_length())).astype("i8")
    return np.minimum(np.bincount(doc * FOLD + bucket, minlength=texts * FOLD), FULL).astype("<u2").reshape(texts, FOLD)


def signed(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, t1, t2 (a hash of the text), bands (keys; none for a text without words), folded (shingles in each
    of FOLD buckets, 16 bits each) and size (shingles)."""
    registers = bands * rows
    names = ["doc_id", "t1", "t2", "bands", "folded", "size"]

    def sign(batches):
        worker_state("signatures")
        for batch in lean(batches):
            data, offsets = utf8(batch.column(3))
            for a, b in groups(offsets, SLICE):
                for a2 in range(a, b, 10_000):  # counted() takes up to 65536 texts
                    b2 = min(b, a2 + 10_000)
                    h, doc = shingles(data[offsets[a2] : offsets[b2]], offsets[a2 : b2 + 1] - offsets[a2], k)
                    s = signatures(*counted(h, doc), b2 - a2, registers)
                    size = np.bincount(doc, minlength=b2 - a2)
                    keys = band_keys(s, bands).view("i8")[size > 0]
                    ends = np.concatenate([[0], np.cumsum((size > 0) * bands)]).astype("i4")
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1)))
                    at = np.arange(b2 - a2 + 1, dtype="i4") * (2 * FOLD)
                    counts = pa.Array.from_buffers(pa.binary(), b2 - a2, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(folded(h, doc, b2 - a2).tobytes())])
                    yield pa.RecordBatch.from_arrays([*(c[a2:b2] for c in batch.columns[:3]), lists, counts, pa.array(size)], names)

    hashed = docs.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("t"), "text").alias("t2"), "text")
    return hashed.mapInArrow(sign, "doc_id long, t1 long, t2 long, bands array<long>, folded binary, size long")


def alike(pairs: DataFrame, texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """Of pairs (a, b), those whose texts (node, text) have at least the similarity."""

    def check(batches):
        worker_state("signatures")
        for batch in lean(batches):
            left, right = utf8(batch.column(2)), utf8(batch.column(3))
            both = left[1] + right[1]
            for s, e in groups(both, SLICE):
                for s2 in range(s, e, 60_000):
                    e2 = min(e, s2 + 60_000)
                    sides = [shingles(d[o[s2] : o[e2]], o[s2 : e2 + 1] - o[s2], k) for d, o in (left, right)]
                    ok = pa.array(weighted_jaccard(*sides, e2 - s2) >= similarity - 1e-12)
                    yield pa.RecordBatch.from_arrays([c[s2:e2].filter(ok) for c in batch.columns[:2]], ["a", "b"])

    first = pairs.join(texts.withColumnRenamed("node", "a").withColumnRenamed("text", "text_a"), "a")
    second = first.join(texts.withColumnRenamed("node", "b").withColumnRenamed("text", "text_b"), "b")
    return second.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long")


def dealt(rows: DataFrame, bytes_column: str | None = None) -> DataFrame:
    """rows (band, node, own, ...) of bands with several components, as groups (band, i, j).

    A group holds a block of the band's texts (asks false) and a block of those outside its
    largest component (asks true), each of at most about BLOCK texts, or BLOCK_BYTES of
    the column named. minor says whether a text is outside the largest component.
    """
    volume = F.col(bytes_column) if bytes_column else F.lit(0)
    each = rows.groupBy("band", "own").agg(F.count("*").alias("n"), F.sum(volume).alias("v"))
    total = each.groupBy("band").agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.max(F.struct("n", "own", "v")).alias("most"), F.count("*").alias("kinds")).filter("kinds > 1")
    blocks = lambda n, v: F.greatest(F.ceil(n / BLOCK), F.ceil(v / BLOCK_BYTES), F.lit(1)).cast("int")
    mixed = total.select("band", F.col("most.own").alias("major"), blocks(F.col("n"), F.col("v")).alias("is"), blocks(F.col("n") - F.col("most.n"), F.col("v") - F.col("most.v")).alias("js"))
    held = rows.join(small(written(mixed, "mixed")), "band").withColumn("minor", F.col("own") != F.col("major"))
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = held.withColumn("asks", F.lit(False)).withColumn("i", part("is")).withColumn("j", every("js"))
    asking = held.filter("minor").withColumn("asks", F.lit(True)).withColumn("j", part("js")).withColumn("i", every("is"))
    return asked.unionByName(asking).drop("is", "js", "major")


def in_groups(rows: DataFrame, find, schema: str) -> DataFrame:
    """What find(table, starts) yields for tables of whole groups (band, i, j) that start at the given rows."""
    names = rows.columns

    def search(batches):
        worker_state("signatures")
        held = []
        for batch in lean(batches):
            held.append(batch)
            table = pa.Table.from_batches(held).combine_chunks()
            keys = np.stack([table.column(c).to_numpy() for c in ("band", "i", "j")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            if len(cuts):
                yield from find(table.slice(0, cuts[-1]), np.concatenate([[0], cuts[:-1]]))
                held = table.slice(cuts[-1]).to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from find(table, np.array([0]))

    return rows.select(*names).repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(search, schema)


def candidates(asks: int, at: np.ndarray, own: np.ndarray, node: np.ndarray, minor: np.ndarray, size: np.ndarray, counts: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows `at`, those of other components that may be similar enough to row `asks`, and the most that they can be.

    Folded counts have at least as many shingles in common as the texts, so that no similar text
    is left out. Where buckets of both texts may be full, they leave the pair possible.
    """
    at = at[(own[at] != own[asks]) & (~minor[at] | (node[at] < node[asks]))]
    at = at[np.minimum(size[at], size[asks]) >= similarity * np.maximum(size[at], size[asks]) - 1e-6]
    common = np.minimum(counts[at], counts[asks]).sum(1, dtype="i8")
    most = np.where(np.minimum(size[at], size[asks]) > FULL, 1.0, common / (size[at] + size[asks] - common))
    near = most >= similarity - 1e-12
    return at[near], most[near]


def _columns(table: pa.Table) -> dict[str, np.ndarray]:
    out = {c: table.column(c).to_numpy() for c in ("band", "node", "own", "minor", "asks", "size")}
    raw = b"".join(table.column("folded").to_pylist())
    return out | {"folded": np.frombuffer(raw, "<u2").reshape(len(table), FOLD)}


def possible(rows: DataFrame, similarity: float) -> DataFrame:
    """band, node of the texts that may have a similar text of another component in the band."""

    def find(table, starts):
        c = _columns(table)
        hit = np.zeros(len(table), bool)
        for s, e in zip(starts, [*starts[1:], len(table)], strict=True):
            asks = c["asks"][s:e]
            asked = s + np.flatnonzero(~asks)
            for q in (s + np.flatnonzero(asks)).tolist():
                near, _ = candidates(q, asked, c["own"], c["node"], c["minor"], c["size"], c["folded"], similarity)
                if len(near):
                    hit[q] = hit[near] = True
        yield pa.RecordBatch.from_arrays([pa.array(c["band"][hit]), pa.array(c["node"][hit])], ["band", "node"])

    return in_groups(rows, find, "band long, node long")


def links_between(c: dict[str, np.ndarray], texts: list[str], k: int, similarity: float) -> list[tuple[int, int]]:
    """Links that join components of a group's texts: each possible pair is compared, the likeliest first,
    unless links found before have joined its components."""
    distinct = {t: n for n, t in enumerate(dict.fromkeys(texts))}
    raw = [t.encode() for t in distinct]
    offsets = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), "u1")
    bags = []
    for a, b in groups(offsets, SLICE):
        d, key, n = counted(*shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k))
        cut = np.searchsorted(d, np.arange(b - a + 1))
        bags += [(key[x:y], n[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)]
    bag = [bags[distinct[t]] for t in texts]
    asked = np.flatnonzero(~c["asks"])
    out, root = [], c["own"].copy()
    for q in np.flatnonzero(c["asks"]).tolist():
        near, most = candidates(q, asked, root, c["node"], c["minor"], c["size"], c["folded"], similarity)
        key, n = bag[q]
        for j in near[np.argsort(-most, kind="stable")].tolist():
            if root[j] == root[q]:
                continue
            other, m = bag[j]
            at = np.minimum(np.searchsorted(other, key), len(other) - 1)
            same = other[at] == key
            common = int(np.minimum(n[same], m[at[same]]).sum())
            if common >= (similarity - 1e-12) * (c["size"][q] + c["size"][j] - common):
                out.append((int(c["node"][j]), int(c["node"][q])))
                low, high = sorted((int(root[q]), int(root[j])))
                root[root == high] = low
    return out


def compared(rows: DataFrame, k: int, similarity: float) -> DataFrame:
    """a, b: links between components, from groups of rows with texts."""

    def find(table, starts):
        c = _columns(table)
        for s, e in zip(starts, [*starts[1:], len(table)], strict=True):
            found = links_between({x: y[s:e] for x, y in c.items()}, table.column("text").slice(s, e - s).to_pylist(), k, similarity)
            pairs = np.array(found, "i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return in_groups(rows, find, "a long, b long")


def texts_of(base: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, t1, t2, text of the wanted nodes; a node of several texts has a row for each, once."""
    one_text = F.struct("t1", "t2")
    chosen = written(nodes.select("node", "t1", "t2").join(small(wanted), "node").select(F.col("node").alias("doc_id"), one_text.alias("of")), "chosen")
    texts = base.join(small(chosen), "doc_id").filter(F.struct(F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("t"), "text").alias("t2")) == F.col("of"))
    return written(texts.groupBy(F.col("doc_id").alias("node"), "of").agg(F.min("text").alias("text")).select("node", "of.t1", "of.t2", "text"), "texts")


def near_duplicates(docs: DataFrame, k: int = K, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id of each document: the least doc_id of its group.

    A group is a connected component of texts with weighted Jaccard similarity of at
    least `similarity` over multisets of k-word shingles. Texts that are equal byte for
    byte are compared as one. A text of fewer than k words has one shingle of all of
    them; a null text or one without words is alone. Rows with the same doc_id count as
    one document, whatever their texts; a null doc_id takes no part and gets a null class.
    Texts may be of any length. An empty table gives no rows. Columns other than doc_id
    and text are ignored.
    """
    bounded_batches(docs.sparkSession)
    base = id_and_text(docs)
    signs = written(signed(base.filter("doc_id IS NOT NULL"), k, bands, rows), "signatures")
    worded = signs.filter(F.size("bands") > 0)
    nodes = written(worded.groupBy("t1", "t2").agg(F.min("doc_id").alias("node"), *(F.first(c).alias(c) for c in ("bands", "folded", "size"))), "nodes")
    held = signs.groupBy("doc_id").agg(F.min(F.struct("t1", "t2")).alias("low"), F.max(F.struct("t1", "t2")).alias("high"))
    several = small(written(held.filter("low <> high").select("doc_id"), "several"))  # doc_ids with different texts
    joint = worded.select("doc_id", "t1", "t2").join(several, "doc_id").distinct().join(nodes.select("t1", "t2", "node"), ["t1", "t2"])
    joint = joint.join(joint.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").filter("node <> a").select("a", F.col("node").alias("b"))
    banded = nodes.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("node").alias("leader"), F.count("*").alias("n")).filter("n > 1").select("band", "leader")
    inside = written(banded.join(shared, "band"), "bands")
    stars = inside.filter("node <> leader").groupBy(F.col("leader").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("n"))
    likely = written(stars.filter(F.col("n") >= max(1, math.ceil(bands * similarity**rows / 2))).select("a", "b"), "likely")  # half the bands that similar texts share
    texts = texts_of(base, nodes, written(likely.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "wanted"))
    links = written(alike(likely, texts.select("node", "text"), k, similarity).union(joint), "links")
    found = components(links)

    owned = inside.select("band", "node").join(small(found.withColumnRenamed("component", "own")), "node", "left").withColumn("own", F.coalesce("own", "node"))
    owned = written(owned, "owned")
    mixed = owned.groupBy("band").agg(F.min("own").alias("low"), F.max("own").alias("high")).filter("low <> high").select("band")
    rest = written(owned.join(small(written(mixed, "mixed")), "band"), "rest")
    counts = nodes.select("node", "t1", "t2", "folded", "size")
    open_rows = written(possible(dealt(rest).join(counts.drop("t1", "t2"), "node"), similarity).distinct(), "possible")
    texts = texts_of(base, nodes, written(open_rows.select("node").distinct(), "wanted"))
    last = written(rest.join(open_rows, ["band", "node"]).join(texts, "node").withColumn("bytes", F.octet_length("text")).join(counts, ["node", "t1", "t2"]).drop("t1", "t2"), "open")
    more = written(compared(dealt(last, "bytes"), k, similarity), "links")
    if more.limit(1).count():
        found = components(links.union(more))

    classes = nodes.select("t1", "t2", "node").join(found, "node", "left").select("t1", "t2", F.coalesce("component", "node").alias("class_id"))
    members = worded.select("doc_id", "t1", "t2").join(classes, ["t1", "t2"]).select("doc_id", "class_id")
    worded_class = members.join(several, "doc_id").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    alone = signs.filter(F.size("bands") == 0).select("doc_id").join(worded_class, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    unnamed = base.filter("doc_id IS NULL").select("doc_id", F.lit(None).cast("long").alias("class_id"))
    return members.unionByName(alone).unionByName(unnamed)
