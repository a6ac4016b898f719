import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vecframe.llm import ann, bagminhash, components, decontaminate, langid, quality, queries, textbytes, tokencounts, tokens

PATH = tokens.public_path("word_bpe_49k.json")
SF = "/root/testdata/sf0.01"


# token counts

def by_library(text, bounds, rule):
    """Token by token, from the library's offsets for the whole text."""
    out = np.zeros(len(bounds))
    edges = [*bounds.tolist(), 1 << 40]
    for start, stop in tokens.ChunkEncoder(tokens.read_json(PATH)).tokenizer.encode(text, add_special_tokens=False).offsets:
        shares = [max(0, min(stop, edges[k + 1]) - max(start, edges[k])) for k in range(len(bounds))]
        if rule == "start":
            out[max(k for k in range(len(bounds)) if edges[k] <= start)] += 1
        elif rule == "majority":
            out[shares.index(max(shares))] += 1
        else:
            out += np.array(shares) / (stop - start)
    return out


def test_rules_give_different_counts():
    encoder = tokencounts.SpanEncoder(tokens.read_json(PATH))
    text = "unhappinesses " * 9
    bounds = np.array([0, 3, 12, 50])
    got = {rule: tokencounts.attribute(encoder, text, bounds, rule) for rule in tokencounts.RULES}
    assert len({tuple(x) for x in got.values()}) == len(tokencounts.RULES)
    assert all(np.allclose(x, by_library(text, bounds, rule)) for rule, x in got.items())


@pytest.mark.parametrize("rule", tokencounts.RULES)
def test_token_counts_against_the_library(spark, rule):
    docs = [(1, "Thandhahe of ing.\n\nunhappinesses é\n"), (2, None), (3, ""), (4, "İstanbul 日本 x"), (None, "a\x1cb ethandhaheing <|endoftext|>"), (4, "again " * 300), (5, "\n\n")]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, section int")
    for width in (None, 3):
        got = tokencounts.line_counts(frame, PATH, rule, width).collect()
        want = []
        for doc, text in docs:
            text = text or ""
            bounds = np.arange(0, max(len(text), 1), width) if width else np.array([m.start() for m in re.finditer(r"(?<=\n)(?!\Z)", text) if m.start() < len(text)], "i8")
            bounds = bounds if width else np.concatenate([[0], bounds]).astype("i8")
            for n, (b, c) in enumerate(zip(bounds, by_library(text, bounds, rule), strict=True)):
                want.append((str(doc), n, int(b), round(float(c), 9)))
        assert sorted((str(r.doc_id), r.section, r.start_char, round(float(r.n_tokens), 9)) for r in got) == sorted(want)


def test_registered_sections_are_crossed_by_tokens(spark):
    sf, registered = "/root/testdata/sf0.001", queries.QUERIES
    lines, got = ([(r.doc_id, r.section, r.n_tokens) for r in registered[n](spark, sf).collect()] for n in ("op9_token_counts", "op9_token_stretches"))
    totals = [Counter() for _ in range(2)]
    for total, rows in zip(totals, (lines, got), strict=True):
        for doc, _, n in rows:
            total[doc] += n
    assert totals[0] == totals[1]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    other = tokencounts.line_counts(docs, PATH, next(r for r in tokencounts.RULES if r != "start"), queries.STRETCH)
    assert sorted(got) != sorted((r.doc_id, r.section, r.n_tokens) for r in other.collect())


def test_field_counts(spark):
    frame = spark.createDataFrame([(1, "one two", None, "three"), (2, None, None, None)], "id long, a string, b string, key string")
    got = {(r.id, r.field): r.n_tokens for r in tokencounts.field_counts(frame, "id", ["a", "b", "key"], PATH).collect()}
    assert got == {(1, "a"): 2, (1, "b"): 0, (1, "key"): 1, (2, "a"): 0, (2, "b"): 0, (2, "key"): 0}


# near duplicates

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def bag(text, k=5):
    w = WORDS.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else Counter()


def classes(docs):
    group = {d: d for d, _ in docs if d is not None}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    bags = [(d, bag(t)) for d, t in docs if d is not None]
    for i, (a, x) in enumerate(bags):
        for b, y in bags[:i]:
            n = sum((x & y).values())
            if n and n >= 0.8 * (sum(x.values()) + sum(y.values()) - n):
                lo, hi = sorted((find(a), find(b)))
                group[hi] = lo
    return {d: find(d) for d in group}


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(4)
    say = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 500, n))
    docs, base = [], [say(120) for _ in range(6)]
    for k in range(90):
        w = base[k % 6].split()
        for at in rng.integers(0, len(w), rng.integers(0, 5)):
            w[at] = f"new{k}"
        docs.append((1000 - k, " ".join(w)))
    chain = say(100).split()
    docs += [(2000 + k, " ".join(chain[4 * k :] + [f"t{j}" for j in range(4 * k)])) for k in range(8)]
    docs += [(1, "Two words"), (2, "two, WORDS!"), (3, None), (4, ""), (5, "!!"), (6, "la " * 400), (7, "la " * 330), (8, "la " * 200), (9, docs[0][1]), (1, "Two words"), (10, "x")]
    frame = spark.createDataFrame([(*d, 1) for d in docs + [(None, docs[0][1])]], "doc_id long, text string, node int").repartition(4)
    rows = bagminhash.near_duplicates(frame).collect()
    assert len(rows) == len(docs) + 1
    assert [r.class_id for r in rows if r.doc_id is None] == [None]
    assert {r.doc_id: r.class_id for r in rows if r.doc_id is not None} == classes(docs)
    assert bagminhash.near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("block_bytes", [8 << 20, 900])
def test_near_duplicates_in_crowded_bands(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(bagminhash, "BLOCK", 7)
    monkeypatch.setattr(bagminhash, "BLOCK_BYTES", block_bytes)
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in rng.integers(0, 900, 60)]
    docs = []
    for k in range(70):  # around one text at distances on both sides of the limit, so that bands hold several components
        w = list(base)
        for at in rng.choice(len(w), rng.integers(0, 4), replace=False):
            w[at] = f"n{k}_{at}"
        docs.append((k, " ".join(w)))
    docs += [(100 + k, docs[k % 3][1]) for k in range(12)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = classes(docs)
    assert len(set(want.values())) > 3
    assert {r.doc_id: r.class_id for r in bagminhash.near_duplicates(frame).collect()} == want


def test_candidates_of_one_band_are_all_compared(spark, monkeypatch):
    def one_band(doc, element, count, texts, registers):
        """All texts share the first band and nothing else: estimates fall far short."""
        out = np.zeros((texts, registers), "u8")
        for t in range(texts):
            out[t, 5:] = np.random.default_rng(int(np.bitwise_xor.reduce(element[doc == t]))).integers(1, 1 << 32, registers - 5)
        return out

    monkeypatch.setattr(bagminhash, "signatures", one_band)
    rng = np.random.default_rng(11)
    docs = []
    for k in range(24):
        w = [f"w{k % 4}_{x}" for x in range(100)] if k >= 4 else [f"w{k}_{x}" for x in range(100)]
        for at in rng.choice(100, rng.integers(0, 6), replace=False):
            w[at] = f"n{k}_{at}"
        docs.append((k, " ".join(w)))
    docs += [(40, "la " * 80_000), (41, "la " * 70_000), (42, "la " * 50_000)]  # buckets of the first two are full
    want = classes(docs)
    assert 7 < len(set(want.values())) < 20 and want[41] == 40 and want[42] == 42
    assert {r.doc_id: r.class_id for r in bagminhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()} == want


def test_near_duplicates_of_ids_with_several_texts(spark):
    rng = np.random.default_rng(8)
    say = lambda first: " ".join([first, *(f"w{x}" for x in rng.integers(0, 500, 99))])
    a, b, c = say("a"), say("b"), say("c")
    docs = [(5, a), (5, b), (7, b), (9, b + " more"), (30, c), (30, a + " more"), (31, c + " more"), (2, "!!"), (40, c), (2, say("d")), (50, "!!"), (50, b)]
    rows = bagminhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert len(rows) == len(docs) and {(r.doc_id, r.class_id) for r in rows} == set(classes(docs).items())


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    element = rng.integers(1, 1 << 48, 300).astype("u8")
    a, b = rng.integers(0, 9, 300), rng.integers(0, 9, 300)
    b[:150] = a[:150]
    doc = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
    s = bagminhash.signatures(doc, np.concatenate([element[a > 0], element[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 4096)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def test_components_of_a_long_chain(spark):
    edges = [(k, k + 1) for k in range(60)] + [(200, 201), (201, 202), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 200: 200, 201: 200, 202: 200}


# nearest neighbours

def nearest(rows, queries, k=10):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], "f4").astype("f8")
    out = {}
    for q in queries:
        v = x[ids == q][0]
        d = np.sqrt(((x - v) ** 2).sum(1))
        keep = ids != q
        order = np.lexsort([ids[keep], d[keep]])[:k]
        out[q] = list(zip(ids[keep][order].tolist(), d[keep][order], strict=True))
    return out


def test_search_recall_and_order(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    want = nearest(rows, [i for i, _ in rows if i % 100 == 0])
    got = {}
    for r in ann.search(frame, frame.vec_id % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want])
    assert recall >= 0.9, recall
    exact = {(q, i): d for q in want for i, d in want[q]}
    for q, hits in got.items():
        assert len(hits) == 10 and hits == sorted(hits, key=lambda h: (h[1], h[0]))
        assert all(abs(exact[q, i] - d) < 1e-12 for i, d in hits if (q, i) in exact)


def test_search_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (100, [0.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (200, [float("inf"), 0.0])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    got = [(r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in ann.search(frame, frame.vec_id % 100 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 100, 2.236068), (100, 1, 0, 2.236068), (100, 2, 1, 2.236068), (100, 3, 2, 2.236068)]
    assert ann.search(frame.limit(0), frame.vec_id % 100 == 0).count() == 0


def test_search_of_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.5]), (1, [0.0, 1.25]), (2, [3.0, 0.0]), *[(3, [1.0, 0.1 + n]) for n in range(30)]]
    got = [(r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, k=2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3, 0.1), (0, 2, 1, 0.25)]


def test_search_scores_doubles(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1e-12]), (2, [1.0, 1e-13]), (3, [0.1, 0.2])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got[:2]] == [(2, 1e-13), (1, 1e-12)]


@pytest.mark.parametrize(("rows", "every"), [(500, 7), (20_000, 1000)])
def test_recall_with_registered_parameters(spark, rows, every):
    vectors = [r.embedding for r in spark.read.parquet("/root/testdata/check_s/embeddings.parquet").limit(rows).collect()] if rows <= 500 else None
    if vectors is None:
        rng = np.random.default_rng(2)
        centers = rng.normal(size=(10, 64))
        x = rng.normal(size=(rows, 64)) + 0.5 * centers[rng.integers(0, 10, rows)]
        vectors = (x / np.linalg.norm(x, axis=1, keepdims=True)).tolist()
    table = list(enumerate(vectors))
    frame = spark.createDataFrame(pa.table({"vec_id": [i for i, _ in table], "embedding": [v for _, v in table]}))
    got = {}
    for r in ann.search(frame, F.col("vec_id") % every == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    x = np.array(vectors, "f8")
    recall = []
    for q in range(0, len(x), every):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        recall.append(len(got[q] & set(np.argsort(d, kind="stable")[:10].tolist())) / 10)
    print("recall", rows, np.mean(recall))
    assert np.mean(recall) >= 0.9


# languages

def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs, keep=["lang"]).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and len(held) > 100
    assert np.mean([r.lang_pred == r.kept_0 for r in held]) > 0.98
    assert not any(r.rejected for r in got) and all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(spark):
    docs = [(k, "the cat and the dog " * 9, "en") for k in range(9)] + [(k, "der Hund und die Katze " * 9, "de") for k in range(20, 29)]
    docs += [(50, None, "en"), (51, "", "en"), (52, "123 !!", "de"), (53, "the dog", None), (None, "die Katze", "de"), (54, "日本語テキスト" * 30, None), (53, "the dog", None)]
    frame = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in langid.identify(frame).collect()}
    assert [got[k].lang_pred for k in (50, 51, 52, 53, None)] == ["und", "und", "und", "en", "de"]
    assert [got[k].score for k in (50, 51, 52)] == [0, 0, 0] and got[50].rejected and got[None].held_out
    assert {r.lang_pred for r in langid.identify(frame.filter("lang is null")).collect()} == {"und"}
    assert langid.identify(frame.limit(0)).count() == 0


def test_rejection_of_frequent_and_rare_languages(spark):
    rng = np.random.default_rng(3)
    latin, greek, cyrillic = "abcdefghijklmnopqrstuvwxyz", "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцч"
    words = {a: ["".join(rng.choice(list(a), rng.integers(2, 8))) for _ in range(80)] for a in (latin, greek, cyrillic)}
    say = lambda a, n: " ".join(rng.choice(words[a], n))
    junk = lambda a, n: " ".join("".join(rng.choice(list(a), 5)) for _ in range(n))
    rows = [(say(latin, int(rng.integers(1, 60))), "la") for _ in range(3000)] + [(say(greek, 30), "el") for _ in range(38)] + [(say(cyrillic, 30), "ru") for _ in range(15)]
    good = [say(a, n) for a in (latin, greek, cyrillic) for n in (1, 2, 3, 12, 40) for _ in range(8)]
    bad = [junk(a, 40) for a in (latin, greek, cyrillic) for _ in range(8)] + [f"{say(latin, 20)} {junk(latin, 20)}" for _ in range(8)]
    docs = [(k, *r) for k, r in enumerate(rows)] + [(None, t, "good") for t in good] + [(None, t, "bad") for t in bad]
    got = langid.identify(spark.createDataFrame(docs, "doc_id long, text string, lang string"), keep=["lang", "text"]).collect()
    assert [r.kept_1 for r in got if r.kept_0 == "bad" and not r.rejected] == []
    assert [r.kept_1 for r in got if r.kept_0 != "bad" and r.rejected] == []


def letters_of(text, order=4):
    low = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    return [0] * (order - 1) + [ord(c) if c != " " else 0 for c in re.sub(" +", " ", low).strip()] + [0]


def slow_model(texts, order=4):
    """p(letter, context) by dictionaries: interpolated Kneser-Ney, raw counts at the top, kinds of letters before below."""
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        s = letters_of(t, order)
        counts[order].update(tuple(s[i : i + order]) for i in range(len(s) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k].update(g[1:] for g in counts[k + 1])
    discount, total, kinds = {}, [Counter() for _ in range(order + 1)], [Counter() for _ in range(order + 1)]
    for k in range(1, order + 1):
        n1, n2 = (sum(v == n for v in counts[k].values()) for n in (1, 2))
        discount[k] = min(0.95, max(0.1, n1 / (n1 + 2 * n2) if n1 else 0.5))
        for g, n in counts[k].items():
            total[k][g[:-1]] += n
            kinds[k][g[:-1]] += 1

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / (1 << 16)
        context = gram[:-1]
        if not total[k][context]:
            return p(gram[1:])
        return (max(counts[k][gram] - discount[k], 0) + discount[k] * kinds[k][context] * p(gram[1:])) / total[k][context]

    return p


def test_cross_entropies_against_slow_models(spark):
    texts = {"en": ["the cat, the dog and  the cow", "a cat sat", "THE end", "1 2", "日本 x"], "de": ["der Hund und die Katze", "Übermäßig schön, die Kuh"]}
    rows = [(k, t, lang) for lang, ts in texts.items() for k, t in enumerate(ts)]
    model = langid.fitted(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    asked = ["the cow", "die Kuh schläft", "日本語", "x", "!", None, "ζ the " * 30, "𐐨 a"]
    h, lettered, lengths = model.cross_entropies(asked)
    slow = [slow_model(texts[x]) for x in model.languages]
    assert model.languages == ["de", "en"] and lettered.tolist() == [bool(t and any(c.isalpha() for c in t)) for t in asked]
    for n, t in enumerate(asked[:7]):
        s = letters_of(t)
        assert lengths[n] == len(s) - 3
        for k, p in enumerate(slow):
            want = -sum(np.log(p(tuple(s[i : i + 4]))) for i in range(len(s) - 3)) / (len(s) - 3)
            assert h[n, k] == pytest.approx(want, rel=1e-5)


def test_own_ngrams_count_as_unseen(spark):
    rows = [(1, "alpha beta", "x"), (2, "alpha gamma", "x")]
    model = langid.fitted(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    seen, held = (model.cross_entropies([r[1] for r in rows], own)[0] for own in (None, np.zeros(2, "i8")))
    assert (held > seen + 0.5).all()


def test_kneser_ney_is_a_distribution():
    rng = np.random.default_rng(0)
    codes, n = np.unique(langid.grams(rng.integers(97, 103, 4000).astype("u2")), return_counts=True)
    model = langid.LanguageModel({"x": (codes, n, int((n == 1).sum()), int((n == 2).sum()))})
    every = (codes[0] >> np.uint64(16) << np.uint64(16)) + np.arange(1 << 16, dtype="u8")
    assert abs(np.exp(model.log_probabilities(every).astype("f8")).sum() - 1) < 1e-4


def test_no_ngram_goes_where_no_bound_is_set(spark):
    rng = np.random.default_rng(2)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9FA0, 100_000))) for _ in range(11)]
    rows = [(k, t, "zh") for k, t in enumerate([*texts, texts[0][:1000]])] + [(100, "the cat", "en"), (101, "die Katze", "de"), (102, "le chat", "fr")]
    held = {tuple(x) for t in texts for x in zip(t, t[1:], t[2:], t[3:], strict=False)}
    model = langid.fitted(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4))
    assert len(model.codes[-1].order) >= len(held) > 1_000_000


def test_rare_ngrams_go_beyond_the_bound(spark, monkeypatch):
    frame = spark.createDataFrame([(1, "abcd " * 50 + "xyz qrs tuv", "x")], "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "GRAMS", 8)
    model = langid.fitted(frame)
    assert 0 < len(model.codes[-1].order) <= 8 and model.predict(["abcd abcd"])[0] == ["x"]


# quality

def test_quality_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.rank_quality(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    right = [np.mean([r.predicted == q for r in held if r.quality == q]) for q in (0, 1)]
    assert min(right) > 0.95, right
    assert all(r.predicted == (r.score >= 0.7) for r in got)


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "good text here", 1), (2, "!!! $$$", 2), (3, None, 3), (None, "", 4), (1, "good text here", 5)], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (9, 5)], "doc_id long, quality int")
    got = quality.rank_quality(docs, labels, folds=1000, fold=999).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert all(r.score == pytest.approx(0.7) for r in quality.rank_quality(docs, labels.limit(0)).collect())
    assert quality.rank_quality(docs.limit(0), labels).count() == 0


def test_repeated_ids_teach_once(spark):
    docs = spark.createDataFrame([(1, "good text here")] * 40 + [(1, "zz")] + [(2, "!!! $$$"), (3, "%% !!"), (4, "fine words")], "doc_id long, text string").repartition(3)
    labels = [(1, 1), (1, 1), (2, 0), (3, 0), (3, 1)]
    seen = []
    train = quality.PairwiseRanker.fit
    quality.PairwiseRanker.fit = lambda self, x, better: seen.append((x, better)) or train(self, x, better)
    try:
        quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    finally:
        quality.PairwiseRanker.fit = train
    (x, better), = seen
    assert sorted(better.tolist()) == [0, 1] and len(x) == 2


def slow_features(text):
    raw = (text or "").encode()
    f = np.zeros(quality.WIDTH)
    for b in raw:
        f[b] += 1
    for a, b in zip(raw, raw[1:], strict=False):
        f[256 + ((a * 0x9E3779B1 + b * 0x85EBCA77) % (1 << 32) >> 23)] += 1
    f[: 256 + quality.PAIRS] = np.log1p(1000 * f[: 256 + quality.PAIRS] / (len(raw) + quality.SMOOTH))
    w = WORDS.findall(raw.lower() if raw.isascii() else re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw))
    upper, lower_ = sum(65 <= b <= 90 for b in raw), sum(97 <= b <= 122 for b in raw)
    f[-5] = np.log1p(100 * sum(a == b for a, b in zip(w, w[1:], strict=False)) / (len(w) + 8))
    f[-4] = np.log1p(len(raw))
    f[-3] = len(raw) / (sum(b in b" \n" for b in raw) + 1)
    f[-2] = upper / max(upper + lower_, 1)
    f[-1] = sum(48 <= b <= 57 for b in raw) / (len(raw) + quality.SMOOTH)
    return f


def test_features_against_loops():
    texts = ["Good good text, HERE 42", "", None, "é ü\nla la la", "a", "x " * 200]
    data, offsets = textbytes.utf8(pa.array(texts, pa.string()))
    got = quality.features(data, offsets)
    for row, t in zip(got, texts, strict=True):
        assert np.allclose(row, slow_features(t), atol=1e-4)


def test_ranking_minimises_the_pairwise_loss():
    rng = np.random.default_rng(6)
    x = np.zeros((300, quality.WIDTH))
    x[:, :4] = rng.normal(size=(300, 4))
    better = (x[:, 0] - 0.5 * x[:, 1] + 0.3 * rng.normal(size=300) > 0).astype(int)
    ranker = quality.PairwiseRanker().fit(x, better)
    z = (x - ranker.mean) / ranker.scale

    def loss(w):
        d = (z[better == 1] @ w)[:, None] - (z[better == 0] @ w)[None]
        return np.log1p(np.exp(-d)).mean() + ranker.decay / 2 * w @ w

    at = loss(ranker.weights)
    w = np.zeros(quality.WIDTH)
    for _ in range(4000):  # plain descent on all pairs
        d = (z[better == 1] @ w)[:, None] - (z[better == 0] @ w)[None]
        g = 1 / (1 + np.exp(d))
        w += 1.0 * ((z[better == 1] * g.mean(1)[:, None]).mean(0) - (z[better == 0] * g.mean(0)[:, None]).mean(0) - ranker.decay * w)
        if loss(w) < at - 0.02:
            break
    assert loss(w) > at - 0.02


def test_very_long_texts(spark):
    long = "the quick brown fox, and 7 dogs; " * 60_000
    docs = [(1, long, "en", "s"), (2, long + "end", "en", "s"), (3, "kurz und gut", "de", "s"), (4, "le chat noir", "fr", "s")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(frame, folds=1000, fold=999).collect()}
    assert got == {1: "en", 2: "en", 3: "de", 4: "fr"}
    labels = spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, quality int")
    assert quality.rank_quality(frame, labels, folds=1000, fold=999).count() == 4
    counts = {}
    for r in tokencounts.line_counts(frame, PATH, width=100_000).collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + r.n_tokens
    library = tokens.ChunkEncoder(tokens.read_json(PATH)).tokenizer
    assert counts == {d: len(library.encode(t, add_special_tokens=False).ids) for d, t, _, _ in docs}
    assert {r.doc_id: r.class_id for r in bagminhash.near_duplicates(frame).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    item = spark.createDataFrame([(1, " ".join(long.split()[:13]))], "item_id long, text string")
    assert {r.doc_id: r.contaminated for r in decontaminate.contamination(frame, item).collect()} == {1: True, 2: True, 3: False, 4: False}
