import hashlib

import numpy as np
from test_models import classes
from test_native import base_spans, candidates, contamination

import corpus_pipeline
from vecframe.llm import tokens


def fixture():
    rng = np.random.default_rng(5)
    en, de = ("the of and that with from which this have been were".split(), "der die das und nicht eine werden durch schon wieder".split())
    say = lambda words, n: " ".join(rng.choice(words) + str(rng.integers(0, 50)) * int(rng.integers(0, 2)) for _ in range(n))
    docs = [(k, say(de if k % 3 == 0 else en, 60), "de" if k % 3 == 0 else "en") for k in range(60)]
    item = say(en, 30)
    docs += [(100, docs[4][1], "en"), (101, docs[4][1] + " end", "en"), (102, say(en, 40) + " " + item, "en"), (103, say(en, 300) + " " + " ".join(item.split()[:13]), "en")]
    docs += [(104, say(en, 50) + ' token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" ' + say(en, 20), "en"), (105, "12345 !!", "en"), (106, None, "de"), (107, "", None), (None, say(de, 50), "de"), (7, docs[7][1], "en")]
    return docs, [("i1", item), ("i2", say(de, 40))]


def test_pipeline_against_brute_force(spark, tmp_path):
    docs, bench = fixture()
    rows = [(d, t, lang, f"src{n % 7}", len(t or "")) for n, (d, t, lang) in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    left = [(d, t, s) for d, t, _, s, _ in rows if any(c.isalpha() for c in t or "")]
    group = classes([(d, t) for d, t, _ in left])
    once, kept = set(), []
    for d, t, s in left:
        if d is None or (group[d] == d and d not in once):
            kept.append((d, t, s))
            once.add(d)
    bad = {r[0] for r in contamination([(d, t) for d, t, _ in kept], bench) if r[5]}
    kept = [r for r in kept if str(r[0]) not in bad]
    assert bad == {"102"} and len(kept) < len(left)
    owners: dict = {}
    for _, t, s in kept:
        for m in candidates(t):
            owners.setdefault(m[0], set()).add(s)
    library = tokens.ChunkEncoder(tokens.read_json(tokens.public_path("word_bpe_49k.json"))).tokenizer
    want = []
    for d, t, _ in kept:
        spans = sorted([(s, e) for s, _, e, _ in base_spans(t)] + [m.span() for m in candidates(t) if len(owners[m[0]]) <= 2])
        out, at = "", 0
        for s, e in spans:
            if s > at or not out:
                out += t[at:s] + "[SECRET]"
            at = max(at, e)
        ids = library.encode(out + t[at:], add_special_tokens=False).ids
        want.append((str(d), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()))
    got = [(str(r.doc_id), r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_stages_keep_the_columns(spark, tmp_path):
    docs, bench = fixture()
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame = spark.createDataFrame([(d, t, lang, "s", 0, 1, "x") for d, t, lang in docs], "doc_id long, text string, lang string, source string, n_chars long, k1 int, row string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, str(tmp_path)).columns == frame.columns, name
        assert stage(spark, frame.limit(0), str(tmp_path)).count() == 0, name
