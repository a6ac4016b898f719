import hashlib
import random
import re

import numpy as np
import pytest

from vecframe.llm import substrings, suffixes


def brute(docs, span):
    seen = {}
    raws = [(t or "").encode() for _, t in docs]
    for raw in raws:
        for i in range(len(raw) - span + 1):
            seen[raw[i : i + span]] = seen.get(raw[i : i + span], 0) + 1
    out = []
    for (doc, _), raw in zip(docs, raws, strict=True):
        gone = np.zeros(len(raw) + 1, "i1")
        for i in range(len(raw) - span + 1):
            if seen[raw[i : i + span]] > 1:
                gone[i : i + span] = 1
        kept = bytes(b for b, g in zip(raw, gone[:-1], strict=True) if not g)
        out.append((str(doc), len(raw), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_and_prefixes(seed):
    rng = random.Random(seed)
    strings = [bytes(rng.choices(b"ab\x00\xff"[: rng.randint(1, 4)], k=rng.randint(0, 60))) for _ in range(9)]
    data, ends = np.frombuffer(b"".join(strings), "u1"), np.cumsum([len(s) for s in strings])
    order, rank = suffixes.suffix_array(data, ends)
    places = [(s, i) for s, x in enumerate(strings) for i in range(len(x) + 1)]
    want = sorted(range(len(places)), key=lambda p: ([c + 1 for c in strings[places[p][0]][places[p][1] :]], places[p][0]))
    marked = sorted(range(len(places)), key=lambda p: [*(c + 1 for c in strings[places[p][0]][places[p][1] :]), 0, places[p][0]])
    assert order.tolist() == marked and len(want) == len(marked)
    assert (rank[order] == np.arange(len(order))).all()
    prefixes = suffixes.common_prefixes(data, ends, order, rank)
    for k in range(1, len(order)):
        a, b = (strings[s][i:] for s, i in (places[order[k - 1]], places[order[k]]))
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert prefixes[k] == n


def fixture():
    rng = random.Random(7)
    word = lambda n: "".join(rng.choices("abcdefghé ", k=n))
    passage, line = word(900), word(500)
    docs = [(k, word(rng.randint(0, 300)) + passage[rng.randint(0, 300) : rng.randint(600, 900)] + word(200)) for k in range(12)]
    docs += [(100 + k, word(300) + line + word(rng.randint(5, 100))) for k in range(30)]
    docs += [(200, word(2000)), (201, None), (202, ""), (203, "a" * 1500), (204, "ab" * 900), (205, word(399))]
    docs += [(206, docs[3][1]), (207, docs[-1][1]), (208, docs[-1][1]), (None, docs[5][1]), (209, "tiny"), (209, "tiny"), (210, "\x00" * 700)]
    docs += [(211, docs[0][1][:450] + docs[0][1][449:]), (212, word(100) + passage + word(3) + passage)]
    return docs


@pytest.mark.parametrize("hot", [2000, 5])
def test_remove_repeats_against_brute_force(spark, hot):
    docs = fixture()
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, k string, n long").repartition(3)
    got = [(str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(frame, hot=hot).collect()]
    assert sorted(got) == brute(docs, 400)


def test_long_texts_are_searched_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(substrings, "PIECE", 700)
    rng = random.Random(3)
    x = "".join(rng.choices("abcdefgh", k=5000))
    docs = [(1, x), (2, "q" * 50 + x[1000:3333]), (3, x[4000:] + x[:500])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = [(str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(frame).collect()]
    assert sorted(got) == brute(docs, 400)


def shared_words(docs, n):
    texts = [re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in docs]
    held = {}
    for k, w in enumerate(texts):
        for i in range(len(w) - n + 1):
            held.setdefault(tuple(w[i : i + n]), set()).add(docs[k])  # equal rows are one document by id
    out = []
    for k, w in enumerate(texts):
        out.append((str(docs[k][0]), any(len(held[tuple(w[i : i + n])]) > 1 for i in range(len(w) - n + 1))))
    return sorted(out)


@pytest.mark.parametrize(("hot", "passage"), [(2000, 50), (3, 50), (2000, 12)])
def test_shared_passages_against_brute_force(spark, hot, passage):
    rng = random.Random(5)
    say = lambda n: [f"w{rng.randint(0, 99)}é"[: rng.randint(2, 4)] for _ in range(n)]
    p, q = say(60), say(49)
    docs = [(k, " ".join(say(rng.randint(0, 30)) + p[rng.randint(0, 12) : rng.randint(45, 60)] + say(20))) for k in range(14)]
    docs += [(50, " ".join(q)), (51, " ".join(say(9) + q)), (52, " ".join(p * 3)), (53, " ".join(say(80) * 3)), (54, "  ".join(p).upper() + "!"), (55, None), (56, ""), (57, " ".join(say(30)))]
    docs += [(58, docs[53 - 36][1]), (59, " ".join(say(200))), (60, "la " * 70), (61, "la " * 49), (62, "tiny"), (63, " ".join(say(70))), (63, docs[-1][1])]
    got = substrings.remove_repeats(spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, k int").repartition(3), hot=hot, passage=passage).collect()
    want = shared_words(docs, passage)
    assert sorted((str(r.doc_id), r.shares_passage) for r in got) == want and len({x for _, x in want}) == 2


def test_empty_table(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
