import hashlib
import io
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vecframe.llm import bpe, packing, tokens

PATH = tokens.public_path("word_bpe_49k.json")
SPEC = tokens.read_json(PATH)
ENCODER, BPE = tokens.ChunkEncoder(SPEC), bpe.Bpe(SPEC)
LIBRARY = ENCODER.tokenizer
ODD = ["", None, "a", "It's 42!! we'll  see\x1c\x1dx\x85y\xa0z", "É<|endoftext|>x <|ENDOFTEXT|>", "é ΣΣ İ", "aaaa" * 50, "日本語 ¹²½ ʼn ǅ", " x­y'Sſ", "</w> <w>", "x" * 3000]


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_both_encoders_equal_the_library(text):
    want = library_ids(text)
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == want
    assert np.frombuffer(BPE.encode([text])[0], "<u4").tolist() == want
    assert BPE.decode(np.array(want, "u4")) == LIBRARY.decode(want, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x2FF), st.sampled_from("thean edring's'*!-12é<|>\n ")), max_size=60))
def test_latin_texts(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == library_ids(text)
    assert np.frombuffer(BPE.encode([text])[0], "<u4").tolist() == library_ids(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == library_ids(text)
    assert np.frombuffer(BPE.encode([text])[0], "<u4").tolist() == library_ids(text)


def test_greedy_words_that_fail_are_repaired():
    words = ["reonwhhe", "thandhaheing", "unhappinessly", "tokenizations", "ththonble"]
    greedy = [BPE.propose(BPE._mapped(w)) for w in words]
    exact = [library_ids(w) for w in words]
    assert [list(x) for x in BPE.encode_words([BPE._mapped(w) for w in words])] == exact
    assert greedy != exact


@pytest.mark.parametrize("bits", [1, 5, 16, 17, 32])
def test_packing_round_trip_and_random_access(bits):
    rng = np.random.default_rng(bits)
    out = io.BytesIO()
    writer = packing.ShardWriter(out, bits, block=128)
    docs = [rng.integers(0, 1 << bits, n).astype("u4") for n in (0, 1, 64, 5000, 0, 333)]
    for k, d in enumerate(docs):
        writer.add(None if k == 0 else k, d)
    writer.close()
    reader = packing.ShardReader(io.BytesIO(out.getvalue()))
    every = np.concatenate(docs)
    assert reader.n_ids == every.size and reader.present.tolist() == [False, *[True] * 5]
    for a, b in ((0, every.size), (127, 129), (5, 5), (4000, 5300)):
        assert (reader.ids(a, b) == every[a:b]).all()
    assert all((reader.document(k) == d).all() for k, d in enumerate(docs))
    assert list(reader.checksums()) == [(d.size, zlib.crc32(d.astype("<u4").tobytes())) for d in docs]


def test_bits_for_and_too_wide():
    assert [packing.bits_for(n) for n in (0, 1, 2, 3, 49408, 65537)] == [1, 1, 1, 2, 16, 17]
    with pytest.raises(ValueError):
        packing.pack(np.array([4], "u4"), 2)


def frame(spark, rows):
    return spark.createDataFrame([(a, b, 7, "x") for a, b in rows], "doc_id long, text string, start long, n_tokens string").repartition(3)


def test_token_files_against_the_library(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(3, "again"), (3, "again"), (None, "no id"), (900, "the end " * 4000)]
    got = packing.token_files(frame(spark, rows), PATH).orderBy("start").collect()
    assert len(got) == len(rows) and got[0].doc_id is None
    ids = [r.doc_id for r in got[1:]]
    assert ids == sorted(ids)
    at, want = 0, sorted((d if d is not None else -1, *((len(x := library_ids(t) + [2])), zlib.crc32(np.array(x, "<u4").tobytes()))) for d, t in rows)
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_crc32) for r in got) == want


def test_encode_decode_against_the_library(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(1, None), (None, "x")]
    got = bpe.encode_decode(frame(spark, rows), PATH, keep_ids=True).collect()
    want = []
    for d, t in rows:
        ids = library_ids(t)
        want.append((str(d), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest(), ids))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in got) == sorted(want)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.token_files(empty, PATH).count() == 0
    assert bpe.encode_decode(empty, PATH).count() == 0


def test_only_files_of_the_manifest_are_read(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(ODD)]
    folder = f"file://{tmp_path}/tokens"
    first = packing.token_files(frame(spark, rows), PATH, folder=folder).orderBy("doc_id").collect()
    (tmp_path / "tokens" / "shard-000000-999.tok").write_bytes(b"left by a lost attempt")
    assert packing.read_index(spark, folder).orderBy("doc_id").collect() == first
    manifest = packing.read_manifest(folder)
    assert manifest["end_id"] == 2 and manifest["bits"] == 16
    assert sum(x["documents"] for x in manifest["shards"]) == len(rows) and manifest["shards"][-1]["start"] + manifest["shards"][-1]["ids"] == sum(r.n_tokens for r in first)


def test_bounded_caches_change_no_ids(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    monkeypatch.setattr(bpe, "CACHE_CHUNKS", 3)
    monkeypatch.setattr(bpe, "AWAY", 2)
    coder = bpe.Bpe(tokens.read_json(PATH))
    texts = [f"word{k % 7} the, cat's {k} end. 'unhappiness' the" for k in range(40)] + list(ODD)
    got = [x for k in range(0, len(texts), 6) for x in coder.encode(texts[k : k + 6], group=60)]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library_ids(t) for t in texts]
    assert len(coder.chunks) <= 8


def test_the_encoder_keeps_no_second_vocabulary():
    assert bpe.Bpe(SPEC).library.get_vocab_size() == 0


def test_freed_memory_goes_back_between_batches():
    code = """
import re
from vecframe.llm import shared, textbytes
held = lambda: int(re.search(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) >> 10
textbytes.powers(5)
shared.worker_state("another operator")
assert "powers" not in shared._state
first, pins = held(), []
for _ in shared.lean(range(3)):
    assert held() < first + 40, held()
    many = [bytes(2000) for _ in range(50_000)]
    pins.append(bytes(2000))  # above them, so that the heap's end cannot fall
    del many
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
