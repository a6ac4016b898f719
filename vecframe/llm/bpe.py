"""BPE encoding and decoding: propose by greedy longest match, verify adjacent pairs, repair.

A sequence of tokens is what merging would give exactly when each token is what merging
gives for its own characters and no merge ever crosses a boundary between neighbours.
The second is a matter of the two neighbours alone: walking both back through the
merges that made them, last merge first, shows every pair of pieces that ever stood at the
boundary. The walk runs in numpy for all new pairs at once. Words with a failing pair are
merged exactly, with a heap. Words are found in white-space chunks, whose results are
kept in a bounded cache.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import tokens
from .shared import bounded_batches, id_and_text, lean, worker_state

#: Stands for the mark that closes a word; no mapped byte is this character.
CLOSE = "\n"
NEVER = 1 << 40
NONE = 1 << 62
#: Parts of a word up to which exact merging scans its ranks.
SHORT = 64
#: Bounds of what a worker keeps: chunks that are words, other chunks, and pairs of tokens.
CACHE_WORDS = 260_000
CACHE_CHUNKS = 80_000
CACHE_PAIRS = 400_000
AWAY = 8


class Chunks(dict):
    """Ids of chunks: those kept, else those learned last.

    Words and other chunks are kept in the order they come, which holds what is frequent, up
    to a bound for each; all go once many times as many have been turned away.
    """

    def __init__(self, words: int, others: int):
        super().__init__()
        self.bounds, self.fresh = (others, words), {}
        self.empty()

    def empty(self) -> None:
        self.clear()
        self.room, self.away = list(self.bounds), 0

    def __missing__(self, chunk: str) -> bytes:
        return self.fresh[chunk]

    def keep(self) -> None:
        for c, ids in self.fresh.items():
            kind = c.isalpha()
            if self.room[kind]:
                self[c] = ids
                self.room[kind] -= 1
            else:
                self.away += 1
        self.fresh = {}
        if self.away > AWAY * sum(self.bounds):
            self.empty()


class Bpe:
    """Encodes and decodes by a tokenizers file of byte-level BPE with word ends."""

    def __init__(self, spec_json: str):
        import regex
        from tokenizers import Tokenizer

        spec = json.loads(spec_json)
        if not tokens.independent_chunks(spec) or not spec["model"].get("end_of_word_suffix") or spec.get("decoder") is not None:
            raise ValueError("this needs byte-level BPE with word ends, lower case and no decoder")
        model = spec["model"]
        #: The library without words and merges: its normaliser and splitter serve texts beyond Latin letters.
        self.library = Tokenizer.from_str(json.dumps({**spec, "model": {**model, "vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None}))
        end = model["end_of_word_suffix"]
        self.end = end
        self.close = lambda t: t[: -len(end)] + CLOSE if t.endswith(end) else t
        self.ids = {self.close(t): i for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.strings = [""] * size
        for t, i in [*model["vocab"].items(), *self.special.items()]:
            self.strings[i] = t
        self.letters = dict(enumerate(tokens.byte_letters()))
        self.words = regex.compile(tokens.FORM["split"])
        self.by_special = re.compile("(" + "|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + ")") if self.special else None
        self.size, self.bits = size, size.bit_length()
        self.merges: dict[int, int] = {}  # a * size + b: the rank, and below it in `bits` bits what a and b give
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges.setdefault(self.ids[self.close(a)] * size + self.ids[self.close(b)], rank << self.bits | self.ids[self.close(a + b)])
        self._derive(size)
        self.reach: dict[str, int] = {}  # the longest proposal that starts with three characters
        for t in self.proposals:
            self.reach[t[:3]] = max(len(t), self.reach.get(t[:3], 2))
        self.pairs: dict[int, bool] = {}
        self.chunks = Chunks(CACHE_WORDS, CACHE_CHUNKS)

    def _derive(self, size: int) -> None:
        """How each token is made, and which tokens are not what merging gives for them."""
        keys = np.fromiter(self.merges, "i8", len(self.merges))
        ranks = np.fromiter(self.merges.values(), "i8", len(self.merges)) >> self.bits
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], ranks[order]
        self.made = np.full(size, -1, "i8")
        self.left, self.right = np.zeros(size, "i8"), np.zeros(size, "i8")
        times = np.zeros(size, int)
        for key, value in self.merges.items():
            to = value & ((1 << self.bits) - 1)
            times[to] += 1
            self.made[to], (self.left[to], self.right[to]) = value >> self.bits, divmod(key, size)
        for to in np.flatnonzero(times > 1).tolist():  # several merges give it: ask which one does
            self._merge(self._base(self.strings_closed(to)), to)
        merged = np.flatnonzero(self.made >= 0)
        good = np.ones(size, bool)
        l, r, m = self.left[merged], self.right[merged], self.made[merged]
        good[merged] = (self.made[l] < m) & (self.made[r] < m) & self.compatible(l, r, m)
        for t in merged[np.argsort(m)].tolist():
            good[t] &= good[self.left[t]] and good[self.right[t]]
        for t, i in self.ids.items():
            if self.made[i] < 0 and len(t) > 1 and not (len(t) == 2 and t[1] == CLOSE):
                good[i] = False
        self.good = good
        self.proposals = {t: i for t, i in self.ids.items() if good[i]}

    def strings_closed(self, token: int) -> str:
        return self.close(self.strings[token])

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge crosses the boundary of a and b before `until` (the end if none)."""
        a, b = np.asarray(a, "i8").copy(), np.asarray(b, "i8").copy()
        ends_a = np.full(len(a), NEVER, "i8") if until is None else np.asarray(until, "i8").copy()
        ends_b = ends_a.copy()
        if until is not None:
            ends_b -= 1  # the merge at `until` is that of a and b itself
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        while live.size:
            x, y = a[live], b[live]
            r = self.rank(x, y)
            crossed = (r < ends_a[live]) & (r <= ends_b[live]) & (r < NEVER)
            ok[live[crossed]] = False
            mx, my = self.made[x], self.made[y]
            go = ~crossed & ((mx >= 0) | (my >= 0))
            live, x, y, mx, my = live[go], x[go], y[go], mx[go], my[go]
            undo_a = mx > my
            i, j = live[undo_a], live[~undo_a]
            ends_a[i], a[i] = mx[undo_a], self.right[x[undo_a]]
            ends_b[j], b[j] = my[~undo_a], self.left[y[~undo_a]]
        return ok

    def _base(self, closed: str) -> list[int]:
        body = closed[:-1] if closed.endswith(CLOSE) else closed
        out = [self.ids[c] for c in body]
        if body != closed and out:
            out[-1] = self.ids[body[-1] + CLOSE]
        return out

    def _merge(self, parts: list[int], derive: int | None = None) -> list[int]:
        """Exact merging: the lowest rank first, the leftmost of equals."""
        n, size, low, get = len(parts), self.size, (1 << self.bits) - 1, self.merges.get
        if n <= SHORT and derive is None:  # a scan of so few ranks is faster than a heap
            ranks = [get(a * size + b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
            while ranks and (best := min(ranks)) != NONE:
                i = ranks.index(best)
                parts[i] = best & low
                del parts[i + 1], ranks[i]
                if i < len(ranks):
                    ranks[i] = get(parts[i] * size + parts[i + 1], NONE)
                if i:
                    ranks[i - 1] = get(parts[i - 1] * size + parts[i], NONE)
            return parts
        nxt, prv = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(m, i, parts[i], parts[i + 1]) for i in range(n - 1) if (m := get(parts[i] * size + parts[i + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            best, i, a, b = heapq.heappop(heap)
            j = nxt[i] if parts[i] == a else -1
            if j < 0 or parts[j] != b:
                continue
            parts[i] = best & low
            parts[j] = -1
            nxt[i] = nxt[j]
            if nxt[i] >= 0:
                prv[nxt[i]] = i
            for k, o in ((prv[i], i), (i, nxt[i])):
                if k >= 0 and o >= 0 and (m := get(parts[k] * size + parts[o], NONE)) != NONE:
                    heapq.heappush(heap, (m, k, parts[k], parts[o]))
            if derive is not None and parts[i] == derive:
                self.made[derive], self.left[derive], self.right[derive] = best >> self.bits, a, b
        return [p for p in parts if p >= 0]

    def propose(self, word: str) -> list[int] | None:
        """Greedy longest match; None where it comes to a character that it cannot place."""
        out, at, n, get, reach = [], 0, len(word), self.proposals.get, self.reach.get
        while at < n:
            for stop in range(min(n, at + reach(word[at : at + 3], 2)), at, -1):
                if stop != n - 1 and (t := get(word[at:stop])) is not None:  # the mark never stands alone
                    out.append(t)
                    at = stop
                    break
            else:
                return None
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of words of mapped bytes, each closed by CLOSE."""
        found = [self.propose(w) for w in words]
        size, pairs = self.size, self.pairs
        if len(pairs) > CACHE_PAIRS:
            pairs.clear()
        new = np.array(list({k for f in found if f for k in map(lambda a, b: a * size + b, f, f[1:]) if k not in pairs}), "i8")
        if new.size:
            pairs.update(zip(new.tolist(), self.compatible(new // size, new % size).tolist(), strict=True))
        return [
            f if f is not None and all(map(pairs.__getitem__, map(lambda a, b: a * size + b, f, f[1:]))) else self._merge(self._base(w))
            for f, w in zip(found, words, strict=True)
        ]

    def _mapped(self, word: str) -> str:
        return word.encode().decode("latin-1").translate(self.letters) + CLOSE

    def learn(self, chunks: list[str]) -> None:
        """Makes the ids of new lower-cased chunks known, for the texts at hand."""
        known = self.chunks
        split = {c: self.words.findall(c) for c in chunks if not c.isalpha()}
        words = [c for c in chunks if c.isalpha()]
        words = list(dict.fromkeys([*words, *(w for ws in split.values() for w in ws if w not in known)]))
        known.fresh = {w: array("I", ids).tobytes() for w, ids in zip(words, self.encode_words([self._mapped(w) for w in words]), strict=True)}
        for c, ws in split.items():
            if c not in known.fresh:  # a chunk that is one word
                known.fresh[c] = b"".join(map(known.__getitem__, ws))

    def _any(self, text: str) -> bytes:
        """A text of any characters: the library's normaliser and splitter, our merges."""
        out: list[int] = []
        for part in self.by_special.split(text) if self.by_special else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                words = [w + CLOSE for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))]
                for ids in self.encode_words(words):
                    out += ids
        return np.array(out, "<u4").tobytes()

    def encode(self, texts: list[str | None], group: int = 1 << 20) -> list[bytes]:
        """Ids of whole texts as u32 bytes; null has none. New chunks are learned a group of characters at a time."""
        out: list[bytes] = []
        held: list[list[str] | bytes] = []
        size = 0
        for k, text in enumerate(texts):
            if not text:
                held.append(b"")
            elif tokens.plain(text):
                held.append(text.lower().split())
                size += len(text)
            else:
                held.append(self._any(text))
            if size >= group or k == len(texts) - 1:
                if new := {c for h in held if isinstance(h, list) for c in h} - self.chunks.keys():
                    self.learn(list(new))
                get = self.chunks.__getitem__
                out += [h if isinstance(h, bytes) else b"".join(map(get, h)) for h in held]
                self.chunks.keep()
                held, size = [], 0
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The tokens' strings joined by spaces, as the library does where there is no decoder."""
        return " ".join(map(self.strings.__getitem__, ids.tolist()))


def worker_bpe(spec_json: str) -> Bpe:
    return worker_state(("bpe", hash(spec_json)), lambda: Bpe(spec_json))


def encode_decode(docs: DataFrame, tokenizer: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document, and its ids if asked for.

    docs needs doc_id and text; further columns are ignored. A null or empty text has no
    tokens and decodes to the empty text. Null and repeated doc_ids keep a row each. Texts
    are encoded whole, whatever their length. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(tokens.read_json(tokenizer))

    def digest(batches):
        bpe = worker_bpe(spec.value)
        for batch in lean(batches):
            coded = [np.frombuffer(x, "<u4") for x in bpe.encode(batch.column(1).to_pylist())]
            columns = [
                batch.column(0),
                pa.array([x.size for x in coded], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in coded], pa.string()),
                pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in coded], pa.string()),
            ]
            if keep_ids:
                columns.append(pa.array([x.astype("i4") for x in coded], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    return id_and_text(docs).mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)
