"""Language identification by interpolated Kneser-Ney character models.

Letters are lower-cased and each run of other characters is one boundary. An n-gram of
ORDER letters is a 64-bit hash: 16 bits a letter, which keep every letter of the basic
plane apart (others fold into its private area). n-grams of all training documents are
counted by language; the models hold, for each order, a sorted array of all the hashes with a row
of log probabilities, and one of contexts with the weights left to the lower order; the first
bits of a hash say where in the array to look. A text gets the language of the lowest cross-entropy per letter.

The score's temperature is calibrated on a labelled sample of bounded size, and the
cross-entropy from which a text is rejected by language on all training documents. Both
score a document as if the n-grams that it alone has were unseen, so that what the
model has learnt from a document does not flatter it. The level rises for short texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, bounded_sample, held_out, lean, worker_state, written
from .textbytes import BASE

BITS, ORDER = 16, 4
#: The uniform distribution below the lowest order is over so many letters.
ALPHABET = 1 << BITS
#: The private area of the basic plane, into which letters above it fold.
PRIVATE, PRIVATE_SIZE = 0xE000, 0x1900
#: If set, a bound of n-grams of all models together, beyond which each language's rarest go; all are held without it.
GRAMS: int | None = None
CALIBRATION_ROWS = 2_000
SLICE = 1 << 18
#: Standard deviations above the mean cross-entropy of a language from which texts are rejected.
REJECT_DEVIATIONS = 8.0
#: The least training rows of a language with a mean and deviation of its own.
LEVEL_ROWS = 20

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """The 16 bits of each code point; 0 for all that are no letters."""
    if not _letters:
        table = np.arange(0x110000)
        table[0x10000:] = PRIVATE + table[0x10000:] % PRIVATE_SIZE
        table[~np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)] = 0
        _letters.append(table.astype("u2"))
    return _letters[0]


def sequences(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts, each text preceded by ORDER - 1 boundaries and closed by one; and their ends."""
    low = [t.lower() if t else "" for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum([len(t) for t in low], dtype="i8")
    c = letters()[points]
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    starts = np.concatenate([[0], ends[:-1]]).astype("i8")
    first = starts[ends > starts]
    keep[first] = c[first] != 0  # the boundary in front is there already
    last = ends[ends > starts] - 1
    keep[last] &= c[last] != 0
    kept = np.concatenate([[0], np.cumsum(keep)])
    out_ends = np.cumsum(kept[ends] - kept[starts] + ORDER)
    out = np.zeros(int(out_ends[-1]) if len(out_ends) else 0, "u2")
    doc = np.repeat(np.arange(len(ends)), ends - starts)[keep]
    out[np.arange(kept[-1]) + ORDER * doc + ORDER - 1] = c[keep]
    return out, out_ends


def lower(codes: np.ndarray, order: int) -> np.ndarray:
    """The last `order` letters of n-grams."""
    return codes & np.uint64((1 << (BITS * order)) - 1)


def grams(sequence: np.ndarray) -> np.ndarray:
    """The n-gram that ends at each position from ORDER - 1 on."""
    n = max(len(sequence) - ORDER + 1, 0)
    out = np.zeros(n, "u8")
    for k in range(ORDER):
        out <<= np.uint64(BITS)
        out |= sequence[k : k + n]
    return out


def pieces(texts: list[str | None], size: int = SLICE):
    """Ranges of texts of about so many characters."""
    at = total = 0
    for k, t in enumerate(texts):
        total += len(t or "")
        if total >= size or k == len(texts) - 1:
            yield at, k + 1
            at, total = k + 1, 0


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all of docs (columns lang, text)."""

    def count(batches):
        worker_state("n-grams")
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def packed():
            for lang, arrays in held.items():
                codes, at = np.unique(np.concatenate([a for a, _ in arrays]), return_inverse=True)
                held[lang] = [(codes, np.bincount(at, np.concatenate([n for _, n in arrays])).astype("i8"))]

        for batch in lean(batches):
            langs, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                own = [texts[i] for i in np.flatnonzero(langs == lang)]
                for a, b in pieces(own):
                    sequence, ends = sequences(own[a:b])
                    codes = grams(sequence)
                    inside = np.ones(len(codes), bool)  # not those that reach over the end of a text
                    for k in range(1, ORDER):
                        inside[(ends[:-1] - k)[ends[:-1] - k < len(codes)]] = False
                    x, n = np.unique(codes[inside], return_counts=True)
                    held.setdefault(lang, []).append((x, n))
                    size += len(x)
                    if size > 1 << 21:
                        packed()
                        size = sum(len(a[0][0]) for a in held.values()) // 2
        packed()
        for lang, [(codes, n)] in held.items():
            for k in range(0, len(codes), 50_000):
                part = codes[k : k + 50_000].view("i8")
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part), pa.array(n[k : k + 50_000])], ["lang", "gram", "n"])

    return docs.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def found(codes: np.ndarray, among: np.ndarray) -> np.ndarray:
    """The place of each code in a sorted array, or -1."""
    if not len(among):
        return np.full(len(codes), -1)
    at = np.minimum(np.searchsorted(among, codes), len(among) - 1)
    return np.where(among[at] == codes, at, -1)


class HashArray:
    """Distinct 64-bit codes sorted by a multiplicative hash, with the places at which the hashes' first bits start."""

    def __init__(self, codes: np.ndarray):
        hashes = codes * np.uint64(BASE)
        self.order = np.argsort(hashes)
        self.hashes = np.append(hashes[self.order], np.uint64((1 << 64) - 1))
        bits = len(codes).bit_length() + 2
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(self.hashes[:-1], np.arange(1 << bits, dtype="u8") << self.shift).astype("i4")

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        """The place of each code in the order of hashes, or -1."""
        h = codes * np.uint64(BASE)
        at = self.starts[h >> self.shift]
        there = self.hashes[at]
        late = np.flatnonzero(there < h)
        while len(late):
            at[late] += 1
            there[late] = self.hashes[at[late]]
            late = late[there[late] < h[late]]
        at[(there != h) | (at == len(self.order))] = -1
        return at


def kneser_ney(own: list[tuple[np.ndarray, np.ndarray]], once: list[tuple[int, int]], codes: list[np.ndarray], contexts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """One language: for each order log p of `codes`, and log weights left to the lower order by `contexts`.

    own has the n-grams and counts of each order: raw ones of the highest, for lower ones
    the number of distinct letters before. once has how many were counted once and twice;
    an order's discount is n1 / (n1 + 2 n2).
    """
    p, log_p, log_left = np.full(1, 1.0 / ALPHABET), [], []
    for k, ((grams_k, n), (n1, n2)) in enumerate(zip(own, once, strict=True), 1):
        d = min(0.95, max(0.1, n1 / (n1 + 2 * n2) if n1 else 0.5))
        held, first = np.unique(grams_k >> np.uint64(BITS), return_index=True)
        total = np.add.reduceat(n, first).astype("f8") if len(first) else np.zeros(0)
        kinds = np.diff(np.append(first, len(grams_k)))
        left = np.ones(len(contexts[k - 1]))
        at = found(held, contexts[k - 1])
        left[at] = d * kinds / total
        sums = np.ones(len(contexts[k - 1]))
        sums[at] = total
        in_context = found(codes[k - 1] >> np.uint64(BITS), contexts[k - 1])
        q = left[in_context] * (p[found(lower(codes[k - 1], k - 1), codes[k - 2])] if k > 1 else p[0])
        at = found(grams_k, codes[k - 1])
        q[at] += (n - d) / sums[in_context[at]]
        p = q
        log_p.append(np.log(q))
        log_left.append(np.log(left))
    return log_p, log_left


class LanguageModel:
    """Models of all languages, the calibrated temperature and rejection levels."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray, int, int]]):
        """counts: each language's sorted n-grams, their counts, and how many n-grams were seen once and twice."""
        self.languages = sorted(counts)
        orders, once = [], []
        for x in self.languages:
            codes, n, n1, n2 = counts[x]
            own, few = [(codes, n.astype("f8"))], [(n1, n2)]
            for k in range(ORDER - 1, 0, -1):
                below, kinds = np.unique(lower(own[0][0], k), return_counts=True)
                own.insert(0, (below, kinds.astype("f8")))
                few.insert(0, (int((kinds == 1).sum()), int((kinds == 2).sum())))
            orders.append(own)
            once.append(few)
        codes = [np.unique(np.concatenate([o[k][0] for o in orders] or [np.empty(0, "u8")])) for k in range(ORDER)]
        contexts = [np.unique(c >> np.uint64(BITS)) for c in codes]
        made = [kneser_ney(o, f, codes, contexts) for o, f in zip(orders, once, strict=True)]
        self.codes, self.contexts = [HashArray(c) for c in codes], [HashArray(c) for c in contexts]
        rows = lambda n, k, at: np.stack([m[n][k] for m in made], 1)[at].astype("f4")
        self.log_p = [rows(0, k, self.codes[k].order) for k in range(ORDER if made else 0)]
        self.log_left = [rows(1, k, self.contexts[k].order) for k in range(ORDER if made else 0)]
        self.counts = np.zeros((len(codes[-1]), len(self.languages)), "u1")  # up to 255
        for k, x in enumerate(self.languages):
            self.counts[self.codes[-1](counts[x][0]), k] = np.minimum(counts[x][1], 255)
        self.temperature = 1.0
        self.levels = np.tile([np.log(ALPHABET), 0.0, 0.0], (len(self.languages), 1))  # mean, deviation, log2 of the usual length

    def _backed_off(self, codes: np.ndarray, order: int) -> np.ndarray:
        """log p in each language of n-grams that the order lacks: the context's weight times the lower order's p."""
        context = self.contexts[order - 1](codes >> np.uint64(BITS))
        out = np.where(context[:, None] < 0, 0, self.log_left[order - 1][context])
        if order == 1:
            return out - np.float32(np.log(ALPHABET))
        codes = lower(codes, order - 1)
        k = self.codes[order - 2](codes)
        below = self.log_p[order - 2][k]
        new = np.flatnonzero(k < 0)
        if len(new):
            below[new] = self._backed_off(codes[new], order - 1)
        return out + below

    def log_probabilities(self, codes: np.ndarray, alone=None) -> np.ndarray:
        """log p in each language of n-grams; alone(k) names those that count as unseen, by their places k."""
        k = self.codes[-1](codes)
        logs = self.log_p[-1][k]
        new = np.flatnonzero(k < 0)
        if alone is not None:
            new = np.concatenate([new, alone(k)])
        if len(new):
            logs[new] = self._backed_off(codes[new], ORDER)
        return logs

    def _alone(self, k: np.ndarray, who: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Where the text has all that its own language has of an n-gram (up to 255)."""
        n = np.where(k < 0, 0, self.counts[k, own[who]])
        few = np.flatnonzero((n > 0) & (n < 255))
        _, at, times = np.unique((who[few].astype("i8") << 32) | k[few].astype("i8"), return_inverse=True, return_counts=True)
        return few[times[at] >= n[few]]

    def cross_entropies(self, texts: list[str | None], own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text the nats per letter in each language, whether it has letters, and its length.

        With `own`, the languages of training texts, n-grams that a text alone has count as unseen.
        """
        out, lettered, lengths = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), bool), np.zeros(len(texts), "i8")
        for a, b in pieces(texts):
            sequence, ends = sequences(texts[a:b])
            starts = np.concatenate([[0], ends[:-1]]) + ORDER - 1  # the places that are predicted
            doc = np.repeat(np.arange(b - a, dtype="i4"), np.diff(ends, prepend=0))
            lettered[a:b] = np.bincount(doc, sequence > 0, b - a) > 0
            sums = np.zeros((b - a, len(self.languages)))
            for s in range(0, len(sequence) - ORDER + 1, SLICE):
                codes = grams(sequence[s : s + SLICE + ORDER - 1])
                who = doc[s + ORDER - 1 : s + ORDER - 1 + len(codes)]
                within = np.arange(s + ORDER - 1, s + ORDER - 1 + len(codes)) >= starts[who]
                codes, who = codes[within], who[within]
                logs = self.log_probabilities(codes, None if own is None else lambda k, who=who: self._alone(k, who, own[a:b]))  # noqa: B023
                first = np.flatnonzero(np.diff(who, prepend=-1))
                if len(first):
                    sums[who[first]] += np.add.reduceat(logs, first, axis=0, dtype="f8")
            out[a:b] = -sums / (ends - starts)[:, None]
            lengths[a:b] = ends - starts
        return out, lettered, lengths

    def calibrate(self, entropies: np.ndarray, truth: np.ndarray) -> None:
        """Fits the temperature by likelihood."""
        if not len(truth):
            return
        best = np.inf
        for t in np.geomspace(0.5, 64, 29):
            z = -entropies * t
            z -= z.max(1, keepdims=True)
            loss = -(z[np.arange(len(truth)), truth] - np.log(np.exp(z).sum(1))).mean()
            if loss < best:
                best, self.temperature = loss, float(t)

    def calibrate_rejection(self, sums: np.ndarray) -> None:
        """Sets the levels from each language's rows, own cross-entropies, their squares, and log2 of lengths, summed.

        A language of under LEVEL_ROWS rows gets the level of all together; if these are as
        few, nothing can be calibrated and only texts worse than a uniform guess are rejected.
        """
        pooled = sums.sum(0)
        for k in range(len(self.languages)):
            n, total, squares, length = sums[k] if sums[k, 0] >= LEVEL_ROWS else pooled
            if n >= LEVEL_ROWS:
                self.levels[k] = total / n, np.sqrt(max(squares / n - (total / n) ** 2, 0.0)), length / n

    def reject_from(self, k: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The cross-entropies from which texts of these languages and lengths are rejected.

        Below the usual length the deviation grows as that of a mean of so many classes.
        """
        mean, deviation, usual = self.levels[k].T
        return mean + REJECT_DEVIATIONS * deviation * np.sqrt(np.maximum(2**usual / np.maximum(lengths, 1), 1))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score from 0 to 1, cross-entropy, and whether the text is rejected."""
        if not self.languages:
            none = np.zeros(len(texts))
            return ["und"] * len(texts), none, none, np.ones(len(texts), bool)
        h, lettered, lengths = self.cross_entropies(texts)
        best = h.argmin(1)
        low = h[np.arange(len(h)), best] if len(h) else np.zeros(0)
        z = np.exp(-(h - low[:, None]) * self.temperature)
        score = np.where(lettered, 1 / z.sum(1), 0.0)
        rejected = ~lettered | (low > self.reject_from(best, lengths))
        return [self.languages[k] if ok else "und" for k, ok in zip(best, lettered, strict=True)], score, low, rejected


def fitted(train: DataFrame) -> LanguageModel:
    """The models of train (columns lang, text), whose n-grams are all counted and held.

    Only where GRAMS is set and the n-grams are more, each language keeps those of a least
    count with which they are fewer; the others count for the discount alone.
    """
    counted = written(gram_counts(train), "grams")
    few = counted.groupBy("lang", F.least("n", F.lit(4096)).alias("n")).count().collect()  # at most 4096 rows a language
    shape: dict[str, dict[int, int]] = {}
    for r in few:
        shape.setdefault(r.lang, {})[r.n] = r["count"]
    if GRAMS is not None and sum(sum(hist.values()) for hist in shape.values()) > GRAMS:
        least = {}
        for lang, hist in shape.items():
            left = sum(hist.values())
            for n in sorted(hist):
                if left <= GRAMS // len(shape):
                    break
                left -= hist[n]
            least[lang] = n if left < sum(hist.values()) else 1
        bounds = train.sparkSession.createDataFrame(sorted(least.items()), "lang string, least long")
        counted = counted.join(F.broadcast(bounds), "lang").filter("n >= least")
    table = counted.select("lang", "gram", "n").toArrow()
    lang = table.column("lang").combine_chunks().dictionary_encode()
    names, own = lang.dictionary.to_pylist(), lang.indices.to_numpy()
    gram, n = table.column("gram").to_numpy().view("u8"), table.column("n").to_numpy()
    counts = {}
    for k, x in enumerate(names):
        at = np.flatnonzero(own == k)
        at = at[np.argsort(gram[at])]
        counts[x] = gram[at], n[at], shape[x].get(1, 0), shape[x].get(2, 0)
    return LanguageModel(counts)


def fit(train: DataFrame) -> LanguageModel:
    """Learns from all of train (doc_id, lang, text); rows without lang or text teach nothing."""
    train = train.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    model = fitted(train)
    if not model.languages:
        return model
    shared = train.sparkSession.sparkContext.broadcast(model)

    def measured(batch):
        names = {x: k for k, x in enumerate(shared.value.languages)}
        own = np.array([names.get(x, -1) for x in batch.column(0).to_pylist()], "i8")
        h, ok, lengths = shared.value.cross_entropies(batch.column(1).to_pylist(), own)
        ok &= own >= 0
        return own[ok], h[ok], lengths[ok]

    def entropies(batches):
        for batch in batches:
            own, h, _ = measured(batch)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(list(h), pa.list_(pa.float64()))], ["own", "h"])

    def own_sums(batches):
        sums = np.zeros((len(shared.value.languages), 4))
        for batch in lean(batches):
            own, h, lengths = measured(batch)
            h = h[np.arange(len(own)), own]
            for k, x in enumerate((np.ones(len(h)), h, h * h, np.log2(lengths))):
                sums[:, k] += np.bincount(own, x, len(sums))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), *(pa.array(x) for x in sums.T.copy())], ["own", "n", "h", "hh", "length"])

    sums = np.zeros((len(model.languages), 4))
    for r in train.select("lang", "text").mapInArrow(own_sums, "own long, n double, h double, hh double, length double").groupBy("own").agg(*(F.sum(c).alias(c) for c in ("n", "h", "hh", "length"))).collect():
        sums[r.own] = r.n, r.h, r.hh, r.length
    model.calibrate_rejection(sums)
    rows = bounded_sample(train, "doc_id", CALIBRATION_ROWS).select("lang", "text").mapInArrow(entropies, "own long, h array<double>").collect()
    model.calibrate(np.array([r.h for r in rows]).reshape(-1, len(model.languages)), np.array([r.own for r in rows], "i8"))
    shared.destroy()
    return model


def verdict(docs: DataFrame, folds: int = 5, fold: int = 0) -> Column:
    """lang_pred, score, cross_entropy and rejected, as a struct made from the column text by models of docs outside the fold."""
    bounded_batches(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = docs.sparkSession.sparkContext.broadcast(fit(base.filter(~held_out(F.col("doc_id"), folds, fold))))
    names = ["lang_pred", "score", "cross_entropy", "rejected"]

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in lean(batches):
            lang, score, h, rejected = model.value.predict(texts.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(h, pa.float64()), pa.array(rejected, pa.bool_())], names)

    udf = F.arrow_udf(predict, "lang_pred string, score double, cross_entropy double, rejected boolean")
    return udf(F.col("text").cast("string"))  # texts alone go to Python


def identify(docs: DataFrame, folds: int = 5, fold: int = 0, keep: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected of each document.

    Learns from the rows of docs outside the fold alone. docs needs doc_id, text and lang;
    `keep` names columns to carry on, as kept_0, kept_1, ... A null text, or one without letters, is `und`
    with score 0 and rejected. Texts are scored whole, whatever their length. Ties go to the
    language first by name. With nothing to learn from, every row is `und`. A null doc_id
    counts as held out; repeated rows keep a row each. An empty table gives no rows.
    """
    kept = [F.col(c).alias(f"kept_{k}") for k, c in enumerate(keep or [])]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id"), folds, fold).alias("held_out"), *kept, verdict(docs, folds, fold).alias("verdict"))
    return rows.select("doc_id", "held_out", "verdict.*", *(f"kept_{k}" for k in range(len(kept))))


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs that are not rejected, as they are."""
    return docs.filter(~verdict(docs)["rejected"])
