"""Document quality by Bradley-Terry pairwise ranking.

A document's features are transformed frequencies of its bytes and of hashed pairs of
bytes, and a few of its shape. Weights are learnt from pairs of one better and one
worse document by logistic loss on the difference of their features. The learnt score
is cut where the quantile of sample scores parts the labels best, and scaled so that
the cut lies at CUT.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, bounded_sample, held_out, id_and_text
from .textbytes import groups, utf8, words

CUT = 0.7
PAIRS = 512  # hashed pairs of bytes
EXTRA = 5
SMOOTH = 64  # bytes that each text counts as longer, so that short texts show no extremes
WIDTH = 256 + PAIRS + EXTRA
#: The bound of labelled rows of each kind that the ranking is fitted on.
FIT_ROWS = 4_000


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row for each text: logs of scaled frequencies; an empty text has zeros."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(n), sizes)
    single = np.bincount(doc * 256 + data, minlength=n * 256).reshape(n, 256)
    pair = (data[:-1].astype("u4") * np.uint32(0x9E3779B1) + data[1:].astype("u4") * np.uint32(0x85EBCA77)) >> np.uint32(23)
    inside = doc[:-1] == doc[1:]
    double = np.bincount(doc[:-1][inside] * PAIRS + pair[inside], minlength=n * PAIRS).reshape(n, PAIRS)
    f = np.zeros((n, WIDTH), "f4")
    scale = 1.0 / (sizes + SMOOTH)[:, None]
    f[:, :256] = np.log1p(1000 * single * scale)
    f[:, 256 : 256 + PAIRS] = np.log1p(1000 * double * scale)
    blanks = single[:, 0x20] + single[:, 0x0A]
    h, starts, ends = words(data, offsets)
    again = np.zeros(len(h) + 1)
    again[1 : len(h)] = h[1:] == h[:-1]
    again[starts] = 0
    sums = np.concatenate([[0], np.cumsum(again)])
    f[:, -5] = np.log1p(100 * (sums[ends] - sums[starts]) / (ends - starts + 8))
    f[:, -4] = np.log1p(sizes)
    f[:, -3] = sizes / (blanks + 1)
    f[:, -2] = single[:, 0x41:0x5B].sum(1) / np.maximum(single[:, 0x41:0x5B].sum(1) + single[:, 0x61:0x7B].sum(1), 1)
    f[:, -1] = single[:, 0x30:0x3A].sum(1) * scale[:, 0]
    return f


class PairwiseRanker:
    """Bradley-Terry weights over standardised features."""

    def __init__(self, seed: int = 11, steps: int = 800, batch: int = 512, decay: float = 1e-4):
        self.seed, self.steps, self.batch, self.decay = seed, steps, batch, decay
        self.mean, self.scale, self.weights = np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH)
        self.slope, self.cut = 1.0, 0.0

    def fit(self, x: np.ndarray, better: np.ndarray) -> "PairwiseRanker":
        good, bad = np.flatnonzero(better == 1), np.flatnonzero(better == 0)
        if not len(good) or not len(bad):
            return self  # nothing to compare: every score stays at the cut
        self.mean, self.scale = x.mean(0), x.std(0) + 0.05
        z = (x - self.mean) / self.scale
        rng = np.random.default_rng(self.seed)
        w, m, v = self.weights.copy(), np.zeros(WIDTH), np.zeros(WIDTH)
        for step in range(1, self.steps + 1):
            d = z[rng.choice(good, self.batch)] - z[rng.choice(bad, self.batch)]
            g = -(d / (1 + np.exp(np.clip(d @ w, -30, 30)))[:, None]).mean(0) + self.decay * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= 0.02 * (1 - step / (self.steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.weights = w
        s = z @ w
        share = np.linspace(0, 1, 501)
        cuts = np.quantile(s, share)
        ordered_good, ordered_bad = np.sort(s[good]), np.sort(s[bad])
        right = (1 - np.searchsorted(ordered_good, cuts) / len(good)) + np.searchsorted(ordered_bad, cuts) / len(bad)
        best = np.flatnonzero(right >= right.max() - 1e-12)
        self.cut = float((cuts[best[0]] + cuts[best[-1]]) / 2)
        spread = (s[good].mean() - s[bad].mean()) / 2
        self.slope = float(4 / spread) if spread > 1e-9 else 1.0
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        s = ((x - self.mean) / self.scale) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * (s - self.cut) + np.log(CUT / (1 - CUT)), -500, 500)))


def fit(docs: DataFrame, labels: DataFrame) -> PairwiseRanker:
    """Fits on at most about FIT_ROWS labelled documents of each kind.

    docs has doc_id and text, labels has doc_id and quality; rows with other or null
    labels teach nothing, nor do doc_ids with both labels. A labelled doc_id teaches
    once, with the least of its texts if there are several.
    """
    single = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).filter("quality = other")
    kinds = [bounded_sample(single.filter(F.col("quality") == k).select("doc_id", "quality"), "doc_id", FIT_ROWS) for k in (0, 1)]
    chosen = F.broadcast(kinds[0].unionByName(kinds[1]).select("doc_id", "quality"))

    def measure(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in groups(offsets):
                f = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([r.tobytes() for r in f.astype("f2")], pa.binary())], ["quality", "f"])

    once = docs.join(chosen, "doc_id").groupBy("doc_id").agg(F.first("quality").cast("int").alias("quality"), F.min("text").alias("text"))
    rows = once.select("quality", "text").mapInArrow(measure, "quality int, f binary").toArrow()
    x = np.array([np.frombuffer(r, "f2") for r in rows.column("f").to_pylist()], "f4").reshape(-1, WIDTH)
    order = np.lexsort([*x.T[[0, 32, -4]], rows.column("quality").to_numpy()])  # whatever the order of tasks
    return PairwiseRanker().fit(x[order].astype("f8"), rows.column("quality").to_numpy()[order])


def rank_quality(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted of each document.

    Labels of the fold are never read. A null text counts as empty; empty texts are scored
    by their features, all zero. Repeated and null doc_ids keep a row each; a null
    doc_id counts as held out. Texts are measured whole, whatever their length; equal
    texts have equal scores. Without labels of both kinds every score is the cut. An empty
    table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    base = id_and_text(docs)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality")).filter(~held_out(F.col("doc_id"), folds, fold))
    ranker = docs.sparkSession.sparkContext.broadcast(fit(base, marks))

    def predict(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for a, b in groups(offsets):
                s = ranker.value.score(features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], batch.column(1)[a:b], pa.array(s, pa.float64()), pa.array((s >= CUT).astype("i4"))], ["doc_id", "held_out", "score", "predicted"]
                )

    return base.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "text").mapInArrow(predict, "doc_id long, held_out boolean, score double, predicted int")
