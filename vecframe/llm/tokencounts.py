"""Token counts of sections and fields, attributed by the places of tokens.

A document is encoded whole, once. The character spans of its tokens are joined with the
intervals of its sections. A token that crosses a boundary is allocated by the rule:
`start` to the section of its first character, `majority` to the section that holds most
of its characters (the earlier in ties), `split` to each section by its share.

The spans of a whole text are put together from those of its white-space chunks, which
no token crosses and which a worker keeps; texts for which this is not proven, as
tokens.plain says, are encoded by the library in one piece.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .shared import bounded_batches, id_and_text, worker_state

RULES = ("start", "majority", "split")
#: Distinct chunks kept by a worker.
CACHE_CHUNKS = 250_000
#: Whether each character below U+0300 is white space.
BLANK = np.array([chr(c).isspace() for c in range(0x300)])


class SpanEncoder(tokens.ChunkEncoder):
    """Maps a lower-cased chunk to the spans of its tokens as pairs of little-endian signed 32-bit bytes."""

    def __missing__(self, chunk: str) -> bytes:
        spans = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).offsets, "<i4").tobytes()
        self.put(chunk, spans)
        return spans

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First character and end of every token of a whole text, in order."""
        if not (self.fast and tokens.plain(text)) or "İ" in text:  # whose lower case is longer
            pairs = np.array(self.tokenizer.encode(text, add_special_tokens=False).offsets, "i8").reshape(-1, 2)
            return pairs[:, 0], pairs[:, 1]
        held = list(map(self.__getitem__, text.lower().split()))
        if not held:
            return np.empty(0, "i8"), np.empty(0, "i8")
        inside = np.zeros(len(text) + 2, bool)
        inside[1:-1] = ~BLANK[np.frombuffer(text.encode("utf-32-le"), "<u4")]
        at = np.flatnonzero(inside[1:] & ~inside[:-1])  # where chunks start
        pairs = np.frombuffer(b"".join(held), "<i4").reshape(-1, 2)
        at = np.repeat(at, np.fromiter(map(len, held), "i8", len(held)) // 8)
        return at + pairs[:, 0], at + pairs[:, 1]


def allot(start: np.ndarray, stop: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section: the tokens' spans joined with the sections that start at bounds (the first at 0)."""
    first = np.searchsorted(bounds, start, "right") - 1
    last = np.maximum(first, np.searchsorted(bounds, stop - 1, "right") - 1)
    if rule == "start":
        return np.bincount(first, minlength=len(bounds)).astype("f8")
    out = np.bincount(first[first == last], minlength=len(bounds)).astype("f8")
    for t in np.flatnonzero(first != last).tolist():
        a, b = first[t], last[t]
        sizes = np.diff([start[t], *bounds[a + 1 : b + 1].tolist(), stop[t]])
        if rule == "majority":
            out[a + int(sizes.argmax())] += 1
        else:
            out[a : b + 1] += sizes / (stop[t] - start[t])
    return out


def attribute(encoder: SpanEncoder, text: str, bounds: np.ndarray, rule: str = "start") -> np.ndarray:
    """Tokens of each section of text; sections start at bounds, ascending from 0."""
    return allot(*encoder.spans(text), bounds, rule)


def worker_spans(spec_json: str) -> SpanEncoder:
    return worker_state(("spans", hash(spec_json)), lambda: SpanEncoder(spec_json, CACHE_CHUNKS))


def _kind(rule: str) -> str:
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    return "double" if rule == "split" else "long"


def line_counts(docs: DataFrame, tokenizer: str, rule: str = "start", width: int | None = None) -> DataFrame:
    """doc_id, section, start_char, end_char, n_tokens of each section of each document.

    Sections are lines with their line feed, or stretches of `width` characters if given.
    A null or empty text has one empty section. docs needs doc_id and text; further
    columns are ignored. Null and repeated doc_ids keep their rows. Texts are encoded
    whole, whatever their length. An empty table gives no rows.
    """
    kind = _kind(rule)
    bounded_batches(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(tokens.read_json(tokenizer))

    def count(batches):
        encoder = worker_spans(spec.value)
        for batch in batches:
            rows, section, starts, stops, counts = [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                text = text or ""
                if width:
                    bounds = np.arange(0, max(len(text), 1), width)
                else:
                    lines = text.split("\n")
                    bounds = np.concatenate([[0], np.cumsum([len(x) + 1 for x in lines[:-1]])]).astype("i8")
                    if len(bounds) > 1 and bounds[-1] == len(text):  # nothing after the last line feed
                        bounds = bounds[:-1]
                rows.append(np.full(len(bounds), row))
                section.append(np.arange(len(bounds)))
                starts.append(bounds)
                stops.append(np.append(bounds[1:], len(text)))
                counts.append(attribute(encoder, text, bounds, rule))
            if rows:
                n = np.concatenate(counts)
                cols = [pa.array(np.concatenate(x).astype("i8")) for x in (section, starts, stops)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(rows))), *cols, pa.array(n if kind == "double" else np.rint(n).astype("i8"))], ["doc_id", "section", "start_char", "end_char", "n_tokens"])

    return id_and_text(docs).mapInArrow(count, f"doc_id long, section long, start_char long, end_char long, n_tokens {kind}")


def field_counts(table: DataFrame, key: str, fields: list[str], tokenizer: str, separator: str = "\n", rule: str = "start") -> DataFrame:
    """key, field, n_tokens: the fields of a row joined by separator and encoded as one text.

    A separator belongs to the field before it. A null field is empty and has a row with
    no tokens. Null and repeated keys keep their rows; an empty table gives no rows.
    """
    kind = _kind(rule)
    spec = table.sparkSession.sparkContext.broadcast(tokens.read_json(tokenizer))

    def count(batches):
        encoder = worker_spans(spec.value)
        for batch in batches:
            counts = []
            for values in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                parts = [(v or "") + separator for v in values[:-1]] + [values[-1] or ""]
                ends = np.cumsum([len(p) for p in parts])
                starts, own = np.unique(np.concatenate([[0], ends[:-1]]), return_index=True)
                n = np.zeros(len(parts))
                n[own] = attribute(encoder, "".join(parts), starts, rule)
                counts.append(n)
            n = np.concatenate(counts) if counts else np.empty(0)
            rows = np.repeat(np.arange(len(batch)), len(fields))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(fields * len(batch), pa.string()), pa.array(n if kind == "double" else np.rint(n).astype("i8"))], ["key", "field", "n_tokens"])

    if not separator:
        raise ValueError("fields need a separator")
    key_kind = dict(table.dtypes)[key]
    chosen = table.select(F.col(key).alias("key"), *(F.col(f).cast("string").alias(f"f{n}") for n, f in enumerate(fields)))
    return chosen.mapInArrow(count, f"key {key_kind}, field string, n_tokens {kind}").withColumnRenamed("key", key)
