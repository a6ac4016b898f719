"""Texts as arrays of UTF-8 bytes: words, hashes of spans, shingles, all in numpy.

Words are runs of digits, a-z after lower-casing A-Z, and bytes from 0x80 on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import beside

SLICE = 1 << 20
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2 ** 64


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (or binary values) in one array, and the offsets of the texts; null is empty."""
    binary = pa.types.is_binary(column.type)
    column = pc.fill_null(column.cast(pa.large_binary() if binary else pa.large_string()), b"" if binary else "")
    offsets = np.frombuffer(column.buffers()[1], "i8")[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, "u1") if data is not None else np.empty(0, "u1")
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups(offsets: np.ndarray, size: int = SLICE):
    """Ranges of texts of about so many bytes."""
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, to
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which each input bit moves each output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype="u8") * np.uint64(BASE) + np.uint64(seed))


VALUES = byte_values(1)
LOWER = np.arange(256, dtype="u1")
LOWER[0x41:0x5B] += 32
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse."""
    held = beside("powers", list)
    if not held or len(held[0]) < n:
        most = max(n, SLICE + (1 << 18))
        steps = np.full(most, BASE, "u8")
        steps[0] = 1
        inverse = np.full(most, pow(BASE, -1, 1 << 64), "u8")
        inverse[0] = 1
        held[:] = [np.multiply.accumulate(steps), np.multiply.accumulate(inverse)]
    return held[0][:n], held[1][:n]


class SpanHash:
    """Hashes of any spans of the given bytes from one pass of prefix sums."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, "u8")
        np.cumsum(VALUES[data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        h = (self.sums[stop] - self.sums[start]) * self.down[start]
        return mix(h + (stop - start).astype("u8") * np.uint64(0xC2B2AE3D27D4EB4F))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, and for each text where its words start and end among them."""
    low = LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = WORD[low]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    stops = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    ends = np.searchsorted(starts, offsets[1:])
    return SpanHash(low)(starts, stops), np.concatenate([[0], ends[:-1]]).astype("i8"), ends


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words, and the text of each; a text of fewer words has one of all."""
    h, starts, ends = words(data, offsets)
    n = ends - starts
    many = np.maximum(n - k + 1, 0)
    doc = np.repeat(np.arange(len(n)), many)
    first = np.repeat(starts, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    out = np.zeros(len(first), "u8")
    for j in range(k):
        out = (out + h[first + j]) * np.uint64(BASE)
    out = mix(out)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        extra = np.zeros(len(short), "u8")
        for j in range(k - 1):
            held = n[short] > j
            extra[held] = (extra[held] + h[starts[short[held]] + j]) * np.uint64(BASE)
        out, doc = np.concatenate([out, mix(extra + np.uint64(1))]), np.concatenate([doc, short])
    return out, doc


def counted(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (text, hash) of up to 65536 texts, as text, 48 bits of the hash, count."""
    key, n = np.unique((doc.astype("u8") << np.uint64(48)) | (h >> np.uint64(16)), return_counts=True)
    return (key >> np.uint64(48)).astype("i8"), key & np.uint64((1 << 48) - 1), n
