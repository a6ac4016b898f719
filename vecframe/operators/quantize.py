"""Scalar and product quantization of vectors as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import let
from ..functions.dense import l2_squared, vector
from ..schema import Metric
from . import cluster
from .search import matrix_of


def fp16(v: Column, mode: str = "truncate") -> Column:
    """The values that half precision keeps: below 2^-14 zero, from 2^16 infinite.

    "truncate" drops the excess bits, "nearest" rounds them half to even.
    """

    def one(x: Column) -> Column:
        a = F.abs(x)
        q = F.pow(F.lit(2.0), F.floor(F.log2(a)) - 10)
        steps = F.floor(a / q).cast("double") if mode == "truncate" else F.rint(a / q)
        kept = F.signum(x) * steps * q
        top = F.lit(65536.0) if mode == "truncate" else F.lit(65520.0)
        return F.when(F.isnan(x), x).when(a < 2.0**-14, 0.0).when(a >= top, F.signum(x) * float("inf")).otherwise(kept)

    return F.transform(vector(v), one)


def fp16_codes(v: Column, mode: str = "truncate") -> Column:
    """The 16 bits of each component's half-precision value: sign, 5 bits of exponent, 10 of mantissa."""

    def one(x: Column) -> Column:
        a = F.abs(x)
        e = F.floor(F.log2(a)).cast("int")
        body = F.when(F.isnan(x), F.lit(0x7E00)).when(a == 0, F.lit(0)).when(a == float("inf"), F.lit(0x7C00))
        body = body.otherwise((e + 15) * 1024 + F.rint(a / F.pow(F.lit(2.0), e - 10)).cast("int") - 1024)
        return body + F.when(x < 0, F.lit(0x8000)).otherwise(0)

    return F.transform(fp16(v, mode), one)


def fp16_decode(codes: Column) -> Column:
    """The values of 16-bit codes."""

    def one(c: Column) -> Column:
        e, m = F.shiftright(c, 10).bitwiseAND(31), c.bitwiseAND(1023)
        value = F.when(e == 0, 0.0).when((e == 31) & (m > 0), float("nan")).when(e == 31, float("inf")).otherwise((1024 + m) * F.pow(F.lit(2.0), e - 25))
        return F.when(c >= 0x8000, -value).otherwise(value)

    return F.transform(codes, one)


def _affine(v: Column, steps: int, body) -> Column:
    """body(vector, low, scale) with each computed once; scale is 1 where all components are equal."""

    def scaled(x: Column) -> Column:
        low, high = F.array_min(x), F.array_max(x)
        bounds = F.struct(low.alias("low"), F.when(high == low, 1.0).otherwise((high - low) / steps).alias("scale"))
        return let(bounds, lambda b: body(x, b["low"], b["scale"]))

    return let(vector(v), scaled)


def int8(v: Column) -> Column:
    """STRUCT<codes ARRAY<INT>, scale, low>: codes from -128 to 127."""

    def code(x: Column, low: Column, scale: Column) -> Column:
        codes = F.transform(x, lambda e: F.greatest(F.lit(-128), F.least(F.lit(127), F.round((e - low) / scale).cast("int") - 128)))
        return F.struct(codes.alias("codes"), scale.alias("scale"), low.alias("low"))

    return _affine(v, 255, code)


def int8_decode(q: Column) -> Column:
    return let(q, lambda s: F.transform(s["codes"], lambda c: (c + 128) * s["scale"] + s["low"]))


def int8_dot(a: Column, b: Column) -> Column:
    """The product of two coded vectors from their integer sums."""
    n = F.size(a["codes"])
    up = lambda q: F.aggregate(q["codes"], F.lit(0).cast("bigint"), lambda s, c: s + c + 128)
    both = F.aggregate(F.zip_with(a["codes"], b["codes"], lambda x, y: ((x + 128) * (y + 128)).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return a["scale"] * b["scale"] * both + a["scale"] * b["low"] * up(a) + b["scale"] * a["low"] * up(b) + n * a["low"] * b["low"]


def int4(v: Column) -> Column:
    """STRUCT<packed ARRAY<INT>, scale, low, n>: two codes from 0 to 15 a byte, the even one high."""

    def code(x: Column, low: Column, scale: Column) -> Column:
        codes = F.transform(x, lambda e: F.greatest(F.lit(0), F.least(F.lit(15), F.round((e - low) / scale).cast("int"))))
        pack = lambda c: F.transform(F.sequence(F.lit(0), F.floor((F.size(c) - 1) / 2).cast("int")), lambda i: F.get(c, 2 * i) * 16 + F.coalesce(F.get(c, 2 * i + 1), F.lit(0)))
        return F.struct(let(codes, pack).alias("packed"), scale.alias("scale"), low.alias("low"), F.size(x).alias("n"))

    return _affine(v, 15, code)


def int4_decode(q: Column) -> Column:
    def decode(s: Column) -> Column:
        byte = lambda i: F.get(s["packed"], F.floor(i / 2).cast("int"))
        return F.transform(F.sequence(F.lit(0), s["n"] - 1), lambda i: F.when(i % 2 == 0, F.floor(byte(i) / 16)).otherwise(byte(i) % 16) * s["scale"] + s["low"])

    return let(q, decode)


def squared_error(v: Column, decoded: Column) -> Column:
    return let(F.struct(v.alias("a"), decoded.alias("b")), lambda p: l2_squared(p["a"], p["b"]))


@dataclass(frozen=True)
class ProductQuantizer:
    """codebook[sub][code] is a centroid of the sub-vectors at that place."""

    codebook: list[cluster.Centroids]

    @property
    def m(self) -> int:
        return len(self.codebook)

    @property
    def large(self) -> bool:
        return sum(len(b) for b in self.codebook) * self.width > cluster.EXPRESSION_SIZE

    @property
    def width(self) -> int:
        return len(self.codebook[0][0])

    @classmethod
    def train(cls, df: DataFrame, dims: int, m: int, k: int, max_iters: int = 10, seed: int = 0, vector: str = "vector", key: str = "pk") -> ProductQuantizer:
        """k-means in each sub-space; the sub-spaces' steps run as one job each round."""
        if dims % m or not 1 <= k <= 256:
            raise ValueError("m must divide the dimension and k lie between 1 and 256")
        width = dims // m
        k = min(k, df.count())
        first = df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(k).select(F.col(vector).cast("array<double>").alias("v")).collect()
        book = [[list(r.v[s * width : (s + 1) * width]) for r in first] for s in range(m)]
        for _ in range(max_iters):
            rows = cls(book).parts(df, vector).groupBy("sub", "code", "i").agg(F.avg("x").alias("x")).collect()  # m * k * width numbers
            new = [[list(c) for c in sub] for sub in book]
            for r in rows:
                new[r["sub"]][r["code"]][r["i"]] = r["x"]
            if new == book:
                break
            book = new
        return cls(book)

    def parts(self, df: DataFrame, vector: str) -> DataFrame:
        coded = df.select(F.col(vector).cast("array<double>").alias("v"), self.encode(F.col(vector)).alias("codes"))
        cut = F.transform(F.sequence(F.lit(0), F.lit(self.m - 1)), lambda s: F.slice("v", s * self.width + 1, self.width))
        subs = coded.select("codes", F.posexplode(cut).alias("sub", "part"))
        return subs.select("sub", F.get("codes", F.col("sub")).alias("code"), F.posexplode("part").alias("i", "x"))

    def sub(self, v: Column, s: int) -> Column:
        return F.slice(v, s * self.width + 1, self.width)

    def encode(self, v: Column) -> Column:
        """ARRAY<INT> of the nearest code of each sub-vector; as cluster.assign, by literals or by matrix products."""
        if self.large:
            books, w = [np.array(b, "f8") for b in self.codebook], self.width

            @F.arrow_udf("array<int>")
            def by_products(vectors: pa.Array) -> pa.Array:
                there = pc.is_valid(vectors)
                at = np.flatnonzero(there.to_numpy(zero_copy_only=False))
                codes = np.zeros((len(vectors), len(books)), "i4")
                x = matrix_of(vectors.take(pa.array(at)))
                for s, book in enumerate(books):
                    codes[at, s] = cluster.nearest_rows(Metric.L2, x[:, s * w : (s + 1) * w], book)[1]
                return cluster.lists(codes, there)

            return by_products(v.cast("array<double>"))
        return let(vector(v), lambda x: F.array(*(cluster.assign(self.sub(x, s), self.codebook[s])["cluster"] for s in range(self.m))))

    def decode(self, codes: Column) -> Column:
        if self.large:
            books = [np.array(b, "f8") for b in self.codebook]

            @F.arrow_udf("array<double>")
            def by_place(codes: pa.Array) -> pa.Array:
                there = pc.is_valid(codes)
                at = np.flatnonzero(there.to_numpy(zero_copy_only=False))
                out = np.zeros((len(codes), sum(b.shape[1] for b in books)))
                own = matrix_of(codes.take(pa.array(at))).astype("i8")
                out[at] = np.concatenate([b[own[:, s]] for s, b in enumerate(books)], 1)
                return cluster.lists(out, there)

            return by_place(codes.cast("array<int>"))
        return let(codes, lambda k: F.flatten(F.array(*(F.get(cluster.literal(self.codebook[s]), F.get(k, s)) for s in range(self.m)))))

    def table(self, query: list[float]) -> list[list[float]]:
        """Squared distance of each sub-vector of query to each code."""
        w = self.width
        return [[sum((a - b) ** 2 for a, b in zip(query[s * w : (s + 1) * w], c, strict=True)) for c in self.codebook[s]] for s in range(self.m)]

    def adc(self, codes: Column, query: list[float]) -> Column:
        """Squared distance of query to a coded vector through the table."""
        parts = [F.get(F.array(*(F.lit(x) for x in row)), F.get(codes, s)) for s, row in enumerate(self.table(query))]
        out = F.lit(0.0)
        for p in parts:
            out = out + p
        return out
