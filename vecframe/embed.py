"""Embedding functions, HTTP clients with an injected transport, and batch embedding of columns."""

from __future__ import annotations

import asyncio
import json
import os
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Transport = Callable[[str, dict, dict, float], dict]


class EmbeddingError(Exception):
    pass


class InvalidInput(EmbeddingError):
    pass


class EmptyInput(EmbeddingError):
    pass


class NetworkError(EmbeddingError):
    pass


class ApiError(EmbeddingError):
    pass


class ParseError(EmbeddingError):
    pass


class DimensionMismatch(EmbeddingError):
    pass


class DenseEmbedding(Protocol):
    def dimension(self) -> int: ...

    def embed(self, text: str) -> list[float]: ...

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]: ...


class SparseEmbedding(Protocol):
    def embed_sparse(self, text: str) -> tuple[list[int], list[float]]: ...

    def embed_sparse_batch(self, texts: Sequence[str]) -> list[tuple[list[int], list[float]]]: ...


def post_json(url: str, headers: dict, body: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            raw = answer.read()
    except urllib.error.HTTPError as e:
        raise ApiError(f"{e.code}: {e.reason}") from e
    except OSError as e:
        raise NetworkError(str(e)) from e
    try:
        return json.loads(raw)
    except ValueError as e:
        raise ParseError(str(e)) from e


@dataclass
class HttpEmbedding:
    """POSTs {"model", "input"} to url and reads {"data": [{"index", "embedding"}]}.

    Without dims, the length of the first answer is taken as the dimension.
    """

    url: str
    model: str
    dims: int | None = None
    api_key: str | None = None
    timeout: float = 30.0
    transport: Transport = field(default=post_json, repr=False)

    @classmethod
    def with_key_from(cls, variable: str, base: str, model: str, dims: int, **rest) -> HttpEmbedding:
        """A client of the `embeddings` path below base, with a bearer key from the environment."""
        key = os.environ.get(variable)
        if not key:
            raise InvalidInput(f"{variable} is not set")
        return cls(f"{base.rstrip('/')}/embeddings", model, dims, key, **rest)

    def dimension(self) -> int:
        if self.dims is None:
            self.embed("dimension")
        return self.dims

    def embed(self, text: str) -> list[float]:
        return self.embed_batch([text])[0]

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]:
        if not texts or any(not t for t in texts):
            raise EmptyInput("nothing to embed")
        headers = {"Authorization": f"Bearer {self.api_key}"} if self.api_key else {}
        answer = self.transport(self.url, headers, {"model": self.model, "input": list(texts)}, self.timeout)
        try:
            vectors = [list(map(float, d["embedding"])) for d in sorted(answer["data"], key=lambda d: d.get("index", 0))]
        except (KeyError, TypeError, ValueError) as e:
            raise ParseError(f"no embeddings in the answer: {e}") from e
        if len(vectors) != len(texts):
            raise ParseError(f"{len(vectors)} embeddings for {len(texts)} texts")
        for v in vectors:
            if self.dims is None:
                self.dims = len(v)
            if len(v) != self.dims:
                raise DimensionMismatch(f"{len(v)} components, expected {self.dims}")
        return vectors


def embed_column(make: Callable[[], DenseEmbedding], text: Column, batch: int = 256) -> Column:
    """ARRAY<FLOAT> of each text; the function is made once a task. Null and empty texts give null."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for part in parts:
            out: list = [None] * len(part)
            at = [i for i, t in enumerate(part) if t]
            for a in range(0, len(at), batch):
                for i, v in zip(at[a : a + batch], model.embed_batch([part.iloc[i] for i in at[a : a + batch]]), strict=True):
                    out[i] = v
            yield pd.Series(out)

    return run(text)


def embed_sparse_column(make: Callable[[], SparseEmbedding], text: Column) -> Column:
    """STRUCT<indices, values> of each text."""

    @F.pandas_udf("struct<indices: array<bigint>, values: array<double>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make()
        for part in parts:
            made = model.embed_sparse_batch([t or "" for t in part])
            yield pd.DataFrame({"indices": [list(i) for i, _ in made], "values": [list(v) for _, v in made]})

    return run(text)


class AsyncEmbedding:
    """Awaitable calls of an embedding function, which runs in a thread of its own."""

    def __init__(self, inner: DenseEmbedding | SparseEmbedding):
        self.inner = inner

    def dimension(self) -> int:
        return self.inner.dimension()

    async def embed(self, text: str) -> list[float]:
        return await asyncio.to_thread(self.inner.embed, text)

    async def embed_batch(self, texts: Sequence[str]) -> list[list[float]]:
        return await asyncio.to_thread(self.inner.embed_batch, texts)

    async def embed_sparse(self, text: str) -> tuple[list[int], list[float]]:
        return await asyncio.to_thread(self.inner.embed_sparse, text)

    async def embed_sparse_batch(self, texts: Sequence[str]) -> list[tuple[list[int], list[float]]]:
        return await asyncio.to_thread(self.inner.embed_sparse_batch, texts)
