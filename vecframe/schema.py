"""Field roles, the metric, and the configuration of a collection."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from enum import Enum


class Metric(Enum):
    L2 = "l2"
    IP = "ip"
    COSINE = "cosine"
    MIPS = "mips"

    @property
    def higher_is_better(self) -> bool:
        return self is not Metric.L2

    def is_better(self, a: float, b: float) -> bool:
        return a > b if self.higher_is_better else a < b

    @property
    def worst(self) -> float:
        return float("-inf") if self.higher_is_better else float("inf")


ROLES = ("string", "filtered", "tags")


@dataclass(frozen=True)
class Schema:
    """Named fields with roles. All values are strings; a role only says how a field is meant to be used."""

    fields: tuple[tuple[str, str], ...] = ()

    def __post_init__(self):
        names = [n for n, _ in self.fields]
        if len(set(names)) != len(names):
            raise ValueError("a field is named twice")
        for name, role in self.fields:
            if role not in ROLES:
                raise ValueError(f"{name}: unknown type {role!r}")

    @classmethod
    def of(cls, **roles: str) -> Schema:
        return cls(tuple(roles.items()))

    @classmethod
    def from_json(cls, text: str) -> Schema:
        """From [{"name": ..., "type": ...}, ...]; an empty text is the empty schema."""
        if not text.strip():
            return cls()
        return cls(tuple((f["name"], f["type"]) for f in json.loads(text)))

    def to_json(self) -> str:
        return json.dumps([{"name": n, "type": r} for n, r in self.fields])

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.fields]

    def role(self, name: str) -> str | None:
        return dict(self.fields).get(name)

    def is_indexed(self, name: str) -> bool:
        return self.role(name) in ("filtered", "tags")

    @property
    def indexed_fields(self) -> list[str]:
        return [n for n in self.names if self.is_indexed(n)]

    @property
    def has_indexed_fields(self) -> bool:
        return bool(self.indexed_fields)

    def add(self, name: str, role: str) -> Schema:
        if self.role(name):
            raise ValueError(f"field {name} exists")
        return Schema((*self.fields, (name, role)))

    def drop(self, name: str) -> Schema:
        if not self.role(name):
            raise KeyError(name)
        return Schema(tuple(f for f in self.fields if f[0] != name))

    def rename(self, old: str, new: str) -> Schema:
        if not self.role(old):
            raise KeyError(old)
        if self.role(new):
            raise ValueError(f"field {new} exists")
        return Schema(tuple((new if n == old else n, r) for n, r in self.fields))

    def union(self, other: Schema) -> Schema:
        """Fields of both; this schema's roles win."""
        return Schema((*self.fields, *(f for f in other.fields if not self.role(f[0]))))


@dataclass(frozen=True)
class CollectionConfig:
    dims: int
    metric: Metric = Metric.IP
    schema: Schema = field(default_factory=Schema)

    def with_metric(self, metric: Metric) -> CollectionConfig:
        return replace(self, metric=metric)

    def with_schema(self, schema: Schema) -> CollectionConfig:
        return replace(self, schema=schema)

    def to_json(self) -> str:
        return json.dumps({"dims": self.dims, "metric": self.metric.value, "schema": self.schema.to_json()})

    @classmethod
    def from_json(cls, text: str) -> CollectionConfig:
        d = json.loads(text)
        return cls(d["dims"], Metric(d["metric"]), Schema.from_json(d["schema"]))
