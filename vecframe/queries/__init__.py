"""The registry of queries: name -> (query over a folder of tables, the same for DuckDB or None)."""

from __future__ import annotations

from . import collections, models, vectors

REGISTRY = {**vectors.REGISTRY, **collections.REGISTRY, **models.REGISTRY}
QUERIES = {name: run for name, (run, _) in REGISTRY.items()}
SQL = {name: sql for name, (_, sql) in REGISTRY.items() if sql}
