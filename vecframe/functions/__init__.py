"""Functions on dense and sparse vectors as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: inside a lambda it would be computed for each element."""
    return F.transform(F.array(value), body)[0]
