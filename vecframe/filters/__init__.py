"""The filter language: text to expression tree, tree to Column."""

from .compile import to_column
from .parser import FilterError, parse_filter

__all__ = ["FilterError", "parse_filter", "to_column"]
