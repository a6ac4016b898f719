"""Expression trees as Columns.

The language is two-valued. Negations are pushed to the leaves, where a missing value is
decided with IS NULL; positive leaves may be unknown, which a Filter drops like false. So
every leaf stays a plain comparison that Parquet can be asked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tree import COMPARISONS, And, Compare, Contains, Expr, In, IsNull, Like, Not, Or, like_form


def tags(value: Column) -> Column:
    """The trimmed, comma-separated tags; trims all Unicode white space."""
    return F.transform(F.split(value, ","), lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", ""))


def negation_free(e: Expr, negate: bool = False) -> Expr:
    """Negation normal form: NOT stands before CONTAINS, LIKE and IN alone."""
    match e:
        case Not(x):
            return negation_free(x, not negate)
        case And(a, b):
            return (Or if negate else And)(negation_free(a, negate), negation_free(b, negate))
        case Or(a, b):
            return (And if negate else Or)(negation_free(a, negate), negation_free(b, negate))
        case IsNull(f, negated):
            return IsNull(f, negated != negate)
    return Not(e) if negate else e


def _leaf(e: Expr, v: Column) -> Column:
    match e:
        case In(_, values):
            return v.isin(*values)
        case Contains(_, tag):
            return F.array_contains(tags(v), tag)
        case Like(_, pattern):
            form, body = like_form(pattern)
            return {"any": lambda: v.isNotNull(), "infix": lambda: v.contains(body), "suffix": lambda: v.endswith(body), "prefix": lambda: v.startswith(body), "exact": lambda: v == body}[form]()
        case Compare(_, op, x):
            return {"=": v == x, "!=": (v != x) | v.isNull(), "<": v < x, "<=": v <= x, ">": v > x, ">=": v >= x}[op]
    raise TypeError(e)


def to_column(e: Expr, field: Callable[[str], Column] = F.col) -> Column:
    """The condition for a Filter; field(name) gives the column of a name."""

    def build(x: Expr) -> Column:
        match x:
            case And(a, b):
                return build(a) & build(b)
            case Or(a, b):
                return build(a) | build(b)
            case IsNull(f, negated):
                return field(f).isNotNull() if negated else field(f).isNull()
            case Not(Compare(f, "!=", v)):
                return field(f) == v
            case Not(Compare(f, op, v)):
                return _leaf(Compare(f, COMPARISONS[op], v), field(f)) | field(f).isNull()
            case Not(leaf):
                return ~_leaf(leaf, field(leaf.field)) | field(leaf.field).isNull()
        return _leaf(x, field(x.field))

    return build(negation_free(e))


def as_boolean(e: Expr, field: Callable[[str], Column] = F.col) -> Column:
    """The condition as a value that is never null, for projections."""
    return F.coalesce(to_column(e, field), F.lit(False))
