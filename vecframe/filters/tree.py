"""Expression trees of the filter language, with a direct two-valued evaluator."""

from __future__ import annotations

from dataclasses import dataclass


def quoted(value: str) -> str:
    """A literal that the parser reads back as value; the language has none for text with both kinds of quotes."""
    if "'" in value and '"' in value:
        raise ValueError("no literal holds both kinds of quotes")
    return f'"{value}"' if "'" in value else f"'{value}'"


COMPARISONS = {"=": "!=", "!=": "=", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}


@dataclass(frozen=True)
class Compare:
    field: str
    op: str
    value: str

    def __str__(self):
        return f"{self.field} {self.op} {quoted(self.value)}"


@dataclass(frozen=True)
class In:
    field: str
    values: tuple[str, ...]

    def __str__(self):
        return f"{self.field} IN ({', '.join(map(quoted, self.values))})"


@dataclass(frozen=True)
class Contains:
    field: str
    tag: str

    def __str__(self):
        return f"{self.field} CONTAINS {quoted(self.tag)}"


@dataclass(frozen=True)
class Like:
    field: str
    pattern: str

    def __str__(self):
        return f"{self.field} LIKE {quoted(self.pattern)}"


@dataclass(frozen=True)
class IsNull:
    field: str
    negated: bool = False

    def __str__(self):
        return f"{self.field} IS {'NOT ' * self.negated}NULL"


@dataclass(frozen=True)
class And:
    left: Expr
    right: Expr

    def __str__(self):
        return f"({self.left} AND {self.right})"


@dataclass(frozen=True)
class Or:
    left: Expr
    right: Expr

    def __str__(self):
        return f"({self.left} OR {self.right})"


@dataclass(frozen=True)
class Not:
    inner: Expr

    def __str__(self):
        return f"NOT ({self.inner})"


Expr = Compare | In | Contains | Like | IsNull | And | Or | Not


def like_form(pattern: str) -> tuple[str, str]:
    """A pattern's form: % at its ends is all that is special."""
    head, tail = pattern.startswith("%"), pattern.endswith("%")
    if pattern.strip("%") == "" and pattern:
        return "any", ""
    body = pattern[1 if head else 0 : -1 if tail else None]
    return {(True, True): "infix", (True, False): "suffix", (False, True): "prefix", (False, False): "exact"}[head, tail], body


def matches(e: Expr, row: dict[str, str]) -> bool:
    """Whether a row (absent keys are missing) meets e. Orders are bytewise."""
    match e:
        case And(a, b):
            return matches(a, row) and matches(b, row)
        case Or(a, b):
            return matches(a, row) or matches(b, row)
        case Not(a):
            return not matches(a, row)
        case IsNull(f, negated):
            return (row.get(f) is None) != negated
    v = row.get(e.field)
    if v is None:
        return isinstance(e, Compare) and e.op == "!="
    match e:
        case In(_, values):
            return v in values
        case Contains(_, tag):
            return tag in [t.strip() for t in v.split(",")]
        case Like(_, pattern):
            form, body = like_form(pattern)
            return {"any": True, "infix": body in v, "suffix": v.endswith(body), "prefix": v.startswith(body), "exact": v == body}[form]
        case Compare(_, op, x):
            a, b = v.encode(), x.encode()
            return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    raise TypeError(e)
