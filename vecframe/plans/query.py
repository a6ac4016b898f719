"""The compact dialect: text or builder to a query, a query to a DataFrame.

SELECT COUNT(*) FROM c [WHERE e]
SELECT f, COUNT(*) FROM c GROUP BY f [WHERE e]  (or WHERE first)
SELECT * | f, ... FROM c [WHERE e] [ORDER BY f | _distance [ASC | DESC]] [LIMIT n]

What follows a complete query is an error, never ignored. LIMIT 0 is no limit.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..filters import FilterError, parse_filter, to_column
from ..filters.tree import And, Expr
from ..functions import dense
from ..schema import Metric

TOKEN = re.compile(r"""\s*(?:(?P<text>'[^']*'|"[^"]*")|(?P<word>\w+)|(?P<op><=|>=|!=|[=<>(),*])|(?P<bad>\S))""")
STOPS = ("ORDER", "LIMIT", "GROUP")


class QueryError(ValueError):
    pass


@dataclass(frozen=True)
class Query:
    kind: str = "select"  # select, count, group
    fields: tuple[str, ...] = ()  # none: all
    condition: Expr | None = None
    order: str | None = None
    descending: bool | None = None
    limit_to: int = 0

    # builder
    @classmethod
    def select(cls, *fields: str) -> Query:
        return cls("select", fields)

    @classmethod
    def count(cls) -> Query:
        return cls("count")

    @classmethod
    def group_count(cls, name: str) -> Query:
        return cls("group", (name,))

    def where(self, condition: str | Expr) -> Query:
        e = parse_filter(condition) if isinstance(condition, str) else condition
        return replace(self, condition=e if self.condition is None else And(self.condition, e))

    def order_by(self, name: str, descending: bool | None = None) -> Query:
        return replace(self, order=name, descending=descending)

    def limit(self, n: int) -> Query:
        return replace(self, limit_to=n)

    @classmethod
    def parse(cls, text: str) -> Query:
        return _Parser(text).query()


@dataclass
class _Parser:
    text: str
    at: int = 0
    tokens: list[tuple[str, str, int, int]] = field(default_factory=list)

    def __post_init__(self):
        place, end = 0, len(self.text.rstrip())
        while place < end:
            m = TOKEN.match(self.text, place)
            place = m.end()
            if m.lastgroup == "bad":
                raise QueryError(f"unexpected {m['bad']!r} at {m.start('bad')}")
            self.tokens.append((m.lastgroup, m[m.lastgroup], m.start(m.lastgroup), m.end()))
        if not self.tokens:
            raise QueryError("the query is empty")

    def key(self) -> str:
        return self.tokens[self.at][1].upper() if self.at < len(self.tokens) and self.tokens[self.at][0] in ("word", "op") else ""

    def skip(self, *words: str) -> bool:
        ahead = [t[1].upper() for t in self.tokens[self.at : self.at + len(words)]]
        if ahead == list(words):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.skip(*words):
            raise QueryError(f"expected {' '.join(words)}")

    def name(self, what: str) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "word":
            raise QueryError(f"expected {what}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def where(self) -> Expr | None:
        if not self.skip("WHERE"):
            return None
        start = self.at
        while self.at < len(self.tokens) and not (self.tokens[self.at][0] == "word" and self.key() in STOPS):
            self.at += 1
        if start == self.at:
            raise QueryError("WHERE has no condition")
        try:
            return parse_filter(self.text[self.tokens[start][2] : self.tokens[self.at - 1][3]])
        except FilterError as e:
            raise QueryError(str(e)) from e

    def done(self, q: Query) -> Query:
        if self.at < len(self.tokens):
            raise QueryError(f"unexpected {self.tokens[self.at][1]!r} at {self.tokens[self.at][2]}")
        return q

    def query(self) -> Query:
        self.need("SELECT")
        count = ("COUNT", "(", "*", ")")
        if self.skip(*count):
            self.need("FROM")
            self.name("a collection")
            return self.done(Query("count", condition=self.where()))
        fields: list[str] = []
        counted = False
        if not self.skip("*"):
            fields.append(self.name("a field"))
            while self.skip(","):
                if self.skip(*count):
                    counted = True
                    break
                fields.append(self.name("a field"))
        self.need("FROM")
        self.name("a collection")
        condition = self.where()
        if counted:
            self.need("GROUP", "BY")
            if [self.name("a field")] != fields:
                raise QueryError("one field is selected, and GROUP BY names it")
            if condition is None:
                condition = self.where()
            return self.done(Query("group", tuple(fields), condition))
        order = descending = None
        if self.skip("ORDER"):
            self.need("BY")
            order = self.name("a field")
            descending = True if self.skip("DESC") else False if self.skip("ASC") else None
        n = 0
        if self.skip("LIMIT"):
            word = self.name("a number")
            if not word.isdigit():
                raise QueryError(f"LIMIT takes a number, not {word!r}")
            n = int(word)
        return self.done(Query("select", tuple(fields), condition, order, descending, n))


def execute(q: Query, df: DataFrame, column: Callable[[str], Column] = F.col, names: Sequence[str] = (), metric: Metric = Metric.IP, vector: Sequence[float] | None = None, digits: int | None = None) -> DataFrame:
    """The rows of q over df (pk, vector, fields); names are the fields of SELECT *."""
    if q.condition is not None:
        df = df.filter(to_column(q.condition, column))
    if q.kind == "count":
        return df.agg(F.count("*").alias("count"))
    if q.kind == "group":
        name = q.fields[0]
        rows = df.select(column(name).alias(name)).filter(F.col(name).isNotNull())
        return rows.groupBy(name).agg(F.count("*").alias("count")).orderBy(F.desc("count"), name)
    chosen = [column(n).alias(n) for n in q.fields or names]
    order: list[Column] = []
    if q.order == "_distance":
        if vector is None:
            raise QueryError("ORDER BY _distance needs a vector")
        d = dense.distance(metric, F.col("vector"), vector)
        chosen.append((d if digits is None else F.round(d, digits)).alias("_distance"))
        df = df.filter(F.col("vector").isNotNull())
        better = metric.higher_is_better if q.descending is None else q.descending
        order = [F.col("_distance").desc() if better else F.col("_distance").asc(), F.col("_pk").asc()]
        out = df.select(F.col("pk").alias("_pk"), *chosen).orderBy(*order)
    elif q.order is not None:
        key = F.coalesce(column(q.order), F.lit(""))
        ranked = df.orderBy(key.desc() if q.descending else key.asc(), "pk")
        out = (ranked.limit(q.limit_to) if q.limit_to else ranked).select(F.col("pk").alias("_pk"), *chosen)
        return out
    else:
        out = df.select(F.col("pk").alias("_pk"), *chosen)
        if q.limit_to:
            out = out.orderBy("_pk")
    return out.limit(q.limit_to) if q.limit_to else out
