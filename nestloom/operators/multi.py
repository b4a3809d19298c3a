"""Inner equijoins of several collections; a row holds one namespace for each alias."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.fields import element_scope
from .predicate import Predicates
from .relational import KEY, rows


@dataclass(frozen=True)
class _Source:
    name: str
    alias: str
    tests: tuple = ()
    limit: int | None = None
    left: tuple[str, str] | None = None  # alias, path
    right: str | None = None
    params: tuple = ()
    documents: int | None = None  # the most that may be read


class MultiQuery:
    def __init__(self, session, sources: tuple[_Source, ...] = (), limit_: int | None = None, keys: bool = False) -> None:
        self.session, self.sources, self._limit, self.keys = session, sources, limit_, keys

    def _next(self, *sources: _Source) -> MultiQuery:
        return MultiQuery(self.session, sources, self._limit, self.keys)

    def from_(self, name: str, alias: str | None = None) -> MultiQuery:
        return self._add(name, alias)

    def join(self, name: str, alias: str | None = None) -> MultiQuery:
        return self._add(name, alias)

    def _add(self, name: str, alias: str | None) -> MultiQuery:
        self.session.binding(name)
        alias = alias or name
        if any(s.alias == alias for s in self.sources):
            raise QueryError("duplicate_alias", alias)
        return self._next(*self.sources, _Source(name, alias))

    def _last(self, **changes: Any) -> MultiQuery:
        return self._next(*self.sources[:-1], replace(self.sources[-1], **changes))

    def on(self, left: str, right: str) -> MultiQuery:
        """left: a path of the source before."""
        return self.on_from(self.sources[-2].alias, left, right)

    def on_from(self, alias: str, left: str, right: str) -> MultiQuery:
        if alias not in [s.alias for s in self.sources[:-1]]:
            raise QueryError("unknown_alias", alias)
        return self._last(left=(alias, left), right=right)

    def where(self, test: Any, **params: Any) -> MultiQuery:
        return self._last(tests=(*self.sources[-1].tests, test), params=(*self.sources[-1].params, *params.items()))

    def source_limit(self, n: int) -> MultiQuery:
        return self._last(limit=n)

    def source_budget(self, documents: int) -> MultiQuery:
        """A source whose filters leave more documents is refused."""
        return self._last(documents=documents)

    def limit(self, n: int) -> MultiQuery:
        """The first n rows in order of the sources' keys."""
        return MultiQuery(self.session, self.sources, n, self.keys)

    def include_keys(self) -> MultiQuery:
        return MultiQuery(self.session, self.sources, self._limit, True)

    def _side(self, s: _Source) -> DataFrame:
        b = self.session.binding(s.name)
        df = b.df
        for test in s.tests:
            df = df.where(Predicates(rows(df, b.nulls_present, b.variant), dict(s.params), "filter").column(test))
        if s.documents is not None and df.limit(s.documents + 1).count() > s.documents:
            raise QueryError("rql_budget_exceeded", f"{s.alias}: documents > {s.documents}")
        if s.limit is not None:
            df = df.orderBy(KEY).limit(s.limit)
        return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(s.alias))

    def collect_frame(self) -> DataFrame:
        """A column for each alias. Rows without a key on either side drop; equal keys multiply."""
        out = None
        for s in self.sources:
            side = self._side(s)
            if out is None:
                out = side
                continue
            if s.left is None:
                raise QueryError("join_without_key", s.alias)
            a, path = s.left
            b = self.session.binding(next(x.name for x in self.sources if x.alias == a))
            right = self.session.binding(s.name)
            left_key = element_scope(F.col(a), out.schema[a].dataType, b.nulls_present).field(path)
            right_key = element_scope(F.col(s.alias), side.schema[s.alias].dataType, right.nulls_present).field(s.right)
            x, y = left_key.canonical(), right_key.canonical()
            if b.nulls_present and right.nulls_present:  # null joins null
                out = out.withColumn("x_", F.struct(x.alias("k"))).join(side.withColumn("y_", F.struct(y.alias("k"))), F.col("x_") == F.col("y_")).drop("x_", "y_")
            else:
                out = out.withColumn("x_", x).join(side.withColumn("y_", y), F.col("x_") == F.col("y_")).drop("x_", "y_")
        if self._limit is not None:
            out = out.orderBy(*[F.col(s.alias).getField(KEY) for s in self.sources]).limit(self._limit)
        if not self.keys:
            for s in self.sources:
                out = out.withColumn(s.alias, F.col(s.alias).dropFields(KEY))
        return out
