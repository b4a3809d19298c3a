"""Predicates as columns with two truth values.

`loose` columns may be NULL where they are false, which a filter treats alike; such bare comparisons reach the scan. Under a
negation every leaf is made strict first. Profile "text" is that of the text language, "filter" that of object filters and
SQL, where != holds for missing fields and truth values have an order.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.fields import Field, Scope
from ..plans.tree import And, Compare, Const, Not, OneOf, Or, Param, Path, Test, Text


def bind(value: Any, params: dict[str, Any]) -> Any:
    if isinstance(value, Param):
        if value.name not in params:
            raise QueryError("rql_unbound_parameter", value.name)
        return params[value.name]
    return value


class Predicates:
    def __init__(self, scope: Scope, params: dict[str, Any] | None = None, profile: str = "text") -> None:
        self.scope, self.params, self.filter = scope, params or {}, profile == "filter"

    def column(self, test: Any) -> Column:
        return self._build(test, strict=False)

    def _build(self, test: Any, strict: bool) -> Column:
        if isinstance(test, Const):
            return F.lit(test.value)
        if isinstance(test, (And, Or)):
            parts = [self._build(p, strict) for p in test.parts]
            out = parts[0] if parts else F.lit(isinstance(test, And))
            for p in parts[1:]:
                out = (out & p) if isinstance(test, And) else (out | p)
            return out
        if isinstance(test, Not):
            return ~self._build(test.part, True)
        leaf = self._leaf(test)
        return F.coalesce(leaf, F.lit(False)) if strict else leaf

    def _leaf(self, test: Any) -> Column:
        if isinstance(test, Compare):
            f = self.scope.field(test.left.name)
            if isinstance(test.right, Path):
                return self._fields(test.op, f, self.scope.field(test.right.name))
            return self._compare(test.op, f, bind(test.right, self.params))
        f = self.scope.field(test.path.name)
        if isinstance(test, OneOf):
            values = [v for x in test.values for b in [bind(x, self.params)] for v in (b if isinstance(x, Param) and isinstance(b, (list, tuple)) else [b])]
            return (f.present & ~F.coalesce(self._any(f, values), F.lit(False))) if test.negated else self._any(f, values)
        if isinstance(test, Test):
            return {"present": f.present, "missing": ~f.present, "null": f.null, "not_null": f.present & ~f.null}[test.kind]
        if isinstance(test, Text):
            value = bind(test.value, self.params)
            if test.kind == "starts_with":
                return f.text().startswith(value) if isinstance(value, str) and f.family in ("text", "variant") else F.lit(False)
            return self._contains(f, value)
        raise QueryError("rql_syntax", f"not a predicate: {test}")

    def _any(self, f: Field, values: list) -> Column:
        if f.family in ("text", "number", "bool") and values and all(v is not None and _fits(f, v) for v in values):
            return f.value.isin(*values)
        out = F.lit(False)
        for v in values:
            out = out | F.coalesce(self._equal(f, v), F.lit(False))
        return out

    def _contains(self, f: Field, value: Any) -> Column:
        if f.family == "array":
            kind = Field(f.value, f.type.elementType, f.present, f.null)
            return F.array_contains(f.value, F.lit(value)) if value is not None and _fits(kind, value) else F.lit(False)
        if f.family == "variant":
            items = F.try_variant_get(f.value, "$", "array<variant>")
            one = lambda x: F.coalesce(self._equal(Field(x, f.type, x.isNotNull(), F.is_variant_null(x)), value), F.lit(False))
            inside = F.coalesce(F.exists(items, one), F.lit(False))
            return F.coalesce(f.text().contains(value), inside) if isinstance(value, str) else inside
        return f.text().contains(value) if isinstance(value, str) and f.family == "text" else F.lit(False)

    def _equal(self, f: Field, value: Any) -> Column:
        if value is None:
            return f.null
        if f.family == "variant":
            if isinstance(value, bool):
                return f.truth() == value
            if isinstance(value, (int, float)):
                return f.number() == float(value)
            if isinstance(value, str):
                return f.text() == value
            return F.to_json(f.value) == F.to_json(F.array(*map(F.lit, value)))
        if isinstance(value, (list, tuple)):
            if f.family != "array":
                return F.lit(False)
            return f.value == F.array(*map(F.lit, value)) if value else F.size(f.value) == 0
        return f.value == _literal(f, value) if _fits(f, value) else F.lit(False)

    def _compare(self, op: str, f: Field, value: Any) -> Column:
        if op == "=":
            return self._equal(f, value)
        if op == "!=":
            same = self._equal(f, value)
            if self.filter:
                return ~F.coalesce(same, F.lit(False))
            if f.family in ("text", "number", "bool") and value is not None and _fits(f, value) and not self.scope.nulls_present:
                return f.value != _literal(f, value)
            return f.present & ~F.coalesce(same, F.lit(False))
        if isinstance(value, bool):
            left, right = (f.truth(), F.lit(value)) if self.filter and f.family in ("bool", "variant") else (None, None)
        elif isinstance(value, (int, float)):
            left, right = (f.value if f.family == "number" else f.number(), F.lit(value)) if f.family in ("number", "variant") else (None, None)
        elif isinstance(value, str):
            left, right = (f.value, _literal(f, value)) if f.family == "time" else (f.text(), F.lit(value)) if f.family in ("text", "variant") else (None, None)
        else:
            left = right = None
        return F.lit(False) if left is None else _ordered(op, left, right)

    def _fields(self, op: str, a: Field, b: Field) -> Column:
        if "absent" in (a.family, b.family):
            return F.lit(False)
        alike = a.family == b.family != "variant"
        both = a.present & b.present
        if op in ("=", "!="):
            same = a.value.eqNullSafe(b.value) if alike else F.lit(False) if "variant" not in (a.family, b.family) else a.canonical().eqNullSafe(b.canonical())
            return both & (same if op == "=" else ~same)
        if alike and a.family in ("number", "text", "time"):
            return _ordered(op, a.value, b.value)
        return F.coalesce(_ordered(op, a.number(), b.number()), _ordered(op, a.text(), b.text()), F.lit(False))


def _ordered(op: str, a: Column, b: Column) -> Column:
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def _fits(f: Field, value: Any) -> bool:
    kinds = {"text": str, "number": (int, float), "bool": bool, "time": str}
    return f.family in kinds and isinstance(value, kinds[f.family]) and (f.family == "bool") == isinstance(value, bool)


def _literal(f: Field, value: Any) -> Column:
    """A text that is no time compares with none."""
    return F.lit(value).try_cast(f.type) if f.family == "time" else F.lit(value)
