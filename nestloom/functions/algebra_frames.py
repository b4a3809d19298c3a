"""The algebra over DataFrames: columns where a program has a column form, equijoins for matches, Arrow batches for the rest.

The column form gives what the Arrow form gives. It is made only where the families of both sides are known and alike and
where Spark's arithmetic is exact: no sums, products or quotients, no times, no single-precision numbers.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from fractions import Fraction
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import algebra
from .fields import Scope, row_scope

_COMPARE = {"=", "!=", "<", "<=", ">", ">="}


@dataclass(frozen=True)
class _Typed:
    """A column, its family (int, long, double, text, bool, null), and where it has a value of that family."""

    value: Column
    family: str
    fine: Column


def to_column(e: tuple, scope: Scope, name: str = "input") -> Column | None:
    """Where an expression over typed fields of the named row is true; None if it has no column form."""
    found = _typed(e, scope, name)
    return found.fine & found.value if found is not None and found.family == "bool" else None


def _literal(x: Any) -> _Typed | None:
    always = F.lit(True)
    if x is None:
        return _Typed(F.lit(None), "null", always)
    if isinstance(x, bool):
        return _Typed(F.lit(x), "bool", always)
    if isinstance(x, str):
        return _Typed(F.lit(x), "text", always)
    if not isinstance(x, Fraction):
        return None
    if x.denominator == 1 and abs(x) < 1 << 31:
        return _Typed(F.lit(int(x)), "int", always)
    if x.denominator == 1 and abs(x) < 1 << 53:
        return _Typed(F.lit(int(x)).cast("bigint"), "long", always)
    return _Typed(F.lit(float(x)), "double", always) if abs(x) < 1 << 60 and Fraction(str(float(x))) == x else None


def _field(scope: Scope, label: str) -> _Typed | None:
    f = scope.field(label) if "." not in label else None
    if f is None or f.type is None:
        return None
    there = f.value.isNotNull()
    if isinstance(f.type, (T.ByteType, T.ShortType, T.IntegerType)):
        return _Typed(f.value, "int", there)
    if isinstance(f.type, T.LongType):
        return _Typed(f.value, "long", there)
    if isinstance(f.type, T.DoubleType):  # what isn't finite is a text in JSON
        return _Typed(f.value, "double", there & ~F.isnan(f.value) & (F.abs(f.value) < float("inf")))
    if isinstance(f.type, (T.StringType, T.BooleanType)):
        return _Typed(f.value, "text" if isinstance(f.type, T.StringType) else "bool", there)
    return None


def _alike(a: _Typed, b: _Typed) -> bool:
    """Whether Spark compares the two exactly."""
    return a.family == b.family or {a.family, b.family} in ({"int", "long"}, {"int", "double"})


def _typed(e: tuple, scope: Scope, name: str) -> _Typed | None:
    if e[0] == "lit":
        return _literal(e[1])
    if e[0] == "select" and e[1] in (("name", name), ("hole",)) and e[3] == "":
        return _field(scope, e[2])
    if e[0] == "not":
        x = _typed(e[1], scope, name)
        return _Typed(~x.value, "bool", x.fine) if x is not None and x.family == "bool" else None
    if e[0] == "call" and e[1][0] == "name" and e[1][1] in ("startsWith", "strContains") and len(e[2]) == 2:
        a, b = (_typed(x, scope, name) for x in e[2])
        if a is None or b is None or not a.family == b.family == "text":
            return None
        return _Typed(a.value.startswith(b.value) if e[1][1] == "startsWith" else a.value.contains(b.value), "bool", a.fine & b.fine)
    if e[0] != "op":
        return None
    op, a, b = e[1], _typed(e[2], scope, name), _typed(e[3], scope, name)
    if a is None or b is None:
        return None
    if op in ("and", "or"):
        both = a.family == b.family == "bool"
        return _Typed(a.value & b.value if op == "and" else a.value | b.value, "bool", a.fine & b.fine) if both else None
    if op in ("=", "!=") and (_alike(a, b) or "null" in (a.family, b.family)):
        same = a.value.eqNullSafe(b.value)
        return _Typed(same if op == "=" else ~same, "bool", F.lit(True))
    if op in _COMPARE - {"=", "!="} and _alike(a, b) and a.family not in ("bool", "null"):
        x, y = a.value, b.value
        return _Typed({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], "bool", a.fine & b.fine)
    return None


# rows through Arrow


def _labels(e: Any, name: str) -> set[str] | None:
    """The fields of the named row that a program reads; None if it may read any."""
    if isinstance(e, tuple) and len(e) == 4 and e[0] == "select" and e[1] in (("name", name), ("hole",)):
        return {e[2]}
    if e in (("name", name), ("hole",)):
        return None
    out: set[str] = set()
    for x in e if isinstance(e, (tuple, list)) else ():
        found = _labels(x, name)
        if found is None:
            return None
        out |= found
    return out


def _json(df: DataFrame, names: list[str]) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false"}) if names else F.lit("{}")


def _record(text: str) -> Any:
    row = algebra.from_json(json.loads(text, parse_float=Fraction))
    return algebra.V("prod", row.data) if isinstance(row, algebra.V) and row.kind == "map" else row


def _read_by(df: DataFrame, parsed: list, name: str) -> list[str]:
    found = _labels(parsed, name)
    return [c for c in df.columns if found is None or c in found]


def filter_rows(df: DataFrame, scope: Scope, predicate: str, name: str = "input", **bound: Any) -> DataFrame:
    """Rows for which the predicate is true; anything else, errors included, drops the row. bound: JSON values by name."""
    parsed = algebra.parse(predicate)
    if not bound and len(parsed) == 1 and (test := to_column(parsed[0][1], scope, name)) is not None:
        return df.where(test)
    given = {k: algebra.from_json(v) for k, v in bound.items()}

    def go(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                record = _record(text)
                keep.append(algebra.run_parsed(parsed, {**given, name: record, "_": record}) is True)
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], schema=pa.schema([batch.schema.field(i) for i in range(batch.num_columns - 1)])).filter(pa.array(keep, pa.bool_()))

    return df.select("*", _json(df, _read_by(df, parsed, name)).alias("algebra_doc_")).mapInArrow(go, df.schema)


def map_rows(df: DataFrame, program: str, name: str = "input", **bound: Any) -> DataFrame:
    """doc and result, as JSON texts, of a program over each row. bound: JSON values by name."""
    parsed = algebra.parse(program)
    given = {k: algebra.from_json(v) for k, v in bound.items()}

    def go(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                record = _record(text)
                out.append(json.dumps(algebra.to_json(algebra.run_parsed(parsed, {**given, name: record, "_": record}))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc", "result"])

    return df.select(_json(df, df.columns).alias("doc"), _json(df, _read_by(df, parsed, name)).alias("read_")).mapInArrow(go, "doc string, result string")


# programs over several collections

#: Frames that a program gets as sequences of records must be small: they are gathered on the driver up to this many rows.
LOCAL_ROWS = 10_000


def run_over(frames: Mapping[str, DataFrame], program: str, limit: int = LOCAL_ROWS, **bound: Any) -> Any:
    """The JSON value of a program over whole collections by name, which are sequences of records. A collection of more than
    `limit` rows is refused; match_rows and filter_rows are for those."""
    from ..errors import QueryError

    env: dict[str, Any] = {k: algebra.from_json(v) for k, v in bound.items()}
    for name, df in frames.items():
        got = df.select(_json(df, df.columns).alias("doc")).limit(limit + 1).collect()
        if len(got) > limit:
            raise QueryError("rql_budget_exceeded", f"{name}: more than {limit} rows")
        env[name] = algebra.V("seq", tuple(_record(r.doc) for r in got))
    return algebra.to_json(algebra.run_parsed(algebra.parse(program), env))


def _key_column(e: tuple, df: DataFrame) -> _Typed | None:
    """Of a function x => x<field>, the field."""
    if e[0] != "fn" or e[2][0] != "select" or e[2][1] != ("name", e[1]) or e[2][3] != "":
        return None
    return _field(row_scope(df), e[2][2])


def match_rows(left: DataFrame, right: DataFrame, program: str, left_name: str = "l", right_name: str = "r") -> DataFrame:
    """Match(l, r, x => x<a>, y => y<b>) for each row of left as an equijoin: left and right structs of each pair. Null keys
    are equal, as in the algebra; keys of different families match where both are null alone."""
    from ..errors import QueryError

    parsed = algebra.parse(program)
    if len(parsed) != 1 or parsed[0][0] != "do":
        raise QueryError("t_sda_not_a_match", program)
    e = parsed[0][1]
    if e[0] != "call" or e[1] != ("name", "Match") or len(e[2]) != 4 or e[2][0] != ("name", left_name) or e[2][1] != ("name", right_name):
        raise QueryError("t_sda_not_a_match", program)
    a, b = _key_column(e[2][2], left), _key_column(e[2][3], right)
    if a is None or b is None or not _alike(a, b):
        raise QueryError("t_sda_not_a_match", "keys must be fields of one family")
    body = lambda df: F.struct(*[F.col(f"`{c}`") for c in df.columns])
    x = left.select(F.struct(a.value.alias("k")).alias("left_key_"), body(left).alias("left"))
    y = right.select(F.struct(b.value.alias("k")).alias("right_key_"), body(right).alias("right"))
    return x.join(y, F.col("left_key_").eqNullSafe(F.col("right_key_"))).select("left", "right")


def set_operation(op: str, left: DataFrame, right: DataFrame) -> DataFrame:
    """Sets and bags as DataFrames of rows."""
    return {
        "union": lambda: left.union(right).distinct(),
        "inter": lambda: left.intersect(right),
        "diff": lambda: left.subtract(right),
        "bunion": lambda: left.union(right),
        "bdiff": lambda: left.exceptAll(right),
    }[op]()


def bag_difference(a: Any, b: Any) -> Column:
    """Of two arrays: a's items less b's, by multiplicity. For arrays of the size of a document's; whole tables are set_operation's."""
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y.eqNullSafe(x)))
    with_place = F.transform(a, lambda x, i: F.struct(x.alias("x"), count(F.slice(a, 1, i + 1), x).alias("nth")))
    return F.transform(F.filter(with_place, lambda s: s["nth"] > count(b, s["x"])), lambda s: s["x"])
