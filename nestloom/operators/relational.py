"""Grouping, ordering and flat projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import Scope, row_scope
from ..plans.tree import Aggregate, OrderTerm, Path

KEY = "_key"


def grouped(df: DataFrame, scope: Scope, keys: tuple[Path, ...], aggregates: tuple[Aggregate, ...]) -> DataFrame:
    """Absent and null keys form one group. Without keys there is one group, or none if there is no row."""
    by = [_group_key(scope, k).alias(k.last) for k in keys]

    def column(a: Aggregate) -> Column:
        if a.fun == "count":
            return F.count(F.lit(1)).alias(a.output)
        x = scope.field(a.source.name).aggregable()
        return {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}[a.fun](x).alias(a.output)

    if not aggregates:
        return df.select(*by).distinct() if by else df.select().limit(1)
    if by:
        return df.groupBy(*by).agg(*map(column, aggregates))
    return df.agg(F.count(F.lit(1)).alias("rows_"), *map(column, aggregates)).where("rows_ > 0").drop("rows_")


def _group_key(scope: Scope, path: Path) -> Column:
    f = scope.field(path.name)
    if f.family == "variant":  # grouped by the canonical text, as variants can't be compared
        return F.when(f.null | ~f.present, None).otherwise(F.coalesce(f.text(), F.to_json(f.value)))
    return f.value


def group_tie(keys: tuple[Path, ...]) -> list[Column]:
    """Groups have no key of their own; ties are broken by a hash of the group's keys."""
    return [F.sha2(F.to_json(F.struct(*[F.col(f"`{k.last}`") for k in keys])), 256)] if keys else []


def sort_columns(scope: Scope, terms: tuple[OrderTerm, ...]) -> list[tuple[Column, bool]]:
    """Columns and whether they descend. Nulls come before all values and absent ones where the term says; a descending
    term turns all of this round. Typed columns need no rank of their own."""
    out: list[tuple[Column, bool]] = []
    for t in terms:
        f = scope.field(t.path.name)
        if f.family == "absent":
            continue
        first = t.nulls == "first"
        if f.family == "variant":
            tag = f.tag()
            family = F.when(tag == "BOOLEAN", 1).when(f.number().isNotNull(), 2).when(tag == "STRING", 3).otherwise(4)
            out.append((F.when(~f.present, F.lit(-1 if first else 9)).when(f.null, F.lit(0)).otherwise(family), t.desc))
            out += [(f.truth(), t.desc), (f.number(), t.desc), (F.coalesce(f.text(), F.to_json(f.value)), t.desc)]
        else:
            lead = first or scope.nulls_present
            out.append((f.value, t.desc, lead))
    return [(o[0], o[1], o[2] if len(o) > 2 else True) for o in out]


def ordered(df: DataFrame, columns: list) -> DataFrame:
    def one(c: Column, desc: bool, nulls_lead: bool) -> Column:
        if desc:
            return c.desc_nulls_last() if nulls_lead else c.desc_nulls_first()
        return c.asc_nulls_first() if nulls_lead else c.asc_nulls_last()

    return df.orderBy(*[one(*c) for c in columns])


def projected(df: DataFrame, scope: Scope, paths: tuple[Path, ...]) -> DataFrame:
    """Outputs are named by the whole dotted path; paths that no row has are omitted. The key stays for what follows."""
    kept = [(p.name, f) for p in paths for f in [scope.field(p.name)] if f.family != "absent"]
    names = [n for n, _ in kept]
    key = [F.col(KEY)] if KEY in df.columns and KEY not in names else []
    return df.select(*key, *[f.value.alias(n) for n, f in kept])


def rows(df: DataFrame, nulls_present: bool, variant: str | None) -> Scope:
    return row_scope(df, nulls_present, variant)
