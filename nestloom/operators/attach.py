"""Nesting joins, pipelines over arrays, and projections in braces.

Cardinalities are checked by an action before the result is handed out: a check inside the plan could be pruned away or
filtered past by what the caller does next. The action reads the two keys alone; the joined rows are computed once, by the
caller. What later steps of a plan keep of attached documents is applied before these are gathered.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..functions.fields import Scope, element_scope
from ..plans.tree import Compare, Enrich, Filter, If, Item, Path, ProjectBlock, Within
from .predicate import Predicates, bind
from .relational import KEY, rows

#: Columns that stand beside a document's fields for a while.
LEFT, MATCH, GOT, DOC_KEY, ROW, POS, ELEMENT, ALL, NEW = (f"nestloom_{x}_" for x in ("left", "match", "got", "key", "row", "pos", "el", "all", "new"))
WITHIN_TYPE, CARDINALITY, PROJECT_TYPE = "rql_within_type", "rql_enrich_cardinality", "rql_project_type"


class Attacher:
    def __init__(self, lookup, params: dict[str, Any], nulls_present: bool = False) -> None:
        self.lookup, self.params, self.nulls = lookup, params, nulls_present
        self.arrays: set[str] = set()  # fields that hold an array in every row, as they were attached as one

    def run(self, df: DataFrame, steps: tuple, variant: str | None = None) -> DataFrame:
        steps = list(steps)
        while steps:
            step = steps.pop(0)
            scope = rows(df, self.nulls, variant)
            if isinstance(step, Enrich):
                self.arrays.discard(step.field)
                test = steps[0].where if steps and isinstance(steps[0], Filter) else None
                if step.expect == "many" and (kind := _emptiness(test, step.field)) and not _used(steps[1:], step.field):
                    df = self._semi(df, scope, step, kind)
                    steps.pop(0)
                else:
                    inner = steps.pop(0).steps if step.expect == "many" and steps and _pushable(steps[0], step.field) else ()
                    needed = None if inner else _needed(steps, step.field)
                    if step.expect == "many" and needed == set():  # nothing reads it, and any number will do
                        continue
                    df = self._enrich(df, scope, step, inner, needed)
                    if step.expect == "many":
                        self.arrays.add(step.field)
            elif isinstance(step, Filter):
                df = df.where(Predicates(scope, self.params).column(step.where))
            elif isinstance(step, Within):
                df = self._within(df, scope, step)
            elif isinstance(step, ProjectBlock):
                names = {i.output for i in step.items}
                key = [F.col(KEY)] if KEY in df.columns and KEY not in names else []
                df = df.select(*key, *[c.alias(n) for n, c in self.items(scope, step.items)])
                self.arrays.clear()
        return df

    # joins

    def _foreign(self, step: Enrich) -> tuple[DataFrame, Column, bool]:
        """The candidates, their key, and whether null keys match null keys."""
        df, nulls, variant = self.lookup(step.source)
        scope = rows(df, nulls, variant)
        if step.where is not None:
            df = df.where(Predicates(scope, self.params).column(step.where))
        return df, scope.field(step.right.name).canonical(), self.nulls and nulls

    def _gathered(self, df: DataFrame, key: Column, inner: tuple, needed: set[str] | None) -> DataFrame:
        """For each foreign key the array of what is attached, in order of the documents' keys."""
        body = [c for c in df.columns if c != KEY and (needed is None or c in needed)]
        df = df.select(key.alias(MATCH), F.col(KEY).alias(DOC_KEY), *[F.col(f"`{c}`") for c in body])
        for step in inner:
            scope = rows(df.drop(MATCH, DOC_KEY), self.nulls, None)
            if isinstance(step, Filter):
                df = df.where(Predicates(scope, self.params).column(step.where))
            else:
                df = df.select(MATCH, DOC_KEY, *[c.alias(n) for n, c in self.items(scope, step.items)])
        doc = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in (MATCH, DOC_KEY)])
        hits = F.sort_array(F.collect_list(F.struct(F.col(DOC_KEY).alias("key"), doc.alias("doc"))))
        return df.groupBy(MATCH).agg(F.transform(hits, lambda h: h["doc"]).alias(GOT))

    def _enrich(self, df: DataFrame, scope: Scope, step: Enrich, inner: tuple, needed: set[str] | None) -> DataFrame:
        key = scope.field(step.left.name)
        if key.family == "absent":
            raise QueryError("rql_enrich_path", step.left.name)
        foreign, match, nulls_match = self._foreign(step)
        left = df.withColumn(LEFT, _key(key.canonical(), nulls_match))
        match = _key(match, nulls_match)
        if step.expect == "many":
            right = self._gathered(foreign.where(match.isNotNull()), match, inner, needed)
            joined = left.join(right, F.col(LEFT) == F.col(MATCH), "left")
            return joined.withColumn(step.field, F.coalesce(GOT, F.array().cast(right.schema[GOT].dataType))).drop(LEFT, MATCH, GOT)
        self._check(left.select(LEFT), foreign.select(match.alias(MATCH)), step)
        doc = F.struct(*[F.col(f"`{c}`") for c in foreign.columns if c != KEY])
        right = foreign.select(match.alias(MATCH), doc.alias(GOT))
        return left.join(right, F.col(LEFT) == F.col(MATCH), "left").withColumn(step.field, F.col(GOT)).drop(LEFT, MATCH, GOT)

    def _check(self, left: DataFrame, right: DataFrame, step: Enrich) -> None:
        """Every key asked for has at most one candidate, and exactly one where that is expected."""
        repeated = right.where(F.col(MATCH).isNotNull()).groupBy(MATCH).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        bad = [left.join(repeated, F.col(LEFT) == F.col(MATCH)).select(LEFT, "n")]
        if step.expect == "exactly_one":
            bad.append(left.join(right, F.col(LEFT) == F.col(MATCH), "left_anti").select(LEFT, F.lit(0).alias("n")))
        for rows_ in bad:
            if found := rows_.limit(1).collect():
                raise QueryError(CARDINALITY, f"{step.field}: {found[0].n} matches for {found[0][LEFT]!r}")

    def _semi(self, df: DataFrame, scope: Scope, step: Enrich, kind: str) -> DataFrame:
        """Attaching many and asking only whether there are any is a semi or anti join."""
        right, match, nulls_match = self._foreign(step)
        left = df.withColumn(LEFT, _key(scope.field(step.left.name).canonical(), nulls_match))
        return left.join(right.select(_key(match, nulls_match).alias(MATCH)), F.col(LEFT) == F.col(MATCH), kind).drop(LEFT)

    # arrays

    def _array(self, scope: Scope, path: Path) -> tuple[Column, T.StructType | T.DataType]:
        f = scope.field(path.name)
        if not isinstance(f.type, T.ArrayType):
            raise QueryError(WITHIN_TYPE, f"{path.name} isn't an array")
        return f.value, f.type.elementType

    def _within(self, df: DataFrame, scope: Scope, step: Within) -> DataFrame:
        value, kind = self._array(scope, step.path)
        if step.path.name not in self.arrays and not df.where(value.isNull()).limit(1).isEmpty():
            raise QueryError(WITHIN_TYPE, f"{step.path.name} is absent or null in a row")
        if "." in step.path.name:
            raise QueryError(WITHIN_TYPE, "only arrays at the top of a row or an element")
        if _joins(step.steps):
            return self._within_joined(df, step)
        return df.withColumn(step.path.name, self._pipeline(value, kind, step.steps)[0])

    def _pipeline(self, value: Column, kind: T.DataType, steps: tuple) -> tuple[Column, T.DataType]:
        for step in steps:
            if not isinstance(kind, T.StructType):
                raise QueryError(WITHIN_TYPE, "elements aren't objects")
            if isinstance(step, Filter):
                value = F.filter(value, self._keeps(kind, step))
            elif isinstance(step, ProjectBlock):
                value = F.transform(value, self._reshapes(kind, step))
                kind = self._block_type(kind, step.items)
            elif isinstance(step, Within):
                inner = next((f.dataType for f in kind.fields if f.name == step.path.name), None)
                if not isinstance(inner, T.ArrayType):
                    raise QueryError(WITHIN_TYPE, f"{step.path.name} isn't an array")
                value = F.transform(value, self._descends(inner, step))
        return value, kind

    def _keeps(self, kind: T.StructType, step: Filter):
        return lambda e: F.coalesce(Predicates(element_scope(e, kind, self.nulls), self.params).column(step.where), F.lit(False))

    def _reshapes(self, kind: T.StructType, step: ProjectBlock):
        return lambda e: F.struct(*[c.alias(n) for n, c in self.items(element_scope(e, kind, self.nulls), step.items)])

    def _descends(self, inner: T.ArrayType, step: Within):
        return lambda e: e.withField(step.path.name, self._pipeline(e.getField(step.path.name), inner.elementType, step.steps)[0])

    def _block_type(self, kind: T.StructType, items: tuple) -> T.StructType:
        from pyspark.sql import SparkSession

        probe = SparkSession.getActiveSession().createDataFrame([], T.StructType([T.StructField("e", kind)]))
        return probe.select(F.struct(*[c.alias(n) for n, c in self.items(element_scope(F.col("e"), kind, self.nulls), items)]).alias("e")).schema["e"].dataType

    def _within_joined(self, df: DataFrame, step: Within) -> DataFrame:
        """Elements become rows, go through the same steps, and are gathered again in their order."""
        name = step.path.name
        kind = df.schema[name].dataType.elementType
        if not isinstance(kind, T.StructType):
            raise QueryError(WITHIN_TYPE, "elements aren't objects")
        df = df.withColumn(ROW, F.monotonically_increasing_id() if KEY not in df.columns else F.col(KEY))
        parts = df.select(ROW, F.posexplode(name).alias(POS, ELEMENT)).select(ROW, POS, *[F.col(ELEMENT).getField(c).alias(c) for c in kind.names if c != KEY])
        parts = Attacher(self.lookup, self.params, self.nulls).run_inner(parts, step.steps)
        body = [c for c in parts.columns if c not in (ROW, POS)]
        gathered = parts.groupBy(ROW).agg(F.sort_array(F.collect_list(F.struct(POS, F.struct(*[F.col(f"`{c}`") for c in body]).alias(ELEMENT)))).alias(ALL))
        gathered = gathered.select(ROW, F.transform(ALL, lambda x: x[ELEMENT]).alias(NEW))
        new = F.coalesce(NEW, F.array().cast(gathered.schema[NEW].dataType))
        return df.join(gathered, ROW, "left").withColumn(name, new).drop(ROW, NEW)

    def run_inner(self, df: DataFrame, steps: tuple) -> DataFrame:
        keep = [ROW, POS]
        for step in steps:
            if isinstance(step, ProjectBlock):
                df = df.select(*keep, *[c.alias(n) for n, c in self.items(rows(df, self.nulls, None), step.items)])
            elif isinstance(step, Within) and _joins(step.steps):
                df = self._within_joined(df.withColumn(KEY, F.struct(*keep)), step).drop(KEY)
            else:
                df = self.run(df, (step,))
        return df

    # projections

    def items(self, scope: Scope, items: tuple[Item, ...]) -> list[tuple[str, Column]]:
        out = []
        for i in items:
            if not isinstance(i.value, Path):
                out.append((i.output, self.value(scope, i.value)))
                continue
            f = scope.field(i.value.name)
            if f.family == "absent":
                continue
            out.append((i.output, f.value if i.block is None else self._nested(f.value, f.type, i)))
        return out

    def _nested(self, value: Column, kind: T.DataType, item: Item) -> Column:
        def one(e: Column, k: T.DataType) -> Column:
            if not isinstance(k, T.StructType):
                raise QueryError(PROJECT_TYPE, f"{item.value.name} holds no objects")
            block = F.struct(*[c.alias(n) for n, c in self.items(element_scope(e, k, self.nulls), item.block)])
            return F.when(e.isNotNull(), block)

        return F.transform(value, lambda e: one(e, kind.elementType)) if isinstance(kind, T.ArrayType) else one(value, kind)

    def value(self, scope: Scope, value: Any) -> Column:
        if isinstance(value, If):
            test = F.coalesce(Predicates(scope, self.params).column(value.test), F.lit(False))
            return F.when(test, self.value(scope, value.then)).otherwise(self.value(scope, value.other))
        if isinstance(value, Path):
            return scope.field(value.name).value
        return F.lit(bind(value, self.params))


def _joins(steps: tuple) -> bool:
    return any(isinstance(s, Enrich) or isinstance(s, Within) and _joins(s.steps) for s in steps)


def _emptiness(test: Any, field: str) -> str | None:
    if isinstance(test, Compare) and test.left.name == field and test.right == () and test.op in ("=", "!="):
        return "left_anti" if test.op == "=" else "left_semi"
    return None


def _used(steps: list, field: str) -> bool:
    """Whether the attached field can be seen later: then it must be there. A projection that leaves it out hides it."""
    for s in steps:
        if isinstance(s, ProjectBlock):
            return any(isinstance(i.value, Path) and i.value.name.split(".")[0] == field or not isinstance(i.value, Path) for i in s.items)
        if field in repr(s):
            return True
    return True


def _key(key: Column, nulls_match: bool) -> Column:
    """A join key; inside a struct null equals null."""
    return F.struct(key.alias("k")) if nulls_match else key


def _pushable(step: Any, field: str) -> bool:
    """Whether a within over an attached array can be applied before the array is gathered."""
    return isinstance(step, Within) and step.path.name == field and all(isinstance(x, (Filter, ProjectBlock)) for x in step.steps)


def _needed(steps: list, field: str) -> set[str] | None:
    """The fields of the documents attached at `field` that later steps read, if a projection ends their use; None: all."""
    out: set[str] = set()

    def read(name: str) -> bool:
        first, _, rest = name.partition(".")
        if first == field:
            out.add(rest.split(".")[0])
        return first != field or bool(rest)

    def block(items: tuple) -> bool:
        for i in items:
            if isinstance(i.value, Path) and i.value.name == field and i.block is not None:
                if not all(isinstance(x.value, Path) for x in i.block):
                    return False
                out.update(x.value.name.split(".")[0] for x in i.block)
            elif isinstance(i.value, Path):
                if not read(i.value.name):
                    return False
            elif field in repr(i.value):
                return False
        return True

    for step in steps:
        if isinstance(step, ProjectBlock):
            return out if block(step.items) else None
        if field in repr(step):
            return None
    return None
