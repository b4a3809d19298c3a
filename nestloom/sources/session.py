"""Collections bound to DataFrames, and the ways to query, scan and change them."""

from __future__ import annotations

import hashlib
import json
import os
import re
import threading
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import count, islice
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..functions import algebra_frames
from ..operators.attach import Attacher
from ..operators.page import TTL_SECONDS, Page, opened, past, sign
from ..operators.predicate import Predicates
from ..operators.relational import KEY, group_tie, grouped, ordered, projected, rows, sort_columns
from ..plans.build import Where
from ..plans.text import DEFAULT_PAGE, parse, parse_predicate
from ..plans.tree import Enrich, Filter, Item, OrderTerm, Param, Path, Plan, ProjectBlock, Within
from .folders import new_folder


@dataclass(frozen=True)
class Binding:
    df: DataFrame
    nulls_present: bool = False
    variant: str | None = None
    holes: DataFrame | None = None
    keys: tuple[str, ...] = ()  # the columns whose text is the key; none after a change
    generation: int = 0
    budget: tuple = ()

    def keyed(self, key: str) -> Column | None:
        """Where the document of a key is, over the key's own columns, which reach the scan; None if they can't tell."""
        parts = key.split("/") if len(self.keys) > 1 else [key]
        if not self.keys or len(parts) != len(self.keys):
            return None
        out = F.lit(True)
        for name, part in zip(self.keys, parts, strict=True):
            kind, column = self.df.schema[name].dataType, F.col(f"`{name}`")
            if isinstance(kind, T.StringType) and len(self.keys) == 1:
                out = column == part
            elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
                fits = re.fullmatch(r"0|-?[1-9]\d{0,18}", part) and -(1 << 63) <= int(part) < 1 << 63
                one = column == F.lit(int(part)) if fits else F.lit(False)
                out = one if len(self.keys) == 1 else out & one
            else:
                return None
        return out


@dataclass(frozen=True)
class Result:
    """Rows with what is known about how whole they are."""

    rows: DataFrame
    coverage: str
    holes: DataFrame | None
    stopped: tuple[str, ...]  # budgets that ended the query early


@dataclass(frozen=True)
class Paging:
    """A query from some place on: its rows in order, beside their sort columns, and what its tokens belong to."""

    plan: Plan
    params: dict[str, Any]
    rows: DataFrame
    sorts: int
    bound: dict[str, Any]
    spool: tuple
    left: int | None  # of the query's limit
    stopped: tuple[str, ...]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([f for f in self.rows.schema if not f.name.startswith("sort_")])

    @property
    def take(self) -> int:
        size = self.plan.page_size or DEFAULT_PAGE
        return size if self.left is None else min(size, self.left)


@dataclass(frozen=True)
class Receipt:
    """What a change did: the keys that it touched and the generation that it made."""

    operation: str
    generation: int
    keys: DataFrame


class Session:
    """A heap of named collections. Every query runs in exactly one."""

    def __init__(self, spark: SparkSession, heap: str = "default", secret: bytes | None = None) -> None:
        self.spark, self.heap, self.secret = spark, heap, secret or os.urandom(32)
        self.bindings: dict[str, Binding] = {}
        self._groups: dict[tuple, DataFrame] = {}  # grouped rows that later pages read

    def bind(self, name: str, df: DataFrame, key: str | list[str], null_means: str = "absent", variant: str | None = None, holes: DataFrame | None = None, budget: dict[str, int] | None = None) -> Collection:
        """key: the column or columns whose text is the documents' key. A body field of that name is overwritten. budget:
        documents, bytes or result_bytes that no query over the collection may exceed."""
        cols = [key] if isinstance(key, str) else list(key)
        parts = [F.col(f"`{c}`").cast("string") for c in cols]
        value = parts[0] if len(parts) == 1 else F.concat_ws("/", *parts)
        if cols != [KEY] or not isinstance(df.schema[KEY].dataType, T.StringType):
            df = df.withColumn(KEY, value)
        df = df.select(KEY, *[f"`{c}`" for c in df.columns if c != KEY])
        keys = tuple(cols) if KEY not in cols else ()
        before = self.bindings.get(name)
        self.bindings[name] = Binding(df, null_means == "null", variant, holes, keys, before.generation + 1 if before else 0, tuple(sorted((budget or {}).items())))
        return Collection(self, name)

    def bind_json(self, name: str, documents: DataFrame, key: str = KEY, text: str = "value") -> Collection:
        """documents: key and JSON text. What isn't JSON becomes a hole and is no document."""
        doc = F.try_parse_json(F.col(text))
        split = documents.select(F.col(key).cast("string").alias(KEY), doc.alias("doc"), F.col(text).alias("raw"))
        holes = split.where("doc is null").select(KEY, F.lit("unreadable").alias("status"), F.length("raw").alias("bytes"))
        return self.bind(name, split.where("doc is not null").select(KEY, "doc"), KEY, variant="doc", holes=holes)

    def lookup(self, name: str) -> tuple[DataFrame, bool, str | None]:
        b = self.binding(name)
        return b.df, b.nulls_present, b.variant

    def binding(self, name: str) -> Binding:
        if name not in self.bindings:
            raise QueryError("rql_unknown_collection", name)
        return self.bindings[name]

    def collection(self, name: str) -> Collection:
        self.binding(name)
        return Collection(self, name)

    def list_collections(self) -> list[str]:
        return sorted(self.bindings)

    # queries

    def compile(self, query: str | Plan) -> Plan:
        plan = parse(query) if isinstance(query, str) else query
        self.binding(plan.source)
        return plan

    def explain(self, query: str | Plan) -> dict:
        plan = self.compile(query)
        return {"plan": json.loads(plan.canonical()), "hash": plan.hash()}

    def _core(self, plan: Plan, params: dict[str, Any], df: DataFrame) -> tuple[DataFrame, list]:
        """The rows before paging, and their sort columns."""
        b = self.binding(plan.source)
        scope = rows(b.df, b.nulls_present, b.variant)
        df = df.where(Predicates(scope, params).column(plan.where))
        if plan.group is not None:
            df = grouped(df, scope, plan.group, plan.aggregates)
            columns = sort_columns(rows(df, b.nulls_present, None), tuple(OrderTerm(Path(t.path.last), t.desc, t.nulls) for t in plan.order))
            return df, columns + [(c, False, True) for c in group_tie(plan.group)]
        return df, sort_columns(scope, tuple(t for t in plan.order if t.path.name != KEY)) + [(F.col(KEY), next((t.desc for t in plan.order if t.path.name == KEY), False), True)]

    def _finish(self, plan: Plan, df: DataFrame, params: dict[str, Any]) -> DataFrame:
        b = self.binding(plan.source)
        if plan.project and plan.group is None:
            df = projected(df, rows(df, b.nulls_present, b.variant), plan.project)
        return Attacher(self.lookup, params, b.nulls_present).run(df, plan.steps, None if plan.group is not None else b.variant)

    def _budget(self, plan: Plan) -> dict[str, int]:
        """The stricter of the collection's and the query's."""
        out: dict[str, int] = {}
        for name, most in (*self.binding(plan.source).budget, *plan.budget):
            out[name] = min(most, out.get(name, most))
        return out

    def _governed(self, plan: Plan) -> tuple[DataFrame, tuple[str, ...]]:
        """The documents that a query may read, and the budgets that left some out. Under complete coverage a hole or a budget
        that doesn't suffice is an error. No more documents are read for that than the budget admits."""
        b, budget, stopped = self.binding(plan.source), self._budget(plan), []
        whole, df = plan.coverage == "complete", b.df
        if b.holes is not None and whole and not b.holes.limit(1).isEmpty():
            raise QueryError("rql_coverage_incomplete", plan.source)
        if (most := budget.get("documents")) is not None and df.select(KEY).limit(most + 1).count() > most:
            if whole:
                raise QueryError("rql_budget_exceeded", f"documents > {most}")
            df, stopped = df.orderBy(KEY).limit(most), ["documents"]
        if (most := budget.get("bytes")) is not None and _larger(df, most):
            if whole:
                raise QueryError("rql_budget_exceeded", f"bytes > {most}")
            df, stopped = _first_bytes(df, [(F.col(KEY), False, True)], most), [*stopped, "bytes"]
        return df, tuple(stopped)

    def run_all(self, query: str | Plan, **params: Any) -> DataFrame:
        """The whole result, without a certain order unless the query asks for one or a limit; pages of run() put together
        give the same rows in order. A query that starts with explain gives its plan and hash instead."""
        return self.run_whole(query, **params).rows

    def run_whole(self, query: str | Plan, **params: Any) -> Result:
        """The whole result, with its holes and the budgets that ended it early, which incomplete coverage allows."""
        plan = self.compile(query)
        b = self.binding(plan.source)
        if plan.explain:
            return Result(self.spark.createDataFrame([(plan.canonical(), plan.hash())], "plan string, hash string"), plan.coverage, b.holes, ())
        df, stopped = self._governed(plan)
        df, columns = self._core(plan, params, df)
        if plan.order or plan.limit is not None:
            df = ordered(df, columns)
        if plan.limit is not None:
            df = df.limit(plan.limit)
        out = self._finish(plan, df, params)
        if (most := self._budget(plan).get("result_bytes")) is not None and _larger(out, most):
            if plan.coverage == "complete":
                raise QueryError("rql_budget_exceeded", f"result_bytes > {most}")
            order = columns if plan.group is not None or not plan.steps and not plan.project else [(F.col(KEY), False, True)] if KEY in out.columns else []
            out, stopped = _first_bytes(out, order, most), (*stopped, "result_bytes")
        return Result(out, plan.coverage, b.holes, stopped)

    def collect(self, query: str | Plan, deadline: float | None = None, cancel: threading.Event | None = None, **params: Any) -> list[Row]:
        """The whole result on the driver. Its jobs, and those that check it, are interrupted after `deadline` seconds or
        once `cancel` is set; then no rows come back, but an error."""
        tag, done, why = f"nestloom-{uuid.uuid4().hex}", threading.Event(), []
        until = None if deadline is None else time.monotonic() + deadline

        def watch() -> None:
            while not done.wait(0.05):
                if cancel is not None and cancel.is_set():
                    why.append("cancelled")
                elif until is not None and time.monotonic() >= until:
                    why.append(f"longer than {deadline} s")
                if why:
                    self.spark.sparkContext.cancelJobsWithTag(tag)

        watcher = threading.Thread(target=watch, daemon=True)
        self.spark.sparkContext.addJobTag(tag)
        watcher.start()
        try:
            return self.run_all(query, **params).collect()
        except Exception as e:
            if why:
                raise QueryError("resource_limit", why[0]) from e
            raise
        finally:
            done.set()
            watcher.join()
            self.spark.sparkContext.removeJobTag(tag)

    def run(self, query: str | Plan, after: str | None = None, **params: Any) -> Page:
        """One page, in order, with a token for the next. Its diagnostics name the budgets that ended the query early."""
        at = self._paging(self.compile(query), after, params)
        return self._page(at, *self._cut(at, at.rows.limit(at.take + 1).collect()))

    def _bound(self, plan: Plan, params: dict[str, Any]) -> dict[str, Any]:
        """What the tokens of a query's pages belong to."""
        return {"heap": self.heap, "source": plan.source, "generation": self.binding(plan.source).generation, "plan": plan.hash(), "params": hashlib.sha256(json.dumps({k: v for k, v in params.items() if not (isinstance(plan.after, Param) and k == plan.after.name)}, sort_keys=True, default=str).encode()).hexdigest()}

    def _paging(self, plan: Plan, after: str | None, params: dict[str, Any]) -> Paging:
        governed, stopped = self._governed(plan)
        df, columns = self._core(plan, params, governed)
        token = after or (params.get(plan.after.name) if isinstance(plan.after, Param) else plan.after)
        bound = self._bound(plan, params)
        spool = (plan.source, bound["generation"], bound["plan"], bound["params"])
        if plan.group is not None:  # groups are computed once for all pages of a query
            df = self._groups[spool] = self._groups.pop(spool, None) or df.persist()
            while len(self._groups) > SPOOLS:
                self._groups.pop(next(iter(self._groups))).unpersist()
        left = plan.limit
        if token:
            body = opened(self.secret, token, bound)
            left = body["left"]
            df = df.where(past(columns, [_back(v, c) for v, c in zip(body["last"], body["kinds"], strict=True)]))
        df = ordered(df.withColumns({f"sort_{i}_": c for i, (c, _, _) in enumerate(columns)}), [(F.col(f"sort_{i}_"), d, n) for i, (_, d, n) in enumerate(columns)])
        return Paging(plan, params, df, len(columns), bound, spool, left, stopped)

    def _cut(self, at: Paging, got: list[Row]) -> tuple[list[Row], str | None, int | None]:
        """The documents of the page that got begins with, the token to go on and what is left of the limit. got has one row
        more than the page if another follows."""
        take = at.take
        left = None if at.left is None else at.left - min(take, len(got))
        token = None
        if len(got) > take and left != 0:
            last = [got[take - 1][f"sort_{i}_"] for i in range(at.sorts)]
            token = sign(self.secret, at.bound | {"last": last, "kinds": [type(v).__name__ for v in last], "left": left, "until": time.time() + TTL_SECONDS})
        elif at.spool in self._groups:
            self._groups.pop(at.spool).unpersist()
        names = at.schema.names
        return [Row(*[r[n] for n in names]) for r in got[:take]], token, left

    def _page(self, at: Paging, documents: list[Row], token: str | None, left: int | None) -> Page:
        plan = at.plan
        out = self._finish(plan, self.spark.createDataFrame(documents, at.schema), at.params)
        if documents and plan.group is None and KEY in out.columns:
            place = at.schema.names.index(KEY)
            out = out.orderBy(F.array_position(F.lit([r[place] for r in documents]), F.col(KEY)))
        return Page(out, token, token is None, plan.coverage, plan.consistency, left, self.binding(plan.source).holes, at.stopped)

    def read_view(self, *names: str) -> ReadView:
        """Collections as they are now; a later use tells whether they have changed since."""
        return ReadView(self, {n: (self.binding(n), _files(self.binding(n).df)) for n in names or self.list_collections()})

    # the algebra over whole collections

    def algebra(self, program: str, *names: str, **bound: Any) -> Any:
        """The JSON value of a program over small collections by name, and over JSON values."""
        return algebra_frames.run_over({n: self.binding(n).df for n in names}, program, **bound)

    def match(self, left: str, right: str, program: str) -> DataFrame:
        """Match(l, r, x => x<a>, y => y<b>) over two collections, as an equijoin of structs left and right."""
        return algebra_frames.match_rows(self.binding(left).df, self.binding(right).df, program)

    def _cuts(self, plan: Plan, params: dict[str, Any]) -> Iterator[tuple[Paging, list[Row], str | None, int | None]]:
        """The pages of a query as _cut gives them. What follows the first one is sorted once for all of them, and comes to
        the driver a partition at a time. As with run(), a change of the collection or a late call ends the query."""
        at = self._paging(plan, None, params)
        documents, token, left = self._cut(at, at.rows.limit(at.take + 1).collect())
        yield at, documents, token, left
        if not token:
            return
        at, got = self._paging(plan, token, params), []
        rest = at.rows.toLocalIterator()
        while token:
            opened(self.secret, token, self._bound(plan, params))
            got += islice(rest, at.take + 1 - len(got))
            documents, token, left = self._cut(at, got)
            yield at, documents, token, left
            at, got = replace(at, left=left), got[at.take :]

    def pages(self, query: str | Plan, **params: Any) -> Iterator[Page]:
        for cut in self._cuts(self.compile(query), params):
            yield self._page(*cut)

    def pages_together(self, query: str | Plan, **params: Any) -> DataFrame:
        """The rows of all pages, in their order. Pages of TOGETHER documents or more are finished at once and added to a
        table in the shared folder, so that neither a plan nor what the driver holds grows with the number of pages."""
        plan, path, some, no = self.compile(query), new_folder(self.spark, "pages"), [], count()
        for at, documents, token, _ in self._cuts(plan, params):
            some += documents
            if token and len(some) < TOGETHER:
                continue
            df = self._finish(plan, self.spark.createDataFrame(some, at.schema), params)
            names = df.columns
            if plan.group is None and plan.steps and KEY in names:  # joins lose the order
                place = at.schema.names.index(KEY)
                places = self.spark.createDataFrame(list({r[place]: i for i, r in enumerate(some)}.items()), f"{KEY} string, {_ROW} bigint")
                df = df.join(places, KEY, "left")
            else:
                df = df.withColumn(_ROW, F.monotonically_increasing_id())
            df = df.select(F.lit(next(no)).cast("bigint").alias(_PART), _ROW, *[f"`{n}`" for n in names])
            df.write.mode("append").parquet(path)
            some = []
        return self.spark.read.schema(df.schema).parquet(path).orderBy(_PART, _ROW).drop(_PART, _ROW)


#: Grouped results that are kept for later pages.
SPOOLS = 8
#: Documents that are written at once where pages are put together.
TOGETHER = 4096
_SIZE, _SUM, _PART, _ROW = "nestloom_size_", "nestloom_sum_", "nestloom_part_", "nestloom_row_"


def _bytes_of(df: DataFrame) -> Column:
    return F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))


def _larger(df: DataFrame, most: int) -> bool:
    """Whether rows take more bytes as JSON. A row takes two at least, so no more rows than that are looked at."""
    n, size = df.limit(most // 2 + 1).agg(F.count(F.lit(1)), F.sum(_bytes_of(df))).first()
    return n > most // 2 or (size or 0) > most


def _first_bytes(df: DataFrame, order: list, most: int) -> DataFrame:
    """The first rows in an order that take at most so many bytes; the budget bounds what the one window holds."""
    first = ordered(df, order) if order else df
    first = first.limit(most // 2 + 1).withColumn(_SIZE, _bytes_of(df)).withColumn(_ROW, F.monotonically_increasing_id())
    total = F.sum(_SIZE).over(Window.orderBy(_ROW).rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn(_SUM, total).where(F.col(_SUM) <= most).drop(_SIZE, _SUM, _ROW)


def _files(df: DataFrame) -> str:
    """A fingerprint of the files that a frame reads: their names, lengths and times."""
    spark, seen = df.sparkSession, []
    for name in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        seen.append([name, *((f.getLen(), f.getModificationTime()) if system.exists(path) and (f := system.getFileStatus(path)) else (-1, -1))])
    return hashlib.sha256(json.dumps(seen).encode()).hexdigest()


class ReadView:
    """Collections pinned at a time. It isn't an isolated copy: queries check that nothing has changed, and refuse to run
    where something has."""

    def __init__(self, session: Session, pinned: dict[str, tuple[Binding, str]]) -> None:
        self.session, self.pinned = session, pinned

    def drifted(self) -> list[str]:
        """The collections that were changed, or whose files were."""
        return [n for n, (b, files) in self.pinned.items() if self.session.bindings.get(n) is not b or _files(b.df) != files]

    def _check(self) -> None:
        if found := self.drifted():
            raise QueryError("read_view_drift", ", ".join(found))

    def run_all(self, query: str | Plan, **params: Any) -> DataFrame:
        self._check()
        return self.session.run_all(query, **params)

    def collect(self, query: str | Plan, **params: Any) -> list[Row]:
        """The result on the driver, checked again once it is there."""
        got = self.run_all(query, **params).collect()
        self._check()
        return got


def _back(value: Any, kind: str) -> Any:
    import datetime

    if value is None:
        return None
    if kind == "datetime":
        return datetime.datetime.fromisoformat(value)
    if kind == "date":
        return datetime.date.fromisoformat(value)
    return value


#: Keys that a lookup compares with in the scan; more are joined.
IN_LIST = 500


class Collection:
    """Key lookups, scans, filters and changes of one collection."""

    def __init__(self, session: Session, name: str) -> None:
        self.session, self.name = session, name

    @property
    def df(self) -> DataFrame:
        return self.session.binding(self.name).df

    def find(self, key: str) -> DataFrame:
        """The document of a key, if it is there. Where the key's own columns tell, the comparison reaches the scan."""
        typed = self.session.binding(self.name).keyed(key)
        return self.df.where(F.col(KEY) == key if typed is None else typed)

    def get(self, key: str) -> Row | None:
        found = self.find(key).limit(1).collect()
        return found[0] if found else None

    def get_many(self, keys: list[str]) -> DataFrame:
        """One row for each key asked for; `found_` tells whether it is there. The collection is filtered where it is read
        and only what was asked for is joined."""
        b, keys = self.session.binding(self.name), list(dict.fromkeys(keys))
        asked = self.session.spark.createDataFrame([(k,) for k in keys], "_key string")
        typed = [b.keyed(k) for k in keys] if len(keys) <= IN_LIST else [None]
        if len(b.keys) == 1 and keys and not any(t is None for t in typed):
            number = not isinstance(b.df.schema[b.keys[0]].dataType, T.StringType)
            values = [int(k) for k in keys if re.fullmatch(r"0|-?[1-9]\d{0,18}", k)] if number else keys
            found = self.df.where(F.col(f"`{b.keys[0]}`").isin(values))
        else:
            found = self.df.join(F.broadcast(asked), KEY, "left_semi")
        return asked.join(found.withColumn("found_", F.lit(True)), KEY, "left").withColumn("found_", F.coalesce("found_", F.lit(False)))

    def scan(self) -> DataFrame:
        return self.df.orderBy(KEY)

    def scan_keys(self) -> DataFrame:
        b = self.session.binding(self.name)
        if b.holes is not None and not b.holes.limit(1).isEmpty():
            raise QueryError("rql_coverage_incomplete", self.name)
        return self.df.select(KEY)

    def scan_fields(self, *paths: str) -> DataFrame:
        b = self.session.binding(self.name)
        return projected(self.df, rows(self.df, b.nulls_present, b.variant), tuple(map(Path, paths)))

    def _token(self, kind: str, last: str) -> str:
        b = self.session.binding(self.name)
        return sign(self.session.secret, {"heap": self.session.heap, "source": self.name, "generation": b.generation, "kind": kind, "last": last, "until": time.time() + TTL_SECONDS})

    def _after(self, kind: str, token: str | None) -> str | None:
        """The key to go on from. A token belongs to one collection of one heap as it was when the token was made."""
        if token is None:
            return None
        b = self.session.binding(self.name)
        return opened(self.session.secret, token, {"heap": self.session.heap, "source": self.name, "generation": b.generation, "kind": kind})["last"]

    def scan_page(self, n: int, token: str | None = None, after_key: str | None = None) -> tuple[DataFrame, str | None]:
        """n rows in key order past a token's place or a key, and a token to go on."""
        after = self._after("scan", token) or after_key
        df = self.df if after is None else self.df.where(F.col(KEY) > after)
        got = df.orderBy(KEY).limit(n + 1).collect()
        page = self.session.spark.createDataFrame(got[:n], df.schema)
        return page, self._token("scan", got[n - 1][KEY]) if len(got) > n else None

    def scan_keys_page(self, n: int, token: str | None = None) -> tuple[DataFrame, str | None, DataFrame]:
        """n keys in order, a token to go on, and the gaps: the holes between the page's place and its end."""
        page, more, at = self._covered(n, self._after("keys", token))
        keys = page.where("status = 'present'").select(KEY)
        return keys, self._token("keys", at) if more else None, page.where("status = 'hole'").select(KEY)

    def scan_covered_page(self, n: int, token: str | None = None) -> tuple[DataFrame, str | None]:
        """n documents in key order, holes among them: status present or hole, and the document as a struct."""
        page, more, at = self._covered(n, self._after("covered", token))
        return page, self._token("covered", at) if more else None

    def _units(self) -> DataFrame:
        """status, key and document of all documents and holes. A key that has both counts as present."""
        b = self.session.binding(self.name)
        doc = F.struct(*[F.col(f"`{c}`") for c in b.df.columns if c != KEY])
        units = b.df.select(KEY, F.lit("present").alias("status"), doc.alias("document"))
        if b.holes is None:
            return units
        lost = b.holes.select(KEY).distinct().join(b.df.select(KEY), KEY, "left_anti")
        return units.unionByName(lost.select(KEY, F.lit("hole").alias("status"), F.lit(None).cast(units.schema["document"].dataType).alias("document")))

    def _covered(self, n: int, after: str | None) -> tuple[DataFrame, bool, str | None]:
        units = self._units() if after is None else self._units().where(F.col(KEY) > after)
        got = units.orderBy(KEY).limit(n + 1).collect()
        return self.session.spark.createDataFrame(got[:n], units.schema), len(got) > n, got[n - 1][KEY] if len(got) > n else None

    def covered(self, keys: list[str]) -> DataFrame:
        """status present, hole or absent, and the document, of each key asked for."""
        asked = self.session.spark.createDataFrame([(k,) for k in dict.fromkeys(keys)], "_key string")
        found = self._units().join(F.broadcast(asked), KEY, "left_semi")
        return asked.join(found, KEY, "left").withColumn("status", F.coalesce("status", F.lit("absent")))

    def scan_iter(self, page_size: int = DEFAULT_PAGE) -> Iterator[Row]:
        return self.scan().toLocalIterator(prefetchPartitions=page_size > DEFAULT_PAGE)

    def scan_partial(self) -> tuple[DataFrame, DataFrame | None]:
        b = self.session.binding(self.name)
        return b.df, b.holes

    def where(self, test: Any, profile: str = "filter", params: dict[str, Any] | None = None) -> DataFrame:
        b = self.session.binding(self.name)
        return self.df.where(Predicates(rows(self.df, b.nulls_present, b.variant), params, profile).column(test.test if isinstance(test, Where) else test))

    def select(self, test: Any = None) -> Selection:
        """Documents that pass an object filter, to be ordered, limited and cut to fields."""
        return Selection(self, self.df if test is None else self.where(test))

    def sda(self, program: str, **bound: Any) -> DataFrame:
        """doc and result, as JSON texts, of a program over each document, bound as input."""
        return algebra_frames.map_rows(self.df, program, **bound)

    def where_sda(self, predicate: str, **bound: Any) -> DataFrame:
        """Documents for which a predicate of the algebra is true."""
        b = self.session.binding(self.name)
        return algebra_frames.filter_rows(self.df, rows(self.df, b.nulls_present, b.variant), predicate, **bound)

    def query(self) -> PlanBuilder:
        return PlanBuilder(self.session, Plan(self.name))

    # changes: the binding moves on to the new state; nothing is overwritten in place

    def _rebind(self, operation: str, df: DataFrame, keys: DataFrame) -> Receipt:
        b = self.session.binding(self.name)
        self.session.bindings[self.name] = replace(b, df=df, keys=(), generation=b.generation + 1)
        return Receipt(operation, b.generation + 1, keys.select(KEY).distinct())

    def _single(self, docs: DataFrame, version: str | None) -> DataFrame:
        """One document for each key: equal ones count once, of others the one of the greatest version stays."""
        names = self.df.columns
        if version is not None:
            body = F.struct(*[F.col(f"`{c}`") for c in names if c != KEY])
            return docs.groupBy(KEY).agg(F.max_by(body, version).alias("nestloom_doc_")).select(KEY, "nestloom_doc_.*").select(*names)
        docs = docs.select(*names)
        if self.session.binding(self.name).variant is None:
            docs = docs.distinct()
        if found := docs.groupBy(KEY).count().where("count > 1").limit(1).collect():
            raise QueryError("key_repeated", found[0][KEY])
        return docs

    def digests(self) -> DataFrame:
        """_key and digest of each document, for replace."""
        body = [F.col(f"`{c}`") for c in self.df.columns if c != KEY]
        return self.df.select(KEY, F.sha2(F.to_json(F.struct(*body), {"ignoreNullFields": "false"}), 256).alias("digest"))

    def put(self, docs: DataFrame, version: str | None = None) -> Receipt:
        """Replaces or adds documents by key. Different documents of one key need a version column, or are refused."""
        docs = self._single(docs, version)
        return self._rebind("put", self.df.join(docs.select(KEY), KEY, "left_anti").select(*docs.columns).unionByName(docs), docs)

    def create(self, docs: DataFrame) -> Receipt:
        docs = self._single(docs, None)
        if not self.df.join(docs.select(KEY), KEY, "left_semi").limit(1).isEmpty():
            raise QueryError("key_exists", self.name)
        return self._rebind("create", self.df.unionByName(docs), docs)

    def add(self, docs: DataFrame) -> Receipt:
        """Adds documents under keys of their own, made from their content, their place and the collection's generation."""
        names = [c for c in self.df.columns if c != KEY]
        b = self.session.binding(self.name)
        place = F.concat_ws("-", F.lit(self.name), F.lit(str(b.generation)), F.monotonically_increasing_id().cast("string"))
        key = F.substring(F.sha2(F.concat_ws("|", place, F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]))), 256), 1, 32)
        docs = docs.select(key.alias(KEY), *[F.col(f"`{c}`") for c in names])
        return self._rebind("add", self.df.unionByName(docs.select(*self.df.columns)), docs)

    def replace(self, docs: DataFrame, expected: DataFrame | None = None) -> Receipt:
        """Replaces documents that are there. expected: _key and digest that they must have now."""
        if not docs.select(KEY).join(self.df.select(KEY), KEY, "left_anti").limit(1).isEmpty():
            raise QueryError("key_missing", self.name)
        if expected is not None:
            want = docs.select(KEY).distinct().join(expected.select(KEY, F.col("digest").alias("expected_")), KEY, "left")
            now = want.join(self.digests(), KEY, "left")
            if not now.where(~F.col("digest").eqNullSafe(F.col("expected_"))).limit(1).isEmpty():
                raise QueryError("cas_mismatch", self.name)
        return replace(self.put(docs), operation="replace")

    def delete(self, keys: DataFrame) -> Receipt:
        return self._rebind("delete", self.df.join(keys.select(KEY), KEY, "left_anti").select(*self.df.columns), keys)

    def save(self, path: str, mode: str = "errorifexists", layout: list[str] | None = None) -> None:
        """Writes parquet; `layout` sorts within files, so that scans can skip by these fields."""
        df = self.df.sortWithinPartitions(*layout) if layout else self.df
        df.write.mode(mode).parquet(path)


class Selection:
    """A collection's filtered documents: one order, a limit, some fields."""

    def __init__(self, collection: Collection, df: DataFrame, order: tuple[str, bool] | None = None, most: int | None = None, fields: tuple[str, ...] = ()) -> None:
        self.collection, self.df, self.order, self.most, self.fields = collection, df, order, most, fields

    def order_by(self, path: str, desc: bool = False) -> Selection:
        """Missing and null fields come first, or last if the order descends; ties go by key."""
        return Selection(self.collection, self.df, (path, desc), self.most, self.fields)

    def limit(self, n: int) -> Selection:
        return Selection(self.collection, self.df, self.order, n, self.fields)

    def project(self, *paths: str) -> Selection:
        return Selection(self.collection, self.df, self.order, self.most, paths)

    def frame(self) -> DataFrame:
        b, df = self.collection.session.binding(self.collection.name), self.df
        scope = rows(df, b.nulls_present, b.variant)
        if self.order is not None:
            terms = sort_columns(scope, (OrderTerm(Path(self.order[0]), self.order[1], "first"),))
            df = ordered(df, [*terms, (F.col(KEY), False, True)])
        elif self.most is not None:
            df = df.orderBy(KEY)
        df = df if self.most is None else df.limit(self.most)
        return projected(df, scope, tuple(map(Path, self.fields))) if self.fields else df


class PlanBuilder:
    """The fluent twin of the text language; equal queries have equal hashes."""

    def __init__(self, session: Session, plan: Plan) -> None:
        self.session, self.plan = session, plan

    def _with(self, **changes: Any) -> PlanBuilder:
        return PlanBuilder(self.session, replace(self.plan, **changes))

    def where(self, test: Any) -> PlanBuilder:
        from ..plans.tree import And, Const

        test = _test(test)
        old = self.plan.where
        return self._with(where=test if old == Const(True) else And((*(old.parts if isinstance(old, And) else (old,)), test)))

    def enrich(self, field: str, using: str, left: str, right: str, expect: str, where: Any = None) -> PlanBuilder:
        return self._with(steps=(*self.plan.steps, attach(field, using, left, right, expect, where)))

    def within(self, path: str, *steps: Any) -> PlanBuilder:
        """steps: what attach, keep, block and inside make."""
        return self._with(steps=(*self.plan.steps, inside(path, *steps)))

    def keep(self, test: Any) -> PlanBuilder:
        """A condition after what was attached before it."""
        return self._with(steps=(*self.plan.steps, keep(test)))

    def block(self, **items: Any) -> PlanBuilder:
        """The projection in braces, which comes last."""
        return self._with(steps=(*self.plan.steps, block(**items)))

    def coverage(self, how: str) -> PlanBuilder:
        if how not in ("complete", "incomplete"):
            raise QueryError("rql_syntax", f"unknown coverage {how!r}")
        return self._with(coverage=how)

    def consistency(self, how: str) -> PlanBuilder:
        if how not in ("available", "current"):
            raise QueryError("rql_syntax", f"unknown consistency {how!r}")
        return self._with(consistency=how)

    def budget(self, **most: int) -> PlanBuilder:
        if unknown := most.keys() - {"documents", "bytes", "result_bytes"}:
            raise QueryError("rql_syntax", f"unknown budget {sorted(unknown)}")
        return self._with(budget=tuple(sorted(most.items())))

    def after(self, token: str) -> PlanBuilder:
        return self._with(after=token)

    def explain(self) -> dict:
        return self.session.explain(self.plan)

    def project(self, *paths: str) -> PlanBuilder:
        from ..plans.text import check_outputs

        check_outputs(list(paths))
        return self._with(project=tuple(map(Path, paths)))

    def group_by(self, *paths: str) -> PlanBuilder:
        return self._with(group=tuple(map(Path, paths)))

    def aggregate(self, fun: str, source: str | None, output: str) -> PlanBuilder:
        from ..plans.tree import Aggregate

        return self._with(group=self.plan.group or (), aggregates=(*self.plan.aggregates, Aggregate(fun, source and Path(source), output)))

    def order_by(self, path: str, desc: bool = False, nulls: str = "last") -> PlanBuilder:
        return self._with(order=(*self.plan.order, OrderTerm(Path(path), desc, nulls)))

    def limit(self, n: int) -> PlanBuilder:
        return self._with(limit=n)

    def page_size(self, n: int) -> PlanBuilder:
        return self._with(page_size=n)

    def run(self, after: str | None = None, **params: Any) -> Page:
        return self.session.run(self.plan, after, **params)

    def run_all(self, **params: Any) -> DataFrame:
        return self.session.run_all(self.plan, **params)


# steps of plans and of within


def _test(test: Any) -> Any:
    return parse_predicate(test) if isinstance(test, str) else test.test if isinstance(test, Where) else test


def attach(field: str, using: str, left: str, right: str, expect: str, where: Any = None) -> Enrich:
    if expect not in ("exactly_one", "optional", "many"):
        raise QueryError("rql_syntax", f"unknown cardinality {expect!r}")
    return Enrich(field, using, Path(left), Path(right), expect, None if where is None else _test(where))


def keep(test: Any) -> Filter:
    return Filter(_test(test))


def inside(path: str, *steps: Any) -> Within:
    return Within(Path(path), steps)


def block(**items: Any) -> ProjectBlock:
    """output=path, output=literal(value), output=choice(...) or, for what is nested, output=(path, {output: ...})."""

    def item(name: str, value: Any) -> Item:
        if isinstance(value, tuple):
            return Item(name, Path(value[0]), tuple(item(k, v) for k, v in value[1].items()))
        return Item(name, Path(value) if isinstance(value, str) else value)

    return ProjectBlock(tuple(item(k, v) for k, v in items.items()))
