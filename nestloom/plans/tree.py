"""Logical plans: frozen, with a canonical JSON form and a hash that text and builders share."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any


@dataclass(frozen=True)
class Path:
    name: str  # dotted

    @property
    def last(self) -> str:
        return self.name.rsplit(".", 1)[-1]


@dataclass(frozen=True)
class Param:
    name: str


@dataclass(frozen=True)
class Const:
    value: bool


@dataclass(frozen=True)
class Compare:
    op: str  # = != < <= > >=
    left: Path
    right: Any  # a literal, Param or Path


@dataclass(frozen=True)
class OneOf:
    path: Path
    values: tuple
    negated: bool = False


@dataclass(frozen=True)
class Test:
    kind: str  # present missing null not_null
    path: Path


@dataclass(frozen=True)
class Text:
    kind: str  # starts_with contains
    path: Path
    value: Any


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: Any


@dataclass(frozen=True)
class Aggregate:
    fun: str
    source: Path | None
    output: str


@dataclass(frozen=True)
class OrderTerm:
    path: Path
    desc: bool = False
    nulls: str = "last"  # where absent values go before desc turns the order round


@dataclass(frozen=True)
class If:
    test: Any
    then: Any
    other: Any


@dataclass(frozen=True)
class Item:
    """An output of a project in braces: a path, a nested block over one, or a computed value."""

    output: str
    value: Any
    block: tuple | None = None


@dataclass(frozen=True)
class Enrich:
    field: str
    source: str
    left: Path
    right: Path
    expect: str  # exactly_one optional many
    where: Any = None


@dataclass(frozen=True)
class Within:
    path: Path
    steps: tuple


@dataclass(frozen=True)
class Filter:
    where: Any


@dataclass(frozen=True)
class ProjectBlock:
    items: tuple


@dataclass(frozen=True)
class Plan:
    source: str
    where: Any = Const(True)
    group: tuple | None = None
    aggregates: tuple = ()
    project: tuple = ()
    order: tuple = ()
    limit: int | None = None
    page_size: int | None = None
    steps: tuple = ()
    coverage: str = "complete"
    consistency: str = "available"
    budget: tuple = ()
    after: Any = field(default=None, compare=False)
    explain: bool = field(default=False, compare=False)

    def canonical(self) -> str:
        return json.dumps(as_json(self, skip=("after", "explain")), sort_keys=True, separators=(",", ":"))

    def hash(self) -> str:
        return hashlib.sha256(self.canonical().encode()).hexdigest()


def as_json(x: Any, skip: tuple = ()) -> Any:
    if is_dataclass(x):
        return {"kind": type(x).__name__} | {f.name: as_json(getattr(x, f.name)) for f in fields(x) if f.name not in skip}
    if isinstance(x, (tuple, list)):
        return [as_json(v) for v in x]
    return x
