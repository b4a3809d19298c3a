"""Predicates in Python: field("a").eq(1) & ~field("b.c").present(), the same plans as the text language's."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from .tree import And, Compare, If, Not, OneOf, Or, Param, Path, Test, Text


@dataclass(frozen=True)
class Where:
    """A predicate that &, | and ~ combine."""

    test: Any

    def __and__(self, other: Where) -> Where:
        return Where(And((*_parts(self.test, And), *_parts(other.test, And))))

    def __or__(self, other: Where) -> Where:
        return Where(Or((*_parts(self.test, Or), *_parts(other.test, Or))))

    def __invert__(self) -> Where:
        return Where(Not(self.test))


def _parts(test: Any, kind: type) -> tuple:
    return test.parts if isinstance(test, kind) else (test,)


@dataclass(frozen=True)
class Field:
    path: Path

    def _compare(self, op: str, value: Any) -> Where:
        value = value.path if isinstance(value, Field) else tuple(value) if isinstance(value, list) else value
        return Where(Compare(op, self.path, value))

    def eq(self, value: Any) -> Where:
        return self._compare("=", value)

    def ne(self, value: Any) -> Where:
        return self._compare("!=", value)

    def lt(self, value: Any) -> Where:
        return self._compare("<", value)

    def le(self, value: Any) -> Where:
        return self._compare("<=", value)

    def gt(self, value: Any) -> Where:
        return self._compare(">", value)

    def ge(self, value: Any) -> Where:
        return self._compare(">=", value)

    def is_in(self, *values: Any) -> Where:
        return Where(OneOf(self.path, values))

    def not_in(self, *values: Any) -> Where:
        return Where(OneOf(self.path, values, True))

    def present(self) -> Where:
        return Where(Test("present", self.path))

    def missing(self) -> Where:
        return Where(Test("missing", self.path))

    def is_null(self) -> Where:
        return Where(Test("null", self.path))

    def not_null(self) -> Where:
        return Where(Test("not_null", self.path))

    def starts_with(self, text: Any) -> Where:
        return Where(Text("starts_with", self.path, text))

    def contains(self, value: Any) -> Where:
        return Where(Text("contains", self.path, value))


def field(path: str) -> Field:
    return Field(Path(path))


def param(name: str) -> Param:
    return Param(name)


def choice(test: Any, then: Any, other: Any) -> If:
    """A computed value: then where the predicate holds, else other."""
    return If(test.test if isinstance(test, Where) else test, then, other)
