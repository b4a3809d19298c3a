"""The text language: `from`, `where`, `group by`, `project`, `order by`, `limit`, `page size`, `after`, `coverage`,
`consistency`, `budget`, and the attach clauses `enrich` and `within`, which may be followed by further `where` clauses and
a project in braces."""

from __future__ import annotations

import re
from dataclasses import replace
from typing import Any

from ..errors import QueryError
from .tree import Aggregate, And, Compare, Const, Enrich, Filter, If, Item, Not, OneOf, Or, OrderTerm, Param, Path, Plan, ProjectBlock, Test, Text, Within

#: Limits and refusals of the language.
MAX_NODES, MAX_SEGMENTS, MAX_ORDER, MAX_PROJECT, MAX_PAGE, DEFAULT_PAGE, MAX_DEPTH = 4096, 64, 16, 1024, 4096, 64, 8
UNAVAILABLE = "rql_feature_unavailable"
REFUSED = {"offset", "skip", "having", "distinct", "join", "union", "intersect", "except", "unwind", "over", "access", "rank"}
AGGREGATES = {"count", "sum", "min", "max", "avg"}

TOKEN = re.compile(r"""\s+|--[^\n]*|(?P<num>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<name>[A-Za-z_$][A-Za-z0-9_$]*(?:\.[A-Za-z_$][A-Za-z0-9_$]*)*)|(?P<op><=|>=|!=|<>|[=<>(){}\[\],:])""")
_ESCAPE = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def _unquoted(s: str) -> str:
    return re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] == "u" and len(m[1]) == 5 else _ESCAPE.get(m[1], m[1]), s[1:-1])


class Parser:
    pattern = TOKEN

    def unquoted(self, text: str) -> str:
        return _unquoted(text)

    def __init__(self, source: str) -> None:
        self.tokens: list[tuple[str, Any]] = []
        pos = 0
        while pos < len(source):
            m = self.pattern.match(source, pos)
            if not m:
                raise QueryError("rql_syntax", f"unexpected text at {source[pos : pos + 24]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
            pos = m.end()
        self.i, self.nodes, self.depth = 0, 0, 0

    def word(self, ahead: int = 0) -> str:
        kind, text = self.tokens[self.i + ahead] if self.i + ahead < len(self.tokens) else ("end", "")
        return text.lower() if kind == "name" else text if kind == "op" else ""

    def eat(self, *words: str) -> bool:
        if all(self.word(k) == w for k, w in enumerate(words)):
            self.i += len(words)
            return True
        return False

    def expect(self, word: str) -> None:
        if not self.eat(word):
            raise QueryError("rql_syntax", f"expected {word!r} at {self.here()}")

    def here(self) -> str:
        return " ".join(t for _, t in self.tokens[self.i : self.i + 4]) or "the end"

    def take(self, *kinds: str) -> tuple[str, str]:
        if self.i < len(self.tokens) and self.tokens[self.i][0] in kinds:
            self.i += 1
            return self.tokens[self.i - 1]
        raise QueryError("rql_syntax", f"expected {' or '.join(kinds)} at {self.here()}")

    def name(self) -> str:
        kind, text = self.take("name", "str")
        return self.unquoted(text) if kind == "str" else text

    def path(self) -> Path:
        name = self.take("name")[1]
        if name.count(".") >= MAX_SEGMENTS:
            raise QueryError("rql_syntax", "too many path segments")
        return Path(name)

    def number(self) -> int:
        kind, text = self.take("num")
        if not text.isdigit():
            raise QueryError("rql_syntax", "expected a whole number")
        return int(text)

    def literal(self) -> Any:
        if self.eat("["):
            out = []
            while not self.eat("]"):
                out.append(self.literal())
                if not self.eat(",") and self.word() != "]":
                    raise QueryError("rql_syntax", f"expected ',' at {self.here()}")
            return tuple(out)
        kind, text = self.take("num", "str", "name")
        if kind == "num":
            return float(text) if re.search("[.eE]", text) else int(text)
        if kind == "str":
            return self.unquoted(text)
        if text.lower() in ("true", "false"):
            return text.lower() == "true"
        if text.lower() == "null":
            return None
        return Param(text[1:]) if text.startswith("$") and text != "$key" else Path(text)

    # predicates

    def predicate(self) -> Any:
        parts = [self.conjunction()]
        while self.eat("or"):
            parts.append(self.conjunction())
        return parts[0] if len(parts) == 1 else Or(tuple(parts))

    def conjunction(self) -> Any:
        parts = [self.negation()]
        while self.eat("and"):
            parts.append(self.negation())
        return parts[0] if len(parts) == 1 else And(tuple(parts))

    def negation(self) -> Any:
        self.nodes += 1
        if self.nodes > MAX_NODES:
            raise QueryError("rql_syntax", "too many predicate nodes")
        if self.eat("not"):
            return Not(self.negation())
        if self.eat("("):
            out = self.predicate()
            self.expect(")")
            return out
        for word in ("true", "false"):
            if self.eat(word):
                return Const(word == "true")
        for kind in ("present", "missing", "starts_with", "contains"):
            if self.word() == kind and self.word(1) == "(":
                self.i += 2
                path = self.path()
                out: Any = Test(kind, path)
                if kind in ("starts_with", "contains"):
                    self.expect(",")
                    out = Text(kind, path, self.literal())
                self.expect(")")
                return out
        path = self.path()
        if self.eat("is"):
            negated = self.eat("not")
            self.expect("null")
            return Test("not_null" if negated else "null", path)
        if self.eat("contains"):
            return Text("contains", path, self.literal())
        negated = self.eat("not")
        if self.eat("in"):
            values = self.literal()
            if not isinstance(values, (tuple, Param)):
                raise QueryError("rql_syntax", "`in` needs a list")
            return OneOf(path, values if isinstance(values, tuple) else (values,), negated)
        op = self.take("op")[1]
        if negated or op not in ("=", "!=", "<>", "<", "<=", ">", ">="):
            raise QueryError("rql_syntax", f"expected a comparison at {self.here()}")
        return Compare("!=" if op == "<>" else op, path, self.literal())

    # projections

    def value(self) -> Any:
        if self.eat("if"):
            test = self.predicate()
            self.expect("then")
            then = self.value()
            self.expect("else")
            return If(test, then, self.value())
        return self.literal()

    def block(self) -> tuple:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise QueryError("rql_projection_depth", "too deep")
        out: list[Item] = []
        while not self.eat("}"):
            path = self.path()
            if self.eat(":") or self.eat("="):
                value = self.value()
                out.append(Item(path.name, value, self.block() if isinstance(value, Path) and self.eat("{") else None))
            else:
                out.append(Item(path.last, path, self.block() if self.eat("{") else None))
            if not self.eat(",") and self.word() != "}":
                raise QueryError("rql_syntax", f"expected ',' at {self.here()}")
        self.depth -= 1
        check_outputs([i.output for i in out])
        return tuple(out)

    def projection(self) -> tuple[list, list, bool]:
        """paths or computed items, aggregates, whether any is computed"""
        items: list = []
        aggregates: list[Aggregate] = []
        while True:
            fun = self.word()
            if fun in AGGREGATES and self.word(1) == "(":
                self.i += 2
                source = None if fun == "count" else self.path()
                self.expect(")")
                self.expect("as")
                aggregates.append(Aggregate(fun, source, self.name()))
            else:
                path = self.path()
                items.append(Item(path.name, self.value()) if self.eat("=") else path)
            if not self.eat(","):
                break
        if len(items) + len(aggregates) > MAX_PROJECT:
            raise QueryError("rql_syntax", "too many outputs")
        return items, aggregates, any(isinstance(i, Item) for i in items)

    # attach clauses

    def enrich(self, alias: str) -> Enrich:
        name = self.name()
        if self.eat("from"):
            source = self.name()
            self.expect("on")
            foreign = source
        else:
            self.expect("using")
            foreign = source = self.name()
            if self.eat("as"):
                foreign = self.name()
            self.expect("matching")
        left = _under(self.path(), alias)
        self.expect("=")
        right = _under(self.path(), foreign)
        where = _moved(self.predicate(), foreign) if self.eat("where") else None
        self.eat("expect")
        expect = self.name()
        if expect == "one":
            expect = "exactly_one"
        if expect not in ("exactly_one", "optional", "many"):
            raise QueryError("rql_syntax", f"unknown cardinality {expect!r}")
        return Enrich(name, source, left, right, expect, where)

    def within(self, alias: str, depth: int = 1) -> Within:
        if depth > MAX_DEPTH:
            raise QueryError("rql_within_depth", "too deep")
        path = _under(self.path(), alias)
        own = self.name() if self.eat("as") else ""
        self.expect("{")
        steps: list = []
        while not self.eat("}"):
            if self.eat("enrich"):
                steps.append(self.enrich(own))
            elif self.eat("within"):
                steps.append(self.within(own, depth + 1))
            elif self.eat("where"):
                steps.append(Filter(_moved(self.predicate(), own)))
            elif self.eat("project", "{"):
                steps.append(ProjectBlock(self.block()))
            else:
                raise QueryError("rql_syntax", f"expected a step at {self.here()}")
        return Within(path, tuple(steps))

    # the whole

    def plan(self) -> Plan:
        explain = self.eat("explain")
        self.expect("from")
        p = Plan(self.name(), explain=explain)
        alias = self.name() if self.eat("as") else ""
        wheres, steps, seen, projected = [], [], set(), ProjectBlock(())

        def once(clause: str) -> None:
            if clause in seen:
                raise QueryError("rql_syntax", f"duplicate {clause} clause")
            seen.add(clause)

        while self.i < len(self.tokens):
            word = self.word()
            if word in REFUSED or word == "at":
                raise QueryError(UNAVAILABLE, word)
            if self.eat("where"):
                test = _moved(self.predicate(), alias)
                if steps:
                    steps.append(Filter(test))
                else:
                    wheres.append(test)
            elif self.eat("group", "by"):
                once("group")
                if "project" in seen:
                    raise QueryError("rql_syntax", "group by must appear before project")
                keys = [self.path()]
                while self.eat(","):
                    keys.append(self.path())
                check_outputs([k.last for k in keys])
                p = replace(p, group=tuple(keys))
            elif self.eat("project"):
                once("project")
                if self.eat("{"):
                    projected = ProjectBlock(self.block())
                    continue
                items, aggregates, computed = self.projection()
                if computed:
                    projected = ProjectBlock(tuple(i if isinstance(i, Item) else Item(i.name, i) for i in items))
                    check_outputs([i.output for i in projected.items])
                elif aggregates or p.group is not None:
                    p = replace(p, group=p.group or (), aggregates=tuple(aggregates))
                    check_outputs([k.last for k in p.group] + [a.output for a in aggregates])
                else:
                    p = replace(p, project=tuple(items))
                    check_outputs([i.name for i in items])
            elif self.eat("order", "by"):
                once("order")
                terms = [self.order_term()]
                while self.eat(","):
                    terms.append(self.order_term())
                if len(terms) > MAX_ORDER:
                    raise QueryError("rql_syntax", "too many order terms")
                p = replace(p, order=tuple(terms))
            elif self.eat("limit"):
                once("limit")
                p = replace(p, limit=self.number())
            elif self.eat("page", "size"):
                once("page")
                size = self.number()
                if not 1 <= size <= MAX_PAGE:
                    raise QueryError("rql_page_size", str(size))
                p = replace(p, page_size=size)
            elif self.eat("after"):
                once("after")
                p = replace(p, after=self.literal())
            elif self.eat("coverage"):
                once("coverage")
                how = self.name()
                if how not in ("complete", "incomplete", "allow_incomplete"):
                    raise QueryError("rql_syntax", f"unknown coverage {how!r}")
                p = replace(p, coverage="complete" if how == "complete" else "incomplete")
            elif self.eat("consistency"):
                once("consistency")
                how = self.name()
                if how not in ("available", "current"):
                    raise QueryError("rql_syntax", f"unknown consistency {how!r}")
                p = replace(p, consistency=how)
            elif self.eat("budget"):
                once("budget")
                self.expect("{")
                parts = []
                while not self.eat("}"):
                    key = self.name()
                    if key not in ("documents", "bytes", "result_bytes"):
                        raise QueryError("rql_syntax", f"unknown budget {key!r}")
                    self.eat(":")
                    parts.append((key, self.number()))
                    self.eat(",")
                p = replace(p, budget=tuple(sorted(parts)))
            elif self.eat("enrich"):
                steps.append(self.enrich(alias))
            elif self.eat("within"):
                steps.append(self.within(alias))
            else:
                raise QueryError("rql_syntax", f"unexpected {self.here()}")
        if projected.items:
            steps.append(projected)
        test = Const(True) if not wheres else wheres[0] if len(wheres) == 1 else And(tuple(wheres))
        return replace(p, where=test, steps=tuple(steps))

    def order_term(self) -> OrderTerm:
        path = self.path()
        desc = self.eat("desc") or (self.eat("asc") and False)
        nulls = "last"
        if self.eat("nulls"):
            nulls = self.name()
            if nulls not in ("first", "last"):
                raise QueryError("rql_syntax", "nulls first or last")
        elif self.word() == "missing":
            raise QueryError(UNAVAILABLE, "missing first|last")
        return OrderTerm(path, desc, nulls)


def check_outputs(names: list[str]) -> None:
    if len(set(names)) < len(names):
        raise QueryError("rql_projection_conflict", ", ".join(sorted({n for n in names if names.count(n) > 1})))


def _under(path: Path, alias: str) -> Path:
    return Path(path.name[len(alias) + 1 :]) if alias and path.name.startswith(alias + ".") else path


def _moved(test: Any, alias: str) -> Any:
    """The predicate with the alias taken off its paths."""
    if not alias:
        return test
    if isinstance(test, Compare):
        return replace(test, left=_under(test.left, alias), right=_under(test.right, alias) if isinstance(test.right, Path) else test.right)
    if isinstance(test, (OneOf, Test, Text)):
        return replace(test, path=_under(test.path, alias))
    if isinstance(test, (And, Or)):
        return type(test)(tuple(_moved(p, alias) for p in test.parts))
    return Not(_moved(test.part, alias)) if isinstance(test, Not) else test


def parse(source: str) -> Plan:
    return Parser(source).plan()


def parse_predicate(source: str) -> Any:
    p = Parser(source)
    out = p.predicate()
    if p.i < len(p.tokens):
        raise QueryError("rql_syntax", f"unexpected {p.here()}")
    return out
