"""A pure expression algebra over sets, bags, sequences, maps and records, with exact numbers and errors as values.

Programs are parsed into nested tuples and run by `evaluate`. Over DataFrames, predicates and projections on fields are
compiled to columns (`to_column`); what has no column form runs in Arrow batches (`map_rows`, `filter_rows`).
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from fractions import Fraction
from typing import Any

from ..errors import QueryError


@dataclass(frozen=True)
class V:
    """A carrier: seq set bag (tuples), map prod (tuples of pairs), bagkv (pairs), bind, some, none, ok, fail, fn."""

    kind: str
    data: Any = None


@dataclass(frozen=True)
class Builtin:
    """What a built-in function's name stands for."""

    arity: int
    run: Callable


class Unkeyable(Exception):
    """A function, or something that holds one, can't be compared."""


def fail(code: str, message: str) -> V:
    return V("fail", (code, message))


#: Codes and messages of errors.
SHAPE = fail("t_sda_wrong_shape", "wrong shape")
ENR_SHAPE = fail("t_enr_wrong_shape", "wrong shape")
DIV_ZERO = fail("t_sda_div_by_zero", "division by zero")
UNBOUND = fail("t_sda_unbound_name", "unbound name")
UNBOUND_HOLE = fail("t_sda_unbound_placeholder", "unbound placeholder")
MISSING_KEY = fail("t_sda_missing_key", "missing key")
DUPLICATE_KEY = fail("t_sda_duplicate_key", "duplicate key")
UNKNOWN_FIELD = fail("t_sda_unknown_field", "unknown field")
NOT_CALLABLE = fail("t_sda_not_callable", "not callable")
ARITY = fail("t_sda_arity_mismatch", "arity mismatch")
COLLISION = fail("t_enr_field_collision", "field collision")
DUPLICATE = fail("t_enr_duplicate", "duplicate match")
MISSING = fail("t_enr_missing", "missing match")
TOO_DEEP = fail("t_sda_depth", "nested too deep")
UNORDERED = fail("t_enr_unordered_policy", "unordered policy")
NONE = V("none")
#: The tags by which JSON tells carriers apart, and ASCII words for symbols.
TAGS = frozenset("map num bytes set bag prod bagkv bind some none ok fail fn".split())
SYMBOLS = {"∪": "union", "∩": "inter", "∖": "diff", "∈": "in", "∧": "and", "∨": "or", "¬": "not", "→": "->", "↦": "=>", "≠": "!=", "≤": "<=", "≥": ">=", "•": "_", "⟨": "<", "⟩": ">"}


def key_of(v: Any) -> Any:
    """Equal values have equal keys; sets, bags, maps and records don't mind order."""
    if v is None or isinstance(v, (bool, str, bytes)):
        return (type(v).__name__, v)
    if isinstance(v, Fraction):
        return ("num", v)
    if v.kind == "fn":
        raise Unkeyable
    if v.kind == "seq":
        return ("seq", tuple(map(key_of, v.data)))
    if v.kind == "set":
        return ("set", frozenset(map(key_of, v.data)))
    if v.kind in ("bag", "bagkv"):
        items = v.data if v.kind == "bag" else [V("bind", p) for p in v.data]
        return (v.kind, frozenset(Counter(map(key_of, items)).items()))
    if v.kind in ("map", "prod"):
        return (v.kind, frozenset((k, key_of(x)) for k, x in v.data))
    return (v.kind, tuple(map(key_of, v.data)) if isinstance(v.data, tuple) else key_of(v.data))


def unique(items) -> tuple:
    return tuple({key_of(x): x for x in reversed(list(items))}.values())[::-1]


# JSON


def from_json(x: Any) -> Any:
    if isinstance(x, (bool, str, Fraction)) or x is None:
        return x
    if isinstance(x, (int, float)):
        return Fraction(str(x))
    if isinstance(x, list):
        return V("seq", tuple(map(from_json, x)))
    tag = x.get("$type")
    if tag not in TAGS:
        return V("map", tuple((k, from_json(v)) for k, v in x.items()))
    if tag == "num":
        return Fraction(x["$value"])
    if tag == "bytes":
        return bytes.fromhex(x["$base16"])
    if tag in ("set", "bag"):
        items = tuple(map(from_json, x["$items"]))
        return V(tag, unique(items) if tag == "set" else items)
    if tag in ("map", "prod"):
        return V(tag, tuple((k, from_json(v)) for k, v in x["$entries" if tag == "map" else "$fields"].items()))
    if tag == "bagkv":
        return V(tag, tuple((from_json(k), from_json(v)) for k, v in x["$items"]))
    if tag == "bind":
        return V(tag, (from_json(x["$key"]), from_json(x["$val"])))
    if tag in ("some", "ok"):
        return V(tag, from_json(x["$value"]))
    return fail(x["$code"], x["$msg"]) if tag == "fail" else V(tag)


def _canonical(items: list) -> list:
    return sorted(items, key=lambda j: json.dumps(j, sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def to_json(v: Any) -> Any:
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, Fraction):
        if v.denominator == 1:
            return int(v)
        rest = v.denominator
        for p in (2, 5):
            while rest % p == 0:
                rest //= p
        return float(v) if rest == 1 else {"$type": "num", "$value": f"{v.numerator}/{v.denominator}"}
    if isinstance(v, bytes):
        return {"$type": "bytes", "$base16": v.hex()}
    if v.kind == "seq":
        return [to_json(x) for x in v.data]
    if v.kind in ("set", "bag"):
        return {"$type": v.kind, "$items": _canonical([to_json(x) for x in v.data])}
    if v.kind == "map":
        out = {k: to_json(x) for k, x in sorted(v.data, key=lambda p: p[0])}
        return {"$type": "map", "$entries": out} if out.get("$type") in TAGS else out
    if v.kind == "prod":
        return {"$type": "prod", "$fields": {k: to_json(x) for k, x in v.data}}
    if v.kind == "bagkv":
        return {"$type": "bagkv", "$items": _canonical([[to_json(k), to_json(x)] for k, x in v.data])}
    if v.kind == "bind":
        return {"$type": "bind", "$key": to_json(v.data[0]), "$val": to_json(v.data[1])}
    if v.kind in ("some", "ok"):
        return {"$type": v.kind, "$value": to_json(v.data)}
    return {"$type": "fail", "$code": v.data[0], "$msg": v.data[1]} if v.kind == "fail" else {"$type": v.kind}


# parsing

_TOKEN = re.compile(r"""\s+|\#[^\n]*|(?P<num>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<str>"(?:[^"\\]|\\.)*")|(?P<name>[^\W\d]\w*)|(?P<op>\|>|->|=>|\+\+|<=|>=|!=|[-+*/=<>(){}\[\],;:?!|])|(?P<sym>[∪∩∖∈∧∨¬→↦≠≤≥•⟨⟩])""")
_LEVELS = [("or",), ("and",), ("=", "!=", "<", "<=", ">", ">=", "in"), ("union", "inter", "diff", "bunion", "bdiff"), ("++",), ("+", "-"), ("*", "/")]
#: Levels of brackets in a program, and of ten's powers in a number.
MAX_DEPTH, MAX_EXPONENT = 64, 400
_CARRIERS = {"Seq": ("[", "]"), "Set": ("{", "}"), "Bag": ("{", "}"), "Map": ("{", "}"), "Prod": ("{", "}"), "BagKV": ("{", "}")}


class _Parser:
    def __init__(self, source: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        pos = 0
        while pos < len(source):
            m = _TOKEN.match(source, pos)
            if not m:
                raise QueryError("t_sda_syntax", source[pos : pos + 20])
            if m.lastgroup == "sym":
                word = SYMBOLS[m[0]]
                self.tokens.append(("name" if word.isalpha() or word == "_" else "op", word))
            elif m.lastgroup:
                self.tokens.append((m.lastgroup, m[0]))
            pos = m.end()
        self.tokens.append(("end", ""))
        self.i, self.depth = 0, 0

    def at(self, text: str, ahead: int = 0) -> bool:
        return self.i + ahead < len(self.tokens) and self.tokens[self.i + ahead][0] in ("op", "name") and self.tokens[self.i + ahead][1] == text

    def eat(self, text: str) -> bool:
        if self.at(text):
            self.i += 1
            return True
        return False

    def expect(self, text: str) -> None:
        if not self.eat(text):
            raise QueryError("t_sda_syntax", f"expected {text!r} before {self.tokens[self.i][1]!r}")

    def take(self, kind: str) -> str:
        if self.tokens[self.i][0] != kind:
            raise QueryError("t_sda_syntax", f"expected a {kind} before {self.tokens[self.i][1]!r}")
        self.i += 1
        return self.tokens[self.i - 1][1]

    def program(self) -> list:
        out = []
        while self.tokens[self.i][0] != "end":
            if self.eat("let"):
                name = self.take("name")
                if name == "_":
                    raise QueryError("t_sda_reserved_placeholder", "reserved placeholder")
                self.expect("=")
                out.append(("let", name, self.pipe()))
            elif self.at("source") and self.tokens[self.i + 1][0] == "name" and self.at(":", 2):
                while not self.at(";"):
                    self.i += 1
            else:
                out.append(("do", self.pipe()))
            if not self.eat(";"):
                break
        if self.tokens[self.i][0] != "end":
            raise QueryError("t_sda_syntax", f"unexpected {self.tokens[self.i][1]!r}")
        return out

    def pipe(self) -> tuple:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise QueryError("t_sda_syntax", "nested too deep")
        out = self.pipeline()
        self.depth -= 1
        return out

    def pipeline(self) -> tuple:
        left = self.function()
        while self.eat("|>"):
            if self.at("enrich") and self.at("{", 1):
                self.i += 2
                left = ("enrich", left, self.pairs("}", ":"))
            else:
                left = ("pipe", left, self.function())
        return left

    def function(self) -> tuple:
        if self.tokens[self.i][0] == "name" and self.at("=>", 1):
            name = self.take("name")
            self.i += 1
            return ("fn", name, self.function())
        return self.level(0)

    def level(self, n: int) -> tuple:
        if n == len(_LEVELS):
            return self.unary()
        if n == 2 and self.eat("not"):
            return ("not", self.level(2))
        left = self.level(n + 1)
        while (op := next((o for o in _LEVELS[n] if self.at(o)), None)) is not None:
            self.i += 1
            left = ("op", op, left, self.level(n + 1))
            if n == 2:
                break
        return left

    def unary(self) -> tuple:
        return ("neg", self.unary()) if self.eat("-") else self.postfix()

    def postfix(self) -> tuple:
        out = self.atom()
        while True:
            if self.at("<") and self.tokens[self.i + 1][0] in ("name", "str") and self.at(">", 2):
                kind, label = self.tokens[self.i + 1]
                self.i += 3
                out = ("select", out, json.loads(label) if kind == "str" else label, "?" if self.eat("?") else "!" if self.eat("!") else "")
            elif self.eat("("):
                out = ("call", out, self.items(")"))
            else:
                return out

    def items(self, close: str) -> list:
        out = []
        while not self.eat(close):
            out.append(self.pipe())
            if not self.eat(",") and not self.at(close):
                self.expect(close)
        return out

    def pairs(self, close: str, mark: str) -> list:
        out = []
        while not self.eat(close):
            kind, text = self.tokens[self.i]
            if kind not in ("name", "str"):
                raise QueryError("t_sda_syntax", "a label is a name or a text")
            self.i += 1
            self.expect(mark)
            out.append((json.loads(text) if kind == "str" else text, self.pipe()))
            if not self.eat(",") and not self.at(close):
                self.expect(close)
        return out

    def atom(self) -> tuple:
        kind, text = self.tokens[self.i]
        self.i += 1
        if kind == "num":
            if abs(int(text.lower().partition("e")[2] or 0)) > MAX_EXPONENT:
                raise QueryError("t_sda_syntax", f"out of range: {text}")
            return ("lit", Fraction(text))
        if kind == "str":
            return ("lit", json.loads(text, strict=False))
        if kind == "op" and text == "(":
            out = self.pipe()
            self.expect(")")
            return out
        if kind == "op" and text == "{":
            return self.comprehension()
        if kind != "name":
            raise QueryError("t_sda_syntax", f"unexpected {text!r}")
        if text in ("null", "true", "false"):
            return ("lit", {"null": None, "true": True, "false": False}[text])
        if text == "None":
            return ("lit", NONE)
        if text in _CARRIERS and self.at(_CARRIERS[text][0]):
            self.i += 1
            close = _CARRIERS[text][1]
            if text in ("Seq", "Set", "Bag"):
                return ("make", text.lower(), self.items(close))
            pairs = self.pairs(close, ":" if text == "Prod" else "->")
            if text != "BagKV" and len({k for k, _ in pairs}) < len(pairs):
                return ("lit", DUPLICATE_KEY)
            return ("pairs", text.lower(), pairs)
        if text in ("one", "oneOpt", "oneReq") and (self.at("?") or self.at("!") or text != "one"):
            return ("name", "oneOpt" if text == "oneOpt" or text == "one" and self.eat("?") else "oneReq" if text == "oneReq" or self.eat("!") else text)
        return ("hole",) if text == "_" else ("name", text)

    def comprehension(self) -> tuple:
        made = None
        if self.eat("yield"):
            made = self.pipe()
            self.expect("|")
        name = self.take("name")
        self.expect("in")
        source = self.level(3)
        test = self.pipe() if self.eat("|") else None
        self.expect("}")
        return ("each", name, source, test, made)


def parse(source: str) -> list:
    try:
        return _Parser(source).program()
    except RecursionError as e:  # chains of prefixes, which no bracket counts
        raise QueryError("t_sda_syntax", "nested too deep") from e


# running


def _number(a: Any, b: Any) -> bool:
    return isinstance(a, Fraction) and isinstance(b, Fraction)


def _records(a: Any, b: Any) -> bool:
    return isinstance(a, V) and isinstance(b, V) and a.kind == b.kind and a.kind in ("map", "prod")


def _merged(a: Any, b: Any, policy: str) -> V:
    if not _records(a, b):
        return ENR_SHAPE
    left, right = dict(a.data), dict(b.data)
    if policy == "fail" and left.keys() & right.keys():
        return COLLISION
    return V(a.kind, tuple(({**left, **right} if policy != "left" else {**right, **left}).items()))


def _binary(op: str, a: Any, b: Any) -> Any:
    if op == "+" and _records(a, b):
        return _merged(a, b, "fail")
    if op in ("+", "-", "*", "/"):
        if not _number(a, b):
            return SHAPE
        if op == "/":
            return a / b if b else DIV_ZERO
        return a + b if op == "+" else a - b if op == "-" else a * b
    if op == "++":
        if isinstance(a, str) and isinstance(b, str):
            return a + b
        both = isinstance(a, V) and isinstance(b, V) and a.kind == b.kind == "seq"
        return V("seq", a.data + b.data) if both else SHAPE
    if op in ("=", "!="):
        try:
            return (key_of(a) == key_of(b)) == (op == "=")
        except Unkeyable:
            return SHAPE
    if op in ("<", "<=", ">", ">="):
        if not (_number(a, b) or isinstance(a, str) and isinstance(b, str)):
            return SHAPE
        return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    if op in ("and", "or"):
        return SHAPE if not (isinstance(a, bool) and isinstance(b, bool)) else (a and b) if op == "and" else (a or b)
    if op == "in":
        if not isinstance(b, V) or b.kind not in ("seq", "set", "bag", "map", "prod"):
            return SHAPE
        try:
            return any(key_of(a) == key_of(x) for x in b.data) if b.kind in ("seq", "set", "bag") else isinstance(a, str) and a in dict(b.data)
        except Unkeyable:
            return SHAPE
    want = "bag" if op in ("bunion", "bdiff") else "set"
    if not (isinstance(a, V) and isinstance(b, V) and a.kind == b.kind == want):
        return SHAPE
    if op == "bunion":
        return V("bag", a.data + b.data)
    if op == "bdiff":
        left, out = Counter(map(key_of, b.data)), []
        for x in a.data:
            if left[key_of(x)] > 0:
                left[key_of(x)] -= 1
            else:
                out.append(x)
        return V("bag", tuple(out))
    other = set(map(key_of, b.data))
    if op == "union":
        return V("set", unique(a.data + b.data))
    return V("set", tuple(x for x in a.data if (key_of(x) in other) == (op == "inter")))


def _select(x: Any, label: str, how: str) -> Any:
    if not isinstance(x, V):
        return SHAPE
    if how == "":
        return SHAPE if x.kind != "prod" else dict(x.data).get(label, UNKNOWN_FIELD)
    if x.kind not in ("map", "bagkv"):
        return SHAPE
    found = [v for k, v in x.data if k == label]
    if how == "?":
        return V("some", found[0]) if len(found) == 1 else NONE
    return V("ok", found[0]) if len(found) == 1 else MISSING_KEY if not found else DUPLICATE_KEY


_TYPES = {type(None): "null", bool: "bool", Fraction: "num", str: "str", bytes: "bytes"}


def _is(x: Any, *kinds: str) -> bool:
    return isinstance(x, V) and x.kind in kinds


def _one(x: Any, none: Any, some: Callable) -> Any:
    if not _is(x, "seq", "set", "bag"):
        return ENR_SHAPE
    return none if not x.data else some(x.data[0]) if len(x.data) == 1 else DUPLICATE


def _end(x: Any, i: int) -> Any:
    if _is(x, "set", "bag"):
        return UNORDERED
    return (V("some", x.data[i]) if x.data else NONE) if _is(x, "seq") else ENR_SHAPE


def _normalized(x: Any) -> Any:
    if not _is(x, "bagkv"):
        return SHAPE
    return V("ok", V("map", x.data)) if len(dict(x.data)) == len(x.data) else DUPLICATE_KEY


def _path(doc: Any, steps: Any) -> Any:
    if not _is(steps, "seq"):
        return SHAPE
    for s in steps.data:
        if not (_is(doc, "map", "prod") and isinstance(s, str) and s in dict(doc.data)):
            return NONE
        doc = dict(doc.data)[s]
    return V("some", doc)


def _as_bagkv(x: Any) -> Any:
    if not (_is(x, "bag") and all(_is(b, "bind") and isinstance(b.data[0], str) for b in x.data)):
        return SHAPE
    return V("bagkv", tuple(b.data for b in x.data))


def _monad(kinds: tuple[str, str], how: str) -> Callable:
    def run(x: Any, f: Any) -> Any:
        if not _is(x, *kinds):
            return SHAPE
        if how == "else":
            return x if x.kind == kinds[0] else f
        if x.kind == kinds[1]:
            return x
        y = call(f, [x.data])
        if how == "map":
            return V(kinds[0], y)
        return y if _is(y, *kinds) else SHAPE

    return run


_BOTH_TEXT = lambda f: lambda a, b: f(a, b) if isinstance(a, str) and isinstance(b, str) else SHAPE
_BAG = lambda x: V("bag", x.data) if _is(x, "seq", "set", "bag") else ENR_SHAPE
FUNCTIONS: dict[str, tuple[int, Callable]] = {
    "typeOf": (1, lambda x: x.kind if isinstance(x, V) else _TYPES[type(x)]),
    "keys": (1, lambda m: V("set", tuple(sorted(dict(m.data)))) if _is(m, "map") else SHAPE),
    "values": (1, lambda m: V("seq", tuple(v for _, v in sorted(m.data, key=lambda p: p[0]))) if _is(m, "map") else SHAPE),
    "count": (2, lambda x, b: Fraction(sum(key_of(x) == key_of(y) for y in b.data)) if _is(b, "bag") else SHAPE),
    "normalizeUnique": (1, _normalized),
    "Bind": (2, lambda k, v: V("bind", (k, v))),
    "asBagKV": (1, _as_bagkv),
    "mapOpt": (2, _monad(("some", "none"), "map")),
    "bindOpt": (2, _monad(("some", "none"), "bind")),
    "orElseOpt": (2, _monad(("some", "none"), "else")),
    "mapRes": (2, _monad(("ok", "fail"), "map")),
    "bindRes": (2, _monad(("ok", "fail"), "bind")),
    "orElseRes": (2, _monad(("ok", "fail"), "else")),
    "getPath": (2, _path),
    "startsWith": (2, _BOTH_TEXT(lambda a, b: a.startswith(b))),
    "strContains": (2, _BOTH_TEXT(lambda a, b: b in a)),
    "oneOpt": (1, lambda x: _one(x, NONE, lambda v: V("some", v))),
    "oneReq": (1, lambda x: _one(x, MISSING, lambda v: v)),
    "only": (1, lambda x: _one(x, MISSING, lambda v: v)),
    "first": (1, lambda x: _end(x, 0)),
    "last": (1, lambda x: _end(x, -1)),
    "merge": (2, lambda a, b: _merged(a, b, "fail")),
    "mergeFail": (2, lambda a, b: _merged(a, b, "fail")),
    "mergeLeft": (2, lambda a, b: _merged(a, b, "left")),
    "mergeRight": (2, lambda a, b: _merged(a, b, "right")),
    "asBag": (1, _BAG),
    "matchBag": (1, _BAG),
    "Some": (1, lambda x: V("some", x)),
    "Ok": (1, lambda x: V("ok", x)),
    "Fail": (2, lambda c, m: fail(c, m) if isinstance(c, str) and isinstance(m, str) else SHAPE),
    "Bytes": (1, lambda s: bytes.fromhex(s) if isinstance(s, str) and re.fullmatch("(?:[0-9a-fA-F]{2})*", s) else SHAPE),
    "Match": (4, lambda left, right, a, b: _match(left, right, a, b)),
}


def _match(left: Any, right: Any, a: Any, b: Any) -> Any:
    """The members of right whose key equals that of left, in one pass over right; match_rows joins whole tables so."""
    if not _is(right, "seq", "set", "bag"):
        return ENR_SHAPE
    want = key_of(call(a, [left]))
    return V("bag", tuple(r for r in right.data if key_of(call(b, [r])) == want))


def call(f: Any, args: list) -> Any:
    if not _is(f, "fn"):
        return NOT_CALLABLE
    if isinstance(f.data, Builtin):
        return f.data.run(*args) if len(args) == f.data.arity else ARITY
    name, body, env = f.data
    return ARITY if len(args) != 1 else evaluate(body, {**env, name: args[0]})


def evaluate(e: tuple, env: dict[str, Any]) -> Any:
    """An expression's value. What would have to compare functions has a wrong shape."""
    try:
        return _evaluated(e, env)
    except Unkeyable:
        return SHAPE


def _evaluated(e: tuple, env: dict[str, Any]) -> Any:
    kind = e[0]
    if kind == "lit":
        return e[1]
    if kind == "name":
        if e[1] in env:
            return env[e[1]]
        return V("fn", Builtin(*FUNCTIONS[e[1]])) if e[1] in FUNCTIONS else UNBOUND
    if kind == "hole":
        return env.get("_", UNBOUND_HOLE)
    if kind == "make":
        items = tuple(evaluate(x, env) for x in e[2])
        return V(e[1], unique(items) if e[1] == "set" else items)
    if kind == "pairs":
        return V(e[1], tuple((k, evaluate(x, env)) for k, x in e[2]))
    if kind == "op":
        return _binary(e[1], evaluate(e[2], env), evaluate(e[3], env))
    if kind == "neg":
        x = evaluate(e[1], env)
        return -x if isinstance(x, Fraction) else SHAPE
    if kind == "not":
        x = evaluate(e[1], env)
        return (not x) if isinstance(x, bool) else SHAPE
    if kind == "fn":
        return V("fn", (e[1], e[2], env))
    if kind == "pipe":
        return evaluate(e[2], {**env, "_": evaluate(e[1], env)})
    if kind == "select":
        return _select(evaluate(e[1], env), e[2], e[3])
    if kind == "call":
        if e[1][0] == "name" and e[1][1] not in env and e[1][1] in FUNCTIONS:
            n, f = FUNCTIONS[e[1][1]]
            return call(V("fn", Builtin(n, f)), [evaluate(x, env) for x in e[2]])
        return call(evaluate(e[1], env), [evaluate(x, env) for x in e[2]])
    if kind == "enrich":
        return _enriched(evaluate(e[1], env), e[2], env)
    return _each(e, env)


def _enriched(rows: Any, fields: list, env: dict[str, Any]) -> Any:
    if not _is(rows, "seq", "set", "bag"):
        return ENR_SHAPE
    out = []
    for row in rows.data:
        if not _is(row, "map", "prod"):
            return ENR_SHAPE
        row = _merged(row, V(row.kind, tuple((k, evaluate(x, {**env, "l": row, "_": row})) for k, x in fields)), "fail")
        if _is(row, "fail"):
            return row
        out.append(row)
    return V(rows.kind, tuple(out))


def _each(e: tuple, env: dict[str, Any]) -> Any:
    _, name, source, test, made = e
    x = evaluate(source, env)
    if not _is(x, "seq", "set", "bag", "bagkv"):
        return SHAPE
    out = []
    for item in x.data if x.kind != "bagkv" else [V("bind", p) for p in x.data]:
        inner = {**env, name: item}
        keep = True if test is None else evaluate(test, inner)
        if not isinstance(keep, bool):
            return SHAPE
        if keep:
            out.append(evaluate(made, inner) if made else item)
    if x.kind != "set":
        return V("seq" if x.kind == "seq" else "bag", tuple(out))
    try:
        return V("set", unique(out))
    except Unkeyable:
        return SHAPE


def run(source: str, env: dict[str, Any] | None = None) -> Any:
    """Runs a program over JSON values and gives its last expression as JSON."""
    return to_json(run_parsed(parse(source), {k: from_json(v) for k, v in (env or {}).items()}))


def run_parsed(program: list, env: dict[str, Any]) -> Any:
    try:
        return _run_steps(program, env)
    except RecursionError:
        return TOO_DEEP


def _run_steps(program: list, env: dict[str, Any]) -> Any:
    env, out = dict(env), None
    for step in program:
        if step[0] == "let":
            env[step[1]] = evaluate(step[2], env)
        else:
            out = evaluate(step[1], env)
    return out


_NAME = re.compile(r"[^\W\d]\w*")
_LEVEL = {op: n for n, ops in enumerate(_LEVELS) for op in ops}


def formatted_program(program: list) -> str:
    """The canonical source of a parsed program: a step a line, single spaces, brackets only where they are needed."""
    return "\n".join(f"let {step[1]} = {_source(step[2])};" if step[0] == "let" else f"{_source(step[1])};" for step in program)


def _decimal(x: Fraction) -> str:
    """A number as a program writes it: all digits, as its parser reads decimals alone."""
    places = 0
    while (x * 10**places).denominator != 1:
        places += 1
    digits = str(int(x * 10**places)).zfill(places + 1)
    return f"{digits[:-places]}.{digits[-places:]}" if places else digits


def _label(text: str) -> str:
    return text if _NAME.fullmatch(text) else json.dumps(text, ensure_ascii=False)


def _source(e: tuple, level: int = -2) -> str:
    """level: what stands around binds as tightly as that; looser expressions get brackets."""
    kind = e[0]
    if kind == "lit":
        return _decimal(e[1]) if isinstance(e[1], Fraction) else formatted(e[1])
    if kind in ("name", "hole"):
        return {"oneOpt": "one?", "oneReq": "one!"}.get(e[1], e[1]) if kind == "name" else "_"
    if kind == "make":
        a, b = ("[", "]") if e[1] == "seq" else ("{", "}")
        return f"{e[1].capitalize()}{a}{', '.join(map(_source, e[2]))}{b}"
    if kind == "pairs":
        name, mark = {"map": ("Map", " -> "), "prod": ("Prod", ": "), "bagkv": ("BagKV", " -> ")}[e[1]]
        return f"{name}{{{', '.join((_label(k) if e[1] == 'prod' else json.dumps(k, ensure_ascii=False)) + mark + _source(x) for k, x in e[2])}}}"
    if kind == "each":
        made = f"yield {_source(e[4])} | " if e[4] else ""
        return f"{{ {made}{e[1]} in {_source(e[2], 3)}{f' | {_source(e[3])}' if e[3] else ''} }}"
    if kind == "call":
        return f"{_source(e[1], len(_LEVELS) + 1)}({', '.join(map(_source, e[2]))})"
    if kind == "select":
        return f"{_source(e[1], len(_LEVELS) + 1)}<{_label(e[2])}>{e[3]}"
    own, text = _loose_source(e)
    return f"({text})" if own < level else text


def _loose_source(e: tuple) -> tuple[int, str]:
    """How tightly an operator's expression binds, and its source."""
    kind, tight = e[0], len(_LEVELS)
    if kind == "pipe":
        return -2, f"{_source(e[1], -2)} |> {_source(e[2], -1)}"
    if kind == "enrich":
        return -2, f"{_source(e[1], -2)} |> enrich {{ {', '.join(f'{_label(k)}: {_source(x)}' for k, x in e[2])} }}"
    if kind == "fn":
        return -1, f"{e[1]} => {_source(e[2], -1)}"
    if kind == "not":
        return 2, f"not {_source(e[1], 2)}"
    if kind == "neg":
        return tight, f"-{_source(e[1], tight)}"
    n = _LEVEL[e[1]]
    left = n + 1 if n == 2 else n
    return n, f"{_source(e[2], left)} {e[1]} {_source(e[3], n + 1)}"


def formatted(e: Any) -> str:
    """The canonical source of a value."""
    if isinstance(e, V):
        if e.kind in ("seq", "set", "bag"):
            a, b = ("[", "]") if e.kind == "seq" else ("{", "}")
            return f"{e.kind.capitalize()}{a}{', '.join(map(formatted, e.data))}{b}"
        if e.kind in ("map", "prod", "bagkv"):
            name = {"map": "Map", "prod": "Prod", "bagkv": "BagKV"}[e.kind]
            return f"{name}{{{', '.join(f'{k}: {formatted(v)}' if e.kind == 'prod' else f'{json.dumps(k)} -> {formatted(v)}' for k, v in e.data)}}}"
        if e.kind == "none":
            return "None"
        args = e.data if isinstance(e.data, tuple) and e.kind in ("fail", "bind") else (e.data,)
        return f"{e.kind.capitalize()}({', '.join(map(formatted, args))})"
    if isinstance(e, bytes):
        return f'Bytes("{e.hex()}")'
    if isinstance(e, Fraction):
        return str(e.numerator) if e.denominator == 1 else f"{e.numerator} / {e.denominator}"
    return json.dumps(e, ensure_ascii=False)
