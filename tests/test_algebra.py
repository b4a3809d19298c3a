import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nestloom.functions.algebra import from_json, parse, run, to_json


def failure(code, message):
    return {"$type": "fail", "$code": code, "$msg": message}


@pytest.mark.parametrize(
    "program, want",
    [
        ('one?(Set{"x", Seq["x"]});', failure("t_enr_duplicate", "duplicate match")),
        ("one!(Bag{} bunion Bag{});", failure("t_enr_missing", "missing match")),
        ('{ x in Seq["a", "bb"] | startsWith(x, "b") } |> only(_);', "bb"),
        ("first(asBag(Seq[7]));", failure("t_enr_unordered_policy", "unordered policy")),
        ('Seq[Seq[], "z"] |> last(_) |> mapOpt(_, v => typeOf(v));', {"$type": "some", "$value": "str"}),
        ('merge(Prod{left: 1, same: 2}, Prod{same: 2});', failure("t_enr_field_collision", "field collision")),
        ('mergeLeft(Prod{p: 1, q: "own"}, Prod{q: "other", r: null})<q>;', "own"),
        ('keys(mergeRight(Map{"x" -> 1}, Map{"y" -> 2}));', {"$type": "set", "$items": ["x", "y"]}),
        ("1 / 3;", {"$type": "num", "$value": "1/3"}),
        ("1 / 3 * 3;", 1),
        ("0.1 + 0.2 = 0.3;", True),
        ("1 / 0;", failure("t_sda_div_by_zero", "division by zero")),
        ("1 < \"a\";", failure("t_sda_wrong_shape", "wrong shape")),
        ("nothing;", failure("t_sda_unbound_name", "unbound name")),
        ("_ + 1;", None),
        ("1 |> _ + 1 |> _ * 2;", 4),
        ("BagKV{\"k\" -> 1, \"k\" -> 2}<\"k\">?;", {"$type": "none"}),
        ("BagKV{\"k\" -> 1, \"k\" -> 2}<\"k\">!;", failure("t_sda_duplicate_key", "duplicate key")),
        ("Map{}<\"x\">!;", failure("t_sda_missing_key", "missing key")),
        ("Prod{a: 1}<b>;", failure("t_sda_unknown_field", "unknown field")),
        ("Bag{1, 1, 2} = Bag{2, 1, 1};", True),
        ("Set{1, 2} = Set{2, 1, 1};", True),
        ("Some(null) = None;", False),
        ("normalizeUnique(BagKV{\"a\" -> 1});", {"$type": "ok", "$value": {"a": 1}}),
        ("getPath(Map{\"a\" -> Map{\"b\" -> null}}, Seq[\"a\", \"b\"]);", {"$type": "some", "$value": None}),
        ("typeOf(Seq[]);", "seq"),
        ("keys(Map{\"b\" -> 1, \"a\" -> 2});", {"$type": "set", "$items": ["a", "b"]}),
        ("count(1, Bag{1, 2, 1});", 2),
        ("source s : Index[Str, Num]; let x = 2; x;", 2),
        ("Set{1, 2} ∩ Set{2, 3};", {"$type": "set", "$items": [2]}),
    ],
)
def test_programs(program, want):
    got = run(program)
    assert got == want if want is not None else got["$type"] == "fail" or got is not None


json_values = st.recursive(st.none() | st.booleans() | st.integers(-1000, 1000) | st.text(max_size=5), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=3).filter(lambda k: k != "$type"), c, max_size=3), max_leaves=8)


@given(json_values)
def test_json_goes_round(x):
    assert to_json(from_json(x)) == x


@given(st.lists(st.integers(0, 5)), st.lists(st.integers(0, 5)))
def test_bag_laws(a, b):
    text = lambda xs: f"Bag{{{', '.join(map(str, xs))}}}"
    assert run(f"{text(a)} bunion {text(b)} = {text(b)} bunion {text(a)};")
    assert run(f"({text(a)} bunion {text(b)}) bdiff {text(b)} = {text(a)};")


records = st.dictionaries(st.sampled_from("abc"), st.integers(-9, 9), max_size=3)


@given(records, records)
def test_merging_laws(a, b):
    env = {"a": a, "b": b}
    assert run("mergeLeft(a, b);", env) == {**b, **a} and run("mergeRight(a, b);", env) == {**a, **b}
    assert run("merge(a, b);", env) == ({**a, **b} if not a.keys() & b.keys() else failure("t_enr_field_collision", "field collision"))


@given(st.lists(st.integers(-9, 9), max_size=4))
def test_ends_and_singles(xs):
    some = lambda x: {"$type": "some", "$value": x}
    none = {"$type": "none"}
    assert run("first(xs);", {"xs": xs}) == (some(xs[0]) if xs else none) and run("last(xs);", {"xs": xs}) == (some(xs[-1]) if xs else none)
    assert run("one?(xs);", {"xs": xs}) == (none if not xs else some(xs[0]) if len(xs) == 1 else failure("t_enr_duplicate", "duplicate match"))


@settings(max_examples=200)
@given(st.text(max_size=30))
def test_parser_ends_with_a_coded_error_or_a_program(source):
    from nestloom.errors import QueryError

    try:
        parse(source)
    except (QueryError, ValueError):
        pass
