"""Parts of the language and its surfaces that other tests don't touch."""

import pytest

from nestloom.errors import QueryError
from nestloom.functions.algebra import run
from nestloom.operators.multi import MultiQuery
from nestloom.plans import dialects
from nestloom.plans.text import parse
from nestloom.sources.session import Session


def keys(df):
    return sorted(r["_key"] for r in df.collect())


@pytest.fixture
def s(spark):
    s = Session(spark)
    s.bind("posts", spark.createDataFrame([("p1", "u1", ["a", "b"], [(1, [5, 6])]), ("p2", "u2", [], [(2, [7])]), ("p3", "u9", ["b"], [])], "_key string, author string, tags array<string>, parts array<struct<n:int,xs:array<int>>>"), "_key")
    s.bind("users", spark.createDataFrame([("k1", "u1", "Ada"), ("k2", "u2", "Bob")], "_key string, id string, name string"), "_key")
    s.bind("nested", spark.createDataFrame([("n1", [("g", [(1, "x"), (5, "y")]), ("h", [])])], "_key string, groups array<struct<name:string,items:array<struct<q:int,w:string>>>>"), "_key")
    return s


def test_scans(s, spark):
    c = s.collection("users")
    assert [r.id for r in c.scan_iter()] == ["u1", "u2"] and s.list_collections() == ["nested", "posts", "users"]
    rows, holes = c.scan_partial()
    assert rows.count() == 2 and holes is None and keys(c.scan_keys()) == ["k1", "k2"]
    broken = s.bind_json("broken", spark.createDataFrame([("a", "{}"), ("b", "{")], "_key string, value string"))
    assert broken.scan_partial()[0].count() == broken.scan_partial()[1].count() == 1
    with pytest.raises(QueryError, match="rql_coverage_incomplete"):
        broken.scan_keys()


@pytest.mark.parametrize(("test", "want"), [('contains(tags, "a")', "p1"), ('tags contains "b"', "p1 p3"), ('tags = ["a", "b"]', "p1"), ("tags = []", "p2"), ('tags in [["b"], []]', "p2 p3"), ('tags != ["b"]', "p1 p2"), ('not contains(tags, "b")', "p2")])
def test_arrays(s, test, want):
    assert keys(s.run_all(f"from posts where {test}")) == want.split()


def test_second_form_of_enrich(s):
    one = s.run_all("from posts enrich u from users on author = id expect optional project { name: u.name }")
    two = s.run_all("from posts enrich u using users matching author = id expect optional project { name: u.name }")
    assert one.collect() == two.collect() and {r["_key"]: r["name"] for r in one.collect()} == {"p1": "Ada", "p2": "Bob", "p3": None}


def test_within_inside_within(s):
    got = s.run_all("from nested within groups as g { within items as i { where i.q > 2 project { w } } project { name, items } }")
    assert [(g.name, [x.w for x in g["items"]]) for r in got.collect() for g in r.groups] == [("g", ["y"]), ("h", [])]


def test_sources_of_a_join(s):
    q = MultiQuery(s).from_("posts", "p").join("users", "u").on("author", "id")
    assert [r.p["_key"] for r in q.include_keys().limit(1).collect_frame().collect()] == ["p1"]
    assert MultiQuery(s).from_("posts", "p").source_limit(1).join("users", "u").on("author", "id").collect_frame().count() == 1
    with pytest.raises(QueryError, match="rql_budget_exceeded"):
        MultiQuery(s).from_("posts", "p").source_budget(2).join("users", "u").on("author", "id").collect_frame()
    with pytest.raises(QueryError, match="duplicate_alias"):
        MultiQuery(s).from_("posts", "p").join("users", "p")
    twice = MultiQuery(s).from_("users", "a").join("users", "b").on("id", "id").collect_frame()
    assert sorted((r.a.name, r.b.name) for r in twice.collect()) == [("Ada", "Ada"), ("Bob", "Bob")]


def test_own_dialects(s):
    dialects.register("only", lambda text: dialects.object_filter({"id": text}))
    assert keys(s.collection("users").where(dialects.compile_dialect("only", "u2"))) == ["k2"]
    assert keys(s.collection("users").where(dialects.compile_dialect("sql", "name <> 'Bob' AND nothing IS NULL"))) == ["k1"]
    assert keys(s.collection("users").where(dialects.compile_dialect("json", '{"name": {"$not": {"$eq": "Bob"}}}'))) == ["k1"]
    with pytest.raises(QueryError, match="dialect_unavailable"):
        dialects.compile_dialect("nope", "")


def test_consistency_and_coverage_are_carried(s):
    page = s.run("from users consistency current coverage incomplete page size 1")
    assert (page.consistency, page.coverage, page.exhausted) == ("current", "incomplete", False)
    assert parse("from users consistency current").hash() != parse("from users").hash()


def test_numbers_of_aggregates(s, spark):
    s.bind("v", spark.createDataFrame([("a", 1, 2**40), ("b", 2, 1)], "_key string, i int, l bigint"), "_key")
    got = s.run_all("from v project count() as n, sum(i) as a, max(l) as b, avg(i) as c").collect()[0]
    assert (got.n, got.a, got.b, got.c) == (2, 3.0, float(2**40), 1.5)


FAIL = {"$type": "fail", "$code": "c", "$msg": "m"}


@pytest.mark.parametrize(
    ("program", "want"),
    [
        ('"a" ++ "b" ++ "";', "ab"),
        ("Seq[1] ++ Seq[2, 3];", [1, 2, 3]),
        ("2 in Set{1, 2} and not (3 in Bag{1}) and \"k\" in Map{\"k\" -> 1};", True),
        ("Bind(\"a\", 1);", {"$type": "bind", "$key": "a", "$val": 1}),
        ('asBagKV(Bag{Bind("a", 1), Bind("a", 2)});', {"$type": "bagkv", "$items": [["a", 1], ["a", 2]]}),
        ("asBag(Seq[2, 1, 2]);", {"$type": "bag", "$items": [1, 2, 2]}),
        ("mapRes(Ok(2), x => x * 3);", {"$type": "ok", "$value": 6}),
        ('mapRes(Fail("c", "m"), x => x);', FAIL),
        ('bindRes(Ok(1), x => Fail("c", "m"));', FAIL),
        ('orElseRes(Fail("c", "m"), Ok(9));', {"$type": "ok", "$value": 9}),
        ("orElseRes(Ok(1), Ok(9));", {"$type": "ok", "$value": 1}),
        ("bindOpt(Some(4), x => None) |> orElseOpt(_, Some(0));", {"$type": "some", "$value": 0}),
        ('Seq[Prod{a: 1}, Prod{a: 5}] |> enrich { b: l<a> * 2 } |> { yield r<b> | r in _ };', [2, 10]),
        ("let double = x => x * 2; double(double(3));", 12),
        ("let f = startsWith; f(\"abc\", \"ab\");", True),
        ("Match(Prod{k: 1}, Seq[Prod{k: 1, v: 2}, Prod{k: 3, v: 4}], a => a<k>, b => b<k>);", {"$type": "bag", "$items": [{"$type": "prod", "$fields": {"k": 1, "v": 2}}]}),
        ('Bytes("00ff");', {"$type": "bytes", "$base16": "00ff"}),
        ("values(Map{\"b\" -> 1, \"a\" -> 2});", [2, 1]),
        ("Prod{a: 1} + Prod{b: 2};", {"$type": "prod", "$fields": {"a": 1, "b": 2}}),
        ("Set{1, 2} union Set{3} diff Set{1};", {"$type": "set", "$items": [2, 3]}),
    ],
)
def test_functions_of_the_algebra(program, want):
    assert run(program) == want
