"""Keys, joins, budgets, pages, changes and views of collections."""

import pytest
from pyspark.sql import functions as F

from nestloom.errors import QueryError
from nestloom.operators import coverage
from nestloom.plans.build import choice, field
from nestloom.plans.text import parse
from nestloom.sources import session
from nestloom.sources.session import Session, attach, block, inside, keep


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def keys(df):
    return sorted(r["_key"] for r in df.collect())


@pytest.fixture
def stored(spark, tmp_path):
    spark.range(100).selectExpr("id", "cast(id % 7 as int) as part", "concat('n', id) as name", "id * 0.5D as amount").write.parquet(str(tmp_path / "t"))
    s = Session(spark, secret=b"k")
    s.bind("t", spark.read.parquet(str(tmp_path / "t")), "id")
    s.bind("two", spark.read.parquet(str(tmp_path / "t")), ["part", "id"])
    s.bind("named", spark.read.parquet(str(tmp_path / "t")), "name")
    return s


def test_keys_reach_the_scan(stored):
    c = stored.collection("t")
    assert "EqualTo(id,7)" in plan_of(c.find("7")) and c.get("7").name == "n7"
    assert c.get("07") is None and c.get("x") is None and c.get("-1") is None and c.get(str(1 << 70)) is None
    assert "EqualTo(name,n3)" in plan_of(stored.collection("named").find("n3"))
    assert stored.collection("two").get("3/10").id == 10 and stored.collection("two").get("4/10") is None
    assert "EqualTo(part,3)" in plan_of(stored.collection("two").find("3/10"))


def test_many_keys_are_filtered_where_they_are_read(stored):
    c = stored.collection("t")
    got = c.get_many(["5", "nope", "5", "99", "007"])
    assert sorted((r["_key"], r.found_, r.id) for r in got.collect()) == [("007", False, None), ("5", True, 5), ("99", True, 99), ("nope", False, None)]
    assert "In(id, [5,99])" in plan_of(got)
    many = c.get_many([str(i) for i in range(1000)])
    assert many.where("found_").count() == 100 and "Exchange hashpartitioning(_key" not in plan_of(many).split("Scan parquet")[0].split("LeftSemi")[-1]
    assert stored.collection("two").get_many(["3/10", "x"]).where("found_").count() == 1


def test_what_is_attached_is_pruned(stored):
    got = stored.run_all("from t enrich items using two matching part = id expect many within items as i { where i.amount > 1 project { a: amount } }")
    scans = plan_of(got).split("Scan parquet")
    assert any("ReadSchema: struct<id:bigint,part:int,amount:double>" in x and "GreaterThan(amount" in x for x in scans)
    assert {r["_key"]: [x.a for x in r["items"]] for r in got.where("id in (3, 2)").collect()} == {"3": [1.5], "2": []}
    unread = stored.run_all("from t enrich items using two matching part = id expect many project { id }")
    assert "Join" not in plan_of(unread) and unread.count() == 100
    few = stored.run_all("from t enrich items using two matching part = id expect many project { id, items { amount } }")
    assert any("ReadSchema: struct<id:bigint,part:int,amount:double>" in x for x in plan_of(few).split("Scan parquet"))


def test_null_keys_match_where_null_is_a_value(spark):
    left = spark.createDataFrame([("a", 1), ("b", None)], "_key string, k int")
    right = spark.createDataFrame([("x", 1, "one"), ("y", None, "none")], "_key string, k int, v string")
    for means, want in (("null", {"a": ["one"], "b": ["none"]}), ("absent", {"a": ["one"], "b": []})):
        s = Session(spark)
        s.bind("l", left, "_key", null_means=means)
        s.bind("r", right, "_key", null_means=means)
        got = s.run_all("from l enrich m using r matching k = k expect many")
        assert {r["_key"]: [x.v for x in r.m] for r in got.collect()} == want
        got = s.run_all("from l enrich m using r matching k = k expect optional project { v: m.v }")
        assert {r["_key"]: r.v for r in got.collect()} == {k: (v or [None])[0] for k, v in want.items()}
        assert keys(s.run_all("from l enrich m using r matching k = k expect many where m = [] project { k }")) == [k for k, v in want.items() if not v]


def test_fields_may_have_the_names_of_helpers(spark):
    s = Session(spark)
    s.bind("l", spark.createDataFrame([("a", 1, 2, 3, 4)], "_key string, left_ int, match_ int, n_ int, got_ int"), "_key")
    s.bind("r", spark.createDataFrame([("x", 1, 9)], "_key string, match_ int, hit_ int"), "_key")
    got = s.run_all("from l enrich m using r matching left_ = match_ expect exactly_one").collect()[0]
    assert (got.left_, got.match_, got.n_, got.got_, got.m.hit_) == (1, 2, 3, 4, 9)


def test_a_text_that_is_no_time_matches_nothing(spark):
    s = Session(spark)
    s.bind("e", spark.sql("select 1 as id, timestamp'2020-01-01' as at"), "id")
    assert s.run_all('from e where at > "soon" or at = "soon"').count() == 0
    assert s.run_all('from e where at != "soon"').count() == 1 and s.run_all('from e where at >= "2020-01-01"').count() == 1


def test_budgets_hold(stored):
    with pytest.raises(QueryError, match="documents > 5"):
        stored.run_all("from t budget { documents: 5 }")
    got = stored.run_whole("from t budget { documents: 5 } coverage incomplete")
    assert keys(got.rows) == ["0", "1", "10", "11", "12"] and got.stopped == ("documents",)
    for name in ("bytes", "result_bytes"):
        with pytest.raises(QueryError, match=f"{name} > 200"):
            stored.run_all(f"from t budget {{ {name}: 200 }}")
        got = stored.run_whole(f"from t order by id asc budget {{ {name}: 200 }} coverage incomplete")
        assert 0 < got.rows.count() < 6 and got.stopped == (name,)
        assert stored.run_all(f"from t budget {{ {name}: 100000 }}").count() == 100
    assert stored.run("from t budget { documents: 5 } coverage incomplete").diagnostics == ("documents",)
    s = stored
    s.bind("tight", s.binding("t").df, "_key", budget={"documents": 3})
    with pytest.raises(QueryError, match="documents > 3"):
        s.run_all("from tight budget { documents: 50 }")


def test_explain_gives_no_rows(stored):
    got = stored.run_all("explain from t where id > 5").collect()
    assert len(got) == 1 and got[0].hash == parse("from t where id > 5").hash()


def test_tokens_belong_to_a_generation(spark, stored):
    c = stored.collection("t")
    page, token = c.scan_page(10)
    assert keys(page) == sorted(str(i) for i in range(100))[:10]
    assert keys(c.scan_page(5, token)[0]) == sorted(str(i) for i in range(100))[10:15]
    with pytest.raises(QueryError, match="rql_cursor_mismatch"):
        c.scan_keys_page(5, token)
    with pytest.raises(QueryError, match="rql_cursor_mismatch"):
        stored.collection("two").scan_page(5, token)
    c.delete(spark.createDataFrame([("1",)], "_key string"))
    with pytest.raises(QueryError, match="rql_cursor_mismatch"):
        c.scan_page(5, token)


def test_pages_report_gaps(spark):
    s = Session(spark)
    c = s.bind_json("d", spark.createDataFrame([("a", "{}"), ("b", "{oops"), ("c", "{}"), ("d", "{oops")], "_key string, value string"))
    got, token, gaps = c.scan_keys_page(3)
    assert (keys(got), keys(gaps), token is None) == (["a", "c"], ["b"], False)
    got, token, gaps = c.scan_keys_page(3, token)
    assert (keys(got), keys(gaps), token) == ([], ["d"], None)
    page, _ = c.scan_covered_page(4)
    assert [(r["_key"], r.status, r.document is None) for r in page.orderBy("_key").collect()] == [("a", "present", False), ("b", "hole", True), ("c", "present", False), ("d", "hole", True)]
    assert {r["_key"]: r.status for r in c.covered(["a", "b", "z"]).collect()} == {"a": "present", "b": "hole", "z": "absent"}


def test_changes(spark):
    s = Session(spark)
    c = s.bind("d", spark.createDataFrame([("a", 1), ("b", 2)], "_key string, v int"), "_key")
    put = lambda *rows: spark.createDataFrame(rows, "_key string, v int, at int")
    with pytest.raises(QueryError, match="key_repeated"):
        c.put(put(("c", 1, 1), ("c", 2, 2)))
    receipt = c.put(put(("c", 1, 1), ("c", 2, 2), ("a", 5, 1)), version="at")
    assert (receipt.operation, receipt.generation, keys(receipt.keys)) == ("put", 1, ["a", "c"])
    c.put(put(("e", 7, 1), ("e", 7, 1)))
    assert sorted(map(tuple, c.df.collect())) == [("a", 5), ("b", 2), ("c", 2), ("e", 7)]
    before = c.digests().where("_key = 'a'").collect()
    expected = spark.createDataFrame(before)
    c.replace(put(("a", 6, 0)), expected)
    with pytest.raises(QueryError, match="cas_mismatch"):
        c.replace(put(("a", 8, 0)), expected)
    with pytest.raises(QueryError, match="key_missing"):
        c.replace(put(("zz", 8, 0)))
    with pytest.raises(QueryError, match="key_exists"):
        c.create(put(("b", 8, 0)))
    added = keys(c.add(spark.createDataFrame([(9,), (9,)], "v int")).keys)
    assert len(added) == 2 and c.df.where("v = 9").count() == 2


def test_read_views_tell_of_drift(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "t"))
    s = Session(spark)
    s.bind("t", spark.read.parquet(str(tmp_path / "t")), "id")
    view = s.read_view()
    assert len(view.collect("from t")) == 5 and view.drifted() == []
    s.collection("t").delete(spark.createDataFrame([("1",)], "_key string"))
    with pytest.raises(QueryError, match="read_view_drift"):
        view.run_all("from t")
    s.bind("u", spark.read.parquet(str(tmp_path / "t")), "id")
    view = s.read_view("u")
    spark.range(9).write.mode("overwrite").parquet(str(tmp_path / "t"))
    assert view.drifted() == ["u"]


def test_builders_make_the_plans_of_the_text(stored):
    q = stored.collection("t").query()
    a = q.where(field("id").gt(5) & (field("part").is_in(1, 2) | ~field("name").starts_with("n9"))).order_by("id").limit(3).coverage("incomplete").budget(documents=500)
    assert a.plan.hash() == parse('from t where id > 5 and (part in [1, 2] or not starts_with(name, "n9")) order by id limit 3 coverage incomplete budget { documents: 500 }').hash()
    b = q.enrich("items", "two", "part", "id", "many", field("amount").gt(1)).within("items", keep("amount > 2"), block(a="amount")).block(id="id", kind=choice(field("id").lt(5), "low", "high"), items=("items", {"a": "a"}))
    text = 'from t enrich items using two matching part = id where amount > 1 expect many within items { where amount > 2 project { a: amount } } project { id: id, kind: if id < 5 then "low" else "high", items: items { a: a } }'
    assert b.plan.hash() == parse(text).hash() and b.explain()["hash"] == b.plan.hash()
    assert b.run_all().collect() == stored.run_all(text).collect()
    with pytest.raises(QueryError, match="rql_syntax"):
        q.budget(rows=3)
    assert inside("a", attach("f", "t", "x", "y", "optional")).steps[0].expect == "optional"


def test_selections_order_and_limit(spark):
    s = Session(spark)
    c = s.bind("d", spark.createDataFrame([("a", 2), ("b", None), ("c", 2), ("d", 1)], "_key string, v int"), "_key")
    order = lambda q: [r["_key"] for r in q.frame().collect()]
    assert order(c.select().order_by("v")) == list("bdac") and order(c.select().order_by("v", desc=True)) == list("acdb")
    assert order(c.select(field("v").present()).order_by("v").limit(2)) == list("da") and order(c.select().limit(2)) == list("ab")
    assert c.select().order_by("v").project("v").frame().columns == ["_key", "v"]


def test_groups_are_computed_once_for_all_pages(stored):
    q = "from t group by part project part, count() as n order by part asc page size 3"
    first = stored.run(q)
    assert len(stored._groups) == 1
    second = stored.run(q, after=first.next)
    third = stored.run(q, after=second.next)
    assert [r.part for p in (first, second, third) for r in p.rows.collect()] == list(range(7)) and third.exhausted and not stored._groups


def test_scattered_scans_merge_and_go_on(spark):
    df, left = spark.range(300), [p for p in range(64) if p != 5]
    part = coverage.partition_of(F.col("id"))
    want = [str(r.id) for r in df.where(part != 5).orderBy(F.col("id").cast("string")).collect()]
    got, after = [], None
    while True:
        page = coverage.scatter_scan(df, "id", {p: "near" if p < 9 else "far" for p in left}, 70, after)
        got += [str(r.id) for r in page.rows.collect()]
        assert not page.complete and {r.part for r in page.coverage.where("state = 'unavailable'").collect()} == {5}
        assert page.coverage.where("tier = 'near'").count() == 8
        if (after := page.next) is None:
            break
    assert got == want
    assert coverage.scatter_scan(df, "id", list(range(64)), 5, test=F.col("id") > 500).complete


@pytest.fixture
def chained(stored):
    def rows(q):
        """What run() gives token by token, as pages."""
        out, after = [], None
        while True:
            page = stored.run(q, after=after)
            out.append(page.rows.collect())
            if (after := page.next) is None:
                return out

    return rows


PAGED = ["from t where id >= 3 project id order by part desc, amount asc page size 40", "from t order by part asc limit 25 page size 10", "from t where id < 0 page size 5", "from t group by part project part, count() as n order by n desc page size 3", "from t where part < 3 enrich o using named matching name = name expect exactly_one where o.part != 2 project { id, o { part } } page size 20"]


@pytest.mark.parametrize("q", PAGED)
def test_pages_and_what_they_make_together(stored, chained, monkeypatch, q):
    monkeypatch.setattr(session, "TOGETHER", 5)
    want = chained(q)
    pages = list(stored.pages(q))
    assert [p.rows.collect() for p in pages] == want and [p.exhausted for p in pages] == [False] * (len(want) - 1) + [True]
    together = stored.pages_together(q)
    assert together.collect() == sum(want, []) and together.columns == pages[0].rows.columns
    assert not stored._groups


def test_work_and_plans_do_not_grow_with_pages(stored, monkeypatch):
    sorts = []
    monkeypatch.setattr(session, "ordered", lambda *a, f=session.ordered: sorts.append(1) or f(*a))
    got = stored.pages_together("from t project id order by amount desc page size 2")
    assert [r.id for r in got.collect()] == list(range(99, -1, -1))
    assert len(sorts) == 2 and got._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_pages_of_a_changed_collection_are_refused(stored):
    pages = stored.pages("from t order by amount desc page size 30")
    next(pages), next(pages)
    stored.collection("t").delete(stored.spark.createDataFrame([("1",)], "_key string"))
    with pytest.raises(QueryError, match="rql_cursor_mismatch"):
        next(pages)
