import os
import threading

import pytest
from pyspark.sql import functions as F

from nestloom.errors import QueryError
from nestloom.operators import coverage, history
from nestloom.sources.session import Session
from nestloom.streaming.live import current, fold_batch, folded, follow

COLUMNS = "key string, seq long, event_id long, kind string, body string"
EVENTS = [("a", 1, 1, "put", "x"), ("a", 2, 2, "put", "y"), ("a", 2, 2, "put", "y"), ("b", 3, 3, "put", "z"), ("b", 4, 4, "delete", None), ("c", 5, 5, "delete", None), ("c", 6, 6, "put", "w")]


def test_history_and_live_state(spark):
    e = spark.createDataFrame(EVENTS, COLUMNS)
    assert [r.seq for r in history.history(e, "a").collect()] == [1, 2]
    gaps = e.withColumn("known_gap_before", F.col("seq") == 2)
    assert [r.hole_before for r in history.history(gaps, "a").collect()] == [False, True]
    assert {r.key: r.body for r in history.live_state(e).collect()} == {"a": "y", "c": "w"}
    e = e.dropDuplicates()
    assert {r.key: r.body for r in history.last_complete(e).collect()} == {"a": "x"}
    assert {r.key: r.body for r in history.last_complete(e, True).collect()} == {"a": "x", "b": "z"}


def test_conflicts_have_no_winner(spark):
    r = spark.createDataFrame([("s", "n1", "a"), ("s", "n2", "b"), ("t", "n1", "a"), ("t", "n2", "a"), ("u", "n1", ""), ("u", "n2", None)], "subject string, node string, body string")
    assert [x.subject for x in history.conflicts(r).orderBy("subject").collect()] == ["s", "u"]
    assert [tuple(x) for x in history.converged(r).collect()] == [("t", "a")]


def test_unavailable_is_not_empty(spark):
    got = coverage.partition_coverage(spark.range(50), "id", [0, 1], partitions=4).collect()
    assert sorted(r.state for r in got) == ["completed"] * 2 + ["unavailable"] * 2
    assert all((r.n is None) == (r.state == "unavailable") for r in got)


def test_a_stream_folds_to_the_live_state(spark, tmp_path):
    e = spark.createDataFrame(EVENTS, COLUMNS)
    e.where("seq <= 3").coalesce(1).write.parquet(str(tmp_path / "in"))
    q = follow(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    e.where("seq > 3").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = follow(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    got = current(spark, str(tmp_path / "out"), e.schema)
    assert {r.key: r.body for r in got.where("kind = 'put'").collect()} == {r.key: r.body for r in history.live_state(e).collect()}
    assert folded(got, e.limit(0)).count() == 3


def test_batches_write_what_they_touch_and_may_be_repeated(spark, tmp_path):
    out = str(tmp_path / "out")
    frames = [spark.createDataFrame([(f"k{i}", n, n, "put", f"{n}") for i in keys], COLUMNS) for n, keys in enumerate([range(40), [1], [1], [2]])]
    for n, f in enumerate(frames):
        fold_batch(f, n, out, buckets=8)
        fold_batch(f, n, out, buckets=8)  # as after a failure
        assert current(spark, out, f.schema).count() == 40
    state = {r.key: r.body for r in current(spark, out, frames[0].schema).collect()}
    assert (state["k1"], state["k2"], state["k3"]) == ("2", "3", "0")
    assert len(os.listdir(f"{out}/v1")) - ("_SUCCESS" in os.listdir(f"{out}/v1")) - sum(x.endswith(".crc") for x in os.listdir(f"{out}/v1")) == 0


def test_deadlines_and_cancellation(spark):
    slow = spark.range(0, 4, 1, 4).withColumn("x", F.expr("reduce(sequence(1, 3000000), 0D, (a, i) -> a + sqrt(i * (id + 1)) % 7)"))
    s = Session(spark)
    s.bind("slow", slow, "id")
    s.bind("fast", spark.range(3), "id")
    assert len(s.collect("from fast", deadline=60, cancel=threading.Event())) == 3
    stop = threading.Event()
    stop.set()
    for limits in ({"deadline": 0.1}, {"cancel": stop}):
        with pytest.raises(QueryError) as e:
            s.collect("from slow where x > 0", **limits)
        assert e.value.code == "resource_limit"
    assert len(s.collect("from fast")) == 3
