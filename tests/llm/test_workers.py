from nestloom.llm import common


def test_make_room_drops_the_caches_of_others(monkeypatch):
    dropped = []
    monkeypatch.setattr(common, "_held", {})
    common.holds("a", lambda: dropped.append("a"))
    common.holds("b", lambda: dropped.append("b"))
    common.make_room("a")
    assert dropped == ["b"]
    common.make_room("c")
    assert dropped == ["b", "a", "b"]


def test_text_batches_keep_own_settings(spark):
    keys = (common._BATCH_KEY, common._BYTES_KEY)
    before = [spark.conf.get(k) for k in keys]
    try:
        spark.conf.set(keys[0], "77")
        spark.conf.set(keys[1], common._OWN_BYTES)
        common.text_batches(spark)
        assert [spark.conf.get(k) for k in keys] == ["77", common.TEXT_BYTES]
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)


def test_broadcasts_are_checked_by_rows_and_characters(spark, monkeypatch):
    hinted = lambda df: "broadcast" in common.small_side(df)._jdf.queryExecution().logical().toString().lower()
    monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(common, "BROADCAST_CHARS", 1000)
    assert hinted(spark.range(10)) and not hinted(spark.range(11))
    assert not hinted(spark.range(2).selectExpr("repeat('x', 600) as t")) and hinted(spark.range(2).selectExpr("repeat('x', 60) as t"))


def test_tables_of_a_block_go_but_what_is_kept(spark):
    with common.dropping(spark) as keep:
        one = common.written(spark.range(5), "one")
        kept = keep(one.where("id > 2"), "kept")
    assert kept.count() == 2
    import os

    assert not os.path.exists(one.inputFiles()[0].removeprefix("file://"))
