"""The stages on a small table with odd rows, each against what it should do."""

import corpus_pipeline
from nestloom.llm import queries
from tests.llm.test_corpus import brute_components


def test_stages(spark):
    schema = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").schema
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*schema.names)
    odd = [(-1, None, "en", "src0", 0), (-2, "12345", None, None, 5), (-3, "the house is on the hill", "en", None, 24), (-3, "the house is on the hill", "en", None, 24)]
    docs = docs.unionByName(spark.createDataFrame(odd, schema))
    stages = dict(corpus_pipeline.STAGES)
    one = stages["language_id"](spark, docs, "").cache()
    assert one.columns == docs.columns and {r.doc_id for r in docs.collect()} - {r.doc_id for r in one.collect()} == {-1, -2}
    two = stages["near_duplicates"](spark, one, "").cache()
    want = {i for i, (_, c) in brute_components([(r.doc_id, r.text) for r in one.collect()], 5).items() if i == c}
    ids = [r.doc_id for r in two.collect()]
    assert set(ids) == want and len(ids) == len(want) and two.columns == docs.columns
    three = stages["mix_sources"](spark, two, "").cache()
    assert three.columns == docs.columns and three.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 2
    four = stages["byte_bpe"](spark, three, "")
    assert four.count() == three.count() and all(len(r.ids) == 4 * r.n_tokens for r in four.collect())


def test_stages_of_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, component_id int"
    house, tree = "the house is on the hill and the sea is near to it", "of all the trees this is the one that they have in the garden"
    rows = [(None, house, "en", "s", 1, "x", "y", 1), (3, house, "en", "s", 1, "x", "y", 1), (None, tree, "en", None, 1, "x", "y", 1), (None, tree, None, None, 1, "x", "y", 1), (None, "123", "en", "s", 1, "x", "y", 1), (None, None, None, None, None, None, None, None)]
    rows += [(10 + i, r.text, r.lang, r.source, r.n_chars, "x", "y", 2) for i, r in enumerate(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) > 60").limit(40).collect())]
    docs = spark.createDataFrame(rows, schema)
    stages = dict(corpus_pipeline.STAGES)
    one = stages["language_id"](spark, docs, "").cache()
    assert one.columns == docs.columns and one.where("doc_id is null").count() == 3 and one.count() == len(rows) - 2
    two = stages["near_duplicates"](spark, one, "").cache()
    assert two.columns == docs.columns and [r.text for r in two.where("doc_id is null").collect()] == [tree]  # the house has an id elsewhere
    three = stages["mix_sources"](spark, docs, "").cache()
    assert three.columns == docs.columns and three.where("doc_id is null").groupBy("text").count().agg({"count": "max"}).first()[0] <= 2
    assert stages["byte_bpe"](spark, three, "").count() == three.count()
    for stage in stages.values():
        assert stage(spark, docs.limit(0), "").count() == 0


def test_eleven_queries():
    names = list(queries.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "mix_sources", "byte_bpe"]
