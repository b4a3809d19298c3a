"""Results that must not depend on a table's size or on a list of known cases."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from nestloom.llm import ann, html_text, langid


def recall(spark, path, n, queries=40):
    v = np.random.default_rng(8).standard_normal((n, 64)).astype(np.float32)
    vectors = pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), 64).cast(pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": vectors}), path, row_group_size=20_000)
    every = n // queries
    got: dict[int, set[int]] = {}
    for r in ann.nearest(spark.read.parquet(path), every=every).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    x = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
    hits = 0
    for q in range(0, n, every):
        s = x @ x[q]
        s[q] = -2
        hits += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    return hits / (5 * len(range(0, n, every)))


def test_recall_holds_as_the_table_grows(spark, tmp_path):
    assert recall(spark, str(tmp_path / "small.parquet"), 8_000) >= 0.9
    assert recall(spark, str(tmp_path / "large.parquet"), 120_000) >= 0.9


def test_a_block_on_two_pages_of_a_large_host_goes(spark):
    def twice(i):
        return " ".join(f"word{i}of{j}" for j in range(12))

    rows = [(i, f"http://large.org/{i}", f"<div>{twice(i % 400)}</div><p>unique words {i} of page {i * 7}</p>") for i in range(800)]
    rows += [(2000, "http://large.org/x", "<div>this long passage stands on one page only, though the page has a copy</div>")] * 2
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [i for i in range(800) if got[i] != f"unique words {i} of page {i * 7}"] == []
    assert got[2000].startswith("this long passage")


def test_all_labels_count_in_one_spelling(spark):
    rows = [(f"x{chr(97 + i // 26)}{chr(97 + i % 26)}", f"word{i} of language{i}") for i in range(70)] + [("pt-BR", "uma casa"), ("PT", "uma casa")]
    model = langid.fit(spark.createDataFrame(rows, "label string, text string"))
    assert model.labels == sorted({"pt"} | {label for label, _ in rows[:70]})
