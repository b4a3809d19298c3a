"""Language ID, mixing, near-duplicates, neighbours, pages and archives against brute force."""

import hashlib
import math
import random
import re
import shutil
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from nestloom.llm import ann, components, html_text, langid, mixing, near_dedup, shingles, warc

SMALL = "/root/testdata/sf0.001"
WORDS = "[^\x20\x09-\x0d]+"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, l, s, 0, "clash", True) for i, t, l, s in rows], "doc_id long, text string, lang string, source string, n_chars long, copies string, kept boolean")


# language ID


def test_language_held_out(spark):
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.fit(d.where("doc_id % 2 = 0").selectExpr("lang as label", "text"))
    rows = d.where("doc_id % 2 = 1 and length(text) > 40").select("lang", "text").collect()
    best = model.score([r.text for r in rows]).argmax(axis=1)
    assert np.mean([model.labels[b] == r.lang for b, r in zip(best, rows, strict=True)]) > 0.97


def test_evidence_is_fused(spark):
    d = spark.read.parquet(f"{SMALL}/documents.parquet").where("lang in ('en', 'de')").select("doc_id", "text", "lang", "source", "n_chars")
    d = d.unionByName(spark.createDataFrame([(-1, None, "en", "s", 0), (-2, "", None, None, 0), (-3, "123 456 ...", "en", "s", 0), (-4, "the", None, None, 0), (-4, "the", None, None, 0)], d.schema))
    got = langid.identify_documents(d).collect()
    assert len(got) == d.count()
    by = {r.doc_id: r for r in got}
    assert not by[-1].kept and not by[-2].kept and not by[-3].kept and by[-4].kept and by[-4].lang == "en"
    assert all(r.kept for r in got if r.doc_id >= 0)
    assert langid.identify_documents(d.limit(0)).count() == 0


def fused(rows, model):
    """The fusion by loops, for rows (text, declared, address, host): language, confidence."""
    means, n = model.means([t or "" for t, *_ in rows])
    scores = means * np.minimum(n, langid.TEMPER)[:, None]
    labels, letters = model.labels, [any(c.isalpha() for c in t or "") for t, *_ in rows]
    first, doubt = [s.argmax() for s in scores], {}
    for k in (1, 2):
        seen = [labels[f] == r[k] for r, f, ok in zip(rows, first, letters, strict=True) if ok and r[k] in labels]
        doubt[k] = min(0.5, max(0.01, (seen.count(False) + 1) / (len(seen) + 10)))
    evidence = []
    for r, s in zip(rows, scores, strict=True):
        e = list(s)
        for k in (1, 2):
            if r[k] in labels:
                e = [x + (math.log(1 - doubt[k]) if labels[i] == r[k] else math.log(doubt[k] / max(1, len(labels) - 1))) for i, x in enumerate(e)]
        evidence.append(e)
    of_host, of_domain, total = {}, {}, np.ones(len(labels))
    known = model.known(means, n)
    for r, e, ok in zip(rows, evidence, letters & known, strict=True):
        if ok and r[3]:
            one = np.eye(len(labels))[int(np.argmax(e))]
            of_host[r[3]] = of_host.get(r[3], 0) + one
            domain = ".".join(r[3].split(".")[-2:])
            of_domain[domain] = of_domain.get(domain, 0) + one
            total = total + one
    total, b = total / total.sum(), langid.BORROW
    out = []
    for r, e in zip(rows, evidence, strict=True):
        e = np.array(e)
        if r[3] in of_host:
            d = of_domain[".".join(r[3].split(".")[-2:])]
            h = of_host[r[3]]
            e = e + np.log((h + b * (d + b * total) / (d.sum() + b)) / (h.sum() + b))
        p = np.exp(e - e.max())
        out.append((labels[int(e.argmax())], 1 / p.sum()))
    return out


def test_fusion_is_brute_forces(spark):
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.fit(d.selectExpr("lang as label", "text"))
    texts = [r.text for r in d.where("text is not null").orderBy("doc_id").limit(60).collect()]
    r = random.Random(4)
    rows = [(t[: r.choice([3, 8, 20, 400])], r.choice([None, "en", "de", "xx"]), r.choice([None, "en", "fr"]), r.choice([None, "", "a.x.org", "b.x.org", "c.net"])) for t in texts * 3] + [(None, "en", "en", "a.x.org"), ("12 34", "en", None, "c.net")]
    frame = spark.createDataFrame([(i, *x, "clash") for i, x in enumerate(rows)], "id int, t string, lang string, address string, host string, confidence string")
    got = {x.id: x for x in langid.identify(frame, model, "id", F.col("t"), F.col("lang"), F.col("address"), F.col("host")).collect()}
    for i, (lang, confidence) in enumerate(fused(rows, model)):
        assert got[i].lang == lang and got[i].confidence == pytest.approx(confidence, rel=1e-4), rows[i]


def test_unknown_languages_are_rejected(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(d.where("doc_id % 2 = 0").selectExpr("lang as label", "text"))
    other = ["Все люди рождаются свободными и равными в своем достоинстве и правах. " * 5, "人人生而自由在尊严和权利上一律平等他们赋有理性和良心" * 9, "Wszyscy ludzie rodzą się wolni i równi w swojej godności i w swoich prawach. " * 4, "0xdeadbeef 7f3a9c 9b1e00 4c4c4c e2e2e2 a0b1c2d3 " * 8]
    assert not model.known(*model.means(other)).any()
    held = [r.text for r in d.where("doc_id % 2 = 1 and length(text) > 0").collect()]
    assert model.known(*model.means(held)).mean() > 0.995
    frame = spark.createDataFrame([(i, t, "en", None, 0) for i, t in enumerate(other)] + [(9, held[0] * 40, None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.id: r.kept for r in langid.identify(frame.withColumnRenamed("doc_id", "id"), model, "id", F.col("text"), F.col("lang"), F.lit(None).cast("string"), F.col("source")).collect()}
    assert got == {0: False, 1: False, 2: False, 3: False, 9: True}


def test_pages_use_markup_address_and_host(spark):
    d = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("lang as label", "text")
    model = langid.fit(d)
    p = spark.createDataFrame([(1, "http://a.example.de/x", '<html lang="de"><p>ab'), (2, "http://a.example.de/y", "<p>ab"), (3, None, None), (4, "http://x.org/fr/1", '<html lang="fr-CA"><p>qu')], "page_id long, url string, html string")
    got = {r.page_id: r for r in langid.identify_pages(p, d).collect()}
    assert got[1].lang == "de" and got[2].lang == "de" and got[4].lang == "fr" and got[4].declared == "fr" and not got[3].kept
    assert set(model.labels) == {"de", "en", "es", "fr"}


def test_documents_use_the_address_of_their_source(spark):
    d = spark.read.parquet(f"{SMALL}/documents.parquet").where("text is not null").select("doc_id", "text", "lang", "source", "n_chars")
    sources = ["https://A.example.de/x", "www.example.fr", "b.example.org/es/1?q=2", "src0", "de", None, "", "http://a.example.de:80/y"]
    texts = [r.text for r in d.orderBy("doc_id").limit(40).collect()]
    rows = [(-1 - i, t[:3], None, sources[i % len(sources)], 0) for i, t in enumerate(texts)] + [(-100 - i, "12 34", None, s, 0) for i, s in enumerate(sources)]
    d = d.unionByName(spark.createDataFrame(rows, d.schema))
    model = langid.fit(d.select(F.col("lang").alias("label"), "text"))
    known = dict(zip(sources, [("de", "a.example.de"), ("fr", "www.example.fr"), ("es", "b.example.org"), (None, "src0"), (None, "de"), (None, None), (None, ""), ("de", "a.example.de")], strict=True))
    all_rows = d.select("doc_id", "text", "lang", "source").collect()
    got = {r.doc_id: r for r in langid.identify_documents(d).collect()}
    for r, (lang, confidence) in zip(all_rows, fused([(r.text, r.lang, *known.get(r.source, (None, r.source))) for r in all_rows], model), strict=True):
        assert got[r.doc_id].lang == lang and got[r.doc_id].confidence == pytest.approx(confidence, rel=1e-4), r


# mixing


def brute_targets(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, out, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        factor = left / sum(w[s] for s in free)
        over = {s for s in free if factor * w[s] > 2 * sizes[s]}
        if not over:
            return out | {s: factor * w[s] for s in free}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mix_reaches_targets_and_reruns_agree(spark):
    r = random.Random(3)
    rows = [(i, " ".join("w" * r.randint(1, 3) for _ in range(min(400, int(r.expovariate(1 / 40))))), "en", r.choice(["a", "a", "a", "a", "B", "é", None, "z"])) for i in range(6000)]
    rows += [(7000, None, "en", "null text"), (7001, "x y", "en", "b"), (7001, "x y", "en", "b")]
    d = docs(spark, rows)
    got = mixing.mix_sources(d).collect()
    again = mixing.mix_sources(d.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(got) == len(rows)
    source = {i: s for i, _, _, s in rows}
    sizes, taken = {s: 0 for s in source.values()}, {s: 0 for s in source.values()}
    for i, t, _, s in rows:
        sizes[s] += len(re.findall(WORDS, t or ""))
    for x in got:
        assert x.taken in (0, x.size, 2 * x.size) and x.source_size == sizes[source[x.doc_id]]
        taken[source[x.doc_id]] += x.taken
    want = brute_targets(sizes)
    for x in got:
        assert x.target == pytest.approx(want[source[x.doc_id]])
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.02 * t, 400)
    assert mixing.mix_sources(d.limit(0)).count() == 0


def test_mix_of_copies_and_null_ids(spark):
    rows = [(5, "one row often", "en", "a")] * 5000 + [(None, "no id here", "en", "a"), (2**53 + 1, "an id of many digits", "en", "a"), (None, None, None, None)]
    rows += [(100 + i, "x y z " * (1 + i % 5), "en", "b" if i % 3 else None) for i in range(3000)]
    d = docs(spark, rows)
    got = mixing.mix_sources(d).collect()
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, mixing.mix_sources(d.repartition(5)).collect()), key=key)
    assert {x.doc_id for x in got} == {i for i, *_ in rows} and len(got) == len(rows)
    taken = {}
    for x in got:
        taken.setdefault((x.source_size, x.target), []).append(x.taken)
    for (_, target), t in taken.items():
        assert abs(sum(t) - target) <= max(0.02 * target, 40)
    leaves = mixing._told_apart(d.select("doc_id", "source", F.lit(3).cast("bigint").alias("size")))
    assert leaves.where("doc_id = 5").agg(F.count_distinct("nth"), F.max("nth")).collect()[0][:] == (5000, 4999)


def test_rounding_keeps_expectations():
    rng = np.random.default_rng(5)
    share = [0.1, 0.5, 0.7, 0.3, 0.9, 0.2, 0.3]
    total = np.zeros(7)
    for _ in range(4000):
        out, at = mixing.pivot(share, rng)
        assert at == -1 and sum(out) == pytest.approx(3.0)
        total += out
    assert np.allclose(total / 4000, share, atol=0.03)


# near-duplicates


def brute_components(rows, k):
    sets = {}
    for i, t in rows:
        w = re.findall(WORDS, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in sets}


def family(r, base, edits, n):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[r.randrange(len(w))] = f"q{r.random()}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_are_brute_forces(spark):
    r = random.Random(8)
    base = [[f"w{r.randint(0, 3000)}" for _ in range(120)] for _ in range(6)]
    texts = [t for b, e in zip(base, (1, 2, 3, 4, 5, 8), strict=True) for t in family(r, b, e, 25)]  # the later ones lie around the threshold
    texts += ["Same text here now", "same  text HERE\nnow", "two words", "Two words", "", None, " ", "one", "long " * 3000] + [" ".join(base[0])] * 3
    rows = list(enumerate(texts, 10))
    r.shuffle(rows)
    got = near_dedup.near_duplicates(docs(spark, [(i, t, "en", "s") for i, t in rows]), k=4).collect()
    want = brute_components(rows, 4)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want
    assert all(x.kept == (x.doc_id == x.component_id) for x in got)


def test_a_bucket_whose_centre_misses_links(spark, monkeypatch):
    """Every document in one bucket: stars alone would lose the links among others than the centre."""
    r = random.Random(9)
    texts = ["lone document with words of its own"] + [t for _ in range(3) for t in family(r, [f"v{r.random()}" for _ in range(60)], 1, 6)]
    monkeypatch.setattr(near_dedup, "constants", lambda n, s: shingles.constants(n, s) * np.uint64(0))
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    d = docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(d, k=4).collect()}
    assert got == {i: c for i, (_, c) in brute_components(list(enumerate(texts)), 4).items()}


def test_links_at_the_threshold(spark, monkeypatch):
    """Many short documents around the threshold in one bucket: none of their links may be ruled out by an estimate."""
    r = random.Random(5)
    base = [f"t{i}" for i in range(14)]
    rows = [(i, " ".join(base[:k] + [f"u{i}x{j}" for j in range(r.randint(0, 3))])) for i, k in enumerate(r.randint(8, 14) for _ in range(700))]
    rows += [(1000 + i, " ".join(f"v{i % 40}x{j}" for j in range(9 + i % 3))) for i in range(300)]
    monkeypatch.setattr(near_dedup, "constants", lambda n, s: shingles.constants(n, s) * np.uint64(0))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_duplicates(docs(spark, [(i, t, "en", "s") for i, t in rows]), k=4).collect()}
    assert got == brute_components(rows, 4)


def test_near_duplicates_of_odd_tables(spark):
    nameless = docs(spark, [(None, "a b c d e f", "en", None), (None, "", "en", None), (7, "a b c d e f", "en", None)])
    assert sorted(map(tuple, near_dedup.near_duplicates(nameless, k=4).collect()), key=str) == [(7, 3, 7, True), (None, 0, None, True), (None, 3, None, True)]
    d = docs(spark, [(1, "a b c d e f", "en", None), (1, "a b c d e f", "en", None), (2, "a b c d e f", None, "s"), (3, None, "en", "s"), (4, "x", "en", "s"), (4, "y", "en", "s")])
    got = sorted(map(tuple, near_dedup.near_duplicates(d, k=4).collect()))
    assert got == [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 0, 3, True), (4, 1, 4, True), (4, 1, 4, True)]
    assert near_dedup.near_duplicates(d.limit(0)).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(100, 140)] + [(7, x) for x in range(20, 40)] + [(5, 5), (39, 3)] + [(r.randint(200, 300), r.randint(200, 300)) for _ in range(60)]
    r.shuffle(links)
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in links:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    got = {x.node: x.component for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if any(x in l and l[0] != l[1] for l in links)}


# neighbours


def test_neighbours_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((1500, 16)).astype(np.float32)
    v[100:400] = v[50]  # a hot vector
    rows = [(i, [float(x) for x in a], 1) for i, a in enumerate(v)] + [(5000, None, 1), (5050, [0.0] * 16, 1), (5100, [float("nan")] * 16, 1), (5150, [None] * 16, 1), (5200, [1.0, 2.0], 1), (5203, [2.0, 4.0], 1), (50, [float(x) for x in v[50]], 1), (None, [float(x) for x in v[50]], 1)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = ann.nearest(e).collect()
    x = v.astype(np.float64)
    n = np.sqrt((x * x).sum(axis=1))
    hits = total = 0
    for q in range(0, 1500, 50):
        s = x @ x[q] / (n * n[q])
        order = sorted((i for i in range(1500) if i != q), key=lambda i: (-round(s[i], 12), i))[:5]
        mine = [r for r in got if r.query_id == q]
        assert sorted(r["rank"] for r in mine) == [1, 2, 3, 4, 5]
        assert all(r.score == pytest.approx(s[r.vec_id], abs=1e-12) for r in mine)
        hits += len({r.vec_id for r in mine} & set(order))
        total += 5
    assert hits / total >= 0.9
    assert all(r.query_id is not None and r.vec_id is not None for r in got)
    assert {(r.query_id, r["rank"], r.vec_id) for r in got if r.query_id >= 5000} == {(5200, 1, 5203)}
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 50] == [100, 101, 102, 103, 104]
    assert ann.nearest(e.limit(0)).count() == 0


def test_blocks_and_runs_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(ann, "SEGMENT", 256)
    monkeypatch.setattr(ann, "LEAST_BLOCK", 300)
    rng = np.random.default_rng(6)
    near = rng.standard_normal((40, 24))
    rows = [(i, [float(x) for x in near[i % 40] + rng.standard_normal(24) * (0.3 if i % 3 else 2.0)]) for i in range(2400)] + [(5000 + i, [float(x) for x in rng.standard_normal(5)]) for i in range(60)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = [sorted(map(tuple, ann.nearest(e, start=200, layout=how).collect())) for how in ("blocks", "runs", None)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 5 * (48 + 2)


@pytest.mark.parametrize("layout", ["blocks", "runs"])
def test_scaled_copies_are_split_and_tie(spark, monkeypatch, layout):
    """Vectors with equal strings in all trees are dealt to several runs, and none of them is lost."""
    monkeypatch.setattr(ann, "SEGMENT", 64)
    rng = np.random.default_rng(2)
    v = rng.standard_normal(8).astype(np.float32)
    rows = [(i, [float(x) * 2.0 ** (i % 7 - 3) * (1 + i // 7) for x in v]) for i in range(700)] + [(1000 + i, [float(x) for x in rng.standard_normal(8)]) for i in range(200)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), layout=layout).where("query_id < 1000").collect()
    assert len(got) == 14 * 5 and all(r.score == pytest.approx(1.0, abs=1e-12) and r.vec_id < 700 for r in got)
    again = ann.nearest(spark.createDataFrame(rows[::-1], "vec_id long, embedding array<double>").repartition(5), layout=layout).where("query_id < 1000").collect()
    assert sorted(got) == sorted(again)


# pages


PAGE = """<!DOCTYPE html><html lang=en><head><title>No</title><style>p{}</style></head><body class="menu-open"><header><h1>Site</h1></header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>x</p> --><main><article><header><h2>A &amp; B&nbsp;&#x41;</h2></header>
<p>First <b>bold</b>
 text<br>next<p>Second 1 < 2 <script>if (a<b) "</p>"</script>end<div class="ad">Buy</div><form><input value=">">Mail</form><ul><li>one<li>two</ul><aside>More</aside><section id=comments><p>Reader</p></section></article></main>
<div class="sidebar">Side</div><footer>&copy; Us</footer>"""


def test_blocks_of_a_page():
    kept = [t for t, own in html_text.page_blocks(PAGE) if own]
    assert kept == ["A & B A", "First bold text next", "Second 1 < 2 end", "one", "two"]


@pytest.mark.parametrize(
    ("page", "own", "open_"),
    [
        ('<div class="site has-sidebar"><main><article><p>text', "text", ""),
        ('<div class="sidebar"><article>own</article></div><div class="sidebar">no</div>', "own", ""),
        ("<article><p>one<svg/><p>two<iframe src=x />", "one two", ""),
        ("<article><datalist><option>x</datalist><select><option>1<option>2</select><p>kept", "kept", ""),
        ("<svg><g><svg>in</svg></g>out</svg><math><mi>x</mi></math> y", "", "x y"),
        ('<article><p>a <button>no</button> b <span class="ad">x <span>y</span> z</span> c<p>d', "a b c d", ""),
        ("<p title=it's>hello 'q' <b class=\"x\"y='2'>w</b>", "", "hello 'q' w"),
        ("<!-->text<!-- c --> more<!--->z<script>if(a<b)</script >!", "", "text morez!"),
        ("<form><main><p>asp</main><input>mail</form>", "asp", ""),
        ('<div class="comments"><article class="c">no</article></div><article>yes</article><article class="comment">no', "yes", ""),
        ("<template><template>a</template>b</template><div hidden><main>x</main></div>y", "", "y"),
        ('<ul><li class="ad">x<li>y</ul><table><tr><td class=ad>x<td>y<tr><td>z</table>', "", "y y z"),
        ("a&am<b></b>p; &lt;b&gt; &#x41;&nbsp;z", "", "a&amp; <b> A z"),
    ],
)
def test_markup(page, own, open_):
    blocks = html_text.page_blocks(page)
    assert (" ".join(t for t, o in blocks if o), " ".join(t for t, o in blocks if not o)) == (own, open_)


@pytest.mark.parametrize("page", ["<div>" * 60_000 + "</p>" * 60_000, "<ul><li>" + "<div>" * 40_000 + "<li>x" * 40_000, "<a b='" * 60_000, '<p class="x' * 60_000, "<" * 200_000, "<!--" * 60_000, "<table><tr><td>" * 20_000 + "</div>" * 60_000, "<span class=ad>" * 30_000 + "</span>" * 30_000 + "end", "</!" * 60_000, "&amp;" * 200_000, "<script>" * 60_000, "<p>" * 100_000 + "x", "<a " + "x/ " * 150_000])
def test_odd_markup_stays_cheap(page):
    start = time.process_time()
    html_text.page_blocks(page)
    assert time.process_time() - start < 20


def test_cover_decides_beside_and_inside_articles(spark):
    words = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    foot = "Subscribe to our letter and never miss a story of this house again"
    passage = "a passage of more than eight words that two articles share indeed"
    rows = [(i, f"http://a.org/{i}", f"<article><p>{words(i, 20)}<p>{passage if i < 2 else words(-i - 1, 9)}<p>{foot}</article>") for i in range(10)]
    rows += [(20 + i, f"http://b.org/{i}", f"<article>teaser {i}</article><div>{words(100 + i, 30)}</div><div>{foot}</div>") for i in range(3)]
    rows += [(40, "http://c.org/1", f"<article>{words(9, 20)}</article><div>beside it</div>")]
    rows += [(None, "http://c.org/2", f"<article>{words(8, 20)}</article>"), (2**53 + 1, "http://c.org/3", "<article>an id of many digits</article>")]
    rows += [(50, "http://hot.org/1", "<p>one row often</p>")] * 600 + [(50, "http://hot.org/1", "<p>another text</p>")]
    got = {}
    for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert all(got[i] == [f"{words(i, 20)}\n{passage if i < 2 else words(-i - 1, 9)}"] for i in range(10))
    assert all(got[20 + i] == [f"teaser {i}\n{words(100 + i, 30)}"] for i in range(3))
    assert got[40] == [words(9, 20)] and got[None] == [words(8, 20)] and got[2**53 + 1] == ["an id of many digits"]
    assert sorted(got[50]) == ["another text"] + ["one row often"] * 600 and sum(map(len, got.values())) == len(rows)


def test_text_of_pages(spark):
    template = "<div>Welcome to the site of many things here today friends</div><p>{}</p><div>All the rights of this site are kept by its own makers</div>"
    rows = [(1, "http://h.org/1", PAGE, "x"), (1, "http://h.org/1", PAGE, "x"), (2, None, None, "x"), (3, "http://h.org/3", "", "x")]
    rows += [(10 + i, "http://plain.org/%d" % i, template.format(f"unique text number {i} about matter {i * 7}"), "x") for i in range(5)] + [(20, "http://other.org", template.format("alone"), "x")]
    got = {r.page_id: r for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got[1].text == "A & B A\nFirst bold text next\nSecond 1 < 2 end\none\ntwo" and got[2].text == "" and got[3].n_chars == 0
    assert all(got[10 + i].text == f"unique text number {i} about matter {i * 7}" for i in range(5))
    assert got[20].text.count("\n") == 2


def test_cover_is_brute_forces():
    r = random.Random(6)
    pages = [[r.randint(0, 3) for _ in range(r.randint(0, 60))] for _ in range(8)]
    cover = html_text.covered_words([np.array(p, dtype=np.uint64) for p in pages], 5)
    where = {}
    for i, p in enumerate(pages):
        for j in range(len(p) - 4):
            where.setdefault(tuple(p[j : j + 5]), set()).add(i)
    for p, c in zip(pages, cover, strict=True):
        want = [any(len(where[tuple(p[j : j + 5])]) > 1 for j in range(max(0, x - 4), min(x, len(p) - 5) + 1)) for x in range(len(p))]
        assert c.tolist() == want


def test_archives_give_the_pages_back(spark):
    big, small = "é" * 600, "x" * 999
    rows = [(1, "http://a/1", big, 1), (2, None, big, 1), (3, "http://a/3\r\nX: y", small, 1), (4, "u", small, 1), (5, "u", None, 1), (6, "u", "", 1), (None, "u", big, 1), (2, None, big, 1), (7, "u", "x" * 1000, 1)]
    got = sorted(map(tuple, warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes int")).collect()), key=str)
    last = {(t or ""): max(p for p, _, u, _ in rows if u == t and p is not None) for _, _, t, _ in rows}
    want = []
    for p, _, t, _ in rows:
        raw = (t or "").encode()
        revisit = len(raw) >= 1000 and p != last[t or ""]
        want.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", last[t or ""] if revisit else None))
    assert got == sorted(want, key=str)
    empty = spark.createDataFrame(rows, "page_id long, url string, html string, x int").limit(0)
    assert warc.archive_pages(empty).count() == 0


def test_files_of_other_attempts_dont_count(spark):
    rows = spark.createDataFrame([(i, f"http://a/{i}", f"page {i}") for i in range(40)], "page_id long, url string, html string")
    folder, archives = warc.write_archives(rows)
    name = archives.first().name
    path = folder.removeprefix("file://")
    shutil.copy(f"{path}/{name}", f"{path}/000000-00000-another.warc.zst")
    assert sorted(r.page_id for r in warc.read_archives(spark, folder, archives).collect()) == list(range(40))
    assert archives.agg(F.sum("n")).first()[0] == 40


def test_broken_archives_are_refused():
    r = warc.record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None, "2025-01-01T00:00:00Z")
    assert warc.parsed(r)[:2] == (1, 3)
    for bad in (r[:-1], r.replace(b"abc", b"abd"), r.replace(b"WARC/1.1", b"WARC/9.9"), r.replace(b"WARC-Date", b"X-Date")):
        with pytest.raises(ValueError):
            warc.parsed(bad)
