"""Near-duplicate documents by one-permutation hashing (operator 7).

A document's set is that of its distinct word shingles. Its hashes fall into BINS bins by their leading bits; the least
of each bin is kept, and an empty bin takes the value of the first filled bin in an order of its own, the same for all
documents (optimal densification). BANDS bands of ROWS bins each give bucket keys: two documents of similarity 0.8 share
no bucket with probability (1 - 0.8**4)**32 < 1e-7.

Documents of one set are one class, represented by its least id. In each bucket only star-shaped edges, from the least
representative to every other, become candidates, and each is confirmed on the full sets. A bucket in which this leaves
more than one component is compared further: its members outside its largest component with all its members, in blocks
of a bounded number of members and shingles, on the full sets and without emitting pairs. Nothing is ruled out by an
estimate there, so no link between documents that share a bucket is lost, and no bucket is capped.

A null text counts as empty. A document without words has an empty set, is linked with nothing, and is its own component.
Every row is returned, repeated ones too. Rows of one id are one document; should their texts differ, the one with the
least digest stands for the document. A row without an id is linked with nothing: it has no component and is kept. Only
the id and text columns are read, so other columns can't clash. Ids must be integers. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropping, give_back, make_room, small_side, text_batches, text_or_empty, written
from .components import components
from .shingles import constants, mix, shingle_sets

BINS, ROWS, BANDS = 128, 4, 32
#: Members of a block of comparisons, members that are confirmed against a star's centre in one task's group, and shingles
#: of either.
BLOCK, STAR, SHINGLES = 256, 256, 1 << 19
#: Hashes for which incidences are multiplied at once.
COLUMNS = 2048
_U = np.uint64
_EMPTY = _U(0xFFFFFFFFFFFFFFFF)
_SHIFT = _U(64 - 7)
#: The order in which an empty bin looks for a filled one.
_ORDER = np.argsort(mix(np.arange(BINS * BINS, dtype=_U) + _U(77)).reshape(BINS, BINS), axis=1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BINS values for each set, none of which is empty."""
    out = np.full((len(sets), BINS), _EMPTY)
    for row, s in zip(out, sets, strict=True):
        b = (s >> _SHIFT).astype(np.int64)
        first = np.flatnonzero(np.diff(b, prepend=-1))
        row[b[first]] = s[first]
    filled = out.copy()
    todo = np.flatnonzero((out == _EMPTY).any(axis=1))
    for step in range(BINS):
        if not len(todo):
            break
        part = filled[todo]
        part = np.where(part == _EMPTY, out[todo][:, _ORDER[:, step]], part)
        filled[todo] = part
        todo = todo[(part == _EMPTY).any(axis=1)]
    return filled


def _described(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_hash, n, digest, bands for each row."""
    factor, band = constants(ROWS, 5), constants(BANDS, 6)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(__name__)
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                sets = shingle_sets(part.column(2).to_pylist(), k)
                sig = signatures([s if len(s) else np.zeros(1, _U) for s in sets])
                keys = mix((mix(sig).reshape(-1, BANDS, ROWS) * factor).sum(axis=2) + band).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array(list(keys), pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "text_hash", "n", "digest", "bands"],
                )
                give_back(part.nbytes)
        give_back()

    return docs.mapInArrow(run, "doc_id bigint, text_hash bigint, n bigint, digest binary, bands array<bigint>")


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets on the left with those on the right: products of their incidence with the
    hashes that more than one set has, COLUMNS of them at a time."""
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, col, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n[col] > 1
    rows, col = rows[shared], (np.cumsum(n > 1) - 1)[col[shared]]
    order = np.argsort(col, kind="stable")
    rows, col = rows[order], col[order]
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    for first in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
        lo, hi = np.searchsorted(col, [first, first + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        part[rows[lo:hi], col[lo:hi] - first] = 1
        out += (part[left] @ part[right].T).astype(np.int64)
    return out


def _parts(members: str, shingles: str, most: int) -> Column:
    """Into how many groups so many members with so many shingles are dealt."""
    return F.greatest(F.lit(1), F.ceil(F.col(members) / most), F.ceil(F.col(shingles) / SHINGLES)).cast("bigint")


def _confirmed(edges: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Of the edges (a, b, n) those that hold on the full sets; n: shingles of b. A group has one centre a and some bs."""
    fan = edges.groupBy("a").agg(F.count(F.lit(1)).alias("fan"), F.sum("n").alias("n")).select("a", _parts("fan", "n", STAR).alias("parts"))
    fan = written(fan, "fans")
    members = edges.join(fan, "a").join(texts.select(F.col("doc_id").alias("b"), "text_"), "b").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), F.col("b").alias("doc_id"), "text_")
    centres = fan.join(texts.select(F.col("doc_id").alias("a"), "text_"), "a").select("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), F.col("a").alias("doc_id"), "text_")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        centre = int(pdf["a"].iloc[0])
        pdf = pdf.sort_values("doc_id")
        ids = pdf["doc_id"].tolist()
        own = ids.index(centre)
        sets = shingle_sets(pdf["text_"].tolist(), k)
        good = [i for i, s in zip(ids, sets, strict=True) if i != centre and _similar(sets[own], s, percent)]
        give_back(sum(s.nbytes for s in sets))
        return pd.DataFrame({"a": [centre] * len(good), "b": good}, dtype="int64")

    return members.unionByName(centres).groupBy("a", "part").applyInPandas(run, "a bigint, b bigint")


def _blocks(members: DataFrame) -> DataFrame:
    """members: (bucket, doc_id, n, comp). Adds r, c and seeker: in each block (bucket, r, c) the seekers have to be compared
    with all rows whose comp differs. Seekers are the members outside their bucket's largest component."""
    size = members.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("shingles"))
    main = F.max_by(F.struct("comp", "n", "shingles"), F.struct("n", -F.col("comp"))).alias("main")
    most = size.groupBy("bucket").agg(main, F.sum("n").alias("all"), F.sum("shingles").alias("shingles")).where("all > main.n")
    most = most.withColumns({"rest": F.col("all") - F.col("main.n"), "rest_shingles": F.col("shingles") - F.col("main.shingles")})
    most = written(most.select("bucket", F.col("main.comp").alias("main"), _parts("all", "shingles", BLOCK).alias("cols"), _parts("rest", "rest_shingles", BLOCK).alias("rows")), "buckets")
    m = members.join(most, "bucket").withColumn("slot", F.xxhash64("doc_id"))
    to = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    own = ("bucket", "doc_id", "comp")
    seek = m.where("comp <> main").select(*own, F.pmod("slot", F.col("rows")).alias("r"), to("cols").alias("c"), F.lit(True).alias("seeker"))
    found = m.select(*own, to("rows").alias("r"), F.pmod("slot", F.col("cols")).alias("c"), F.lit(False).alias("seeker"))
    return seek.unionByName(found)


def _rest_links(blocks: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between seekers and others of a block; of the links that join the same components one is enough."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets, ids, comp = shingle_sets(pdf["text_"].tolist(), k), pdf["doc_id"].tolist(), pdf["comp"].tolist()
        root = {c: c for c in comp}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        out, seeker = [], pdf["seeker"].to_numpy()
        left, right = np.flatnonzero(seeker), np.flatnonzero(~seeker)
        size = np.array([len(x) for x in sets])
        both = _common(sets, left, right)
        linked = (100 * both >= percent * (size[left][:, None] + size[right][None, :] - both)) & (pdf["comp"].to_numpy()[left][:, None] != pdf["comp"].to_numpy()[right][None, :])
        for x, y in np.argwhere(linked).tolist():
            i, j = left[x], right[y]
            if find(comp[i]) != find(comp[j]):
                out.append((ids[i], ids[j]))
                root[find(comp[i])] = find(comp[j])
        give_back(8 * int(size.sum()))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return blocks.join(texts, "doc_id").groupBy("bucket", "r", "c").applyInPandas(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, n_shingles, component_id (the least id that links lead to), kept (whether it is that id)."""
    text_batches(docs.sparkSession)
    with dropping(docs.sparkSession) as keep:
        return keep(_near_duplicates(docs, k, percent, id_col, text_col), "near_duplicates")


def _near_duplicates(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(text_col)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text_"))
    rows = written(_described(texts, k), "signatures")
    nameless = rows.where("doc_id is null")
    rows, texts = rows.where("doc_id is not null"), texts.where("doc_id is not null")
    mine = F.struct("digest", "text_hash")
    split = written(rows.groupBy("doc_id").agg(F.min(mine).alias("own"), F.max(mine).alias("other")).where("own <> other").select("doc_id", "own"), "split_ids")
    one = rows.join(split, "doc_id", "left")
    some = one.where("n > 0 and (own is null or own = struct(digest, text_hash))")
    rep = F.struct("doc_id", "text_hash")
    classes = written(some.groupBy("digest").agg(F.min(rep).alias("rep"), F.min_by("bands", rep).alias("bands"), F.max("n").alias("n")).select("digest", "rep.*", "bands", "n"), "classes")
    keyed = classes.select("doc_id", "n", F.explode("bands").alias("bucket"))
    centres = written(keyed.groupBy("bucket").agg(F.min("doc_id").alias("centre"), F.count(F.lit(1)).alias("size"), F.sum(F.shiftright(F.xxhash64("doc_id"), 16)).alias("who")).where("size > 1"), "centres")
    shared = written(keyed.join(centres, "bucket").select("bucket", "centre", "doc_id", "n", "size", "who"), "shared_buckets")
    edges = written(shared.where("doc_id <> centre").select(F.col("centre").alias("a"), F.col("doc_id").alias("b"), "n").distinct(), "stars")
    need = written(edges.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "candidates")
    found = texts.join(small_side(need), "doc_id", "left_semi").join(classes.select("doc_id", "text_hash"), ["doc_id", "text_hash"], "left_semi")
    found = written(found.dropDuplicates(["doc_id"]).select("doc_id", "text_"), "candidate_texts")
    stars = written(_confirmed(edges, found, k, percent), "confirmed")
    first = components(stars)
    # Buckets of the same members are compared once.
    once = shared.where("doc_id = centre").groupBy("size", "who", "centre").agg(F.min("bucket").alias("bucket")).select("bucket")
    comp = first.select(F.col("node").alias("doc_id"), "component")
    members = written(shared.join(once, "bucket", "left_semi").join(comp, "doc_id", "left").select("bucket", "doc_id", "n", F.coalesce("component", "doc_id").alias("comp")), "members")
    mixed = written(members.groupBy("bucket").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("bucket"), "mixed")
    blocks = written(_blocks(written(members.join(mixed, "bucket", "left_semi"), "open")), "blocks")
    more = written(_rest_links(blocks, found, k, percent), "rest")
    final = first if more.isEmpty() else components(stars.unionByName(more))
    of_class = classes.select("digest", "doc_id").join(final.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("digest", F.coalesce("component", "doc_id").alias("component"))
    own_digest = F.when(F.col("n") > 0, F.coalesce("own.digest", "digest"))
    out = one.select("doc_id", "n", own_digest.alias("digest")).join(written(of_class, "class_components"), "digest", "left")
    component = F.coalesce("component", "doc_id")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))
    return out.unionByName(nameless.select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("bigint").alias("component_id"), F.lit(True).alias("kept")))
