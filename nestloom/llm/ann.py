"""Approximate nearest neighbours by a hash-prefix forest (operator 8).

Each of TREES trees gives a vector a string of 64 bits, the signs of its products with random directions, and is the sorted
array of these strings. A query descends to where its own string stands, so to its longest prefix match, and ascends
through shorter prefixes, which are ever wider intervals around that place. All trees ascend together, in two steps. The
first goes up to the longest prefix at which the intervals of FIRST trees hold START strings, of all vectors or, where
there are more than FIRST_BLOCKS blocks of them, of a sample of so many blocks by hash; the k-th best score among those is a
lower bound for the true one. Two vectors at an angle a share b bits of a tree with probability (1 - a/pi)**b,
so the second goes up to the longest prefix at which a vector as near as that bound is missed by all trees with a
probability of at most MISS. This rule knows neither the number of vectors nor their length. Where even the widest
intervals of all trees hold more strings than one whole tree, the query is compared with one whole tree, so with all.

There are two ways to lay the arrays out, which find the same. By blocks, vectors are dealt once to blocks of about BLOCK
components, each of which sorts its own part of every tree, and each query goes to every block. By runs, each tree's whole
array is dealt out as runs of its order, about SEGMENT strings to a run, and a query goes to the runs that its interval
meets; so every vector moves once for each tree, but a query doesn't meet all vectors' runs. The way that moves fewer rows
is taken: runs, where the vectors are so many that queries times blocks exceed vectors times trees. Where many strings are
equal, so that several runs start with one, they are dealt to these runs by id. Nothing is lost at the ends of runs.

Found vectors are compared exactly, in double precision and each pair by itself, so that a score doesn't depend on what
else is near. Equal vectors are one class, searched once and represented by their least ids.

Rows without an id and vectors that are null, zero, empty or hold a null or a non-finite component take no part; vectors of
other lengths are in trees of their own. Repeated ids count once for each different vector. Ties go to the smaller id. Fewer candidates than k
give as many results. Only the id and vector columns are read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropping, written

TREES, BITS, SEGMENT, SALT = 24, 64, 1 << 15, 16
#: Components of a block's vectors, and vectors of the smallest blocks that a small table is dealt to for the sake of cores.
BLOCK, LEAST_BLOCK, CORES = 1 << 22, 1 << 12, 16
#: Trees and strings of the first step, and the probability with which the second may miss a neighbour.
FIRST, START, MISS = 4, 6_000, 0.1
#: Blocks that the first step looks into.
FIRST_BLOCKS = 64
_SIGN = np.uint64(1 << 63)


def _directions(size: int) -> np.ndarray:
    return np.random.default_rng([7, size]).standard_normal((size, TREES * BITS)).astype(np.float32)


def valid(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0)


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """vector, rep, ids: for each different vector its least id and its k + 1 least ones. Hot vectors are cut down salt by
    salt before their ids meet."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALT))).withColumn("hash", F.xxhash64("vector"))
    low = rows.distinct().withColumn("r", F.row_number().over(Window.partitionBy("hash", "vector", "salt").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    return low.groupBy("hash", "vector").agg(F.slice(F.sort_array(F.collect_set("vec_id")), 1, k + 1).alias("ids")).select(F.col("ids")[0].alias("rep"), "vector", "ids")


def _strings(classes: DataFrame, every: int) -> DataFrame:
    """rep, size, query, vector, codes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            for part in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
                vectors = part.column(1).to_pylist()
                codes: list[np.ndarray] = [np.empty(0)] * len(vectors)
                sizes = np.array([len(v) for v in vectors])
                for n in set(sizes.tolist()):
                    p = planes[n] if n in planes else planes.setdefault(n, _directions(n))
                    at = np.flatnonzero(sizes == n)
                    bits = np.array([vectors[i] for i in at], dtype=np.float32) @ p > 0
                    packed = np.packbits(bits.reshape(len(at), TREES, BITS), axis=2).view(">u8")[..., 0].astype(np.uint64)
                    for i, row in zip(at, (packed ^ np.uint64(1 << 63)).view(np.int64), strict=True):  # signed order is the order of the strings
                        codes[i] = row
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int32()), part.column(2), part.column(1), pa.array(codes, pa.list_(pa.int64()))], names=["rep", "size", "query", "vector", "codes"])

    vector_type = classes.schema["vector"].dataType.simpleString()
    query = F.exists("ids", lambda x: x % every == 0)
    return classes.select("rep", "vector", query.alias("query")).mapInArrow(run, f"rep bigint, size int, query boolean, vector {vector_type}, codes array<bigint>")


def _limits(codes: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest string that shares the first bits, one number for each, with a string."""
    shift = (64 - np.maximum(bits, 1)).astype(np.uint64)
    low = np.where(bits == 0, np.uint64(0), (codes.view(np.uint64) ^ _SIGN) >> shift << shift)
    high = np.where(bits == 0, ~np.uint64(0), low | ((np.uint64(1) << shift) - np.uint64(1)))
    return (low ^ _SIGN).view(np.int64), (high ^ _SIGN).view(np.int64)


def _intervals(codes: np.ndarray, asked: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in the sorted strings that share the first bits with the strings asked for."""
    low, high = _limits(asked, bits)
    return np.searchsorted(codes, low, "left"), np.searchsorted(codes, high, "right")


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """The partition's rows, tree by tree, sorted by string."""
    got = [b.to_pandas() for b in batches if b.num_rows]
    if got:
        for _, part in pd.concat(got, ignore_index=True).groupby(["size", "tree"], sort=False):
            yield part.sort_values(["code", "rep"], kind="stable").reset_index(drop=True)


def _starts(strings: DataFrame, parts: int) -> dict[tuple[int, int], tuple[int, np.ndarray]]:
    """For each (size, tree) the number of its first run and the string that each of its runs starts with."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            bounds, n = rows["code"].to_numpy()[::SEGMENT], -(-len(rows) // SEGMENT)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, int(rows[c][0])), pa.int32()) for c in ("size", "tree")] + [pa.array(bounds, pa.int64())], names=["size", "tree", "bound"])

    slim = strings.select("rep", "size", F.posexplode("codes").alias("tree", "code"))
    counted = written(slim.repartitionByRange(parts, "size", "tree", "code", "rep").mapInArrow(run, "size int, tree int, bound bigint"), "starts")
    starts: dict[tuple[int, int], list[int]] = {}
    for r in counted.orderBy("size", "tree", "bound").toLocalIterator():
        starts.setdefault((r.size, r.tree), []).append(r.bound)
    runs, first = {}, 0
    for key, of in starts.items():
        runs[key] = (first, np.array(of, dtype=np.int64))
        first += len(of)
    return runs


def _ascended(sorted_codes: list[np.ndarray], codes: np.ndarray, wanted: int) -> np.ndarray:
    """For each query the longest prefix at which its intervals in all trees hold the wanted number of strings, or 0."""
    low, high = np.zeros(len(codes), np.int64), np.full(len(codes), BITS)
    while (low < high).any():  # fewer strings share a longer prefix
        middle = (low + high + 1) // 2
        held = np.zeros(len(codes), np.int64)
        for t, c in enumerate(sorted_codes):
            lo, hi = _intervals(c, np.ascontiguousarray(codes[:, t]), middle)
            held += hi - lo
        low, high = np.where(held >= wanted, middle, low), np.where(held >= wanted, high, middle - 1)
    return low


def depth(score: float | None, miss: float = MISS) -> int:
    """The longest prefix at which all trees miss a vector of at least this score with a probability of at most `miss`."""
    if score is None:
        return 0
    shared = 1 - float(np.arccos(np.clip(score, -1.0, 1.0))) / np.pi
    need = 1 - miss ** (1 / TREES)
    return BITS if shared**BITS >= need else int(np.log(need) / np.log(shared)) if shared > 0 else 0


def _deal(strings: DataFrame, runs: dict[tuple[int, int], tuple[int, np.ndarray]], trees: int) -> DataFrame:
    """strings: (rep, size, bits, vector, codes), bits null where nothing is asked. Gives run, asks, rep, vector, lo, hi:
    each string in its run, with its code as lo; each query in all runs that its interval meets."""
    shared = strings.sparkSession.sparkContext.broadcast(runs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                sizes, bits = part.column(1).to_numpy(zero_copy_only=False), np.array([-1 if b is None else b for b in part.column(2).to_pylist()])
                reps = part.column(0).to_numpy()
                codes = part.column(4).flatten().to_numpy().reshape(-1, TREES)
                got: list[tuple[np.ndarray, ...]] = []
                for size in set(sizes.tolist()):
                    at = np.flatnonzero(sizes == size)
                    for tree in range(trees):
                        first, bounds = shared.value[(size, tree)]
                        c = codes[at, tree]
                        from_, until = np.searchsorted(bounds, c, "left"), np.searchsorted(bounds, c, "right")
                        own = np.where(until > from_, from_ + reps[at] % np.maximum(until - from_, 1), until - 1)
                        got.append((first + own, np.zeros(len(at), bool), at, c, c))
                        who = at[(bits[at] > 0) | (bits[at] == 0) & (tree == 0)]
                        lo, hi = _limits(np.ascontiguousarray(codes[who, tree]), bits[who])
                        a, b = np.searchsorted(bounds, lo, "left"), np.searchsorted(bounds, hi, "right")
                        a = np.maximum(np.where(np.searchsorted(bounds, lo, "right") > a, a, a - 1), 0)
                        times = b - a
                        inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                        got.append((first + np.repeat(a, times) + inside, np.ones(len(inside), bool), *(np.repeat(x, times) for x in (who, lo, hi))))
                run_, asks, row, lo, hi = (np.concatenate(x) for x in zip(*got, strict=True))
                for i in range(0, len(row), 8192):
                    some = pa.array(row[i : i + 8192])
                    yield pa.RecordBatch.from_arrays([pa.array(run_[i : i + 8192], pa.int64()), pa.array(asks[i : i + 8192]), part.column(0).take(some), part.column(3).take(some), pa.array(lo[i : i + 8192], pa.int64()), pa.array(hi[i : i + 8192], pa.int64())], names=["run", "asks", "rep", "vector", "lo", "hi"])

    vector_type = strings.schema["vector"].dataType.simpleString()
    return strings.select("rep", "size", "bits", "vector", "codes").mapInArrow(run, f"run bigint, asks boolean, rep bigint, vector {vector_type}, lo bigint, hi bigint")


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _stretches(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """place, asks and rows of the stretches of one place (column 0) and one kind (column 1)."""
    for batch in batches:
        of, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        cuts = np.flatnonzero((np.diff(of) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(of)], strict=True):
            if a < b:
                yield int(of[a]), bool(asks[a]), batch.slice(a, b - a)


class _Best:
    """The k + 1 best of each query, gathered for a batch."""

    def __init__(self, k: int) -> None:
        self.k, self.columns = k, ([], [], [])

    def add(self, query: int, reps: np.ndarray, v: np.ndarray, norm: np.ndarray, x: np.ndarray, some: np.ndarray | None) -> None:
        """Of the vectors, or some of them by place, those nearest to x."""
        if some is not None and 4 * len(some) < len(v):
            reps, v, norm, some = reps[some], v[some], norm[some], None
        score = np.einsum("ij,j->i", v, x) / (norm * np.sqrt(np.einsum("i,i->", x, x)))
        if some is not None:
            reps, score = reps[some], score[some]
        if not len(score):
            return
        k = self.k
        t = np.arange(len(score)) if len(score) <= 4 * k else np.flatnonzero(score >= np.partition(score, len(score) - k - 1)[len(score) - k - 1])
        best = t[np.lexsort((reps[t], -score[t]))][: k + 1]
        for column, value in zip(self.columns, (np.full(len(best), query), reps[best], score[best]), strict=True):
            column.append(value)

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.columns[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(self.columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["rep", "other", "score"])
            self.columns = ([], [], [])


_FOUND = "rep bigint, other bigint, score double"


def _by_runs(strings: DataFrame, runs: dict[tuple[int, int], tuple[int, np.ndarray]], trees: int, parts: int, k: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, [], False
        v = norm = codes = reps = np.empty(0)
        for of, asks, part in _stretches(batches):
            if of != now:
                now, held, ready = of, [], False
            if not asks:
                held.append((part.column(2).to_numpy(), _matrix(part.column(3), len(part)), part.column(4).to_numpy()))
                continue
            if not ready:
                if not held:  # no string stands in this run
                    continue
                reps, v, codes = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.lexsort((reps, codes))
                reps, v, codes, held, ready = reps[order], v[order], codes[order], [], True
                norm = np.sqrt(np.einsum("ij,ij->i", v, v))
            best = _Best(k)
            lo, hi = np.searchsorted(codes, part.column(4).to_numpy(), "left"), np.searchsorted(codes, part.column(5).to_numpy(), "right")
            for rep, x, i, j in zip(part.column(2).to_pylist(), _matrix(part.column(3), len(part)), lo.tolist(), hi.tolist(), strict=True):
                best.add(rep, reps[i:j], v[i:j], norm[i:j], x, None)
            yield from best.batches()

    return _deal(strings, runs, trees).repartition(parts, "run").sortWithinPartitions("run", "asks").mapInArrow(run, _FOUND)


def _by_blocks(strings: DataFrame, blocks: int, trees: int, k: int, wanted: int = 0) -> DataFrame:
    """strings: (rep, size, bits, vector, codes). With a wanted number, each block ascends until it holds as many; otherwise
    prefixes are those of bits, null where nothing is asked."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, [], False
        v = norm = reps = np.empty(0)
        order: list[np.ndarray] = []
        sorted_codes: list[np.ndarray] = []
        for of, asks, part in _stretches(batches):
            if of != now:
                now, held, ready = of, [], False
            codes = part.column(4).flatten().to_numpy().reshape(-1, TREES)
            if not asks:
                held.append((part.column(2).to_numpy(), _matrix(part.column(3), len(part)), codes))
                continue
            if not ready:
                if not held:
                    continue
                reps, v, all_codes = (np.concatenate(x) for x in zip(*held, strict=True))
                order = [np.argsort(all_codes[:, t], kind="stable") for t in range(trees)]
                sorted_codes = [all_codes[o, t] for t, o in enumerate(order)]
                held, ready, norm = [], True, np.sqrt(np.einsum("ij,ij->i", v, v))
            best, limits = _Best(k), []
            bits = _ascended(sorted_codes, codes, wanted) if wanted else part.column(5).to_numpy()
            for t in range(trees):
                limits.append(_intervals(sorted_codes[t], np.ascontiguousarray(codes[:, t]), bits))
            for i, (rep, x) in enumerate(zip(part.column(2).to_pylist(), _matrix(part.column(3), len(part)), strict=True)):
                if bits[i] == 0:
                    best.add(rep, reps, v, norm, x, None)
                    continue
                met = np.zeros(len(reps), dtype=bool)
                for o, (lo, hi) in zip(order, limits, strict=True):
                    met[o[lo[i] : hi[i]]] = True
                best.add(rep, reps, v, norm, x, np.flatnonzero(met))
            yield from best.batches()

    place = F.col("size").cast("bigint") * F.lit(1 << 32)
    rows = strings.select((place + F.pmod(F.xxhash64("rep"), F.lit(blocks))).alias("run"), F.lit(False).alias("asks"), "rep", "vector", "codes", "bits")
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
    asks = strings.where("bits is not null").select(every.alias("block"), "size", "rep", "vector", "codes", "bits").select((place + F.col("block")).alias("run"), F.lit(True).alias("asks"), "rep", "vector", "codes", "bits")
    return rows.unionByName(asks).repartition(blocks, "run").sortWithinPartitions("run", "asks").mapInArrow(run, _FOUND)


def _search(found: DataFrame, k: int) -> DataFrame:
    """rep, other, score: the k + 1 best found for each query, itself among them."""
    best = found.groupBy("rep", "other").agg(F.max("score").alias("score"))
    w = Window.partitionBy("rep").orderBy(F.desc("score"), "other")
    return best.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)


def nearest(rows: DataFrame, k: int = 5, every: int = 50, start: int = START, id_col: str = "vec_id", vector_col: str = "embedding", layout: str | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each id divisible by `every`. layout: blocks or runs; by
    default the one that moves fewer rows."""
    with dropping(rows.sparkSession) as keep:
        return keep(_nearest(rows, k, every, start, id_col, vector_col, layout), "nearest")


def _nearest(rows: DataFrame, k: int, every: int, start: int, id_col: str, vector_col: str, layout: str | None) -> DataFrame:
    base = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("vector")).where(F.col("vec_id").isNotNull() & valid(F.col("vector")))
    classes = written(_classes(base, k), "classes")
    own = written(base.where(F.col("vec_id") % every == 0).distinct().join(classes.select("rep", "vector"), "vector").select(F.col("vec_id").alias("query_id"), "rep"), "queries")
    strings = _strings(classes, every)
    asked = own.select("rep").distinct().withColumn("asked", F.lit(True))
    strings = written(strings.drop("query").join(asked, "rep", "left").select("rep", "size", F.coalesce("asked", F.lit(False)).alias("query"), "vector", "codes"), "strings")
    n, asking, longest = strings.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("query").cast("long")), F.lit(0)), F.coalesce(F.max("size"), F.lit(1))).first()
    blocks = max(1, -(-n // max(LEAST_BLOCK, BLOCK // longest)), min(CORES, -(-n // LEAST_BLOCK)))
    as_blocks = layout != "runs" and (layout == "blocks" or n + asking * blocks <= TREES * n)

    some = min(blocks, FIRST_BLOCKS)
    sampled = F.col("query") | (F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(blocks)) < some)
    asks = strings.where(sampled).select("rep", "size", F.when(F.col("query"), F.lit(0)).alias("bits"), "vector", "codes")
    first = _search(_by_blocks(asks, some, FIRST, k, max(k + 1, start // some)), k)
    # One of the k + 1 best is the query itself.
    bound = written(first.groupBy("rep").agg(F.min(F.when(F.col("r") == k + 1, F.col("score"))).alias("bound")), "bounds")
    rule = F.udf(lambda score: b if TREES < 1 << (b := depth(score)) else 0, "int")
    bits = written(bound.select("rep", rule("bound").alias("bits")), "depths")
    trees = 1 if bits.where("bits > 0").isEmpty() else TREES
    rows = strings.join(bits, "rep", "left")
    if as_blocks:
        found = _search(_by_blocks(rows, blocks, trees, k), k)
    else:
        runs = _starts(strings, max(1, -(-n * TREES // SEGMENT)))
        found = _search(_by_runs(rows, runs, trees, max(1, -(-n * trees // SEGMENT)), k), k)
    best = written(found.drop("r"), "best")
    pairs = best.join(classes.select(F.col("rep").alias("other"), F.explode("ids").alias("vec_id")), "other")
    pairs = own.join(pairs, "rep").where("vec_id <> query_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
