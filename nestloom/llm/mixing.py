"""Mixing sources to target weights by pivotal dependent rounding (operator 6).

Every document of a source gets the copies target / size of its source: a whole part and a fraction. Fractions are rounded
in pairs: of two undecided documents one takes mass from the other, at random but keeping both expectations, until one is
whole; the other goes on. A source's documents are dealt by hash to leaves of about LEAF documents, in which neighbours by
size are paired, so that what one gains another of about its size loses. A leaf leaves at most one undecided document;
these are combined FAN at a time in the levels of a reduction tree, and a source's last one is decided by chance.

A null text has size 0; a null source is a source of its own and the last. Sources of size 0 have target 0. Every row is
mixed, repeated ones too, each with its own decision; they are numbered, so that many copies spread over the leaves.
A null id is an id like others. Decisions depend on ids, sizes, numbers of copies and a seed, not on partitions. Only the
id, text and source columns are read, so other columns can't clash. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropping, numbered, small_side, written

WORDS = r"[^\x20\x09-\x0D]+"
LEAF, FAN = 2048, 64


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """sizes: (source, size). For each source: source, no, n, source_size, target. The excess over cap times a source's
    size goes to the others by weight; the common factor is found by a few sums over the sources."""
    per = written(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "sources")
    order = [F.col("source").isNull().alias("last_"), F.col("source")]
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("no") % len(weights) + 1).cast("int"))
    per = written(numbered(per, order).withColumn("weight", weight), "weights")
    most = F.col("source_size") * F.lit(cap)
    total = (per.agg(F.sum("source_size")).first()[0] or 0) * share
    factor, capped = 0.0, -1
    while True:
        full = F.col("weight") * factor >= most
        used, rest, count = per.agg(F.sum(F.when(full, most)), F.sum(F.when(~full, F.col("weight"))), F.sum(full.cast("long"))).first()
        if count == capped or not rest:
            break
        capped, factor = count, (total - (used or 0.0)) / rest
    return per.select("source", "no", "n", "source_size", F.least(most, F.col("weight") * factor).alias("target"))


def source_targets(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """source, source_size, target."""
    return targets(docs.select(F.col(source_col).alias("source"), words(text_col).alias("size")), weights, share, cap).select("source", "source_size", "target")


def words(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("bigint")


def pivot(fraction: list[float], rng: np.random.Generator) -> tuple[list[float], int]:
    """Rounds in the given order. Returns the fractions, of which at most one isn't whole, and that one's place or -1."""
    out, at = list(fraction), -1
    chance = rng.random(len(out)).tolist()
    for i, b in enumerate(out):
        if not 0.0 < b < 1.0:
            continue
        if at < 0:
            at = i
            continue
        a, total = out[at], out[at] + b
        if total < 1.0:
            if chance[i] * total < b:
                out[at], out[i], at = 0.0, total, i
            else:
                out[at], out[i] = total, 0.0
        elif chance[i] * (2.0 - total) < 1.0 - b:
            out[at], out[i], at = 1.0, total - 1.0, i
        else:
            out[at], out[i] = total - 1.0, 1.0
        if abs(out[at] - round(out[at])) < 1e-12:
            out[at], at = float(round(out[at])), -1
    return out, at


_ROW = "no bigint, leaf bigint, doc_id bigint, size bigint, source_size bigint, target double, whole double, fraction double"


def _rounded(rows: DataFrame, seed: int, level: int) -> DataFrame:
    def run(leaf: pa.Table) -> pa.Table:
        leaf = leaf.sort_by([("size", "descending"), ("doc_id", "descending"), ("fraction", "descending")])
        rng = np.random.default_rng([seed, level, leaf["no"][0].as_py(), leaf["leaf"][0].as_py()])
        done, _ = pivot(leaf["fraction"].to_pylist(), rng)
        return leaf.set_column(leaf.column_names.index("fraction"), "fraction", pa.array(done, pa.float64()))

    return rows.groupBy("no", "leaf").applyInArrow(run, _ROW)


def _told_apart(rows: DataFrame) -> DataFrame:
    """Adds nth: 0 but for repeated rows, which are numbered: within each partition, after those of the partitions before."""
    same = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("source").isNull(), "source", "size")
    rows = rows.withColumn("same_", same)
    often = written(rows.groupBy("same_").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("same_"), "repeated")
    if often.isEmpty():
        return rows.drop("same_").withColumn("nth", F.lit(0).cast("bigint"))
    again = written(rows.join(small_side(often), "same_", "left_semi").withColumns({"part_": F.spark_partition_id(), "place_": F.monotonically_increasing_id()}), "copies")
    before = F.coalesce(F.sum("n_").over(Window.partitionBy("same_").orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = again.groupBy("same_", "part_").agg(F.count(F.lit(1)).alias("n_")).select("same_", "part_", before.alias("before_"))
    nth = F.row_number().over(Window.partitionBy("same_", "part_").orderBy("place_")) - 1
    numbered_ = again.withColumn("nth", nth).join(first, ["same_", "part_"]).withColumn("nth", (F.col("nth") + F.col("before_")).cast("bigint"))
    alone = rows.join(small_side(often), "same_", "left_anti").withColumn("nth", F.lit(0).cast("bigint"))
    return alone.drop("same_").unionByName(numbered_.select("doc_id", "source", "size", "nth"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """For each row: doc_id, size, source_size, target, copies, taken."""
    with dropping(docs.sparkSession) as keep:
        return keep(_mixed(docs, weights, share, cap, seed, id_col, text_col, source_col), "mixed")


def _mixed(docs: DataFrame, weights: tuple[int, ...], share: float, cap: float, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    rows = written(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).alias("source"), words(text_col).alias("size")), "sizes")
    per = written(targets(rows, weights, share, cap), "targets")
    known = _told_apart(rows).withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))).drop("source")
    of_source = small_side(per.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))).drop("source"))
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = known.join(of_source, "key").withColumn("copies", copies)
    leaf = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.col("doc_id").isNull(), "size", "nth", F.lit(seed)), F.ceil(F.col("n") / LEAF).cast("bigint"))
    rows = rows.select("no", leaf.alias("leaf"), "doc_id", "size", "source_size", "target", F.floor("copies").cast("double").alias("whole"), (F.col("copies") - F.floor("copies")).alias("fraction"))
    most = per.agg(F.max("n")).first()[0] or 0
    leaves, level, undecided, parts = -(-most // LEAF), 0, (F.col("fraction") > 0) & (F.col("fraction") < 1), []
    while True:
        rows = written(_rounded(rows, seed, level), "rounded")
        parts.append(rows.where(~undecided))
        rows = rows.where(undecided)
        if leaves <= 1:
            break
        level, leaves = level + 1, -(-leaves // FAN)
        rows = rows.withColumn("leaf", F.floor(F.col("leaf") / FAN))
    chance = F.pmod(F.xxhash64("no", F.lit(seed), F.lit("last")), F.lit(1 << 40)) / float(1 << 40)
    parts.append(rows.withColumn("fraction", (chance < F.col("fraction")).cast("double")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    n = (F.col("whole") + F.col("fraction")).cast("bigint")
    return out.select("doc_id", "size", "source_size", "target", n.alias("copies"), (n * F.col("size")).alias("taken"))
