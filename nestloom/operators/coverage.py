"""What a scan has seen: examination reports, holes, and coverage by partition."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITIONS = 64


def examine(lines: DataFrame, text: str = "value", most_bytes: int | None = None) -> DataFrame:
    """lines: JSON texts with key, kind and checksum. A report of one row for each unit. A unit of more than most_bytes isn't
    looked into: it is a hole."""
    fits = F.lit(True) if most_bytes is None else F.octet_length(text) <= most_bytes
    doc = F.try_parse_json(F.when(fits, F.col(text)))
    get = lambda p, t: F.try_variant_get(doc, p, t)
    whole = doc.isNotNull() & get("$.key", "string").isNotNull()
    sound = F.coalesce(get("$.sha256", "string") == F.sha2(get("$.body", "string"), 256), F.lit(False))
    status = F.when(~whole, "hole").when(sound, "verified").otherwise("unverified")
    return lines.select(get("$.key", "string").alias("item"), F.coalesce(get("$.kind", "string"), F.lit("unknown")).alias("unit_kind"), status.alias("status"), F.octet_length(text).alias("bytes"), get("$.body", "string").alias("payload"))


def holes(report: DataFrame) -> DataFrame:
    return report.where("status = 'hole'")


def verified(report: DataFrame) -> DataFrame:
    return report.where("status = 'verified'")


def by_status(report: DataFrame) -> DataFrame:
    return report.groupBy("status").agg(F.count(F.lit(1)).alias("units"), F.sum("bytes").alias("bytes"))


def partition_of(key: Column, partitions: int = PARTITIONS) -> Column:
    """The virtual partition of a document's key: the first 32 bits of its MD5, modulo the partitions."""
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % partitions).cast("int")


def partition_coverage(df: DataFrame, key: str, reachable: list[int], partitions: int = PARTITIONS) -> DataFrame:
    """For each of the partitions by hash of the key: rows seen, or unavailable, which is not the same as empty."""
    spark: SparkSession = df.sparkSession
    seen = df.groupBy(partition_of(F.col(key), partitions).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    every = spark.range(partitions).select(F.col("id").cast("int").alias("part"))
    out = every.join(seen, "part", "left")
    there = F.col("part").isin(reachable)
    return out.select("part", F.when(there, "completed").otherwise("unavailable").alias("state"), F.when(there, F.coalesce("n", F.lit(0))).alias("n"))


@dataclass(frozen=True)
class Scattered:
    """A page of a scan over partitions: rows in key order, the key to go on from, and what each partition gave."""

    rows: DataFrame
    next: str | None
    coverage: DataFrame  # part, tier, state, n

    @property
    def complete(self) -> bool:
        return self.coverage.where("state <> 'completed'").isEmpty()


def scatter_scan(df: DataFrame, key: str, reachable: Mapping[int, str] | list[int], limit: int, after: str | None = None, test: Column | None = None, partitions: int = PARTITIONS) -> Scattered:
    """The next `limit` documents past a key, of the partitions that can be reached, merged by ascending key. reachable may
    name the tier that each partition is read from. Each partition sorts its own rows; Spark merges their first ones."""
    tiers = dict(reachable) if isinstance(reachable, Mapping) else dict.fromkeys(reachable, "local")
    part, text = partition_of(F.col(key), partitions), F.col(key).cast("string")
    there = df.where(part.isin(list(tiers))) if len(tiers) < partitions else df
    if test is not None:
        there = there.where(test)
    if after is not None:
        there = there.where(text > after)
    got = there.withColumn("merge_key_", text).orderBy("merge_key_").limit(limit + 1).collect()
    page = df.sparkSession.createDataFrame([r[: len(df.columns)] for r in got[:limit]], df.schema)
    counts = page.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.createDataFrame([(p, tiers.get(p), "completed" if p in tiers else "unavailable") for p in range(partitions)], "part int, tier string, state string")
    coverage = every.join(counts, "part", "left").withColumn("n", F.when(F.col("state") == "completed", F.coalesce("n", F.lit(0))))
    return Scattered(page, got[limit - 1].merge_key_ if len(got) > limit else None, coverage)
