"""Version histories, their live state, and replicas that disagree.

events: (key, seq, event_id, kind put | delete, body, known_gap_before).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def history(events: DataFrame, key: str) -> DataFrame:
    """A key's events, oldest first, each once; hole_before where the log says that something before it is missing."""
    found = events.where(F.col("key") == key).dropDuplicates(["event_id"])
    gap = F.coalesce("known_gap_before", F.lit(False)) if "known_gap_before" in events.columns else F.lit(False)
    return found.withColumn("hole_before", gap).orderBy("seq", "event_id")


def live_state(events: DataFrame) -> DataFrame:
    """key, body and seq of the latest event of each key, unless it is a delete. One partial aggregation, no window."""
    last = events.groupBy("key").agg(F.max_by(F.struct("kind", "body"), F.struct("seq", "event_id")).alias("last"), F.max("seq").alias("seq"))
    return last.where("last.kind = 'put'").select("key", "last.body", "seq")


def version(events: DataFrame, event_id) -> DataFrame:
    return events.where(F.col("event_id") == event_id).limit(1).select("key", "seq", F.when(F.col("kind") == "put", F.col("body")).alias("body"), (F.col("kind") == "delete").alias("tombstone"))


def last_complete(events: DataFrame, cross_tombstone: bool = False) -> DataFrame:
    """For each key the newest put with a whole body before the current event; a delete stops the search. Both steps
    aggregate in part before they shuffle, so a key with many events is no task of its own."""
    at = F.struct("seq", "event_id")
    per_key = events.groupBy("key").agg(F.max(at).alias("current"), F.max(F.when(F.col("kind") == "delete", at)).alias("deleted"))
    found = events.where("kind = 'put' and body is not null").join(per_key, "key").where(at < F.col("current"))
    if not cross_tombstone:
        found = found.where(F.col("deleted").isNull() | (at > F.col("deleted")))
    return found.groupBy("key").agg(F.max_by(F.struct("body", "seq"), at).alias("v")).select("key", "v.body", "v.seq")


def _digest() -> Column:
    """Of a replica's body; a null body is unlike an empty one."""
    return F.coalesce(F.sha2("body", 256), F.lit("null"))


def conflicts(replicas: DataFrame) -> DataFrame:
    """replicas: (subject, node, body). Subjects whose replicas hold different bodies; none of them wins."""
    return replicas.groupBy("subject").agg(F.count_distinct(_digest()).alias("bodies"), F.count(F.lit(1)).alias("replicas")).where("bodies > 1")


def converged(replicas: DataFrame) -> DataFrame:
    return replicas.groupBy("subject").agg(F.count_distinct(_digest()).alias("bodies"), F.min("body").alias("body")).where("bodies = 1").select("subject", "body")
