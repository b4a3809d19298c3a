"""Connected components of a table of links, by hooking to the least neighbour and contracting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _jump(parents: DataFrame) -> DataFrame:
    """Parents (node, parent) with every node below the root of its chain. Parents are less than their nodes."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        parents = written(parents.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")), "chains")
        if parents.where("moved").isEmpty():
            return parents.select("node", "parent")
        parents = parents.select("node", "parent")


def components(links: DataFrame) -> DataFrame:
    """links: (a, b). Returns (node, component) for every node of a link; component is the least node of its component.

    Each round hooks every node that has a lesser neighbour to the least of them, follows the chains to their roots and
    replaces the links by those between different roots. At least half of the linked nodes go in each round. Links are
    kept in written tables; nothing but the question whether any are left comes to the driver.
    """
    links = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    rounds: list[DataFrame] = []
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    while not links.isEmpty():
        parents = _jump(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")))
        rounds.append(parents)
        for end in ("a", "b"):
            links = links.join(parents.select(F.col("node").alias(end), "parent"), end, "left").withColumn(end, F.coalesce("parent", end)).drop("parent")
        links = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    start = nodes.select("node", F.col("node").alias("component"))
    follow = lambda df, p: df.join(p.select(F.col("node").alias("component"), "parent"), "component", "left").select("node", F.coalesce("parent", "component").alias("component"))
    return written(reduce(follow, rounds, start), "components")
