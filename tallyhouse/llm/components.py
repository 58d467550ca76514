"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.scratch import stage


def components(links: DataFrame) -> DataFrame:
    """`node` and `label` (the smallest node it reaches) for every node of `links` (`a`, `b`).

    Each node hooks to its smallest smaller neighbour, chains are shortened by pointer jumping, and the links between the
    resulting trees go on to the next round, at most half of the trees each time. Rounds and jumps
    are logarithmic; everything is a grouped minimum or a join on written tables, and no
    neighbourhood is ever gathered. NULL ends are ignored.
    """
    pairs = links.select("a", "b").filter("a is not null and b is not null")
    labels = stage(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().withColumn(
        "label", F.col("node")), "labels")
    open_ = stage(_down(pairs), "links")
    while not open_.isEmpty():
        parents = stage(open_.groupBy("hi").agg(F.min("lo").alias("to")), "parents")
        while True:
            further = parents.select(F.col("hi").alias("to"), F.col("to").alias("next"))
            jumped = stage(parents.join(further, "to", "left").select(
                "hi", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "parents")
            parents = jumped.select("hi", "to")
            if jumped.filter("moved").isEmpty():
                break
        labels = stage(labels.join(parents, F.col("label") == F.col("hi"), "left").select(
            "node", F.coalesce("to", "label").alias("label")), "labels")
        up = parents.select(F.col("hi").alias("_k"), F.col("to").alias("_v"))
        hi = open_.join(up, F.col("hi") == F.col("_k"), "left").select(F.coalesce("_v", "hi").alias("a"), "lo")
        both = hi.join(up, F.col("lo") == F.col("_k"), "left").select("a", F.coalesce("_v", "lo").alias("b"))
        open_ = stage(_down(both), "links")
    return labels


def _down(pairs: DataFrame) -> DataFrame:
    """Each link once, from its larger to its smaller end; loops are left out."""
    return pairs.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
