"""Ancestor closure of a parent tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.session import stage


def ancestor_closure(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """All (node, ancestor, depth) pairs, the node itself at depth 0.

    Doubles the reach on each round: `jump` links a node to its ancestor 2^k steps
    up, and every pair found so far gives one more by a jump from its ancestor. A
    tree of depth d takes log2(d) rounds and as many joins, with no limit on levels or
    rows. The jumps are written out, so a round does not repeat the earlier ones. A
    cycle never runs out of jumps and is reported.
    """
    pairs = nodes.select(F.col(id_col).alias("node"), F.col(id_col).alias("ancestor"), F.lit(0).alias("depth"))
    jump = nodes.filter(F.col(parent_col).isNotNull()).select(
        F.col(id_col).alias("_from"), F.col(parent_col).alias("_to"))
    step, total = 1, nodes.count()
    while jump.count() > 0:
        if step > total:
            raise ValueError("the tree has a cycle")
        here = F.struct("ancestor", "depth")
        higher = F.when(F.col("_to").isNotNull(), F.struct(
            F.col("_to").alias("ancestor"), (F.col("depth") + step).alias("depth")))
        pairs = pairs.join(jump, F.col("ancestor") == F.col("_from"), "left").select(
            "node", F.inline(F.array_compact(F.array(here, higher))))
        again = jump.select(F.col("_from").alias("_middle"), F.col("_to").alias("_end"))
        jump = stage(jump.join(again, F.col("_to") == F.col("_middle")).select("_from", F.col("_end").alias("_to")), "jump")
        step *= 2
    return pairs


def updated_closure(closure: DataFrame, changes: DataFrame, removed: DataFrame | None = None, id_col: str = "id",
                    parent_col: str = "parent_id") -> DataFrame:
    """The closure after some nodes got another parent, were added (`changes`: id and parent) or removed with all below them.

    Only what hangs below a changed node is worked out anew: its paths up to the first node that nothing happened to, and from
    there the paths that are known. All other rows stay as they are. Moves come before removals, so what moves
    out of a removed subtree at the same time stays. A move below a node's own subtree is a cycle and is reported.
    """
    edited = stage(changes.select(F.col(id_col).alias("_id"), F.col(parent_col).alias("_parent")), "edits")
    gone = edited.select("_id").limit(0) if removed is None else removed.select(F.col(id_col).alias("_id"))
    named = edited.select("_id").unionByName(gone).distinct()
    below = closure.join(named, F.col("ancestor") == F.col("_id"), "left_semi").select("node")
    touched = stage(below.unionByName(edited.select(F.col("_id").alias("node"))).distinct(), "touched")
    kept = closure.join(touched, "node", "left_anti")
    old = closure.filter("depth = 1").join(touched, "node", "left_semi").select("node", F.col("ancestor").alias("_old"))
    links = touched.join(old, "node", "left").join(edited, F.col("node") == F.col("_id"), "left").select(
        "node", F.when(F.col("_id").isNotNull(), F.col("_parent")).otherwise(F.col("_old")).alias("parent"))
    inner_parents = touched.select(F.col("node").alias("_inner"))
    marked = stage(links.join(inner_parents, F.col("parent") == F.col("_inner"), "left").select(
        "node", "parent", F.col("_inner").alias("inside")), "links")
    inner = stage(ancestor_closure(marked, "node", "inside"), "inner")
    tops = marked.filter("inside is null and parent is not null").select(F.col("node").alias("_top"), F.col("parent").alias("_above"))
    outer = kept.select(F.col("node").alias("_from"), F.col("ancestor").alias("_far"), F.col("depth").alias("_more"))
    above = tops.join(outer, F.col("_above") == F.col("_from"))
    further = inner.join(above, F.col("ancestor") == F.col("_top")).select(
        "node", F.col("_far").alias("ancestor"), (F.col("depth") + 1 + F.col("_more")).alias("depth"))
    new = inner.unionByName(further)
    dropped = new.join(gone, F.col("ancestor") == F.col("_id"), "left_semi").select("node").distinct()
    return kept.unionByName(new.join(dropped, "node", "left_anti"))
