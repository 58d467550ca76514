"""The state of a small automaton before each row of a log, without a window or a loop per hot group.

A row's action maps states to states, and maps compose. So a group is cut into blocks; the map of a
block is made from its rows, that of a sort partition from its blocks, and the state each piece starts in comes down
the same way. What is collected at a time is bounded: the rows of a block, the blocks of a sort partition, the sort partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.plans.numbering import IDX, PART, ordered_stage
from tallyhouse.session import stage

BLOCK_ROWS = 512


def _composed(maps: Column, states: int) -> Column:
    """The map that applies `maps` (each the next state by state) one after the other."""
    identity = F.array(*(F.lit(s) for s in range(states)))
    return F.aggregate(maps, identity, lambda done, move: F.transform(done, lambda s: F.element_at(move, s + 1)))


def _started(maps: Column, first: Column) -> Column:
    """The state before each of `maps`, of which the first meets the state `first`."""
    return F.aggregate(
        maps, F.array(first), lambda seen, move: F.concat(seen, F.array(F.element_at(move, F.element_at(seen, -1) + 1))))


def states_before(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], moves: Column, states: int,
                  start: int = 0, name: str = "state", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add the state that each row finds, in its group and in order. `moves`: for each state 0, 1, .. the next one.

    A NULL group is a group. The last order column should make a row unique.
    """
    staged = ordered_stage(df, [*group_cols, *order_cols])
    group = F.struct(*(F.col(c) for c in group_cols))
    rows = F.struct(F.col(IDX).alias("i"), moves.cast("array<int>").alias("move"), F.struct(*df.columns).alias("row"))
    blocks = stage(staged.select(group.alias("_g"), PART, F.floor(F.col(IDX) / block_rows).cast("long").alias("_b"), rows.alias("_r")).groupBy(
        "_g", PART, "_b").agg(F.array_sort(F.collect_list("_r"), lambda a, b: (a["i"] - b["i"]).cast("int")).alias("_rows")), "blocks")
    # What begins inside a block begins its group, so only what opens a block, one piece each, can have something before it.
    opens = F.col("_rows")[0]["i"] % block_rows == 0
    openers = blocks.filter(opens).select(F.col("_g").alias("_o")).distinct()
    small = blocks.join(openers, F.col("_g").eqNullSafe(F.col("_o")), "left_semi").select(
        "_g", PART, "_b", _composed(F.col("_rows.move"), states).alias("m"))
    parts = small.groupBy("_g", PART).agg(F.sort_array(F.collect_list(F.struct("_b", "m"))).alias("_blocks")).withColumn(
        "m", _composed(F.col("_blocks.m"), states))
    groups = parts.groupBy("_g").agg(F.sort_array(F.collect_list(F.struct(PART, "m", "_blocks"))).alias("_parts"))
    by_part = groups.select("_g", F.explode(F.arrays_zip(
        F.col("_parts").alias("p"), _started(F.col("_parts.m"), F.lit(start)).alias("s"))).alias("z")).filter("z.p is not null")
    by_block = by_part.select("_g", F.col(f"z.p.{PART}").alias("_p"), F.explode(F.arrays_zip(
        F.col("z.p._blocks").alias("b"), _started(F.col("z.p._blocks.m"), F.col("z.s")).alias("s"))).alias("z")).filter("z.b is not null").select(
        F.col("_g").alias("_h"), "_p", F.col("z.b._b").alias("_c"), F.col("z.s").alias("_s"))
    met = blocks.filter(opens).join(by_block, F.col("_g").eqNullSafe(F.col("_h")) & (F.col(PART) == F.col("_p")) & (F.col("_b") == F.col("_c")))
    begun = met.select("_rows", "_s").unionByName(blocks.filter(~opens).select("_rows", F.lit(start).alias("_s")))
    each = begun.select(F.explode(F.arrays_zip(F.col("_rows").alias("r"), _started(F.col("_rows.move"), F.col("_s")).alias("s"))).alias("z"))
    return each.filter("z.r is not null").select("z.r.row.*", F.col("z.s").alias(name))
