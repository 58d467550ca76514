"""Sharding by a Feistel permutation of the global row numbers."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.plans.numbering import number_rows

ROUNDS = 8
# Most steps of a cycle walk. The domain a * b holds fewer than a points outside 0..n-1,
# so a walk ends within a steps: certain for n up to STEPS squared. Beyond, a step fails
# with a chance below 1/sqrt(n), so that all STEPS fail with a chance below STEPS**-STEPS.
STEPS = 64


def sides(rows: int) -> tuple[int, int]:
    """The two sides of the smallest near-square domain for `rows` numbers."""
    a = max(1, math.isqrt(max(rows - 1, 0)) + 1)
    return a, max(1, -(-rows // a))


def _rounds(x: Column, a: int, b: int, key: int, backwards: bool = False) -> Column:
    """One pass of the Feistel network over 0..a*b-1, or of its inverse."""
    sign = -1 if backwards else 1

    def turn(state: Column, i: Column) -> Column:
        left, right = state["l"], state["r"]
        to_left = F.pmod(left + sign * F.pmod(F.xxhash64(F.lit(key), i, right), F.lit(a)), F.lit(a))
        to_right = F.pmod(right + sign * F.pmod(F.xxhash64(F.lit(key), i, left), F.lit(b)), F.lit(b))
        return F.when(i % 2 == 0, F.struct(to_left.alias("l"), right.alias("r"))).otherwise(
            F.struct(left.alias("l"), to_right.alias("r")))

    order = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if backwards else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    start = F.struct(F.pmod(x, F.lit(a)).alias("l"), F.floor(x / F.lit(a)).cast("long").alias("r"))
    return F.aggregate(order, start, turn, lambda s: s["r"] * F.lit(a) + s["l"])


def permute(x: Column, rows: int, key: int, backwards: bool = False) -> Column:
    """The place of `x` in a permutation of 0..rows-1, or the `x` of a place.

    A number that lands outside is sent through the network again until it is inside.
    """
    a, b = sides(rows)
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(STEPS)), _rounds(x, a, b, key, backwards),
        lambda y, _: F.when(y < F.lit(rows), y).otherwise(_rounds(y, a, b, key, backwards)))


def shard_rows(df: DataFrame, order_by: Sequence[str | Column], shards: int, key: int = 20_240_229) -> DataFrame:
    """Deal the rows of `df` into `shards` shards in a shuffled order that a rerun repeats.

    Adds `row_number` (from 0, in the order of `order_by`), `shard` and `slot` (gapless from 0
    in each shard). Row counts of two shards differ by one at most. Place p of the
    permutation is slot p div shards of shard p mod shards, so shard and slot follow from
    the row number alone, and `row_of` goes back. The rows are range-sorted once;
    no task sees more than its range and no row is looked at to place another.

    Rows that tie on `order_by` (plain expressions, ascending) are numbered in any order: make it tell unequal rows apart.
    NULL sorts first. An empty table gives none. Columns of the result's names are
    replaced; all others come back as they were, whatever their names.
    """
    added = ["row_number", "shard", "slot"]
    kept = [c for c in df.columns if c not in added]
    keys = [(F.col(c) if isinstance(c, str) else c).alias(f"_key{i}") for i, c in enumerate(order_by)]
    packed = df.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row"), *keys)
    numbered = number_rows(packed, [f"_key{i}" for i in range(len(keys))], "row_number")
    rows = numbered.count()
    placed = numbered.withColumn("_place", permute(F.col("row_number") - 1, rows, key))
    return placed.select(
        (F.col("row_number") - 1).alias("row_number"), *(F.col("_row").getField(c).alias(c) for c in kept),
        F.pmod("_place", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("_place") / F.lit(shards)).cast("long").alias("slot"))


def row_of(shard: Column, slot: Column, shards: int, rows: int, key: int = 20_240_229) -> Column:
    """The row number at a slot of a shard."""
    return permute(slot * F.lit(shards) + shard, rows, key, backwards=True)
