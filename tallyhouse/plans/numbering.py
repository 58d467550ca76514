"""Positions and carried values over a total order, without one-task windows.

`row_number() over (order by ...)` moves the whole input into one task, and a
window per key moves a hot key into one task. Here the rows are range-sorted
across all tasks and written once, each row with its sort partition and its
place in it. Everything else is arithmetic on the few rows that describe the
partitions.

The last order column should make a row unique: a range sort cannot divide rows
that are equal on every sort key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.session import stage

PART = "_sort_part"
IDX = "_sort_idx"
# monotonically_increasing_id keeps the row's place in the low 33 bits.
PLACE_BITS = 33


def _names(columns: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in columns]


def ordered_stage(df: DataFrame, order_cols: Sequence[str | Column]) -> DataFrame:
    """Range-sort `df`, write it, and add the sort partition and place of each row."""
    marked = df.orderBy(*_names(order_cols)).withColumn(
        "_sort_id", F.monotonically_increasing_id())
    return (
        stage(marked.withColumn(PART, F.shiftright("_sort_id", PLACE_BITS))
                    .withColumn(IDX, F.col("_sort_id").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)))
                    .drop("_sort_id"), "sorted"))


def number_rows(df: DataFrame, order_cols: Sequence[str | Column], name: str = "position") -> DataFrame:
    """Add the 1-based position of each row in the order of `order_cols`."""
    staged = ordered_stage(df, order_cols)
    sizes = staged.groupBy(PART).agg(F.count("*").alias("_rows"))
    # One row per sort partition, so both the window and the broadcast are bounded
    # by the number of shuffle partitions, whatever the size of the data.
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(PART, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    return (
        staged.join(F.broadcast(offsets), PART)
        .select((F.col("_before") + F.col(IDX) + 1).alias(name), *df.columns))


def _edge_groups(staged: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Rows of the groups that open a sort partition: the only ones that can have
    started in an earlier partition. At most one group per sort partition opens it,
    so the groups, and their counts per partition, are few enough to broadcast."""
    openers = staged.filter(F.col(IDX) == 0).select(*[F.col(c).alias(f"_e_{c}") for c in group_cols]).distinct()
    return staged.join(F.broadcast(openers), same_group(group_cols, "_e_"), "left_semi")


def same_group(group_cols: Sequence[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(prefix + c)) for c in group_cols])


def number_within(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str | Column],
                  name: str = "position") -> DataFrame:
    """Add the 1-based position of each row inside its group.

    A group spread over several sort partitions is counted partition by partition;
    the counts of the earlier partitions are added to the later ones.
    """
    staged = ordered_stage(df, [*group_cols, *order_cols])
    local = Window.partitionBy(*group_cols, PART).orderBy(IDX)
    pieces = _edge_groups(staged, group_cols).groupBy(*group_cols, PART).agg(F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*group_cols).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.select(
        *[F.col(c).alias(f"_g_{c}") for c in group_cols], F.col(PART).alias("_g_part"),
        F.sum("_rows").over(earlier).alias("_before"))
    ranked = staged.withColumn("_local", F.row_number().over(local))
    return (
        ranked.join(F.broadcast(carried), (F.col(PART) == F.col("_g_part")) & same_group(group_cols, "_g_"), "left")
        .select((F.col("_local") + F.coalesce("_before", F.lit(0))).alias(name), *df.columns))


def carry_forward(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str | Column],
                  values: dict[str, Column], exclusive: Sequence[str] = ()) -> DataFrame:
    """Add, per group and in order, the last non-NULL value seen so far of each entry.

    The entries named in `exclusive` look at the earlier rows only. Equals
    `last(value, ignoreNulls)` over a window per group, but a hot group is worked on
    in as many pieces as it has sort partitions.
    """
    # The entries are worked out where they are looked at: neither the sort nor the files carry them.
    staged = ordered_stage(df, [*group_cols, *order_cols])
    running = Window.partitionBy(*group_cols, PART).orderBy(IDX)
    upto = {n: -1 if n in exclusive else 0 for n in values}
    pieces = _edge_groups(staged, group_cols).groupBy(*group_cols, PART).agg(
        *[F.max_by(v, F.when(v.isNotNull(), F.col(IDX))).alias(f"_raw_{n}") for n, v in values.items()])
    earlier = Window.partitionBy(*group_cols).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.select(
        *[F.col(c).alias(f"_g_{c}") for c in group_cols], F.col(PART).alias("_g_part"),
        *[F.last(f"_raw_{n}", ignorenulls=True).over(earlier).alias(f"_g_raw_{n}") for n in values])
    seen = staged.withColumns({
        f"_l_raw_{n}": F.last(v, ignorenulls=True).over(
            running.rowsBetween(Window.unboundedPreceding, upto[n])) for n, v in values.items()})
    return (
        seen.join(F.broadcast(carried), (F.col(PART) == F.col("_g_part")) & same_group(group_cols, "_g_"), "left")
        .select(*df.columns,
                *[F.coalesce(f"_l_raw_{n}", f"_g_raw_{n}").alias(n) for n in values]))
