"""As-of join: what was known at a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.plans.numbering import carry_forward


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: Sequence[str],
              name: str = "as_of", tie: str = "id") -> DataFrame:
    """`left` with `name`: a struct of `values` from the last row of `right` with the same `key`, not later than `left_time`.

    Both sides are range-sorted together by key and time, and the last row of `right` is carried forward, so a
    hot key is worked on in pieces. Of equal times the row of `right` counts as earlier; among those the
    highest `tie` wins. NULL if there is none; a NULL key or time of `left` meets nothing.
    """
    kind = left.schema[key].dataType
    events = right.filter(F.col(key).isNotNull() & F.col(right_time).isNotNull()).select(
        F.col(key).cast(kind).alias("_key"), F.col(right_time).cast("timestamp_ntz").alias("_time"), F.lit(0).alias("_side"),
        F.col(tie).cast("long").alias("_tie"), F.struct(*values).alias("_value"), F.lit(None).alias("_left"))
    asked = left.select(
        F.col(key).alias("_key"), F.col(left_time).cast("timestamp_ntz").alias("_time"), F.lit(1).alias("_side"),
        F.monotonically_increasing_id().alias("_tie"), F.lit(None).alias("_value"), F.struct(*left.columns).alias("_left"))
    both = events.unionByName(asked)
    seen = carry_forward(both, ["_key"], ["_time", "_side", "_tie"], {"_seen": F.col("_value")})
    known = F.col("_key").isNotNull() & F.col("_time").isNotNull()
    return seen.filter("_side = 1").select("_left.*", F.when(known, F.col("_seen")).alias(name))
