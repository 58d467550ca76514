"""Join for a left side with hot or missing keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def skewed_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, spread_by: str,
                how: str = "left", pieces: int | None = None) -> DataFrame:
    """The join of `left_key` and `right_key`, for a left side that is uneven.

    Rows with a NULL key would all hash to one partition. A second join key, 0 for
    real keys and a hash of `spread_by` for NULLs, deals them out over `pieces`: by default
    four for each shuffle partition of the session.

    AQE splits the partition of a hot key only if both inputs come straight from a
    shuffle. An aggregated right side does not: it is partitioned by its key already.
    With the second key it is shuffled for the join, as the small side it is.
    """
    pieces = pieces or 4 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    # 0 for every real key, but computed from it, so that the optimizer keeps it as a key.
    def zero(key: str) -> Column:
        return F.pmod(F.hash(key), F.lit(1))

    dealt = left.withColumn("_deal", F.when(
        F.col(left_key).isNull(), F.pmod(F.hash(spread_by), F.lit(pieces))).otherwise(zero(left_key)))
    other = right.withColumn("_deal_r", zero(right_key))
    return (
        dealt.join(other, (F.col(left_key) == F.col(right_key)) & (F.col("_deal") == F.col("_deal_r")), how)
        .drop("_deal", "_deal_r"))
