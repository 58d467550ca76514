"""Written intermediates whose shuffle files go as soon as they are written."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tallyhouse import session

_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside give back the disk of their shuffles at their end, not at some garbage collection."""
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREE)
        else:
            spark.conf.set(_FREE, before)


def stage(df: DataFrame, label: str) -> DataFrame:
    """`session.stage`, with the shuffles' disk given back."""
    with freed_shuffles(df.sparkSession):
        return session.stage(df, label)
