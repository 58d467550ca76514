"""Declared limits of the data model: allowed selections and text lengths."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.schemas import ALLOWED, MAX_LENGTH

Tables = Mapping[str, DataFrame]


def _violation(column: str, test: Column, reason: str) -> Column:
    return F.when(test, F.struct(
        F.lit(column).alias("column_name"), F.col(column).cast("string").alias("value"), F.lit(reason).alias("reason")))


def declaration_violations(t: Tables) -> DataFrame:
    """Values outside their selection or longer than declared, with the row's id. Each
    table is read once for all its columns. Columns that a job stores are checked where a table has them."""
    checks: dict[str, list[Column]] = {}
    for (table, column), allowed in ALLOWED.items():
        if column not in t[table].columns:
            continue
        checks.setdefault(table, []).append(_violation(column, ~F.col(column).isin(*allowed), "not_allowed"))
    for (table, column), limit in MAX_LENGTH.items():
        checks.setdefault(table, []).append(_violation(column, F.length(column) > limit, "too_long"))
    found = [
        t[table].select(F.lit(table).alias("table_name"), F.col("id").cast("bigint").alias("id"),
                        F.inline(F.array_compact(F.array(*tests))))
        for table, tests in checks.items()]
    return reduce(DataFrame.unionByName, found)
