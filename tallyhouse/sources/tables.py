"""Reading business tables with their fixed schemas, and writing reports."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tallyhouse.schemas import DDL, schema_of, stored_schema_of


# Tables of settings, places and people of the company, whose size does not follow the business.
SINGLE_TASK_TABLES = frozenset((
    "res_country province district sector res_store res_users res_company account_payment_term account_tax account_account partner_concept "
    "account_journal product_category product_brand commission_rule fiscal_printer stock_location stock_warehouse delivery_zone "
    "delivery_zone_sector").split())


def conform(df: DataFrame, schema: StructType, stored: StructType | None = None, optional: Iterable[str] = ()) -> DataFrame:
    """Cast the columns of `schema` and, where the source has them, those of `stored`; keep all others as they are.

    A column of `schema` that the source lacks is an error, or NULL if it is `optional`. A stored
    column that the source lacks stays absent: it is computed then, while a stored NULL is a value.
    """
    present, known = set(df.columns), {f.name for f in schema.fields}
    missing = sorted(known - present - set(optional))
    if missing:
        raise ValueError(f"the source lacks {', '.join(missing)}")
    given = [f for f in (stored.fields if stored else ()) if f.name in present]
    rest = [c for c in df.columns if c not in known and c not in {f.name for f in given}]
    return df.select(
        *[(F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields],
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in given], *rest)


def load_tables(spark: SparkSession, directory: str, fmt: str = "parquet",
                names: Iterable[str] | None = None, folders: Mapping[str, str] | None = None,
                optional: Mapping[str, Iterable[str]] | None = None,
                stored: Mapping[str, Iterable[str]] | None = None, **options: str) -> dict[str, DataFrame]:
    """Business tables from `<directory>/<table>` (parquet, orc, csv or json).

    `folders` maps a table to its folder where the two are named differently, `optional` to the columns that may be missing and are
    NULL then. Parquet and orc bring their own columns and types, which are cast to the fixed schema; columns that it does not have are
    kept. So it is with csv files that have a header. Json files, and csv files without one, are read with the fixed schema and the stored
    columns that `stored` names for the table. No data is read until a result is asked for.
    """
    tables = {}
    for name in names or DDL:
        reader = spark.read.format(fmt).options(**options)
        path = f"{directory}/{(folders or {}).get(name, name)}"
        schema, extra = schema_of(name), stored_schema_of(name)
        allowed = (optional or {}).get(name, ())
        if fmt == "json" or fmt == "csv" and str(options.get("header", "false")).lower() != "true":
            more = [f for f in extra.fields if f.name in set((stored or {}).get(name, ()))]
            tables[name] = reader.schema(StructType([*schema.fields, *more])).load(path)
        elif fmt == "csv":
            types = {f.name: f.dataType for f in (*schema.fields, *extra.fields)}
            header = reader.load(path).columns
            typed = StructType([StructField(c, types.get(c, StringType())) for c in header])
            tables[name] = conform(reader.schema(typed).load(path), schema, extra, allowed)
        else:
            tables[name] = conform(reader.load(path), schema, extra, allowed)
    return tables


def jdbc_options(url: str, table: str, key: str = "id", lower: int = 0, upper: int = 0,
                 partitions: int = 1, fetch_size: int = 10_000) -> dict[str, str]:
    """Options for reading one table in `partitions` ranges of its key.

    More than one partition needs the bounds of the key: without them all rows would fall into one range. A single
    partition reads through one task, which suits the small tables in `SINGLE_TASK_TABLES` only.
    """
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size)}
    if partitions > 1:
        if lower >= upper:
            raise ValueError(f"reading {table} in {partitions} ranges needs the bounds of {key}")
        options |= {"partitionColumn": key, "lowerBound": str(lower), "upperBound": str(upper),
                    "numPartitions": str(partitions)}
    return options


def even_ranges(keys: DataFrame, partitions: int, key: str = "id", accuracy: int = 10_000) -> list[str]:
    """Conditions that cut a relation into up to `partitions` ranges of `key` with about equal numbers of rows.

    `keys` is a sample of the keys, such as a query with the database's own sampling. The cuts are its quantiles, so
    ranges are even where the keys are not: after deleted ranges, or ids that jump. A value that fills
    several ranges is one range. Every key, those outside the sample too, and NULL, is in exactly one range.
    """
    if partitions < 1:
        raise ValueError("partitions must be positive")
    wanted = [i / partitions for i in range(1, partitions)]
    row = keys.agg(F.percentile_approx(key, wanted, accuracy).alias("q")).first() if wanted else None
    cuts = sorted(set((row and row["q"]) or []))
    lows, highs = [None, *cuts], [*cuts, None]
    if not cuts:
        return ["1 = 1"]
    return [
        f"{key} < {high} or {key} is null" if low is None else f"{key} >= {low}" if high is None else f"{key} >= {low} and {key} < {high}"
        for low, high in zip(lows, highs)]


def load_jdbc_evenly(spark: SparkSession, name: str, url: str, keys: DataFrame, partitions: int, key: str = "id",
                     source: str | None = None, fetch_size: int = 10_000) -> DataFrame:
    """One business table of a database, read in the `even_ranges` of a sample of its `keys`, one task each."""
    rows = spark.read.jdbc(url, source or name, predicates=even_ranges(keys, partitions, key), properties={"fetchsize": str(fetch_size)})
    return conform(rows, schema_of(name), stored_schema_of(name))


def load_jdbc(spark: SparkSession, name: str, source: str | None = None, **jdbc: str | int) -> DataFrame:
    """One business table from the relation `source` of a database; by default that of
    its own name. Needs the driver's jar. Tables that grow with the business need `partitions` and the key's bounds."""
    if name not in SINGLE_TASK_TABLES and int(jdbc.get("partitions", 1)) < 2:
        raise ValueError(f"{name} may be large: give partitions, lower and upper")
    options = jdbc_options(table=source or name, **jdbc)
    return conform(spark.read.format("jdbc").options(**options).load(), schema_of(name), stored_schema_of(name))


def write_report(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Write a report as parquet, one folder per value of `partition_by`.

    The rebalance hint groups the rows of a value into few files, but lets AQE split
    a value that holds most of the rows over several tasks. Only the folders of the values in `df` are replaced:
    one day's report leaves those of other days. Without `partition_by` the whole report is replaced.
    """
    if partition_by is None:
        df.write.mode("overwrite").parquet(path)
        return
    df.hint("rebalance", F.col(partition_by)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(partition_by).parquet(path)
