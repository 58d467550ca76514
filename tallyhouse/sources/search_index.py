"""Contains-search over a table of trigrams, written once: a search reads the folders that can hold a hit."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tallyhouse.sources.tables import write_report

# Folders of rows, by a hash of the key, and of postings, by a hash of the trigram.
PARTS = 64
GRAM = 3


def matching(rows: DataFrame, column: str, text: str) -> DataFrame:
    """The search box: the rows whose column contains the text, in any case. `%` and `_` stand for any characters."""
    return rows.filter(F.ilike(F.col(column), F.lit(f"%{text}%")))


def write_index(rows: DataFrame, path: str, column: str, key: str = "id", parts: int = PARTS) -> None:
    """Write `rows` by a hash of their `key`, and a posting (trigram, folder of the row, key) for each trigram of `column`.

    The index holds the rows as they are now; a table that changes is indexed anew. Rows without a text, or with
    one of under three characters, have no postings: no search that uses them can match there.
    """
    # rows and postings are written by folder; a folder that holds much is spread over several tasks
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    write_report(dealt, f"{path}/rows", "_part")
    low = F.lower(column)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - (GRAM - 1)), lambda i: F.substr(low, i, F.lit(GRAM))))
    postings = dealt.filter(F.length(low) >= GRAM).select(
        F.explode(grams).alias("gram"), "_part", F.col(key).alias("key")).withColumn("_list", F.pmod(F.xxhash64("gram"), F.lit(parts)).cast("int"))
    write_report(postings, f"{path}/postings", "_list")


def _grams(spark: SparkSession, text: str, parts: int) -> tuple[list[str], list[int]]:
    """The trigrams that every hit has, and the folders of their lists. Spark lowers the pattern, as it does to compare."""
    pattern = spark.range(1).select(F.lower(F.lit(f"%{text}%"))).first()[0]
    runs = [] if "\\" in pattern else re.split("[%_]", pattern)
    grams = sorted({r[i:i + GRAM] for r in runs for i in range(len(r) - GRAM + 1)})
    if not grams:
        return [], []
    lists = spark.createDataFrame([(g,) for g in grams], "gram string").select(F.pmod(F.xxhash64("gram"), F.lit(parts)).cast("int")).distinct()
    return grams, [r[0] for r in lists.collect()]


def search_index(spark: SparkSession, path: str, column: str, text: str, schema: StructType, key: str = "id", parts: int = PARTS) -> DataFrame:
    """The rows of an index whose `column` contains `text`: those that have all its trigrams, each verified. `schema`: of the rows.

    A text without a run of three plain characters is looked for in all rows.
    """
    rows = spark.read.schema(StructType([*schema.fields, StructField("_part", IntegerType())])).parquet(f"{path}/rows")
    grams, lists = _grams(spark, text, parts)
    if not grams:
        return matching(rows, column, text).drop("_part")
    kind = f"gram string, _part int, key {schema[key].dataType.simpleString()}, _list int"
    postings = spark.read.schema(kind).parquet(f"{path}/postings").filter(F.col("_list").isin(lists) & F.col("gram").isin(grams))
    hits = postings.groupBy("_part", "key").agg(F.count("*").alias("n")).filter(F.col("n") == len(grams)).select(
        F.col("_part").alias("_in"), F.col("key").alias("_key"))
    folders = [r[0] for r in hits.select("_in").distinct().collect()]  # `parts` at most
    near = rows.filter(F.col("_part").isin(folders)) if folders else rows.filter("false")
    return matching(near.join(hits, (F.col("_part") == F.col("_in")) & F.col(key).eqNullSafe(F.col("_key")), "left_semi"), column, text).drop("_part")


def find_in(t: Mapping[str, DataFrame], table: str, column: str, text: str, index: str | None) -> DataFrame:
    """The rows of `table` whose `column` contains `text`, through the index in folder `<index>/<table>` if there is one."""
    if index is None:
        return matching(t[table], column, text)
    return search_index(t[table].sparkSession, f"{index}/{table}", column, text, t[table].schema).select(t[table].columns)
