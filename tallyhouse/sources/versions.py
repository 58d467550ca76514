"""New versions of stored tables, of which only the touched partitions are written."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.session import new_path

# Beside the partitions; readers skip names that start so.
PENDING = "_pending"


def _files(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def changed_rows(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """The rows of `after` that differ from the row of `before` with the same `key`, or are new."""
    old = before.select(F.col(key).alias("_key"), F.struct(*after.columns).alias("_old"))
    same = F.coalesce(F.col("_old").eqNullSafe(F.struct(*(F.col(c) for c in after.columns))), F.lit(False))
    return after.join(old, F.col(key) == F.col("_key"), "left").filter(F.col("_key").isNull() | ~same).select(*after.columns)


def finish_rewrite(spark: SparkSession, path: str) -> bool:
    """Carry out a rewrite that was stopped, from its staged copy. True if there was one."""
    files, marker = _files(spark, f"{path}/{PENDING}")
    done, success = _files(spark, f"{path}/{PENDING}/_SUCCESS")
    if not done.exists(success):
        files.delete(marker, True)  # stopped before anything was touched
        return False
    rows = spark.read.parquet(f"{path}/{PENDING}").collect()  # one per touched partition
    staged = rows[0]["staged"]
    (spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(rows[0]["partition_by"]).parquet(path))
    for row in rows:  # the overwrite leaves partitions alone that have no rows any more
        if row["emptied"]:
            uri = spark._jvm.java.net.URI(row["emptied"])
            folder = spark._jvm.org.apache.hadoop.fs.Path(uri)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    files.delete(marker, True)
    return True


def rewrite_partitions(spark: SparkSession, path: str, partition_by: str, changes: DataFrame, key: str = "id",
                       removed: DataFrame | None = None) -> int:
    """Put `changes` (whole rows) in the place of the rows with the same `key`, and leave out those whose `key` is in `removed`.

    The table at `path` is Parquet in folders of `partition_by`. Only folders that hold such a row now, or get one, are
    written; all other files stay. The new folders are first written elsewhere, then noted in the table, then
    swapped in. So a job that stops half-way is carried out by `finish_rewrite`, or by the next rewrite, from the copy.
    Returns the number of folders. They come to the driver, so there should be thousands at most.
    """
    finish_rewrite(spark, path)
    table = spark.read.parquet(path)
    gone = changes.select(key) if removed is None else changes.select(key).unionByName(removed.select(key))
    gone = gone.select(F.col(key).alias("_gone")).distinct()
    held = table.select(partition_by, key).join(gone, F.col(key) == F.col("_gone"), "left_semi").select(partition_by)
    values = [r[0] for r in held.unionByName(changes.select(partition_by)).distinct().collect()]
    if not values:
        return 0

    def among(column: str) -> Column:
        return reduce(lambda a, b: a | b, (F.col(column).eqNullSafe(F.lit(v)) for v in values))

    touched = table.filter(among(partition_by))
    rows = touched.join(gone, F.col(key) == F.col("_gone"), "left_anti").unionByName(changes.select(*table.columns))
    staged = new_path(spark, "version")
    rows.write.partitionBy(partition_by).parquet(staged)
    left = spark.read.schema(table.schema).parquet(staged).select(F.col(partition_by).alias("_left")).distinct()
    folders = touched.select(partition_by, F.regexp_extract(F.input_file_name(), "^(.*)/[^/]*$", 1).alias("emptied")).distinct()
    emptied = [r["emptied"] for r in folders.join(left, F.col(partition_by).eqNullSafe(F.col("_left")), "left_anti").collect()]
    notes = [(staged, partition_by, folder) for folder in emptied] or [(staged, partition_by, None)]
    (spark.createDataFrame(notes, "staged string, partition_by string, emptied string").coalesce(1)
     .write.mode("overwrite").parquet(f"{path}/{PENDING}"))
    finish_rewrite(spark, path)
    return len(values)
