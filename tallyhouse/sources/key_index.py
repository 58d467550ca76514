"""Stored rows by the hash of a key: a check of new rows against them reads the folders and row groups that can hold their keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

# Folders of rows, by the key's hash, and the tasks that write one of them.
PARTS = 64
WRITERS = 8
# Most hashes of new keys that go into the scan's filter; with more, the folders alone are pruned.
LISTED = 1_000


def _hashed(rows: DataFrame, key: Sequence[Column], parts: int) -> DataFrame:
    """The rows that have a whole key, with its hash and folder."""
    given = rows.filter(F.concat_ws("", *[k.cast("string") for k in key]) != "")
    for k in key:
        given = given.filter(k.isNotNull())
    return given.withColumn("_hash", F.xxhash64(*key)).withColumn("_part", F.pmod("_hash", F.lit(parts)).cast("int"))


def write_keys(rows: DataFrame, path: str, key: Sequence[Column], parts: int = PARTS, mode: str = "overwrite") -> None:
    """Write `rows` by the hash of their `key`, in its order, with a Bloom filter of the hashes in every file. `mode="append"` adds rows.

    Rows with NULL in their key, or with an empty one, can't conflict and are left out. A key that many rows hold is
    written by WRITERS tasks.
    """
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(WRITERS))
    dealt = _hashed(rows, key, parts).repartition(F.col("_part"), salt).sortWithinPartitions("_part", "_hash")
    (dealt.write.mode(mode).partitionBy("_part").option("parquet.bloom.filter.enabled#_hash", "true").parquet(path))


def with_stored(new: DataFrame, path: str, key: Sequence[Column], row_id: str | None = "id", parts: int = PARTS) -> DataFrame:
    """`new`, and the rows stored at `path` that can share a key with it, but those that it replaces by `row_id`.

    Any check of equal keys gives for the new rows what it gives over all rows. Only folders of new keys are read,
    and of those the row groups whose statistics and Bloom filters do not rule the hashes out. Rows behind equal hashes of
    different keys come along; the check tells them apart. An empty `new` reads nothing.
    """
    kind = StructType([*new.schema.fields, StructField("_hash", LongType()), StructField("_part", IntegerType())])
    keys = _hashed(new, key, parts).select("_hash", "_part").distinct()
    folders = [r[0] for r in keys.select("_part").distinct().collect()]  # `parts` at most
    if not folders:
        return new
    hashes = [r[0] for r in keys.select("_hash").limit(LISTED + 1).collect()]
    near = new.sparkSession.read.schema(kind).parquet(path).filter(F.col("_part").isin(folders))
    if len(hashes) <= LISTED:
        near = near.filter(F.col("_hash").isin(hashes))
    near = near.join(keys.select(F.col("_hash").alias("_new")), F.col("_hash") == F.col("_new"), "left_semi")
    if row_id is not None:
        near = near.join(new.select(F.col(row_id).alias("_id")), F.col(row_id).eqNullSafe(F.col("_id")), "left_anti")
    return new.unionByName(near.select(*new.columns))
