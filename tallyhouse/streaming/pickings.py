"""Stamping pickings as invoice changes, and pickings, arrive.

Stamps are written per batch and never changed: the last updated invoice wins wherever they are read. So a
batch that is run again, batches in another order, and folders that overlap change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.operators.status import latest_open
from tallyhouse.plans.joins import skewed_join
from tallyhouse.schemas import schema_of
from tallyhouse.session import new_path

STAMP_SCHEMA = "id BIGINT, stamp_number STRING, stamped_on TIMESTAMP_NTZ, stamp_invoice_id BIGINT"
LATEST_SCHEMA = "stamp_origin STRING, stamp_number STRING, stamped_on TIMESTAMP_NTZ, stamp_invoice_id BIGINT"
ARRIVED_SCHEMA = "id BIGINT, origin STRING, factura STRING, create_date TIMESTAMP_NTZ"
# Folders that pickings are dealt to by a hash of their origin, and their column.
PARTS, PART = 64, "origin_part"
EMPTY = -1


def origin_part(origin: str, parts: int) -> Column:
    """The folder of an origin; pickings without one lie apart, where no change looks."""
    return F.when(F.col(origin).isNull(), EMPTY).otherwise(F.pmod(F.xxhash64(origin), F.lit(parts)).cast("int"))


def partition_pickings(pickings: DataFrame, path: str, parts: int = PARTS) -> None:
    """Write the pickings so that a change reads only the folders of its origins."""
    pickings.withColumn(PART, origin_part("origin", parts)).write.mode("overwrite").partitionBy(PART).parquet(path)


def _touched(rows: DataFrame, parts: int, origin: str) -> list[int]:
    """The folders of the rows' origins: `parts` at most."""
    found = rows.select(origin_part(origin, parts).alias("p")).distinct().collect()
    return sorted(r["p"] for r in found if r["p"] != EMPTY)


def _run(spark: SparkSession, schema: str | object, source: str, checkpoint: str, apply) -> None:
    (spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(apply)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())


def _start(spark: SparkSession, schema: str, path: str) -> None:
    """A folder without rows, so that the output can be read before the first batch."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/batch_id={EMPTY}")


def stamp_pickings_stream(spark: SparkSession, changes_dir: str, pickings_path: str, out_path: str,
                          checkpoint: str, parts: int | None = None) -> None:
    """Process the invoice changes that have arrived since the last run, then stop.

    Each batch writes the pickings it touches, with the invoice that stamped them, to
    its own folder of `out_path`. A batch that is run again after a failure overwrites
    that folder, so the result is exactly-once; a run without new files changes
    nothing. With `parts`, the pickings were written by `partition_pickings` with as many folders, and a batch
    reads only those that its origins lie in; without, it reads the whole table.
    """
    def apply(changes: DataFrame, batch_id: int) -> None:
        # Read back by the outer session: it knows the size of the stamps, and AQE,
        # which streams run without, can split a hot origin of the pickings.
        path = new_path(spark, "stamps")
        winners = latest_open(changes)
        winners.write.parquet(path)
        stamps = spark.read.schema(winners.schema).parquet(path)
        kind = schema_of("stock_picking")
        if parts:
            pickings = spark.read.schema(kind.add(PART, "integer")).parquet(pickings_path).filter(
                F.col(PART).isin(_touched(stamps, parts, "stamp_origin")))
        else:
            pickings = spark.read.schema(kind).parquet(pickings_path)
        (pickings.join(stamps, F.col("origin") == F.col("stamp_origin"))
         .select("id", "stamp_number", "stamped_on", "stamp_invoice_id")
         .write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}"))

    _start(spark, STAMP_SCHEMA, out_path)
    _run(spark, schema_of("account_invoice"), changes_dir, checkpoint, apply)


def _last_stamps(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STAMP_SCHEMA).parquet(path).groupBy(F.col("id").alias("_id")).agg(
        F.max(F.struct("stamped_on", "stamp_invoice_id", F.struct("stamp_number").alias("n"))).alias("_stamp"))


def _stamped(pickings: DataFrame, stamps: DataFrame) -> DataFrame:
    return pickings.join(stamps, F.col("id") == F.col("_id"), "left").select(
        "id", "origin",
        F.when(F.col("_stamp").isNotNull(), F.col("_stamp.n.stamp_number")).otherwise(F.col("factura")).alias("factura"))


def stamped_pickings(spark: SparkSession, pickings_path: str, out_path: str) -> DataFrame:
    """The picking table with all stamps written so far. The last updated invoice wins,
    whatever the order in which the changes arrived."""
    return _stamped(spark.read.schema(schema_of("stock_picking")).parquet(pickings_path), _last_stamps(spark, out_path))


def compact_stamps(spark: SparkSession, out_path: str) -> None:
    """Put the folders of all batches so far together into one, with the last stamp of each picking.

    The new folder is complete before the old ones go. A stop in between leaves both, which reads the same, as does
    a batch that is run again after its folder went.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(out_path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    old = [s.getPath() for s in files.listStatus(hadoop) if s.isDirectory() and s.getPath().getName().startswith("batch_id=")]
    ids = [int(p.getName().split("=")[1]) for p in old]
    last = _last_stamps(spark, out_path).select(
        F.col("_id").alias("id"), "_stamp.n.stamp_number", "_stamp.stamped_on", "_stamp.stamp_invoice_id")
    # Batches count up from 0, compactions down from below EMPTY.
    last.write.parquet(f"{out_path}/batch_id={min([EMPTY, *ids]) - 1}")
    for path in old:
        files.delete(path, True)


def stamp_streams(spark: SparkSession, changes_dir: str, pickings_dir: str, out_path: str, checkpoint: str, parts: int = PARTS) -> None:
    """Process the pickings and the invoice changes that have arrived since the last run, in whatever order, then stop.

    An update of an open invoice stamps the pickings of its origin that were there by then: those with a `create_date`
    up to its `write_date`, or none. So a picking that arrives late meets the latest invoice of its origin, which is kept by origin
    across runs, and an invoice that arrives late meets the pickings kept so far. Both are kept in folders
    by a hash of the origin, and a batch reads the folders its origins lie in. `stamped_by_streams` reads the result.
    """
    latest, arrived, stamps = (f"{out_path}/{name}" for name in ("latest", "arrived", "stamps"))

    def kept(schema: str, path: str, touched: list[int]) -> DataFrame:
        return spark.read.schema(f"{schema}, {PART} INT").parquet(path).filter(F.col(PART).isin(touched))

    def stamp(pickings: DataFrame, winners: DataFrame, to: str) -> None:
        met = skewed_join(pickings, winners, "origin", "stamp_origin", "id", how="inner")
        met.filter("create_date is null or create_date <= stamped_on").select(
            "id", "stamp_number", "stamped_on", "stamp_invoice_id").write.mode("overwrite").parquet(to)

    def on_pickings(batch: DataFrame, batch_id: int) -> None:
        path = f"{arrived}/batch_id={batch_id}"
        partition_pickings(batch, path, parts)
        here = spark.read.schema(f"{ARRIVED_SCHEMA}, {PART} INT").parquet(path)
        touched = sorted(r[PART] for r in here.select(PART).distinct().collect() if r[PART] != EMPTY)
        known = kept(LATEST_SCHEMA, latest, touched).groupBy("stamp_origin").agg(
            F.max(F.struct("stamped_on", "stamp_invoice_id", F.struct("stamp_number").alias("n"))).alias("w")).select(
            "stamp_origin", "w.n.stamp_number", "w.stamped_on", "w.stamp_invoice_id")
        stamp(here.filter(F.col(PART).isin(touched)), known, f"{stamps}/batch_id={2 * batch_id}")

    def on_changes(batch: DataFrame, batch_id: int) -> None:
        path = f"{latest}/batch_id={batch_id}"
        latest_open(batch).withColumn(PART, origin_part("stamp_origin", parts)).write.mode("overwrite").partitionBy(PART).parquet(path)
        winners = spark.read.schema(f"{LATEST_SCHEMA}, {PART} INT").parquet(path)
        touched = sorted(r[PART] for r in winners.select(PART).distinct().collect())
        stamp(kept(ARRIVED_SCHEMA, arrived, touched), winners.drop(PART), f"{stamps}/batch_id={2 * batch_id + 1}")

    for schema, path in ((LATEST_SCHEMA, latest), (ARRIVED_SCHEMA, arrived)):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/batch_id={EMPTY}/{PART}={EMPTY}")
    _start(spark, STAMP_SCHEMA, stamps)
    kind = schema_of("stock_picking").add("create_date", "timestamp_ntz")
    _run(spark, kind, pickings_dir, f"{checkpoint}/pickings", on_pickings)
    _run(spark, schema_of("account_invoice"), changes_dir, f"{checkpoint}/changes", on_changes)


def stamped_by_streams(spark: SparkSession, out_path: str) -> DataFrame:
    """The pickings that have arrived, with the stamps so far. Of a picking that arrived again, the last batch counts."""
    rows = spark.read.schema(f"{ARRIVED_SCHEMA}, batch_id LONG, {PART} INT").parquet(f"{out_path}/arrived").filter(F.col("batch_id") >= 0)
    pickings = rows.groupBy("id").agg(F.max_by(F.struct("origin", "factura"), "batch_id").alias("p")).select("id", "p.*")
    return _stamped(pickings, _last_stamps(spark, f"{out_path}/stamps"))
