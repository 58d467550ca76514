import datetime as dt
import os
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import status
from tallyhouse.schemas import schema_of
from tallyhouse.session import shared_dir, stage
from tallyhouse.sources.tables import even_ranges, jdbc_options, load_jdbc, load_tables, write_report
from tallyhouse.streaming.pickings import stamp_pickings_stream, stamped_pickings
from tests.builders import table, values


@pytest.mark.parametrize("fmt, options", [("parquet", {}), ("orc", {}), ("json", {}), ("csv", {"header": "true"})])
def test_tables_have_their_fixed_schema(spark, tmp_path, fmt, options):
    taxes = table(spark, "account_tax", {"id": 1, "description": "ITBMS", "amount": D("7.00"), "is_withholding_tax": False},
                  {"id": 2, "amount": D("-8.00")})
    taxes.write.format(fmt).options(**options).save(f"{tmp_path}/account_tax")
    loaded = load_tables(spark, str(tmp_path), fmt, ["account_tax"], **options)["account_tax"]
    assert loaded.dtypes == taxes.dtypes
    assert values(loaded, "id", "amount") == [(1, D("7.00")), (2, D("-8.00"))]


def test_missing_columns_are_refused_unless_optional(spark, tmp_path):
    spark.range(3).selectExpr("cast(id as int) id", "'x' name").write.parquet(f"{tmp_path}/res_partner")
    with pytest.raises(ValueError, match="lacks .*ruc"):
        load_tables(spark, str(tmp_path), names=["res_partner"])
    loaded = load_tables(spark, str(tmp_path), names=["res_partner"], optional={"res_partner": schema_of("res_partner").names})["res_partner"]
    assert loaded.schema.names == schema_of("res_partner").names
    assert loaded.filter("ruc is null and name = 'x'").count() == 3


@pytest.mark.parametrize("fmt, options", [("parquet", {}), ("json", {}), ("csv", {"header": "true"})])
def test_stored_and_further_columns_survive(spark, tmp_path, fmt, options):
    certificates = table(spark, "withholding_certificate", {"id": 1, "state": "draft"}).withColumn("number", F.lit("CRET/2020/0007"))
    certificates.withColumn("further", F.lit("x")).write.format(fmt).options(**options).save(f"{tmp_path}/withholding_certificate")
    table(spark, "sale_order", {"id": 1}).write.format(fmt).options(**options).save(f"{tmp_path}/sale_order")
    loaded = load_tables(spark, str(tmp_path), fmt, ["withholding_certificate", "sale_order"], stored={"withholding_certificate": ["number"]}, **options)
    assert values(loaded["withholding_certificate"], "id", "number") == [(1, "CRET/2020/0007")]
    assert fmt == "json" or "further" in loaded["withholding_certificate"].columns
    assert "canceled_at" not in loaded["sale_order"].columns


def test_folder_of_another_name(spark, tmp_path):
    table(spark, "commission_rule", {"id": 1, "percentage": D("2.50")}).write.parquet(f"{tmp_path}/rules_v2")
    loaded = load_tables(spark, str(tmp_path), names=["commission_rule"], folders={"commission_rule": "rules_v2"})
    assert values(loaded["commission_rule"], "id", "percentage") == [(1, D("2.50"))]


def test_report_has_a_folder_per_value(spark, tmp_path):
    path = str(tmp_path / "report")
    rows = spark.range(100).selectExpr("id", "date_add(date'2020-01-01', cast(id%3 as int)) day")
    write_report(rows, path, "day")
    write_report(rows, path, "day")
    assert sorted(d for d in os.listdir(path) if d.startswith("day")) == [f"day=2020-01-0{i}" for i in (1, 2, 3)]
    assert spark.read.parquet(path).count() == 100


def test_a_day_rewritten_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "report")
    rows = spark.range(90).selectExpr("id", "date_add(date'2020-01-01', cast(id%3 as int)) day")
    write_report(rows, path, "day")
    write_report(rows.filter("day = date'2020-01-02' and id < 10"), path, "day")
    assert values(spark.read.parquet(path).groupBy("day").count().selectExpr("cast(day as string) day", "count"), "day", "count") == [
        ("2020-01-01", 30), ("2020-01-02", 3), ("2020-01-03", 30)]


def test_jdbc_reads_in_ranges(spark):
    with pytest.raises(ValueError, match="bounds"):
        jdbc_options("jdbc:x", "t", partitions=4)
    with pytest.raises(ValueError, match="may be large"):
        load_jdbc(spark, "account_invoice", url="jdbc:x")
    assert jdbc_options("jdbc:x", "t", lower=1, upper=9, partitions=4)["numPartitions"] == "4"
    assert "partitionColumn" not in jdbc_options("jdbc:x", "t")


def test_written_intermediates_are_in_the_shared_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    staged = stage(spark.range(10), "probe")
    assert all(f.removeprefix("file:").removeprefix("//").startswith(shared_dir(spark)) for f in staged.inputFiles())
    assert staged.agg(F.sum("id")).first()[0] == 45


def test_stream_equals_batch_and_repeats_without_change(spark, tmp_path):
    changes = [
        {"id": i, "origin": f"SO{i % 40}" if i % 9 else None, "state": "open" if i % 4 else "paid", "number": f"F{i}",
         "write_date": dt.datetime(2020, 1, 1 + (i * 7) % 28)} for i in range(200)]
    invoices = table(spark, "account_invoice", *changes)
    pickings = table(spark, "stock_picking", *[
        {"id": i, "origin": f"SO{i % 50}" if i % 10 else None, "factura": "old" if i % 3 else None} for i in range(100)])
    source, out, progress, base = (str(tmp_path / n) for n in ("changes", "out", "progress", "pickings"))
    pickings.write.parquet(base)
    expected = values(status.stamp_pickings({"account_invoice": invoices, "stock_picking": pickings}), "id", "origin", "factura")

    def run():
        stamp_pickings_stream(spark, source, base, out, progress)
        return values(stamped_pickings(spark, base, out), "id", "origin", "factura")

    table(spark, "account_invoice").write.parquet(source)
    assert run() == values(pickings, "id", "origin", "factura")
    # The later changes arrive first.
    invoices.filter("id >= 100").write.mode("append").parquet(source)
    run()
    invoices.filter("id < 100").write.mode("append").parquet(source)
    assert run() == expected
    assert run() == expected


@pytest.mark.parametrize("keys, partitions", [
    ([*range(1000), *range(10**9, 10**9 + 50)], 8), ([5] * 500 + [*range(100)], 4), ([7], 3), ([], 5), ([1, 2, None, None], 1), ([-3, 0, None, 9], 2)])
def test_ranges_of_skewed_keys(spark, keys, partitions):
    """Each key lies in one range, and no range of distinct keys is much larger than its share."""
    frame = spark.createDataFrame([(k,) for k in keys], "id long")
    ranges = even_ranges(frame, partitions)
    rows = spark.createDataFrame([(k,) for k in [*keys, None, -(10**12), 10**12]], "id long")
    counts = [rows.filter(r).count() for r in ranges]
    assert len(ranges) <= max(partitions, 1) and sum(counts) == rows.count()
    assert rows.filter(" or ".join(f"({r})" for r in ranges)).count() == rows.count()
    if len(set(keys)) > 500:
        assert max(counts) <= 1.2 * len(keys) / partitions + 3
