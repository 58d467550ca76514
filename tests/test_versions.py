"""Table versions: only touched folders are written, and a stopped job is carried out."""

import datetime as dt
import os
import shutil

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import orders
from tallyhouse.sources import versions
from tallyhouse.sources.versions import changed_rows, finish_rewrite, rewrite_partitions
from tests.builders import table, values

DUE = dt.date(2020, 5, 1)


@pytest.fixture()
def stored(spark, tmp_path):
    path = str(tmp_path / "sale_order")
    rows = table(spark, "sale_order", *({"id": i, "state": "sale", "invoice_status": "to invoice", "payment_term_id": 1} for i in range(40)))
    rows.withColumns({"canceled_at": F.when(F.col("id").isin(3, 13, 7), F.lit(DUE)), "store": F.when(F.col("id") % 10 < 9, F.col("id") % 10)}).write.partitionBy(
        "store").parquet(path)
    return path


def times(path):
    return {f"{d}/{n}": os.stat(f"{d}/{n}").st_mtime_ns for d, _, names in os.walk(path) for n in names if n.startswith("part-")}


def cancelled(spark, path):
    now = spark.read.parquet(path)
    terms = table(spark, "account_payment_term", {"id": 1, "payment_term_type": "credit_payment"})
    return changed_rows(now, orders.cancel_orders({"sale_order": now, "account_payment_term": terms}, DUE))


def test_only_touched_folders_are_written(spark, stored):
    before, rows = times(stored), values(spark.read.parquet(stored), "id", "store", "canceled_at")
    assert rewrite_partitions(spark, stored, "store", cancelled(spark, stored)) == 2
    after = times(stored)
    assert {f for f in before if "store=3" not in f and "store=7" not in f} == set(before) & set(after)
    assert all(before[f] == after[f] for f in set(before) & set(after))
    assert values(spark.read.parquet(stored).filter("state = 'cancel'"), "id") == [(13,), (3,), (7,)]
    assert values(spark.read.parquet(stored), "id", "store", "canceled_at") == rows
    assert rewrite_partitions(spark, stored, "store", cancelled(spark, stored)) == 0 and times(stored) == after


@pytest.mark.parametrize("lost", [["store=3"], ["store=3", "store=7"], []])
def test_a_job_that_stops_half_way_is_carried_out(spark, stored, tmp_path, monkeypatch, lost):
    """It stops between the note and the swap, with folders already gone."""
    whole = str(tmp_path / "whole")
    shutil.copytree(stored, whole)
    rewrite_partitions(spark, whole, "store", cancelled(spark, whole))
    calls = []

    def stop(*_):
        calls.append(1)
        if len(calls) == 2:
            for folder in lost:
                shutil.rmtree(f"{stored}/{folder}")
            raise RuntimeError("stopped")

    monkeypatch.setattr(versions, "finish_rewrite", stop)
    with pytest.raises(RuntimeError):
        rewrite_partitions(spark, stored, "store", cancelled(spark, stored))
    monkeypatch.undo()
    assert finish_rewrite(spark, stored) and not finish_rewrite(spark, stored)
    rewrite_partitions(spark, stored, "store", cancelled(spark, stored))
    columns = spark.read.parquet(whole).columns
    assert values(spark.read.parquet(stored), *columns) == values(spark.read.parquet(whole), *columns)


def test_rows_that_move_or_go(spark, stored):
    """A folder that loses its last row goes; rows without a value have a folder too; new rows are added."""
    now = spark.read.parquet(stored)
    moved = now.filter("id in (5, 9)").withColumn("store", F.lit(2)).unionByName(now.filter("id = 1").withColumns({"id": F.lit(100).cast("long"), "store": F.lit(77)}))
    removed = spark.createDataFrame([(15,), (25,), (35,), (8,)], "id long")
    expected = {r["id"]: r["store"] for r in now.collect() if r["id"] not in (15, 25, 35, 8)} | {5: 2, 9: 2, 100: 77}
    assert rewrite_partitions(spark, stored, "store", moved.select(now.columns), removed=removed) == 5
    assert {r["id"]: r["store"] for r in spark.read.parquet(stored).collect()} == expected
    assert not os.path.exists(f"{stored}/store=5") and os.path.exists(f"{stored}/store=77")
