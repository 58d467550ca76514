"""A third of the rows on one key: the plans split it, and lose or add nothing."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import fiscal, partners, reports, status
from tallyhouse.sources.tables import conform
from tallyhouse.schemas import schema_of
from tests.builders import tables

ROWS = 60_000


@pytest.fixture(scope="module", autouse=True)
def small_limits(spark):
    """The limits of a cluster, scaled down to the data of a test."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB"}
    for key, value in conf.items():
        spark.conf.set(key, value)
    yield
    for key in conf:
        spark.conf.unset(key)


def filled(df, name):
    schema = schema_of(name)
    return conform(df, schema, optional=schema.names)


def run(df):
    """Rows and final plan of `df`."""
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def test_hot_origin_of_pickings(spark):
    pickings = filled(spark.range(0, ROWS, 1, 12).selectExpr(
        "id", "case when id%3=0 then 'HOT' when id%3=1 then null else concat('SO', id) end origin"), "stock_picking")
    invoices = filled(spark.range(2000).selectExpr(
        "id", "case when id=0 then 'HOT' else concat('SO', id) end origin", "'open' state", "concat('F', id) number",
        "timestamp_ntz'2020-01-01 00:00:00' write_date"), "account_invoice")
    rows, plan = run(status.stamp_pickings({"stock_picking": pickings, "account_invoice": invoices}))
    assert "skew=true" in plan
    assert len(rows) == ROWS
    assert sum(r.factura == "F0" for r in rows) == ROWS // 3
    assert sum(r.factura is not None for r in rows) == ROWS // 3 + sum(1 for i in range(1, 2000) if i % 3 == 2)


def test_hot_ruc(spark):
    people = filled(spark.range(0, ROWS, 1, 12).selectExpr(
        "id", "case when id%3=0 then '8-1 2' else cast(id as string) end ruc"), "res_partner")
    rows, plan = run(partners.ruc_duplicates({"res_partner": people}))
    assert "skew=true" in plan
    # id 812 is spelled like the hot RUC, and is no multiple of 3
    assert len(rows) == ROWS // 3 + 1 and {r.holders for r in rows} == {ROWS // 3 + 1}


def test_hot_bill(spark):
    t = tables(
        spark, account_account=[{"id": 1, "partner_concept_id": 1}], partner_concept=[{"id": 1, "code": "1", "type": 1}],
        res_company=[{"id": 1}], res_partner=[{"id": 1, "supplier": True}])
    t["account_invoice"] = filled(spark.range(0, 40_000, 1, 4).selectExpr(
        "id", "'in_invoice' type", "'paid' state", "1 partner_id"), "account_invoice")
    t["account_invoice_line"] = filled(spark.range(0, ROWS, 1, 12).selectExpr(
        "id", "case when id%3=0 then 7 else id%40000 end invoice_id", "1 account_id", "1 company_id", "1 price_subtotal"),
        "account_invoice_line")
    rows, plan = run(reports.annex72_lines(t))
    assert "skew=true" in plan
    assert len(rows) == ROWS and len({r.id for r in rows}) == ROWS


def test_hot_text_of_refunds(spark):
    t = tables(spark, fiscal_document=[], fiscal_printer=[])
    t["account_invoice"] = filled(spark.range(0, ROWS, 1, 12).selectExpr(
        "id", "'out_refund' type", "case when id%3=0 then 'devuelto' when id%3=1 then concat('m', id) end name"), "account_invoice")
    t["account_invoice_refund"] = filled(spark.range(4000).selectExpr(
        "id", "case when id=0 then 'devuelto' else concat('m', id) end description", "'refund' filter_refund"), "account_invoice_refund")
    rows, plan = run(fiscal.refund_links(t))
    assert "skew=true" in plan
    assert len(rows) == ROWS and sum(r.refund_note == "devuelto" for r in rows) == ROWS // 3


def test_shared_move_name_is_summed_before_the_join(spark):
    day = dt.date(2020, 1, 1)
    t = tables(spark, account_journal=[{"id": 1, "name": "B", "at_least_one_outbound": False, "x_porcentaje_comision": D("0.01")}])
    t["account_move"] = filled(spark.range(0, ROWS, 1, 12).select(
        "id", F.lit("/").alias("name"), F.lit(1).alias("amount"), F.lit(day).alias("date"), F.lit(1).alias("store_id"),
        F.lit(1).alias("journal_id")), "account_move")
    t["account_payment"] = filled(spark.range(3000).selectExpr("id", "'/' move_name"), "account_payment")
    rows, _ = run(reports.cash_payments(t))
    # all pairs would be 180 million rows
    assert len(rows) == 3000 and {(r.subtotal, r.percentage_amount) for r in rows} == {(D(ROWS), D(ROWS) / 100)}
