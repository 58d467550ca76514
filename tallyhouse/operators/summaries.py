"""Pivots with subtotals and the daily cash report."""

from __future__ import annotations

import datetime as dt
from collections import ChainMap
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.columns import MONEY_SUM, as_date
from tallyhouse.operators import reports
from tallyhouse.plans.numbering import number_rows

Tables = Mapping[str, DataFrame]

GRAINS = ("day", "week", "month", "quarter", "year")


def _pivot(df: DataFrame, rows: list[str], measures: list[str]) -> DataFrame:
    """Sums with subtotals. The rows are summed on the full key before they are
    repeated for each level, so the repetition touches groups only. `level` is the
    number of row fields in use: 0 is the grand total, so a NULL name is not taken
    for a subtotal."""
    full = df.groupBy(*rows).agg(*[F.sum(m).alias(m) for m in measures])
    rolled = full.rollup(*rows).agg(
        *[F.sum(m).alias(m) for m in measures],
        *[F.grouping(r).alias(f"_g_{r}") for r in rows])
    used = sum((1 - F.col(f"_g_{r}") for r in rows), F.lit(0))
    return rolled.select(*rows, used.cast("int").alias("level"), *measures)


ANNEX_KEYS = ["partner_name", "partner_ruc", "partner_dv"]
ANNEX_MEASURES = ["account_invoice_line_price", "partner_type", "partner_concept_type", "partner_concept_code", "account_invoice_state"]
COMMISSION_MEASURES = ["total", "commission_total"]


def _annex_pivot(rows: DataFrame) -> DataFrame:
    pivot = _pivot(rows, ANNEX_KEYS, ANNEX_MEASURES)
    return pivot.withColumn("account_invoice_line_price", F.col("account_invoice_line_price").cast(MONEY_SUM))


def annex72_pivot(t: Tables) -> DataFrame:
    """Annex sums by partner name, RUC and DV, with subtotals at every level."""
    return _annex_pivot(reports.annex72_lines(t))


def _commission_pivot(rows: DataFrame, grain: str) -> DataFrame:
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {GRAINS}")
    bucket = F.col("invoice_date") if grain == "day" else F.trunc("invoice_date", grain)
    pivot = _pivot(rows.withColumn("invoice_date", bucket), ["invoice_date", "vendor_name"], COMMISSION_MEASURES)
    return pivot.select("invoice_date", "vendor_name", "level", F.col("total").cast(MONEY_SUM).alias("total"),
                        F.col("commission_total").cast("decimal(32,6)").alias("commission_total"))


def commission_pivot(t: Tables, grain: str = "month") -> DataFrame:
    """Totals and commissions by invoice date (bucketed by `grain`) and vendor, with
    subtotals."""
    return _commission_pivot(reports.commission_lines(t), grain)


# --- pivots kept up to date ---------------------------------------------------

def _sums(lines: DataFrame, keys: list[str], measures: list[str], sign: int = 1) -> DataFrame:
    """Per key the rows, and of each measure the sum and how many rows have one, all times `sign`."""
    def signed(c: Column) -> Column:
        return c if sign > 0 else -c

    return lines.groupBy(*keys).agg(
        signed(F.count("*")).alias("n_rows"), *(signed(F.coalesce(F.sum(m), F.lit(0))).cast("decimal(38,6)").alias(m) for m in measures),
        *(signed(F.count(m)).alias(f"n_{m}") for m in measures))


def _annex_sums(t: Tables, sign: int = 1) -> DataFrame:
    return _sums(reports.annex72_lines(t), ["account_invoice_date", *ANNEX_KEYS], ANNEX_MEASURES, sign)


def _commission_sums(t: Tables, sign: int = 1) -> DataFrame:
    return _sums(reports.commission_lines(t), ["invoice_date", "vendor_name"], COMMISSION_MEASURES, sign)


SUMS = {"annex72": _annex_sums, "commission": _commission_sums}


def pivot_sums(t: Tables, pivot: str) -> DataFrame:
    """What a pivot (`annex72` or `commission`) keeps in store: sums per day and key, with the numbers of rows behind them."""
    return SUMS[pivot](t)


def _of_invoices(t: Tables, invoices: DataFrame) -> Tables:
    """The tables with the invoices of those ids, and their lines, alone."""
    ids = invoices.select(F.col("id").alias("_only"))
    cut = {"account_invoice": "id", "account_invoice_line": "invoice_id"}
    return ChainMap({name: t[name].join(ids, F.col(key) == F.col("_only"), "left_semi") for name, key in cut.items()}, t)


def merged_sums(sums: DataFrame, before: Tables, after: Tables, invoices: DataFrame, pivot: str) -> DataFrame:
    """The stored `sums` after the `invoices` (`id`) changed, came or went: what they gave before is taken off, what they give now is added.

    `before` are the tables that the sums were made of. Only the changed invoices and their lines are looked at, so
    the other tables (partners, accounts, rules, categories) must be the same in both. Keys without a row left go.
    """
    was, now = (SUMS[pivot](_of_invoices(t, invoices), sign) for t, sign in ((before, -1), (after, 1)))
    counts = [c for c in sums.columns if c.startswith("n_")]
    measures = [c[2:] for c in counts if c != "n_rows"]
    keys = [c for c in sums.columns if c not in (*counts, *measures)]
    every = sums.unionByName(was).unionByName(now).groupBy(*keys).agg(
        *(F.sum(c).cast(sums.schema[c].dataType).alias(c) for c in [*counts, *measures]))
    return every.filter("n_rows > 0").select(sums.columns)


def pivot_of_sums(sums: DataFrame, pivot: str, grain: str = "month") -> DataFrame:
    """The pivot out of its stored sums."""
    measures = ANNEX_MEASURES if pivot == "annex72" else COMMISSION_MEASURES
    rows = sums.withColumns({m: F.when(F.col(f"n_{m}") > 0, F.col(m)) for m in measures})
    if pivot != "annex72":
        return _commission_pivot(rows, grain)
    whole = _annex_pivot(rows)
    return whole.withColumns({m: F.col(m).cast("bigint") for m in ANNEX_MEASURES[1:]})


def check_range(start_on: dt.date, end_on: dt.date) -> None:
    """The range check of one report."""
    if end_on < start_on:
        raise ValueError("the end date cannot be earlier than the start date")


def cash_range_check(t: Tables) -> DataFrame:
    """Requested report ranges that end before they start."""
    return t["cash_report_request"].filter(F.col("end_on") < F.col("start_on")).withColumn(
        "reason", F.lit("end_before_start"))


def _in_report(df: DataFrame, store_id: int, start_on: dt.date, end_on: dt.date) -> DataFrame:
    return df.filter((F.col("store_id") == store_id) & F.col("date_invoice").between(as_date(start_on), as_date(end_on)))


def _sections(df: DataFrame, key: str, name: str, measures: dict[str, str]) -> DataFrame:
    """One row per key and measure, and one total row per measure, from one scan."""
    grouped = df.groupingSets([(key,), ()], key).agg(
        F.max(name).alias("name"), F.grouping(key).alias("_total"),
        *[F.coalesce(F.sum(column), F.lit(0)).cast(MONEY_SUM).alias(column) for column in measures.values()])
    pairs = ", ".join(f"'{section}', {column}" for section, column in measures.items())
    return grouped.selectExpr(
        f"cast({key} as bigint) as item_id", "name", "_total = 1 as is_total",
        f"stack({len(measures)}, {pairs}) as (section, total)").select(
        "section", "item_id", F.when(~F.col("is_total"), F.col("name")).alias("name"), "total", "is_total")


def cash_report(t: Tables, store_id: int | None, start_on: dt.date | None, end_on: dt.date | None) -> DataFrame:
    """The cash report of one store and an inclusive date range, in long form.

    Sections `subtotal`, `commission` and `payment` have a row per payment method,
    `tax` a row per tax; each has a total row, and `movements` has its total only. A
    total is 0 when nothing was found. The report is empty while a filter is missing.
    """
    schema = "section string, item_id bigint, name string, total decimal(28,2), is_total boolean"
    spark = t["account_move"].sparkSession
    if not (store_id and start_on and end_on):
        return spark.createDataFrame([], schema)
    check_range(start_on, end_on)
    payments = _sections(
        _in_report(reports.cash_payments(t), store_id, start_on, end_on), "payment_journal_id", "journal_name",
        {"subtotal": "subtotal", "commission": "percentage_amount", "payment": "payment_amount"})
    taxes = _sections(
        _in_report(reports.cash_taxes(t), store_id, start_on, end_on), "tax_id", "tax_description",
        {"tax": "tax_amount"})
    movements = _in_report(reports.cash_movement_rows(t), store_id, start_on, end_on).agg(
        F.coalesce(F.sum("amount_total"), F.lit(0)).cast(MONEY_SUM).alias("total")).selectExpr(
        "'movements' section", "cast(null as bigint) item_id", "cast(null as string) name", "total", "true is_total")
    # Grouping sets give no total row for an empty input; these rows stand in for it.
    zeros = spark.range(1).selectExpr(
        "explode(array('subtotal','commission','payment','tax')) section", "cast(null as bigint) item_id",
        "cast(null as string) name", "cast(0 as decimal(28,2)) total", "true is_total")
    return (
        payments.unionByName(taxes).unionByName(zeros)
        .groupBy("section", "item_id", "is_total")
        .agg(F.max("name").alias("name"), F.sum("total").cast(MONEY_SUM).alias("total"))
        .select("section", "item_id", "name", "total", "is_total")
        .unionByName(movements))


def cash_movements_detail(t: Tables, store_id: int | None, start_on: dt.date | None,
                          end_on: dt.date | None) -> DataFrame:
    """The numbered movements of one store and date range, and their total."""
    columns = ["invoice_number", "partner_name", "journal_name", "date_invoice", "amount_total"]
    if not (store_id and start_on and end_on):
        schema = ("number bigint, invoice_number string, partner_name string, journal_name string, "
                  "date_invoice date, amount_total decimal(28,2), is_total boolean")
        return t["account_move"].sparkSession.createDataFrame([], schema)
    check_range(start_on, end_on)
    rows = _in_report(reports.cash_movement_rows(t), store_id, start_on, end_on)
    order = [F.col("id").asc_nulls_last(), F.col("partner_name").asc_nulls_last(), "amount_total", "date_invoice",
             "invoice_number", "journal_name", "move_id"]
    numbered = number_rows(rows.select("id", *columns, "move_id"), order, "number")
    detail = numbered.select("number", *columns[:-1], F.col("amount_total").cast(MONEY_SUM).alias("amount_total"),
                             F.lit(False).alias("is_total"))
    total = numbered.agg(F.coalesce(F.sum("amount_total"), F.lit(0)).cast(MONEY_SUM).alias("amount_total")).withColumn(
        "is_total", F.lit(True))
    return detail.unionByName(total, allowMissingColumns=True)
