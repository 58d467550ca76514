"""Credit orders, their deadlines and their amounts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.columns import MONEY, as_date, percent_of
from tallyhouse.operators.products import product_attributes
from tallyhouse.plans.asof import asof_join

Tables = Mapping[str, DataFrame]

# Days from the first payment to the cancellation and to the notice.
CANCEL_AFTER_DAYS = 90
NOTIFY_AFTER_DAYS = 80


def _credit_terms(t: Tables) -> DataFrame:
    return t["account_payment_term"].filter(F.col("payment_term_type") == "credit_payment").select(
        F.col("id").alias("_credit_term"))


def _to_invoice() -> Column:
    return (F.col("state") == "sale") & (F.col("invoice_status") == "to invoice")


def _payable(t: Tables, orders: DataFrame) -> DataFrame:
    """Confirmed orders still to invoice, on a credit term."""
    return orders.filter(_to_invoice()).join(
        _credit_terms(t), F.col("payment_term_id") == F.col("_credit_term"), "left_semi")


def _flagged(t: Tables) -> DataFrame:
    """All orders, with whether they are payable."""
    return t["sale_order"].join(
        _credit_terms(t), F.col("payment_term_id") == F.col("_credit_term"), "left").withColumn(
        "_payable", F.coalesce(_to_invoice() & F.col("_credit_term").isNotNull(), F.lit(False)))


def _first_payments(t: Tables) -> DataFrame:
    # Payments get their ids as they are booked; one that is dated back later is not the first.
    first = F.min(F.struct("id", "payment_date")).alias("_first")
    return t["account_payment"].filter(F.col("sale_order_id").isNotNull()).groupBy(
        F.col("sale_order_id").alias("_paid_order")).agg(first)


def _paid_while_payable(t: Tables) -> DataFrame:
    """The first payment of each order that could be paid on when it was booked, by the log of what the order went through.

    Later payments do not count, so an order that was a draft at its first payment never gets a date.
    """
    first = _first_payments(t).select("_paid_order", "_first", F.col("_first.payment_date").alias("_day"))
    log = t["sale_order_log"].select("id", F.col("order_id").alias("_paid_order"), "changed_on", "state", "invoice_status", "payment_term_id")
    met = asof_join(first, log, "_paid_order", "_day", "changed_on", ["state", "invoice_status", "payment_term_id"], "_then")
    then = met.select("_paid_order", "_first", "_then.*")
    return _payable(t, then).select("_paid_order", "_first")


def order_first_payment(t: Tables, as_of_payment: bool = False) -> DataFrame:
    """The first payment of each payable order: the one that was booked first, by id.

    Whether an order is payable is read from its present state. With `as_of_payment` it is read from `sale_order_log`
    as it stood at the payment's day; orders without an entry by then were not payable.
    """
    orders = t["sale_order"].select(F.col("id").alias("order_id")) if as_of_payment else (
        _payable(t, t["sale_order"]).select(F.col("id").alias("order_id")))
    payments = _paid_while_payable(t) if as_of_payment else _first_payments(t)
    return orders.join(payments, F.col("order_id") == F.col("_paid_order")).select(
        "order_id", F.col("_first.id").alias("payment_id"), F.col("_first.payment_date").alias("first_payment_date"))


DATES = ("first_payment_date", "canceled_at", "notified_at")


def _dated(t: Tables, as_of_payment: bool = False) -> DataFrame:
    """The orders with their dates and whether they can be paid on, in one pass. Dates that are set stay."""
    orders = t["sale_order"]
    payments = _paid_while_payable(t) if as_of_payment else _first_payments(t)
    counts = F.lit(True) if as_of_payment else F.col("_payable")
    paid = _flagged(t).join(payments, F.col("id") == F.col("_paid_order"), "left").withColumn(
        "_day", F.when(counts, F.col("_first.payment_date")))

    def updated(name: str, value: Column) -> Column:
        old = F.col(name) if name in orders.columns else F.lit(None).cast("date")
        return F.coalesce(old, value).alias(name)

    # The deadlines count from the first payment that stands, the stored one if there is one.
    paid = paid.withColumn("_start", F.coalesce(
        F.col("first_payment_date") if "first_payment_date" in orders.columns else F.lit(None).cast("date"), "_day"))
    return paid.select(
        *[c for c in orders.columns if c not in DATES],
        updated("first_payment_date", F.col("_day")),
        updated("canceled_at", F.date_add("_start", CANCEL_AFTER_DAYS)),
        updated("notified_at", F.date_add("_start", NOTIFY_AFTER_DAYS)), "_payable")


def order_deadlines(t: Tables, as_of_payment: bool = False) -> DataFrame:
    """The order table with first payment, cancellation and notice dates. A date once given stays.

    `as_of_payment` as in `order_first_payment`.
    """
    return _dated(t, as_of_payment).drop("_payable")


def _due(as_of: dt.date, catch_up: bool) -> Column:
    run_day = as_date(as_of)
    on_time = F.col("canceled_at") <= run_day if catch_up else F.col("canceled_at") == run_day
    return F.col("_payable") & F.coalesce(on_time, F.lit(False))


def orders_to_cancel(t: Tables, as_of: dt.date, catch_up: bool = False) -> DataFrame:
    """Ids of payable orders whose cancellation date is the run date, in order of id.

    `catch_up=True` also takes earlier dates, for a scheduler that missed a day. The
    dates are read from the orders, or computed when the table has none.
    """
    orders = _flagged(t) if "canceled_at" in t["sale_order"].columns else _dated(t)
    return orders.filter(_due(as_of, catch_up)).select("id").orderBy("id")


def cancel_orders(t: Tables, as_of: dt.date, catch_up: bool = False) -> DataFrame:
    """The order table after cancelling the orders that are due."""
    state = F.when(_due(as_of, catch_up), "cancel").otherwise(F.col("state"))
    columns = t["sale_order"].columns
    orders = _flagged(t) if "canceled_at" in columns else _dated(t)
    return orders.withColumn("state", state).select(*columns)


def payable_orders(t: Tables, partner_id: int | None = None) -> DataFrame:
    """Orders a payment can be booked on, optionally of one partner."""
    orders = t["sale_order"]
    if partner_id is not None:
        orders = orders.filter(F.col("partner_id") == partner_id)
    return _payable(t, orders).select("id", "name", "partner_id", "payment_term_id", "state", "invoice_status")


def order_line_amounts(t: Tables) -> DataFrame:
    """Discounted price, subtotal, tax and total of each order line.

    Taxes are a percentage on top of the price, the only case covered.
    """
    lines = t["sale_order_line"]
    taxes = t["account_tax"].select(F.col("id").alias("_tax"), F.col("amount").alias("_rate"))
    reduced = percent_of(F.col("price_unit"), 100 - F.coalesce("discount", F.lit(0).cast("decimal(6,2)")))
    priced = lines.join(taxes, F.col("tax_id") == F.col("_tax"), "left").select(
        "id", "order_id", "product_id", reduced.cast("decimal(21,6)").alias("price_reduced"), "product_uom_qty", "_rate")
    subtotal = F.round(F.col("price_reduced") * F.col("product_uom_qty").cast("decimal(15,2)"), 2).cast(MONEY)
    rated = priced.withColumn("price_subtotal", subtotal).withColumn(
        "price_tax",
        F.round(percent_of(F.col("price_subtotal"), F.coalesce("_rate", F.lit(0).cast("decimal(6,2)"))), 2).cast(MONEY))
    return rated.select("id", "order_id", "product_id", "price_reduced", "price_subtotal", "price_tax",
                        (F.col("price_subtotal") + F.col("price_tax")).cast(MONEY).alias("price_total"))


def price_floor_violations(t: Tables) -> DataFrame:
    """Order lines priced below the product's list price."""
    products = product_attributes(t, list_price="list_price")
    return (
        t["sale_order_line"].join(products, F.col("product_id") == F.col("product_key"))
        .filter(F.col("price_unit") < F.col("list_price"))
        .select("id", "order_id", "product_id", "price_unit", "list_price", F.lit("below_list_price").alias("reason")))
