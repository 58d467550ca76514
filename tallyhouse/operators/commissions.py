"""Sales commissions over the category tree."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.columns import percent_of
from tallyhouse.operators.products import product_attributes
from tallyhouse.plans.closure import ancestor_closure
from tallyhouse.session import stage_once
from tallyhouse.sources.key_index import with_stored
from tallyhouse.sources.key_index import with_stored

Tables = Mapping[str, DataFrame]


def category_ancestors(t: Tables) -> DataFrame:
    """(category, ancestor, depth) of the product categories; depth 0 is the category."""
    return ancestor_closure(t["product_category"]).select(
        F.col("node").alias("category_id"), F.col("ancestor").alias("ancestor_id"), "depth")


def commission_rule_conflicts(t: Tables) -> DataFrame:
    """Rules the reference data may not hold: a category and term used twice, or a
    percentage that is not positive."""
    rules = t["commission_rule"]
    twice = (
        rules.groupBy(F.col("category_id").alias("_c"), F.col("payment_term_id").alias("_t"))
        .agg(F.count("*").alias("_n")).filter("_n > 1"))
    reasons = F.concat_ws(
        ",",
        F.when(F.col("_n").isNotNull(), "duplicate"),
        F.when(F.col("percentage") <= 0, "percentage_not_positive"))
    return (
        rules.join(twice, (F.col("category_id") == F.col("_c")) & (F.col("payment_term_id") == F.col("_t")), "left")
        .withColumn("reason", reasons).filter("reason <> ''")
        .select("id", "category_id", "payment_term_id", "percentage", "reason"))


def rule_key() -> list[Column]:
    """What no two rules share."""
    return [F.col("category_id"), F.col("payment_term_id")]


def new_rule_conflicts(t: Tables, stored: str) -> DataFrame:
    """`commission_rule_conflicts` for new or changed rules (`t`) against those that `write_keys` stored by `rule_key`."""
    new = t["commission_rule"]
    found = commission_rule_conflicts({"commission_rule": with_stored(new, stored, rule_key())})
    return found.join(new.select(F.col("id").alias("_new")), F.col("id") == F.col("_new"), "left_semi")


def _valid_rules(t: Tables) -> DataFrame:
    """One rule per category and term: the lowest id among those with a positive
    percentage, since the later ones could not have been stored."""
    return (
        t["commission_rule"].filter("percentage > 0").groupBy("category_id", "payment_term_id")
        .agg(F.min("id").alias("rule_id"), F.min_by("percentage", "id").alias("percentage")))


def nearest_rules(t: Tables) -> DataFrame:
    """The rule of each category and term: its own, or that of the nearest ancestor.
    Written out, once for the same tables, so that its real size decides how the lines meet it."""
    rules = _valid_rules(t).withColumnRenamed("category_id", "ancestor_id")
    return stage_once(
        [t["commission_rule"], t["product_category"]], "rules",
        lambda: category_ancestors(t).join(rules, "ancestor_id")
        .groupBy(F.col("category_id").alias("rule_category_id"), F.col("payment_term_id").alias("rule_term_id"))
        .agg(F.min_by("rule_id", "depth").alias("rule_id"), F.min_by("percentage", "depth").alias("rule_percentage")))


def commission_total() -> Column:
    """The rule's percentage of a line's subtotal."""
    return percent_of(F.col("price_subtotal"), F.col("rule_percentage")).cast("decimal(22,6)")


def commission_assign(t: Tables, recompute: bool = False) -> DataFrame:
    """The line table with its commission columns.

    A line of a paid invoice with a payment term takes the nearest rule up its
    product's category tree. A line that has a commission keeps it, whatever today's rules say,
    unless all are to be computed anew with `recompute`. Lines without a rule keep what they had: nothing, or
    the columns of the input table.
    """
    lines = t["account_invoice_line"]
    invoices = t["account_invoice"].filter((F.col("state") == "paid") & F.col("payment_term_id").isNotNull()).select(
        F.col("id").alias("_inv"), F.col("payment_term_id").alias("_term"))
    kept = {
        "commission_id": F.lit(None).cast("int"),
        "commission_percentage": F.lit(0).cast("decimal(5,2)"),
        "commission_total": F.lit(0).cast("decimal(22,6)"),
    }
    kept |= {name: F.col(name) for name in kept if name in lines.columns}
    hit = F.col("rule_id").isNotNull()
    if "commission_id" in lines.columns and not recompute:
        hit &= F.col("commission_id").isNull()
    new = {
        "commission_id": F.col("rule_id"),
        "commission_percentage": F.col("rule_percentage"),
        "commission_total": commission_total(),
    }
    return (
        lines
        .join(invoices, F.col("invoice_id") == F.col("_inv"), "left")
        .join(product_attributes(t, _categ="categ_id"), F.col("product_id") == F.col("product_key"), "left")
        .join(nearest_rules(t), (F.col("_categ") == F.col("rule_category_id")) & (F.col("_term") == F.col("rule_term_id")),
              "left")
        .select(*[c for c in lines.columns if c not in new],
                *[F.when(hit, new[name]).otherwise(kept[name]).alias(name) for name in new]))


def assigned_lines(t: Tables) -> DataFrame:
    """The lines with their commission: as stored, or assigned when the table has none."""
    lines = t["account_invoice_line"]
    return lines if "commission_id" in lines.columns else commission_assign(t)


def commission_rules_in_use(t: Tables) -> DataFrame:
    """Rules that lines refer to, with the number of lines: they cannot be deleted."""
    used = (
        assigned_lines(t).filter(F.col("commission_id").isNotNull()).groupBy("commission_id")
        .agg(F.count("*").alias("line_count")))
    return t["commission_rule"].join(used, F.col("id") == F.col("commission_id")).select(
        "id", "category_id", "payment_term_id", "percentage", "line_count")
