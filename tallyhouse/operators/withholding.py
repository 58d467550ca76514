"""Withholding tax of supplier bills and its certificates."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.columns import MONEY, day_month_year, two_decimals, zero_padded
from tallyhouse.plans.numbering import number_within

Tables = Mapping[str, DataFrame]

# The certificate's number series.
NUMBER_PREFIX = "CRET"
NUMBER_WIDTH = 4


def _last_held(t: Tables) -> DataFrame:
    """Amount of the last withholding tax line of each invoice, by tax id."""
    kinds = t["account_tax"].filter("is_withholding_tax").select(F.col("id").alias("_tax"))
    return (
        t["account_invoice_tax"].join(kinds, F.col("tax_id") == F.col("_tax"), "left_semi")
        .groupBy(F.col("invoice_id").alias("_held_of"))
        .agg(F.max(F.struct("tax_id", "amount")).getField("amount").alias("_held")))


def _withheld() -> Column:
    """Tax held on supplier bills; nothing elsewhere."""
    return F.when(F.col("type") == "in_invoice", F.coalesce("_held", F.lit(0))).otherwise(0).cast(MONEY)


def withholding_amounts(t: Tables) -> DataFrame:
    """Withholding tax of each invoice: on supplier bills the amount of the last
    withholding tax line, by tax id, and 0 elsewhere."""
    return t["account_invoice"].select("id", "type").join(
        _last_held(t), F.col("id") == F.col("_held_of"), "left").select("id", "type", _withheld().alias("withholding_tax"))


def certificate_flags(t: Tables) -> DataFrame:
    """Whether each invoice has an approved certificate."""
    approved = _approved(t)
    return t["account_invoice"].select("id").join(approved, F.col("id") == F.col("_approved"), "left").select(
        "id", F.col("_approved").isNotNull().alias("has_withholding_certificate"))


def _approved(t: Tables) -> DataFrame:
    return t["withholding_certificate"].filter(
        (F.col("state") == "approved") & F.col("invoice_id").isNotNull()).select(
        F.col("invoice_id").alias("_approved")).distinct()


def withholding_eligible(t: Tables, supplier_id: int | None = None) -> DataFrame:
    """Open or paid invoices with tax withheld and no certificate yet."""
    invoices = t["account_invoice"].filter(F.col("state").isin("open", "paid"))
    if supplier_id is not None:
        invoices = invoices.filter(F.col("partner_id") == supplier_id)
    return (
        invoices.select("id", "type", "number", "partner_id", "state")
        .join(_last_held(t), F.col("id") == F.col("_held_of"))
        .withColumn("withholding_tax", _withheld()).filter("withholding_tax < 0")
        .join(_approved(t), F.col("id") == F.col("_approved"), "left_anti")
        .select("id", "number", "partner_id", "state", "withholding_tax"))


def certificate_numbers(t: Tables, existing: DataFrame | None = None) -> DataFrame:
    """Gap-free certificate numbers per year of creation, in order of creation and id.

    A certificate whose `number` is stored keeps it; only the others are numbered, each year after its highest
    number. `existing` has a `number` column of further numbers already given, of deleted certificates say.
    """
    return _numbered(t["withholding_certificate"].select(
        *[c for c in ("id", "create_date", "number") if c in t["withholding_certificate"].columns]), existing).select(
        "id", "year", "sequence", "number")


def _numbered(certificates: DataFrame, existing: DataFrame | None) -> DataFrame:
    """The certificates, with all their columns, and `year`, `sequence` and `number`."""
    year, used = (F.split_part("number", F.lit("/"), F.lit(n)) for n in (2, 3))
    dated = certificates.withColumn("year", F.year("create_date"))
    stored = "number" in certificates.columns
    given = [df.select(year.try_cast("int").alias("_year"), used.try_cast("bigint").alias("_used"))
             for df in ([certificates.filter("number is not null")] if stored else []) + ([] if existing is None else [existing])]
    named = F.concat_ws("/", F.lit(NUMBER_PREFIX), F.col("year").cast("string"), zero_padded(F.col("sequence"), NUMBER_WIDTH))
    fresh = dated.filter("number is null").drop("number") if stored else dated
    ranked = number_within(fresh, ["year"], ["create_date", "id"], "_rank")
    if given:
        # One row per year.
        last = reduce(DataFrame.union, given).groupBy("_year").agg(F.max("_used").alias("_used"))
        ranked = ranked.join(last, F.col("year") == F.col("_year"), "left").drop("_year")
    else:
        ranked = ranked.withColumn("_used", F.lit(0))
    new = ranked.withColumn("sequence", (F.col("_rank") + F.coalesce("_used", F.lit(0))).cast("bigint")).withColumn(
        "number", named).drop("_rank", "_used")
    if not stored:
        return new
    old = dated.filter("number is not null").withColumn("sequence", used.try_cast("bigint"))
    return new.unionByName(old.select(*new.columns))


def withholding_certificates(t: Tables, existing: DataFrame | None = None) -> DataFrame:
    """The certificates as printed. The supplier is that of the invoice; amounts are
    shown with the opposite sign."""
    companies = t["res_company"].select(
        F.col("id").alias("co_id"), F.col("name").alias("company_name"), F.col("partner_id").alias("co_partner_id"))
    owners = t["res_partner"].select(
        F.col("id").alias("ow_id"), F.col("ruc").alias("company_ruc"), F.col("dv").alias("company_dv"))
    suppliers = t["res_partner"].select(
        F.col("id").alias("su_id"), F.col("name").alias("supplier_name"), F.col("ruc").alias("supplier_ruc"),
        F.col("dv").alias("supplier_dv"))
    invoices = t["account_invoice"].select(
        F.col("id").alias("ai_id"), "type", F.col("partner_id").alias("supplier_id"),
        F.col("number").alias("invoice_number"), "amount_untaxed")
    taxes = t["account_tax"].select(
        F.col("id").alias("at_id"), F.col("description").alias("tax_description"), F.col("amount").alias("rate"))
    zero = F.lit("0").cast(MONEY)
    return (
        _numbered(t["withholding_certificate"], existing)
        .join(companies, F.col("company_id") == F.col("co_id"), "left")
        .join(taxes, F.col("account_tax_id") == F.col("at_id"), "left")
        .join(invoices, F.col("invoice_id") == F.col("ai_id"), "left")
        .join(_last_held(t), F.col("invoice_id") == F.col("_held_of"), "left")
        .join(owners, F.col("co_partner_id") == F.col("ow_id"), "left")
        .join(suppliers, F.col("supplier_id") == F.col("su_id"), "left")
        .select(
            "id", "number", "state", "certificated_on", "company_id", "company_name", "company_ruc", "company_dv",
            "supplier_id", "supplier_name", "supplier_ruc", "supplier_dv", "account_tax_id", "tax_description",
            F.coalesce("rate", zero).cast("decimal(6,2)").alias("withholding_percentage"),
            "invoice_id", "invoice_number",
            F.coalesce("amount_untaxed", zero).cast(MONEY).alias("invoice_subtotal"),
            _withheld().alias("withholding_amount"),
            two_decimals(F.coalesce("amount_untaxed", zero)).alias("invoice_subtotal_formatted"),
            F.concat(two_decimals(-F.coalesce("rate", zero)), F.lit(" %")).alias("withholding_percentage_formatted"),
            two_decimals(-_withheld()).alias("withholding_amount_formatted"),
            day_month_year(F.col("create_date")).alias("create_date_formatted"), "comments"))


def certificates_deletable(t: Tables) -> DataFrame:
    """Certificates that may be deleted: the drafts."""
    return t["withholding_certificate"].filter(~F.col("state").eqNullSafe("approved")).select(
        "id", "invoice_id", "state")
