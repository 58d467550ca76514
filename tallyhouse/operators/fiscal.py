"""Fiscal documents: eligibility, totals, assembly, file names, queues, deletion."""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.columns import MONEY_SUM, is_blank, percent_of, zero_padded
from tallyhouse.plans.joins import skewed_join
from tallyhouse.session import stage

Tables = Mapping[str, DataFrame]

DISCOUNT = "decimal(28,6)"

# What `document_details` reads.
DETAIL_TABLES = (
    "account_invoice", "account_invoice_line", "account_invoice_tax", "account_tax", "account_invoice_payment_rel",
    "account_payment", "account_journal", "account_invoice_refund", "res_partner", "province", "district", "sector",
    "res_country", "fiscal_printer")


def _last_document(t: Tables) -> DataFrame:
    """The document linked to each invoice: the last one made for it."""
    return (
        t["fiscal_document"].filter(F.col("invoice_id").isNotNull())
        .groupBy(F.col("invoice_id").alias("doc_invoice_id"))
        .agg(F.max("id").alias("doc_id"), F.max_by("print_status", "id").alias("doc_status"),
             F.max_by("fiscal_invoice_number", "id").alias("doc_number")))


def _user_printers(t: Tables) -> DataFrame:
    """The printer of each user; the lowest id when there are several."""
    return t["fiscal_printer"].groupBy(F.col("employee_id").alias("printer_user_id")).agg(
        F.min("id").alias("user_printer_id"), F.min_by("serial", "id").alias("user_printer_serial"))


def fiscal_eligibility(t: Tables) -> DataFrame:
    """Whether each invoice can be sent to the fiscal printer: the first reason
    against it, `ok`, or `noop` when its failed document blocks a new one silently."""
    documents = _last_document(t)
    parents = documents.select(F.col("doc_invoice_id").alias("parent_of"), F.col("doc_number").alias("parent_number"))
    invoices = t["account_invoice"].select("id", "type", "amount_total", "write_uid", "refund_invoice_id")
    # Only refunds have a parent, so most of the keys are NULL.
    joined = skewed_join(
        invoices
        .join(_user_printers(t), F.col("write_uid") == F.col("printer_user_id"), "left")
        .join(documents, F.col("id") == F.col("doc_invoice_id"), "left"),
        parents, "refund_invoice_id", "parent_of", spread_by="id")
    has_document = F.col("doc_id").isNotNull()
    status = (
        F.when((F.coalesce("amount_total", F.lit(0)) <= 0) & (F.col("type") == "out_invoice"), "total_not_positive")
        .when(has_document & F.col("doc_status").isin("pending", "in_progress"), "printing_in_progress")
        .when(has_document & (F.col("doc_status") == "completed") & (F.col("doc_number") > 0), "printing_completed")
        .when(has_document, "noop")
        .when(F.col("user_printer_id").isNull(), "printer_not_assigned")
        .when((F.col("type") == "out_refund") & (F.coalesce("parent_number", F.lit(0)) == 0), "parent_not_printed")
        .otherwise("ok"))
    return joined.select("id", "type", status.alias("eligibility"))


def _of(rows: DataFrame, key: str, only: DataFrame | None) -> DataFrame:
    """The rows whose `key` is an `id` of `only`, before anything is grouped; all rows without `only`."""
    if only is None:
        return rows
    return rows.join(only.select(F.col("id").alias("_only")), F.col(key) == F.col("_only"), "left_semi")


def payment_class_totals(t: Tables, only: DataFrame | None = None) -> DataFrame:
    """Payments per invoice: all, and by class of journal, told by its code. With `only`, of the invoices with those ids."""
    payments = t["account_payment"].select(F.col("id").alias("ap_id"), "amount", "journal_id")
    journals = t["account_journal"].select(F.col("id").alias("aj_id"), "code")
    paid = (
        _of(t["account_invoice_payment_rel"], "invoice_id", only)
        .join(payments, F.col("payment_id") == F.col("ap_id"))
        .join(journals, F.col("journal_id") == F.col("aj_id"), "left"))
    # The codes that make a class.
    classes = {
        "cash_payment_total": F.col("code").contains("CSH1"),
        "bank_payment_total": F.col("code").contains("BNK1"),
        "credit_card_payment_total": F.col("code").startswith("TC-"),
        "debit_card_payment_total": F.col("code").startswith("TD-"),
    }
    return paid.groupBy("invoice_id").agg(
        F.sum("amount").cast(MONEY_SUM).alias("payments_total"),
        *[F.sum(F.when(test, F.col("amount")).otherwise(0)).cast(MONEY_SUM).alias(name) for name, test in classes.items()])


def invoice_discount_total(t: Tables, only: DataFrame | None = None) -> DataFrame:
    """Discount per invoice: unit price x discount percent of each line. The quantity
    is not part of it. With `only`, of the invoices with those ids."""
    return _of(t["account_invoice_line"], "invoice_id", only).groupBy("invoice_id").agg(
        F.sum(percent_of(F.col("price_unit"), F.col("discount"))).cast(DISCOUNT).alias("discount_total"))


def refund_links(t: Tables, only: DataFrame | None = None) -> DataFrame:
    """Refunds with the printed document of the invoice they refund and their reason. `only` is a part of the invoices, with their columns."""
    refunds = (t["account_invoice"] if only is None else only).filter(F.col("type") == "out_refund").select(
        F.col("id").alias("invoice_id"), F.col("refund_invoice_id").alias("parent_invoice_id"),
        F.col("name").alias("refund_name"))
    printers = t["fiscal_printer"].select(F.col("id").alias("fp_id"), F.col("serial").alias("fp_serial"))
    # The last document of each invoice, like `_last_document`.
    parents = None if only is None else refunds.filter("parent_invoice_id is not null").select(F.col("parent_invoice_id").alias("id"))
    printed = ChainMap({"fiscal_document": _of(t["fiscal_document"], "invoice_id", parents)}, t)
    documents = (
        fiscal_filenames(printed, keep_all=True).filter(F.col("invoice_id").isNotNull())
        .join(printers, F.col("printer_id") == F.col("fp_id"), "left")
        .groupBy(F.col("invoice_id").alias("parent_of"))
        .agg(F.max_by("master_filename_assigned", "id").alias("parent_invoice_filename_assigned"),
             F.max_by("fp_serial", "id").alias("parent_invoice_fiscal_printer_serial"),
             F.max_by("fiscal_invoice_number", "id").alias("parent_invoice_fiscal_invoice_number")))
    reasons = (
        t["account_invoice_refund"].filter(F.col("description").isNotNull())
        .groupBy(F.col("description").alias("refund_note"))
        .agg(*[F.min_by(c, "id").alias(c) for c in ("filter_refund", "date_invoice", "create_date")]))
    return (
        refunds
        .join(documents, F.col("parent_invoice_id") == F.col("parent_of"), "left")
        # Free text: many refunds share one phrase, or have none.
        .transform(skewed_join, reasons, "refund_name", "refund_note", spread_by="invoice_id")
        .select(
            "invoice_id", "parent_invoice_id", "parent_invoice_filename_assigned",
            "parent_invoice_fiscal_printer_serial", "parent_invoice_fiscal_invoice_number",
            F.col("filter_refund").alias("refund_type"), "refund_note",
            F.date_format("date_invoice", "dd/MM/yyyy").alias("refund_date"),
            F.date_format("create_date", "H:mm").alias("refund_time")))


def _partner_address(t: Tables) -> DataFrame:
    provinces, districts, sectors, countries = (
        t[table].select(F.col("id").cast("bigint").alias(f"{short}_id"), F.col("name").alias(f"{short}_name"))
        for table, short in (("province", "p"), ("district", "d"), ("sector", "s"), ("res_country", "c")))
    partners = t["res_partner"]
    return (
        partners
        .join(provinces, F.col("province_id") == F.col("p_id"), "left")
        .join(districts, F.col("district_id") == F.col("d_id"), "left")
        .join(sectors, F.col("sector_id") == F.col("s_id"), "left")
        .join(countries, F.col("country_id") == F.col("c_id"), "left")
        .select(
            F.col("id").alias("rp_id"), F.col("name").alias("partner_name"),
            F.when(is_blank(F.col("ruc")), "N/D").otherwise(F.col("ruc")).alias("partner_ruc"),
            *[F.coalesce(source, F.lit("")).alias(f"partner_{name}") for source, name in (
                ("street", "street"), ("zip", "zip"), ("p_name", "province"), ("d_name", "district"),
                ("s_name", "sector"), ("c_name", "country"))]))


def document_details(t: Tables, discount: str = "lines", only: DataFrame | None = None) -> DataFrame:
    """What is printed for each invoice, one row per invoice, or for the invoices in
    `only`, a small part of the table: lines, taxes, payments and refunds of others are left out before they are grouped.

    `discount='lines'` takes the sum over the lines, `'invoice'` the amount stored on
    the invoice. An invoice with several taxes shows the lowest tax id and their number.
    """
    if discount not in ("lines", "invoice"):
        raise ValueError("discount must be 'lines' or 'invoice'")
    invoices = (t["account_invoice"] if only is None else only).select(
        F.col("id").alias("invoice_id"), F.col("type").alias("invoice_type"), "partner_id", "amount_total",
        "amount_untaxed", "amount_tax", "amount_discount", "number", F.col("write_uid").alias("user_id"))
    if discount == "lines":
        totals = invoice_discount_total(t, only).select(
            F.col("invoice_id").alias("dt_invoice"), F.col("discount_total").alias("_discount"))
        invoices = invoices.join(totals, F.col("invoice_id") == F.col("dt_invoice"), "left")
    else:
        invoices = invoices.withColumn("_discount", F.col("amount_discount"))
    taxes = t["account_tax"].select(F.col("id").alias("at_id"), F.col("amount").alias("rate"))
    tax_of = (
        _of(t["account_invoice_tax"], "invoice_id", only).join(taxes, F.col("tax_id") == F.col("at_id"))
        .groupBy(F.col("invoice_id").alias("tx_invoice"))
        .agg(F.min_by("rate", "tax_id").alias("_rate"), F.count("*").alias("_taxes")))
    payments = payment_class_totals(t, only).withColumnRenamed("invoice_id", "py_invoice")
    links = refund_links(t, only).drop("parent_invoice_id").withColumnRenamed("invoice_id", "rf_invoice")
    payment_names = ("payments_total", "cash_payment_total", "bank_payment_total", "credit_card_payment_total",
                     "debit_card_payment_total")
    zero = F.lit(0)
    return (
        invoices
        .join(tax_of, F.col("invoice_id") == F.col("tx_invoice"), "left")
        .join(payments, F.col("invoice_id") == F.col("py_invoice"), "left")
        .join(links, F.col("invoice_id") == F.col("rf_invoice"), "left")
        .join(_partner_address(t), F.col("partner_id") == F.col("rp_id"), "left")
        .select(
            "invoice_id", "invoice_type", "number", "partner_name", "partner_ruc", "partner_street", "partner_zip",
            "partner_province", "partner_district", "partner_sector", "partner_country",
            *[F.coalesce(c, zero).cast(MONEY_SUM).alias(c) for c in payment_names],
            "amount_total", "amount_untaxed", "amount_tax",
            F.coalesce("_discount", zero).cast(DISCOUNT).alias("discount_total"),
            F.coalesce("_rate", zero).cast("decimal(6,2)").alias("tax_percentage"),
            F.coalesce("_taxes", zero).cast("bigint").alias("tax_count"),
            "refund_type", "refund_note", "parent_invoice_filename_assigned", "parent_invoice_fiscal_printer_serial",
            F.coalesce("parent_invoice_fiscal_invoice_number", zero).cast("bigint")
            .alias("parent_invoice_fiscal_invoice_number"),
            "refund_date", "refund_time", "user_id"))


def fiscal_documents(t: Tables, discount: str = "lines") -> DataFrame:
    """The new documents: one per eligible invoice, pending, with its file names."""
    eligible = fiscal_eligibility(t).filter(F.col("eligibility") == "ok").select(F.col("id").alias("_ok"))
    # Written out: five inputs are cut down to these few invoices, by their real size.
    invoices = stage(t["account_invoice"].join(eligible, F.col("id") == F.col("_ok"), "left_semi").select(
        "id", "type", "name", "partner_id", "amount_total", "amount_untaxed", "amount_tax", "amount_discount", "number", "write_uid",
        "refund_invoice_id"), "eligible")
    details = document_details(t, discount, invoices)
    assembled = (
        details.join(_user_printers(t), F.col("user_id") == F.col("printer_user_id"))
        .select(
            *details.columns, F.col("user_printer_id").alias("printer_id"),
            F.col("user_printer_serial").alias("printer_serial_number"),
            F.lit("account_invoice").alias("documents_type_printed"), F.lit("pending").alias("print_status"),
            F.lit(0).cast("bigint").alias("fiscal_invoice_number")))
    return fiscal_filenames(ChainMap({"fiscal_document": assembled}, t), keep_all=True)


def fiscal_filenames(t: Tables, keep_all: bool = False) -> DataFrame:
    """The documents with their serial and the names of the header and line files.

    The serial is the number after the last slash. Without one above zero there are
    no names. `keep_all` keeps the documents' other columns.
    """
    documents = t["fiscal_document"]
    printers = t["fiscal_printer"].select(
        F.col("id").alias("_printer"), F.col("merge_invoices_orders").alias("_merged"))
    serial = F.coalesce(F.element_at(F.split("number", "/"), -1).try_cast("bigint"), F.lit(0))
    # Prefixes of the printer interface.
    prefix = (
        F.when(~F.coalesce("_merged", F.lit(False)), "0")
        .when(F.col("documents_type_printed") == "pos_order", "2").otherwise("1"))
    sale = F.col("invoice_type") == "out_invoice"
    tail = F.concat(prefix, zero_padded(F.col("filename_serial"), 6))
    named = F.col("filename_serial") > 0
    full = (
        documents.join(printers, F.col("printer_id") == F.col("_printer"), "left")
        .withColumn("filename_serial", serial)
        .withColumn("master_filename_assigned",
                    F.when(named, F.concat(F.when(sale, "FACTI").otherwise("NCTI"), tail)))
        .withColumn("lines_filename_assigned",
                    F.when(named, F.concat(F.when(sale, "FACMV").otherwise("NCMV"), tail)))
        .drop("_printer", "_merged"))
    if keep_all:
        return full
    return full.select("id", "number", "filename_serial", "master_filename_assigned", "lines_filename_assigned")


def print_queue_by_user(t: Tables, user_id: int, invoices_only: bool = False) -> DataFrame:
    """Documents of one user that are not printed yet."""
    queue = t["fiscal_document"].filter(
        F.col("print_status").isin("pending", "in_progress", "failed") & (F.col("write_uid") == user_id))
    if invoices_only:
        queue = queue.filter(F.col("documents_type_printed") == "account_invoice")
    return queue.select("id", "invoice_id", "printer_id", "write_uid", "print_status", "documents_type_printed",
                        "number", "create_date")


def documents_deletable(t: Tables) -> DataFrame:
    """Documents that may be deleted, with the invoice whose link goes with it."""
    linked = F.when(F.col("documents_type_printed") == "account_invoice", F.col("invoice_id"))
    return t["fiscal_document"].filter(~F.col("print_status").eqNullSafe("in_progress")).select(
        "id", "print_status", linked.alias("unlinked_invoice_id"))


def document_links_after_delete(t: Tables, deleted: DataFrame) -> DataFrame:
    """Each invoice's document after deleting the documents with an `id` in `deleted`."""
    gone = deleted.select(F.col("id").alias("_gone")).distinct()
    # A printed order's document leaves its invoice's link alone.
    unlinked = (
        t["fiscal_document"].filter(F.col("documents_type_printed") == "account_invoice")
        .join(gone, F.col("id") == F.col("_gone"), "left_semi")
        .select(F.col("id").alias("_unlinked")))
    links = _last_document(t).join(unlinked, F.col("doc_id") == F.col("_unlinked"), "left").select(
        "doc_invoice_id", F.when(F.col("_unlinked").isNull(), F.col("doc_id")).alias("fiscal_document_id"))
    return t["account_invoice"].select("id").join(links, F.col("id") == F.col("doc_invoice_id"), "left").select(
        "id", "fiscal_document_id")


def printers_deletable(t: Tables) -> DataFrame:
    """Printers without documents."""
    used = t["fiscal_document"].select(F.col("printer_id").alias("_used")).filter("_used is not null").distinct()
    return t["fiscal_printer"].join(used, F.col("id") == F.col("_used"), "left_anti").select("id", "serial", "employee_id")
