"""The report views: scans, filters, projections and joins.

Every join is left to the optimizer: it broadcasts a side only when its size is
known to be small, and AQE splits the partitions of a hot key otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.columns import MONEY, MONEY_SUM, small_number
from tallyhouse.operators.commissions import commission_total, nearest_rules
from tallyhouse.operators.fiscal import fiscal_filenames
from tallyhouse.operators.products import product_attributes
from tallyhouse.plans.numbering import number_rows
from tallyhouse.session import stage_once

Tables = Mapping[str, DataFrame]


def annex72_lines(t: Tables) -> DataFrame:
    """Supplier-bill lines for the tax annex: accounts with a concept, open or paid bills."""
    lines = t["account_invoice_line"].select(
        F.col("id").alias("line_id"), "invoice_id", "account_id", F.col("company_id").alias("line_company_id"),
        F.col("name").alias("line_name"), "price_subtotal")
    invoices = (
        t["account_invoice"].filter((F.col("type") == "in_invoice") & F.col("state").isin("open", "paid"))
        .select(F.col("id").alias("inv_id"), "partner_id", "state", "number", "date_invoice", "create_date"))
    partners = t["res_partner"].filter("supplier").select(
        F.col("id").alias("rp_id"), "is_company", "ruc", "dv", F.col("name").alias("rp_name"))
    accounts = t["account_account"].select(
        F.col("id").alias("aa_id"), F.col("name").alias("aa_name"), "partner_concept_id")
    concepts = t["partner_concept"].select(
        F.col("id").alias("pc_id"), "code", F.col("name").alias("pc_name"), F.col("type").alias("pc_type"))
    companies = t["res_company"].select(F.col("id").alias("co_id"))
    # The bills meet their suppliers first, so that the lines are shuffled only once.
    bills = invoices.join(partners, F.col("partner_id") == F.col("rp_id"))
    return (
        lines
        .join(accounts, F.col("account_id") == F.col("aa_id"))
        .join(concepts, F.col("partner_concept_id") == F.col("pc_id"))
        .join(companies, F.col("line_company_id") == F.col("co_id"))
        .join(bills, F.col("invoice_id") == F.col("inv_id"))
        .select(
            F.col("line_id").alias("id"),
            F.col("line_id").alias("account_invoice_line_id"),
            F.col("inv_id").alias("account_invoice_id"),
            F.col("aa_id").alias("account_account_id"),
            F.col("pc_id").alias("partner_concept_id"),
            F.col("rp_id").alias("res_partner_id"),
            F.col("co_id").alias("company_id"),
            F.when(F.col("is_company").eqNullSafe(True), 1).otherwise(2).alias("partner_type"),
            F.col("ruc").alias("partner_ruc"),
            F.col("dv").alias("partner_dv"),
            F.col("rp_name").alias("partner_name"),
            F.col("pc_type").alias("partner_concept_type"),
            small_number(F.col("code")).alias("partner_concept_code"),
            F.col("price_subtotal").alias("account_invoice_line_price"),
            F.when(F.col("state") == "paid", 1).when(F.col("state") == "open", 2).alias("account_invoice_state"),
            F.col("number").alias("account_invoice_number"),
            F.col("line_name").alias("account_invoice_line_name"),
            F.col("pc_name").alias("partner_concept_name"),
            F.col("aa_name").alias("account_account_name"),
            F.col("date_invoice").alias("account_invoice_date"),
            F.col("create_date").alias("account_invoice_create_date")))


def commission_lines(t: Tables) -> DataFrame:
    """Lines of paid invoices that carry a commission. Refunds and supplier bills count
    as well, with a positive sign.

    Lines without commission columns get their rule here, on the way: the same as
    `commission_assign` first, but the lines meet invoices and products only once.
    """
    lines = t["account_invoice_line"]
    stored = "commission_id" in lines.columns
    if stored:
        lines = lines.filter(F.col("commission_id").isNotNull())
    invoices = t["account_invoice"].filter(F.col("state") == "paid").select(
        F.col("id").alias("inv_id"), "user_id", "payment_term_id", F.col("number").alias("invoice_number"),
        F.col("state").alias("invoice_state"), F.col("date_invoice").alias("invoice_date"))
    sold = (
        lines.withColumnsRenamed({"id": "line_id", "name": "product_name"})
        .join(invoices, F.col("invoice_id") == F.col("inv_id"))
        .join(product_attributes(t, category_id="categ_id"), F.col("product_id") == F.col("product_key")))
    if not stored:
        same_rule = (F.col("category_id") == F.col("rule_category_id")) & (
            F.col("payment_term_id") == F.col("rule_term_id"))
        sold = sold.join(nearest_rules(t), same_rule).withColumns({
            "commission_id": F.col("rule_id"), "commission_percentage": F.col("rule_percentage"),
            "commission_total": commission_total()})
    rules = t["commission_rule"].select(F.col("id").alias("_rule"))
    categories = t["product_category"].select(F.col("id").alias("cat_id"), F.col("name").alias("category_name"))
    users = t["res_users"].select(F.col("id").alias("ru_id"), F.col("partner_id").alias("ru_partner_id"))
    partners = t["res_partner"].select(F.col("id").alias("rp_id"), F.col("name").alias("vendor_name"))
    # Written out so that its real size decides how the lines meet it.
    vendors = stage_once([t["res_users"], t["res_partner"]], "vendors", lambda: users.join(
        partners, F.col("ru_partner_id") == F.col("rp_id")))
    terms = t["account_payment_term"].select(F.col("id").alias("apt_id"), F.col("name").alias("payment_term_name"))
    return (
        sold
        .join(rules, F.col("commission_id") == F.col("_rule"), "left_semi")
        .join(categories, F.col("category_id") == F.col("cat_id"))
        .join(vendors, F.col("user_id") == F.col("ru_id"))
        .join(terms, F.col("payment_term_id") == F.col("apt_id"))
        .select(
            F.col("line_id").alias("id"),
            F.col("line_id").alias("account_invoice_line_id"),
            "invoice_id", "product_id", "commission_id", "category_id",
            F.col("user_id").alias("vendor_id"),
            "payment_term_id", "product_name", "category_name", "invoice_number", "vendor_name", "payment_term_name",
            "invoice_state", "invoice_date", "quantity",
            F.col("price_unit").alias("product_price_unit"),
            F.col("price_subtotal").alias("subtotal"),
            F.col("price_total").alias("total"),
            "discount", "commission_percentage", "commission_total"))


def _reversal() -> Column:
    return F.col("ref").contains("Inversa")


def cash_movement_rows(t: Tables) -> DataFrame:
    """Cash movements, unordered, with the move's id as an extra column."""
    moves = t["account_move"].filter(F.col("amount") != 0).select(
        F.col("id").alias("move_id"), F.col("name").alias("am_name"), "ref", F.col("amount").alias("am_amount"),
        F.col("date").alias("am_date"), F.col("store_id").alias("am_store_id"), F.col("partner_id").alias("am_partner_id"),
        F.col("journal_id").alias("am_journal_id"))
    payments = t["account_payment"].select(
        F.col("id").alias("ap_id"), "move_name", "communication", "payment_type")
    partners = t["res_partner"].select(F.col("id").alias("rp_id"), F.col("name").alias("rp_name"))
    # The test on the type of the journal makes its left join an inner one.
    journals = t["account_journal"].filter(F.col("type").isin("bank", "cash")).select(
        F.col("id").alias("aj_id"), F.col("name").alias("aj_name"))
    amount = F.round("am_amount", 2).cast(MONEY)
    return (
        moves
        .join(journals, F.col("am_journal_id") == F.col("aj_id"))
        .join(payments, F.col("am_name") == F.col("move_name"), "left")
        .join(partners, F.col("am_partner_id") == F.col("rp_id"), "left")
        .select(
            F.col("ap_id").alias("id"),
            F.coalesce("communication", F.lit("ABONO")).alias("invoice_number"),
            F.col("rp_name").alias("partner_name"),
            F.col("aj_name").alias("journal_name"),
            F.col("am_date").alias("date_invoice"),
            F.col("am_store_id").alias("store_id"),
            "payment_type",
            F.when(_reversal() | (F.col("payment_type") == "outbound"), -amount).otherwise(amount).cast(MONEY)
            .alias("amount_total"),
            "move_id"))


def cash_movements(t: Tables) -> DataFrame:
    """Cash movements by partner name and amount; reversals and outbound payments are negative."""
    # The ids settle ties, and let the sort divide many equal amounts of one partner.
    return cash_movement_rows(t).orderBy(
        F.col("partner_name").asc_nulls_last(), "amount_total", "id", "move_id").drop("move_id")


def cash_payments(t: Tables) -> DataFrame:
    """Subtotal, commission and net per payment, journal, store and date.

    Only a reversal changes the sign here, and the rate is a fraction. Rounding is
    per move, before summing. The moves are summed by name first: a name shared by
    many moves and many payments never makes all pairs.
    """
    moves = t["account_move"].select(
        "name", "ref", F.col("amount").alias("am_amount"), "date", "store_id", F.col("journal_id").alias("am_journal_id"))
    journals = t["account_journal"].filter(~F.col("at_least_one_outbound")).select(
        F.col("id").alias("aj_id"), F.col("name").alias("journal_name"), F.col("x_porcentaje_comision").alias("rate"))
    payments = t["account_payment"].select(F.col("id").alias("ap_id"), "move_name")
    sign = F.when(_reversal(), -1).otherwise(1)
    part = F.col("am_amount") * F.col("rate")
    by_name = (
        moves.join(journals, F.col("am_journal_id") == F.col("aj_id"))
        .groupBy("name", "aj_id", "journal_name", "store_id", "date")
        .agg(F.sum(F.round("am_amount", 2) * sign).cast(MONEY_SUM).alias("_subtotal"),
             F.sum(F.round(part, 2) * sign).cast(MONEY_SUM).alias("_commission"),
             F.sum(F.round(F.col("am_amount") - part, 2) * sign).cast(MONEY_SUM).alias("_net")))
    return (
        by_name.join(payments, F.col("name") == F.col("move_name"), "left")
        .groupBy("ap_id", "aj_id", "journal_name", "store_id", "date")
        .agg(F.sum("_subtotal").cast(MONEY_SUM).alias("subtotal"),
             F.sum("_commission").cast(MONEY_SUM).alias("percentage_amount"),
             F.sum("_net").cast(MONEY_SUM).alias("payment_amount"))
        .select(
            F.col("ap_id").alias("id"), F.col("aj_id").alias("payment_journal_id"), "journal_name", "subtotal",
            "percentage_amount", "payment_amount", "store_id", F.col("date").alias("date_invoice")))


def cash_taxes(t: Tables) -> DataFrame:
    """Tax per paid customer invoice and tax, at the store of the invoice's last editor."""
    invoices = t["account_invoice"].filter((F.col("state") == "paid") & (F.col("type") == "out_invoice")).select(
        "id", "write_uid", "number", "date_invoice", F.col("amount_tax").alias("invoice_amount_tax"), "partner_id")
    invoice_taxes = t["account_invoice_tax"].select("invoice_id", "tax_id", F.col("amount").alias("tax_amount"))
    taxes = t["account_tax"].select(F.col("id").alias("at_id"), F.col("description").alias("tax_description"))
    partners = t["res_partner"].select(F.col("id").alias("rp_id"))
    users = t["res_users"].select(F.col("id").alias("ru_id"), "store_id")
    stores = t["res_store"].select(F.col("id").alias("rs_id"), F.col("name").alias("store_name"))
    return (
        invoices
        .join(users, F.col("write_uid") == F.col("ru_id"))
        .join(stores, F.col("store_id") == F.col("rs_id"))
        .join(partners, F.col("partner_id") == F.col("rp_id"), "left_semi")
        .join(invoice_taxes, F.col("id") == F.col("invoice_id"))
        .join(taxes, F.col("tax_id") == F.col("at_id"))
        .select("id", "tax_id", "write_uid", "store_id", F.col("number").alias("invoice_number"), "date_invoice",
                "tax_description", "tax_amount", "invoice_amount_tax", "store_name"))


def _named(t: Tables, documents: DataFrame) -> DataFrame:
    """The documents with their file names; a table that stores the names keeps them."""
    if "master_filename_assigned" in documents.columns:
        return documents
    return fiscal_filenames({**t, "fiscal_document": documents}, keep_all=True)


def print_in_progress(t: Tables) -> DataFrame:
    """Documents being printed, numbered by creation."""
    documents = t["fiscal_document"].filter(
        (F.col("print_status") == "in_progress") & (F.col("fiscal_invoice_number") == 0))
    users = t["res_users"].select(F.col("id").alias("ru_id"), F.col("login").alias("user_login"))
    printers = t["fiscal_printer"].select(F.col("id").alias("fp_id"), F.col("serial").alias("fiscal_printer_serial"))
    queue = (
        _named(t, documents)
        .join(users, F.col("write_uid") == F.col("ru_id"))
        .join(printers, F.col("printer_id") == F.col("fp_id"))
        .select("create_date", "id", "master_filename_assigned", "user_login", "fiscal_printer_serial"))
    return number_rows(queue, ["create_date", "id"]).drop("create_date")


def _pending_documents(t: Tables) -> DataFrame:
    return t["fiscal_document"].filter(
        (F.col("print_status") == "pending") & F.col("printer_id").isNotNull()
        & (F.col("documents_type_printed") == "account_invoice") & (F.col("fiscal_invoice_number") == 0))


# The printed header, in the order of the printer's interface.
PENDING_COLUMNS = (
    "id", "partner_name", "partner_ruc", "partner_street", "partner_zip", "partner_province", "partner_district",
    "partner_sector", "partner_country", "payments_total", "cash_payment_total", "bank_payment_total",
    "credit_card_payment_total", "debit_card_payment_total", "amount_total", "amount_untaxed", "amount_tax",
    "discount_total", "tax_percentage", "invoice_type", "refund_type", "refund_note",
    "parent_invoice_filename_assigned", "parent_invoice_fiscal_printer_serial",
    "parent_invoice_fiscal_invoice_number", "refund_date", "refund_time", "master_filename_assigned",
    "lines_filename_assigned", "user_login")


def print_pending(t: Tables) -> DataFrame:
    """Header queue: pending invoice documents with a printer, of open or paid invoices."""
    invoices = t["account_invoice"].filter(F.col("state").isin("open", "paid")).select(F.col("id").alias("ai_id"))
    users = t["res_users"].select(F.col("id").alias("ru_id"), F.col("login").alias("user_login"))
    queue = (
        _named(t, _pending_documents(t))
        .join(invoices, F.col("invoice_id") == F.col("ai_id"), "left_semi")
        .join(users, F.col("write_uid") == F.col("ru_id"))
        .select("create_date", *PENDING_COLUMNS))
    return number_rows(queue, ["create_date", "id"]).drop("create_date")


def print_pending_lines(t: Tables) -> DataFrame:
    """Line queue of the pending documents, one row per tax of a line. The state of
    the invoice is not tested here."""
    documents = _named(t, _pending_documents(t)).select(
        F.col("id").alias("fd_id"), F.col("invoice_id").alias("fd_invoice_id"), "create_date", "write_uid",
        "master_filename_assigned", "lines_filename_assigned")
    lines = t["account_invoice_line"].select(
        F.col("id").alias("line_id"), "invoice_id", F.col("name").alias("line_name"), "product_id", "price_unit",
        "quantity")
    invoices = t["account_invoice"].select(F.col("id").alias("ai_id"))
    products = product_attributes(t, product_code="default_code")
    users = t["res_users"].select(F.col("id").alias("ru_id"), F.col("login").alias("user_login"))
    line_taxes = t["account_invoice_line_tax"].select(
        "invoice_line_id", F.col("tax_id").alias("line_tax_id"))
    taxes = t["account_tax"].select(F.col("id").alias("at_id"), F.col("amount").alias("tax_percentage"))
    queue = (
        documents
        .join(invoices, F.col("fd_invoice_id") == F.col("ai_id"), "left_semi")
        .join(users, F.col("write_uid") == F.col("ru_id"))
        .join(lines, F.col("fd_invoice_id") == F.col("invoice_id"))
        .join(products, F.col("product_id") == F.col("product_key"))
        .join(line_taxes, F.col("line_id") == F.col("invoice_line_id"), "left")
        .join(taxes, F.col("line_tax_id") == F.col("at_id"), "left")
        .select(
            "create_date", "line_tax_id",
            F.col("line_id").alias("id"), F.col("fd_id").alias("fiscal_document_id"), "product_code",
            F.col("variant_code").alias("product_code_2"),
            F.replace("line_name", F.lit("\n"), F.lit("")).alias("product_name"),
            F.col("price_unit").alias("product_price"), "quantity", F.lit("UNIDADES").alias("unit_type"),
            F.lit(2).alias("group_type"), "tax_percentage", "master_filename_assigned", "lines_filename_assigned",
            "user_login"))
    ordered = number_rows(queue, ["create_date", "fiscal_document_id", "id", F.col("line_tax_id").asc_nulls_last()])
    return ordered.drop("create_date", "line_tax_id")
