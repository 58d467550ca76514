"""

Every query runs over whole tables derived from the star schema in `sf_dir`.
"""

from __future__ import annotations

import datetime as dt
from collections import ChainMap
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oracle.queries import build_oracle
from tallyhouse.operators import commissions, fiscal, orders, partners, quality, reports, status, stock, summaries, withholding
from tallyhouse.plans.closure import ancestor_closure, updated_closure
from tallyhouse.plans.numbering import number_rows
from tallyhouse.session import new_path, stage, tune
from tallyhouse.sources.search_index import write_index
from tallyhouse.sources.starschema import TABLE_CODEC, StarTables, star_tables, without_sums
from tallyhouse.sources.tables import load_tables, write_report
from tallyhouse.sources.versions import changed_rows
from tallyhouse.streaming.pickings import (
    PARTS, compact_stamps, partition_pickings, stamp_pickings_stream, stamp_streams, stamped_by_streams, stamped_pickings)

try:  # a subpackage of its own, which may be absent
    import corpus_pipeline
    from tallyhouse.llm import queries as llm
except ImportError:
    corpus_pipeline = llm = None

Query = Callable[[SparkSession, str], DataFrame]

# The run day at which orders fall due in the test data, and one cash report.
CANCEL_DAY = dt.date(1997, 2, 12)
REPORT = {"store_id": 3, "start_on": dt.date(1996, 1, 1), "end_on": dt.date(1997, 12, 31)}
AGE_DAY = dt.date(2024, 2, 29)


def _on(operator: Callable[..., DataFrame], **params: object) -> Query:
    return lambda spark, sf_dir: operator(star_tables(tune(spark), sf_dir), **params)


def _on_own_columns(operator: Callable[..., DataFrame], **params: object) -> Query:
    """The same for operators that ask invoices and documents for nothing that is summed up for them."""
    return lambda spark, sf_dir: operator(without_sums(star_tables(tune(spark), sf_dir)), **params)


# What a job has stored, with values that differ from those that would be computed: columns by table.
STORED_VALUES = {
    "account_invoice": {
        "credit_note_state": "case id%9 when 0 then 'approved' when 1 then 'rejected' when 2 then 'draft' end",
        "print_status": "case id%11 when 0 then 'incomplete' when 1 then 'printed' when 2 then 'failed' end"},
    "res_partner": {"sex": "case id%7 when 0 then 'Femenino' when 1 then 'F' when 2 then 'Masculino' end"},
    "account_invoice_line": {
        "commission_id": "case when id%4=0 then 111 when id%4=2 then 131 end",
        "commission_percentage": "cast(case when id%2=0 then 7.5 else 0 end as decimal(5,2))",
        "commission_total": "cast(case when id%2=0 then price_subtotal*0.5 else 0 end as decimal(22,6))"},
    "sale_order": {
        "first_payment_date": "case when id%4=0 then date'1996-11-14' end",
        "canceled_at": "case when id%4=0 then date'1997-02-12' when id%4=1 then date'1997-01-01' end",
        "notified_at": "case when id%4=0 then date'1997-02-02' end"},
    "fiscal_document": {
        "filename_serial": "id%100", "master_filename_assigned": "concat('ST',cast(id as string))",
        "lines_filename_assigned": "concat('SL',cast(id as string))"},
    "withholding_certificate": {
        "number": "case when id%2=0 then concat('CRET/',cast(year(create_date) as string),'/',lpad(cast(id%40+1 as string),4,'0')) end"},
}
STORED_CHECKS = {
    "account_invoice_line": "sum(commission_id)", "sale_order": "count(canceled_at)", "fiscal_document": "sum(filename_serial)",
    "withholding_certificate": "count(number)"}


def _stored(t: StarTables, *names: str) -> Mapping[str, DataFrame]:
    """The tables, of which those of `names` were written with their stored columns and read by `load_tables`."""
    folder = new_path(t.spark, "erp")
    for name in names:
        t[name].withColumns({c: F.expr(e) for c, e in STORED_VALUES.get(name, {}).items()}).write.option("compression", TABLE_CODEC).parquet(f"{folder}/{name}")
    return ChainMap(load_tables(t.spark, folder, names=names), t)


def _load_tables(t: StarTables) -> DataFrame:
    """Row count and a sum over the stored columns of every business table, after writing and loading them."""
    tables = _stored(t, *t)
    counts = [tables[name].agg(F.count("*").alias("row_count"), F.expr(STORED_CHECKS.get(name, "null")).cast("long").alias("stored_sum")).select(
        F.lit(name).alias("table_name"), "row_count", "stored_sum") for name in t]
    return reduce(DataFrame.unionByName, counts)


def _on_stored(operator: Callable[..., DataFrame], *names: str, **params: object) -> Query:
    return lambda spark, sf_dir: operator(_stored(star_tables(tune(spark), sf_dir), *names), **params)


def _write_report(t: StarTables) -> DataFrame:
    """The annex written by month, and read back from the files."""
    path = new_path(t.spark, "report")
    lines = reports.annex72_lines(t).withColumn("report_month", F.trunc("account_invoice_date", "month"))
    write_report(lines, path, "report_month")
    return t.spark.read.schema(lines.schema).parquet(path).select(
        "report_month", "account_invoice_date", "id", "account_invoice_line_price", "partner_concept_code")


def _number_rows(t: StarTables) -> DataFrame:
    return number_rows(t["account_invoice"].select("id", "create_date"), ["create_date", "id"])


def _links_after_delete(t: Mapping[str, DataFrame]) -> DataFrame:
    return fiscal.document_links_after_delete(t, fiscal.documents_deletable(t).filter("print_status = 'failed'"))


def _numbers_after_existing(t: StarTables) -> DataFrame:
    given = t["account_invoice_tax"].filter("tax_id = 8").join(
        t["account_invoice"].select("id", "date_invoice"), F.col("invoice_id") == F.col("id")).select(
        F.concat(F.lit("CRET/"), F.year("date_invoice").cast("string"), F.lit("/"), F.month("date_invoice").cast("string"))
        .alias("number"))
    return withholding.certificate_numbers(t, given)


def _indexed(operator: Callable[..., DataFrame], columns: dict[str, str], **params: object) -> Query:
    """A search through indexes that are written first."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t, folder = star_tables(tune(spark), sf_dir), new_path(spark, "index")
        for name, column in columns.items():
            write_index(t[name], f"{folder}/{name}", column)
        return operator(t, index=folder, **params)
    return run


def _kept_pivot(t: StarTables, pivot: str) -> DataFrame:
    """A pivot whose sums were stored before some invoices were paid, corrected or made."""
    before = ChainMap({
        "account_invoice": t["account_invoice"].filter("id%11<>0").withColumn(
            "state", F.expr("case when id%5<>0 then state when state='paid' then 'open' else 'draft' end")),
        "account_invoice_line": t["account_invoice_line"].filter("invoice_id%11<>0").withColumns(
            {c: F.expr(f"cast(case when invoice_id%7=0 then {c}*2 else {c} end as decimal(15,2))") for c in ("price_subtotal", "price_total")})}, t)
    changed = t["account_invoice"].filter("id%5=0 or id%7=0 or id%11=0").select("id")
    stored = stage(summaries.pivot_sums(before, pivot), "sums")
    return summaries.pivot_of_sums(summaries.merged_sums(stored, before, t, changed, pivot), pivot)


def _ancestors_updated(t: StarTables) -> DataFrame:
    """The closure of an earlier tree, in which some categories lay elsewhere, were missing, or had not gone yet, brought up to date."""
    now = t["product_category"].select("id", "parent_id")
    parents = now.select(F.col("parent_id").alias("_p")).distinct()
    leaves = now.join(parents, F.col("id") == F.col("_p"), "left_anti").filter("id%3=0").select(F.col("id").alias("_leaf"))
    before = now.join(leaves, F.col("id") == F.col("_leaf"), "left_anti").withColumn(
        "parent_id", F.expr("case when id%4=1 then null else parent_id end")).unionByName(
        now.select((F.col("id") + 1_000_000).alias("id"), F.col("id").alias("parent_id")))
    known = stage(ancestor_closure(before), "closure")
    edits = changed_rows(before, now)
    return updated_closure(known, edits, before.filter("id >= 1000000").select("id")).select(
        F.col("node").alias("category_id"), F.col("ancestor").alias("ancestor_id"), "depth")


def _effects_of_attempts(t: StarTables) -> DataFrame:
    """The records that all attempts leave behind, once those that are refused are out."""
    return status.credit_note_effects({"credit_note_log": status.accepted_actions(t)})


def _stamp_stream(t: StarTables) -> DataFrame:
    """The invoices arrive as files, the pickings are stamped batch by batch, and the batches put together."""
    changes, pickings, out, checkpoint = (
        new_path(t.spark, label) for label in ("changes", "pickings", "stamps", "progress"))
    t["account_invoice"].write.parquet(changes)
    partition_pickings(t["stock_picking"], pickings)
    stamp_pickings_stream(t.spark, changes, pickings, out, checkpoint, parts=PARTS)
    compact_stamps(t.spark, out)
    return stamped_pickings(t.spark, pickings, out)


# When the pickings of the test data came: some before the updates of their invoices, some after.
PICKED_ON = "timestamp_ntz'1992-01-01' + make_interval(0,0,0,cast(id%2500 as int))"


def _stamp_streams(t: StarTables) -> DataFrame:
    """Both tables arrive as files, in two runs each: pickings and changes that come late meet what is there."""
    changes, pickings, out, checkpoint = (
        new_path(t.spark, label) for label in ("changes", "pickings", "stamps", "progress"))
    picked = t["stock_picking"].withColumn("create_date", F.expr(PICKED_ON))
    for half in ("id%2=0", "id%2=1"):
        picked.filter(f"id%4<>1 and {half} or id%4=1 and not ({half})").write.mode("append").parquet(pickings)
        t["account_invoice"].filter(half).write.mode("append").parquet(changes)
        stamp_streams(t.spark, changes, pickings, out, checkpoint)
    return stamped_by_streams(t.spark, out)


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: the supplier-bill lines of the tax annex."""
    return queries()["annex72_lines"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    more = {**llm.QUERIES, "pipeline": corpus_pipeline.run} if llm else {}
    return {
        **more,
        # report views
        "annex72_lines": _on(reports.annex72_lines),
        "commission_lines": _on(reports.commission_lines),
        "orders_to_cancel": _on(orders.orders_to_cancel, as_of=CANCEL_DAY),
        "orders_to_cancel_catch_up": _on(orders.orders_to_cancel, as_of=CANCEL_DAY, catch_up=True),
        "cash_movements": _on(reports.cash_movements),
        "cash_payments": _on(reports.cash_payments),
        "cash_taxes": _on(reports.cash_taxes),
        "print_in_progress": _on(reports.print_in_progress),
        "print_pending": _on(reports.print_pending),
        "print_pending_lines": _on(reports.print_pending_lines),
        # the same, and later runs, over what an earlier run has stored
        "commission_lines_stored": _on_stored(reports.commission_lines, "account_invoice_line"),
        "orders_to_cancel_stored": _on_stored(orders.orders_to_cancel, "sale_order", as_of=CANCEL_DAY),
        "print_pending_stored": _on_stored(reports.print_pending, "fiscal_document"),
        "commission_assign_second_run": _on_stored(commissions.commission_assign, "account_invoice_line"),
        "order_deadlines_second_run": _on_stored(orders.order_deadlines, "sale_order"),
        "certificate_numbers_second_run": _on_stored(withholding.certificate_numbers, "withholding_certificate"),
        # pivots and totals
        "annex72_pivot": _on(summaries.annex72_pivot),
        "commission_pivot": _on(summaries.commission_pivot, grain="month"),
        "commission_pivot_week": _on(summaries.commission_pivot, grain="week"),
        "annex72_pivot_kept": _on(_kept_pivot, pivot="annex72"),
        "commission_pivot_kept": _on(_kept_pivot, pivot="commission"),
        "cash_report": _on(summaries.cash_report, **REPORT),
        "cash_movements_detail": _on(summaries.cash_movements_detail, **REPORT),
        "cash_range_check": _on(summaries.cash_range_check),
        # commissions
        "category_ancestors": _on(commissions.category_ancestors),
        "category_ancestors_updated": _on(_ancestors_updated),
        "commission_assign": _on(commissions.commission_assign),
        "commission_rule_conflicts": _on(commissions.commission_rule_conflicts),
        "commission_rules_in_use": _on(commissions.commission_rules_in_use),
        # credit orders and payments
        "order_first_payment": _on(orders.order_first_payment),
        "order_deadlines": _on(orders.order_deadlines),
        "order_first_payment_as_of": _on(orders.order_first_payment, as_of_payment=True),
        "order_deadlines_as_of": _on(orders.order_deadlines, as_of_payment=True),
        "cancel_orders": _on(orders.cancel_orders, as_of=CANCEL_DAY),
        "payable_orders": _on(orders.payable_orders),
        "payable_orders_of_partner": _on(orders.payable_orders, partner_id=12),
        "order_line_amounts": _on(orders.order_line_amounts),
        "price_floor_violations": _on(orders.price_floor_violations),
        # withholding tax
        "withholding_amounts": _on(withholding.withholding_amounts),
        "withholding_eligible": _on(withholding.withholding_eligible),
        "withholding_eligible_supplier": _on(withholding.withholding_eligible, supplier_id=1000005),
        "withholding_certificates": _on(withholding.withholding_certificates),
        "certificate_numbers": _on(withholding.certificate_numbers),
        "certificate_numbers_existing": _on(_numbers_after_existing),
        "certificate_flags": _on(withholding.certificate_flags),
        "certificates_deletable": _on(withholding.certificates_deletable),
        # fiscal documents
        "fiscal_eligibility": _on_own_columns(fiscal.fiscal_eligibility),
        "payment_class_totals": _on(fiscal.payment_class_totals),
        "invoice_discount_total": _on(fiscal.invoice_discount_total),
        "refund_links": _on_own_columns(fiscal.refund_links),
        "fiscal_documents": _on(fiscal.fiscal_documents),
        "fiscal_documents_invoice_discount": _on(fiscal.fiscal_documents, discount="invoice"),
        "fiscal_filenames": _on_own_columns(fiscal.fiscal_filenames),
        "print_queue_by_user": _on_own_columns(fiscal.print_queue_by_user, user_id=7),
        "print_queue_by_user_invoices": _on_own_columns(fiscal.print_queue_by_user, user_id=7, invoices_only=True),
        "documents_deletable": _on_own_columns(fiscal.documents_deletable),
        "document_links_after_delete": _on_own_columns(_links_after_delete),
        "printers_deletable": _on_own_columns(fiscal.printers_deletable),
        # partners, addresses, delivery, stock
        "ruc_normalized": _on(partners.ruc_normalized),
        "ruc_duplicates": _on(partners.ruc_duplicates),
        "email_invalid": _on(partners.email_invalid),
        "partner_missing_fields": _on(partners.partner_missing_fields),
        "partner_age": _on(partners.partner_age, as_of=AGE_DAY),
        "sector_full_name": _on(partners.sector_full_name),
        "address_children": _on(partners.address_children, level="district"),
        "address_children_provinces": _on(partners.address_children, level="province"),
        "address_children_sectors": _on(partners.address_children, level="sector", parent_id=12),
        "address_mismatches": _on(partners.address_mismatches),
        "default_country": _on(partners.default_country),
        "zone_conflicts": _on(partners.zone_conflicts),
        "order_delivery_notes": _on(partners.order_delivery_notes),
        "invoice_delivery_notes": _on(partners.invoice_delivery_notes),
        "invoice_warranty_notes": _on(partners.invoice_warranty_notes),
        "stock_available": _on(stock.stock_available),
        "stock_search": _on(stock.stock_search, name="wh a"),
        "stock_search_limit": _on(stock.stock_search, name="wh a", limit=100),
        "stock_search_location": _on(stock.stock_search, name="loc/"),
        "product_quants": _on(stock.product_quants),
        "product_quants_of_product": _on(stock.product_quants, product_id=42),
        "supplier_accounts": _on(partners.supplier_accounts),
        "find_by_ruc": _on(partners.find_by_ruc, entity="partners", text="8-12"),
        "find_by_ruc_orders": _on(partners.find_by_ruc, entity="orders", text="8-12"),
        "find_by_ruc_invoices": _on(partners.find_by_ruc, entity="invoices", text="8-12"),
        "find_by_ruc_indexed": _indexed(partners.find_by_ruc, {"res_partner": "ruc"}, entity="orders", text="8-12"),
        "stock_search_indexed": _indexed(stock.stock_search, {"stock_location": "name", "stock_warehouse": "name"}, name="wh a"),
        "company_tax_ids": _on(partners.company_tax_ids),
        "declaration_violations": _on(quality.declaration_violations),
        "declaration_violations_stored": _on_stored(quality.declaration_violations, "account_invoice", "res_partner"),
        # status changes over time
        "credit_note_open_conflicts": _on(status.credit_note_open_conflicts),
        "credit_note_current": _on(status.credit_note_current),
        "credit_note_decisions": _on(status.credit_note_decisions),
        "credit_note_effects": _on(status.credit_note_effects),
        "credit_note_effects_of_attempts": _on(_effects_of_attempts),
        "credit_note_invoice_state": _on(status.credit_note_invoice_state),
        "stamp_pickings": _on(status.stamp_pickings),
        "stamp_pickings_stream": _on(_stamp_stream),
        "stamp_streams": _on(_stamp_streams),
        "number_rows": _on(_number_rows),
        # sources and sinks
        "load_tables": _on(_load_tables),
        "write_report": _on(_write_report),
    }


def oracle_sql() -> dict[str, str]:
    if not llm:
        return build_oracle()
    more = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {**build_oracle(), **llm.ORACLE, **more}
