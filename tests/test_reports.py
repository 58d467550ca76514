import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import reports, summaries
from tests.builders import tables, values

DAY = dt.date(2020, 5, 1)
NOON = dt.datetime(2020, 5, 1, 12)


@pytest.fixture(scope="module")
def annex(spark):
    return tables(
        spark,
        account_invoice_line=[
            {"id": 1, "invoice_id": 1, "account_id": 1, "company_id": 1, "price_subtotal": D("10.00")},
            {"id": 2, "invoice_id": 1, "account_id": 2, "company_id": 1, "price_subtotal": D("20.00")},
            {"id": 3, "invoice_id": 2, "account_id": 3, "company_id": 1, "price_subtotal": D("30.00")},
            {"id": 4, "invoice_id": 3, "account_id": 1, "company_id": 1, "price_subtotal": D("40.00")},
            {"id": 5, "invoice_id": 4, "account_id": 1, "company_id": 1, "price_subtotal": D("50.00")},
            {"id": 6, "invoice_id": 1, "account_id": 4, "company_id": 1, "price_subtotal": D("60.00")},
            {"id": 7, "invoice_id": 1, "account_id": 1, "company_id": 9, "price_subtotal": D("70.00")},
        ],
        account_account=[{"id": 1, "partner_concept_id": 1}, {"id": 2, "partner_concept_id": 2},
                         {"id": 3, "partner_concept_id": 3}, {"id": 4}],
        account_invoice=[
            {"id": 1, "type": "in_invoice", "state": "paid", "partner_id": 1},
            {"id": 2, "type": "in_invoice", "state": "open", "partner_id": 2},
            {"id": 3, "type": "in_invoice", "state": "draft", "partner_id": 1},
            {"id": 4, "type": "in_invoice", "state": "open", "partner_id": 3},
        ],
        res_partner=[{"id": 1, "supplier": True, "is_company": True, "name": "A"},
                     {"id": 2, "supplier": True, "name": "B"}, {"id": 3, "name": "C"}],
        partner_concept=[{"id": 1, "code": "007", "type": 1}, {"id": 2, "code": "A9", "type": 2},
                         {"id": 3, "code": "1234"}],
        res_company=[{"id": 1}])


def test_annex_codes_and_filters(annex):
    lines = reports.annex72_lines(annex)
    # no concept, draft bill, no supplier flag, unknown company: not there
    assert values(lines, "id", "partner_type", "partner_concept_code", "account_invoice_state") == [
        (1, 1, 7, 1), (2, 1, None, 1), (3, 2, None, 2)]


def test_annex_pivot_tells_totals_from_nulls(annex):
    pivot = summaries.annex72_pivot(annex)
    got = {(r.partner_name, r.level): r.account_invoice_line_price for r in pivot.collect()}
    assert got[(None, 0)] == D("60.00")
    assert got[("A", 1)] == D("30.00") and got[("A", 2)] == D("30.00") and got[("A", 3)] == D("30.00")
    assert pivot.filter("level = 0").count() == 1


@pytest.fixture(scope="module")
def cash(spark):
    return tables(
        spark,
        account_move=[
            {"id": 1, "name": "M1", "ref": None, "amount": D("100.00"), "date": DAY, "store_id": 1, "journal_id": 1},
            {"id": 2, "name": "M2", "ref": "Reversión Inversa", "amount": D("10.05"), "date": DAY, "store_id": 1,
             "journal_id": 2, "partner_id": 1},
            {"id": 3, "name": "M3", "ref": "x", "amount": D("7.00"), "date": DAY, "store_id": 1, "journal_id": 2},
            {"id": 4, "name": "M4", "amount": D("0.00"), "date": DAY, "store_id": 1, "journal_id": 2},
            {"id": 5, "name": "M5", "amount": D("5.00"), "date": DAY, "store_id": 1, "journal_id": 3},
            {"id": 6, "name": "M6", "amount": D("9.00"), "date": DAY, "store_id": 2, "journal_id": 2},
        ],
        account_payment=[
            {"id": 11, "move_name": "M1", "payment_type": None, "communication": "SO1"},
            {"id": 12, "move_name": "M1", "payment_type": "inbound"},
            {"id": 13, "move_name": "M3", "payment_type": "outbound"},
        ],
        account_journal=[
            {"id": 1, "name": "Caja", "code": "CSH1", "type": "cash", "at_least_one_outbound": True,
             "x_porcentaje_comision": D("0.0000")},
            {"id": 2, "name": "Banco", "code": "BNK1", "type": "bank", "at_least_one_outbound": False,
             "x_porcentaje_comision": D("0.0150")},
            {"id": 3, "name": "Varios", "code": "MISC", "type": "general", "at_least_one_outbound": False},
        ],
        res_partner=[{"id": 1, "name": "Zoe"}],
        account_invoice=[
            {"id": 1, "type": "out_invoice", "state": "paid", "partner_id": 1, "write_uid": 1, "number": "F1",
             "date_invoice": DAY, "amount_tax": D("9.00")},
            {"id": 2, "type": "out_invoice", "state": "paid", "partner_id": 99, "write_uid": 1, "date_invoice": DAY},
        ],
        account_invoice_tax=[{"invoice_id": 1, "tax_id": 7, "amount": D("7.00")},
                             {"invoice_id": 1, "tax_id": 2, "amount": D("2.00")},
                             {"invoice_id": 2, "tax_id": 2, "amount": D("5.00")}],
        account_tax=[{"id": 7, "description": "T7"}, {"id": 2, "description": "T2"}],
        res_users=[{"id": 1, "store_id": 1}],
        res_store=[{"id": 1, "name": "S1"}])


def test_movements_signs_and_fan_out(cash):
    rows = values(reports.cash_movements(cash), "id", "invoice_number", "amount_total")
    assert rows == [
        (11, "SO1", D("100.00")), (12, "ABONO", D("100.00")), (13, "ABONO", D("-7.00")),
        (None, "ABONO", D("-10.05")), (None, "ABONO", D("9.00"))]


def test_payments_negate_on_reversal_only(cash):
    rows = values(reports.cash_payments(cash), "id", "payment_journal_id", "store_id", "subtotal", "percentage_amount",
                  "payment_amount")
    # journal 1 is out; the outbound payment 13 stays positive; no rate, no commission
    assert rows == [
        (13, 2, 1, D("7.00"), D("0.11"), D("6.90")),
        (None, 2, 1, D("-10.05"), D("-0.15"), D("-9.90")),
        (None, 2, 2, D("9.00"), D("0.14"), D("8.87")),
        (None, 3, 1, D("5.00"), None, None)]


def test_null_payment_is_one_group_per_journal_store_and_day(cash):
    rows = {(r.id, r.payment_journal_id, r.store_id): r.subtotal for r in reports.cash_payments(cash).collect()}
    assert rows == {(13, 2, 1): D("7.00"), (None, 2, 1): D("-10.05"), (None, 3, 1): D("5.00"), (None, 2, 2): D("9.00")}


def test_cash_report_totals(cash):
    report = summaries.cash_report(cash, 1, DAY, DAY)
    totals = {r.section: r.total for r in report.filter("is_total").collect()}
    assert totals == {"subtotal": D("1.95"), "commission": D("-0.04"), "payment": D("-3.00"), "tax": D("9.00"),
                      "movements": D("182.95")}
    for section in ("subtotal", "commission", "payment", "tax"):
        parts = [r.total for r in report.filter(f"section = '{section}' and not is_total").collect()]
        assert sum(parts) == totals[section]


def test_cash_report_without_rows_or_filters(cash):
    empty_day = dt.date(1999, 1, 1)
    rows = values(summaries.cash_report(cash, 1, empty_day, empty_day), "section", "total", "is_total")
    assert rows == [(s, D("0.00"), True) for s in ("commission", "movements", "payment", "subtotal", "tax")]
    assert summaries.cash_report(cash, None, DAY, DAY).count() == 0
    assert summaries.cash_movements_detail(cash, 1, None, DAY).count() == 0
    with pytest.raises(ValueError):
        summaries.cash_report(cash, 1, DAY, empty_day)


def test_movements_detail_is_numbered_with_a_total(cash):
    detail = summaries.cash_movements_detail(cash, 1, DAY, DAY)
    assert sorted(r.number for r in detail.filter("not is_total").collect()) == [1, 2, 3, 4]
    assert [r.amount_total for r in detail.filter("is_total").collect()] == [D("182.95")]


def test_shared_move_name_does_not_make_all_pairs_of_moves_and_payments(spark, cash):
    """Draft moves share a name; each payment sees their sum once."""
    moves = [{"id": i, "name": "/", "amount": D("1.00"), "date": DAY, "store_id": 1, "journal_id": 2}
             for i in range(50)]
    payments = [{"id": i, "move_name": "/"} for i in range(20)]
    t = {**cash, **tables(spark, account_move=moves, account_payment=payments)}
    rows = reports.cash_payments(t).collect()
    assert len(rows) == 20 and {r.subtotal for r in rows} == {D("50.00")}


def test_two_taxes_on_a_line_give_two_queue_lines(spark):
    t = tables(
        spark,
        fiscal_document=[{"id": 1, "invoice_id": 1, "printer_id": 1, "write_uid": 1, "print_status": "pending",
                          "fiscal_invoice_number": 0, "documents_type_printed": "account_invoice", "create_date": NOON,
                          "number": "F/1", "invoice_type": "out_invoice"},
                         {"id": 2, "invoice_id": 2, "printer_id": None, "write_uid": 1, "print_status": "pending",
                          "fiscal_invoice_number": 0, "documents_type_printed": "account_invoice", "create_date": NOON}],
        account_invoice=[{"id": 1, "state": "draft"}, {"id": 2, "state": "open"}],
        account_invoice_line=[{"id": 1, "invoice_id": 1, "product_id": 1, "name": "a\nb"},
                              {"id": 2, "invoice_id": 1, "product_id": 1, "name": "c"}],
        account_invoice_line_tax=[{"invoice_line_id": 1, "tax_id": 1}, {"invoice_line_id": 1, "tax_id": 2}],
        account_tax=[{"id": 1, "amount": D("7.00")}, {"id": 2, "amount": D("10.00")}],
        product_product=[{"id": 1, "product_tmpl_id": 1}], product_template=[{"id": 1, "default_code": "P"}],
        res_users=[{"id": 1, "login": "u"}],
        fiscal_printer=[{"id": 1, "serial": "S", "merge_invoices_orders": False}])
    # the header queue tests the invoice's state, the line queue does not
    assert reports.print_pending(t).count() == 0
    rows = values(reports.print_pending_lines(t), "position", "id", "product_name", "tax_percentage",
                  "lines_filename_assigned")
    assert rows == [(1, 1, "ab", D("7.00"), "FACMV0000001"), (2, 1, "ab", D("10.00"), "FACMV0000001"),
                    (3, 2, "c", None, "FACMV0000001")]


def test_report_filters_reach_the_scan(spark, cash, tmp_path):
    path = str(tmp_path / "moves")
    cash["account_move"].write.parquet(path)
    t = {**cash, "account_move": spark.read.parquet(path)}
    report = reports.cash_payments(t).filter((F.col("store_id") == 1) & F.col("date_invoice").between(DAY, DAY))
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date" in plan and "EqualTo(store_id,1)" in plan
