"""Hand-made edge rows for the business rules."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import commissions, fiscal, orders, partners, quality, reports, status, stock, withholding
from tests.builders import table, tables, values

DAY = dt.date(2020, 5, 1)
NOON = dt.datetime(2020, 5, 1, 12)


# --- commissions ------------------------------------------------------------

@pytest.fixture(scope="module")
def sales(spark):
    return tables(
        spark,
        product_category=[{"id": 1}, {"id": 2, "parent_id": 1}, {"id": 3, "parent_id": 2}, {"id": 9}],
        product_template=[{"id": i, "categ_id": c} for i, c in ((1, 3), (2, 2), (3, 9))],
        product_product=[{"id": i, "product_tmpl_id": i} for i in (1, 2, 3)],
        commission_rule=[
            {"id": 1, "category_id": 1, "payment_term_id": 1, "percentage": D("2.50")},
            {"id": 2, "category_id": 2, "payment_term_id": 2, "percentage": D("4.00")},
            {"id": 3, "category_id": 2, "payment_term_id": 2, "percentage": D("9.00")},
            {"id": 4, "category_id": 3, "payment_term_id": 1, "percentage": D("0.00")},
            {"id": 5, "category_id": 3, "payment_term_id": 3, "percentage": D("1.00")},
        ],
        account_invoice=[{"id": 1, "state": "paid", "payment_term_id": 1}, {"id": 2, "state": "paid", "payment_term_id": 2},
                         {"id": 3, "state": "open", "payment_term_id": 1}, {"id": 4, "state": "paid"}],
        account_invoice_line=[
            {"id": i, "invoice_id": inv, "product_id": p, "price_subtotal": D("10.01")}
            for i, inv, p in ((1, 1, 1), (2, 2, 1), (3, 1, 3), (4, 3, 1), (5, 4, 1), (6, 2, 2))])


def test_nearest_rule_wins_and_others_are_untouched(sales):
    rows = values(commissions.commission_assign(sales), "id", "commission_id", "commission_percentage", "commission_total")
    assert rows == [
        (1, 1, D("2.50"), D("0.250250")),       # grandparent; the rule with 0 percent does not count
        (2, 2, D("4.00"), D("0.400400")),       # parent; of the duplicates the lowest id
        (3, None, D("0.00"), D("0.000000")),    # no rule
        (4, None, D("0.00"), D("0.000000")),    # not paid
        (5, None, D("0.00"), D("0.000000")),    # no term
        (6, 2, D("4.00"), D("0.400400"))]


def test_stored_commission_is_kept(spark, sales):
    stored = commissions.commission_assign(sales).selectExpr(
        "* except (commission_id, commission_percentage, commission_total)", "77 commission_id",
        "cast(7 as decimal(5,2)) commission_percentage", "cast(7 as decimal(22,6)) commission_total")
    again = {**sales, "account_invoice_line": stored}
    assert values(commissions.commission_assign(again), "id", "commission_id") == [(i, 77) for i in range(1, 7)]
    rows = values(commissions.commission_assign(again, recompute=True), "id", "commission_id")
    assert rows == [(1, 1), (2, 2), (3, 77), (4, 77), (5, 77), (6, 2)]
    half = stored.withColumn("commission_id", F.expr("case when id <> 2 then commission_id end"))
    assert values(commissions.commission_assign({**again, "account_invoice_line": half}), "id", "commission_id") == [
        (i, 2 if i == 2 else 77) for i in range(1, 7)]


def test_report_reads_stored_commissions_or_assigns_them(spark, sales):
    t = {**sales, **tables(
        spark, res_users=[{"id": 1, "partner_id": 1}], res_partner=[{"id": 1, "name": "V"}],
        account_payment_term=[{"id": 1, "name": "T1"}, {"id": 2, "name": "T2"}])}
    t["account_invoice"] = t["account_invoice"].withColumn("user_id", F.lit(1))
    columns = ("id", "commission_id", "commission_total", "vendor_name", "payment_term_name", "category_id")
    assigned = values(reports.commission_lines(t), *columns)
    stored = {**t, "account_invoice_line": commissions.commission_assign(t)}
    assert assigned == values(reports.commission_lines(stored), *columns)
    assert assigned == [(1, 1, D("0.250250"), "V", "T1", 3), (2, 2, D("0.400400"), "V", "T2", 3), (6, 2, D("0.400400"), "V", "T2", 2)]


def test_rule_conflicts_and_use(sales):
    assert values(commissions.commission_rule_conflicts(sales), "id", "reason") == [
        (2, "duplicate"), (3, "duplicate"), (4, "percentage_not_positive")]
    assert values(commissions.commission_rules_in_use(sales), "id", "line_count") == [(1, 1), (2, 2)]


# --- orders -----------------------------------------------------------------

@pytest.fixture(scope="module")
def credit(spark):
    return tables(
        spark,
        account_payment_term=[{"id": 1, "payment_term_type": "cash_payment"}, {"id": 2, "payment_term_type": "credit_payment"}],
        sale_order=[
            {"id": 1, "payment_term_id": 2, "state": "sale", "invoice_status": "to invoice", "partner_id": 5},
            {"id": 2, "payment_term_id": 1, "state": "sale", "invoice_status": "to invoice"},
            {"id": 3, "payment_term_id": 2, "state": "draft", "invoice_status": "to invoice"},
            {"id": 4, "payment_term_id": 2, "state": "sale", "invoice_status": "invoiced"},
            {"id": 5, "payment_term_id": 2, "state": "sale", "invoice_status": "to invoice"}],
        account_payment=[{"id": 3, "sale_order_id": 1, "payment_date": dt.date(2020, 1, 2)},
                         {"id": 2, "sale_order_id": 1, "payment_date": dt.date(2020, 1, 2)},
                         {"id": 1, "sale_order_id": 1, "payment_date": dt.date(2020, 2, 1)},
                         {"id": 4, "sale_order_id": 2, "payment_date": DAY}, {"id": 5, "sale_order_id": 3, "payment_date": DAY},
                         {"id": 6, "sale_order_id": 4, "payment_date": DAY}, {"id": 7, "payment_date": DAY}])


def test_first_payment_and_deadlines(credit):
    # The first that was booked, though a later one is dated back.
    assert values(orders.order_first_payment(credit), "order_id", "payment_id") == [(1, 1)]
    first = orders.order_deadlines(credit).filter("id = 1").first()
    assert (first.canceled_at, first.notified_at) == (dt.date(2020, 5, 1), dt.date(2020, 4, 21))
    assert orders.order_deadlines(credit).filter("canceled_at is null").count() == 4


def test_dates_once_given_stay(credit):
    day = dt.date(2019, 1, 1)
    stored = credit["sale_order"].withColumns({c: F.when(F.col("id") == 1, F.lit(day)) for c in orders.DATES})
    rows = orders.order_deadlines({**credit, "sale_order": stored}).filter("id = 1")
    assert [tuple(r) for r in rows.select(*orders.DATES).collect()] == [(day, day, day)]


def test_cancellation_day(credit):
    due, later = dt.date(2020, 5, 1), dt.date(2020, 5, 2)
    assert values(orders.orders_to_cancel(credit, due), "id") == [(1,)]
    assert orders.orders_to_cancel(credit, later).count() == 0
    assert values(orders.orders_to_cancel(credit, later, catch_up=True), "id") == [(1,)]
    assert values(orders.cancel_orders(credit, due), "id", "state") == [
        (1, "cancel"), (2, "sale"), (3, "draft"), (4, "sale"), (5, "sale")]
    assert values(orders.payable_orders(credit, partner_id=5), "id") == [(1,)]


def test_line_amounts(spark):
    t = tables(spark, sale_order_line=[
        {"id": 1, "product_uom_qty": D("3.00"), "price_unit": D("0.35"), "discount": D("15.00"), "tax_id": 7},
        {"id": 2, "product_uom_qty": D("2.00"), "price_unit": D("10.00")}], account_tax=[{"id": 7, "amount": D("7.00")}])
    rows = values(orders.order_line_amounts(t), "id", "price_reduced", "price_subtotal", "price_tax", "price_total")
    assert rows == [(1, D("0.297500"), D("0.89"), D("0.06"), D("0.95")), (2, D("10.000000"), D("20.00"), D("0.00"), D("20.00"))]


# --- withholding ------------------------------------------------------------

@pytest.fixture(scope="module")
def bills(spark):
    return tables(
        spark,
        account_invoice=[
            {"id": 1, "type": "in_invoice", "state": "open", "partner_id": 1, "amount_untaxed": D("100.00"), "number": "B1"},
            {"id": 2, "type": "out_invoice", "state": "open", "partner_id": 1},
            {"id": 3, "type": "in_invoice", "state": "paid", "partner_id": 2},
            {"id": 4, "type": "in_invoice", "state": "draft", "partner_id": 1}],
        account_tax=[{"id": 1, "amount": D("-2.00"), "is_withholding_tax": True},
                     {"id": 2, "amount": D("-8.00"), "is_withholding_tax": True}, {"id": 3, "amount": D("7.00")}],
        account_invoice_tax=[
            {"invoice_id": i, "tax_id": tax, "amount": D(amount)} for i, tax, amount in (
                (1, 1, "-2.00"), (1, 2, "-8.00"), (1, 3, "7.00"), (2, 2, "-1.00"), (3, 2, "-5.50"), (4, 2, "-9.00"))],
        withholding_certificate=[
            {"id": 1, "invoice_id": 3, "state": "approved", "create_date": NOON, "company_id": 1, "account_tax_id": 2},
            {"id": 2, "invoice_id": 1, "state": "draft", "create_date": NOON},
            {"id": 3, "state": "draft", "create_date": dt.datetime(2019, 1, 1)}],
        res_company=[{"id": 1, "partner_id": 9}],
        res_partner=[{"id": 9, "ruc": "R9", "dv": "1"}, {"id": 2, "name": "S2", "ruc": "R2"}])


def test_last_withholding_line_not_the_sum(bills):
    assert values(withholding.withholding_amounts(bills), "id", "withholding_tax") == [
        (1, D("-8.00")), (2, D("0.00")), (3, D("-5.50")), (4, D("-9.00"))]


def test_eligible_and_flags(bills):
    assert values(withholding.withholding_eligible(bills), "id") == [(1,)]
    assert values(withholding.withholding_eligible(bills, supplier_id=2), "id") == []
    assert values(withholding.certificate_flags(bills), "id", "has_withholding_certificate") == [
        (1, False), (2, False), (3, True), (4, False)]
    assert values(withholding.certificates_deletable(bills), "id") == [(2,), (3,)]


def test_numbers_are_gap_free_per_year_and_continue(spark, bills):
    assert values(withholding.certificate_numbers(bills), "id", "number") == [
        (1, "CRET/2020/0001"), (2, "CRET/2020/0002"), (3, "CRET/2019/0001")]
    used = spark.createDataFrame([("CRET/2020/9999",), ("CRET/2020/12",), ("Borrador",)], "number string")
    assert values(withholding.certificate_numbers(bills, used), "id", "number") == [
        (1, "CRET/2020/10000"), (2, "CRET/2020/10001"), (3, "CRET/2019/0001")]


def test_numbered_certificates_keep_their_numbers(bills):
    stored = bills["withholding_certificate"].withColumn("number", F.expr("case when id = 1 then 'CRET/2020/0041' end"))
    again = {**bills, "withholding_certificate": stored}
    expected = [(1, "CRET/2020/0041"), (2, "CRET/2020/0042"), (3, "CRET/2019/0001")]
    assert values(withholding.certificate_numbers(again), "id", "number") == expected
    assert values(withholding.withholding_certificates(again), "id", "number") == expected


def test_unset_texts_and_flags_count_as_empty(spark):
    t = tables(
        spark, sale_order=[{"id": 1, "partner_id": 1, "note": "n"}], res_partner=[{"id": 1, "sector_id": 3}],
        delivery_zone=[{"id": 1, "name": "R1"}, {"id": 2, "description": "d"}],
        delivery_zone_sector=[{"zone_id": 1, "sector_id": 3}, {"zone_id": 2, "sector_id": 3}],
        account_account=[{"id": 1, "name": "a", "internal_type": "other", "company_id": 1},
                         {"id": 2, "name": "b", "internal_type": "other", "company_id": 1, "deprecated": True}],
        res_company=[{"id": 1}])
    assert values(partners.order_delivery_notes(t), "id", "note") == [
        (1, "n\nRuta de entrega: R1, información: Ruta de entrega: , información: d")]
    assert values(partners.supplier_accounts(t), "id") == [(1,)]


def test_certificate_texts(bills):
    one, _, three = withholding.withholding_certificates(bills).orderBy("id").collect()
    assert (one.company_ruc, one.company_dv, one.supplier_id, one.supplier_ruc) == ("R9", "1", 2, "R2")
    assert (one.withholding_percentage_formatted, one.withholding_amount_formatted, one.create_date_formatted) == (
        "8.00 %", "5.50", "01/05/2020")
    assert (three.withholding_percentage_formatted, three.withholding_amount_formatted) == ("0.00 %", "0.00")


# --- fiscal documents -------------------------------------------------------

@pytest.fixture(scope="module")
def shop(spark):
    def doc(i, status, number=0, kind="account_invoice", text="F/1", printer=1):
        return {"id": 100 + i, "invoice_id": i, "print_status": status, "fiscal_invoice_number": number,
                "documents_type_printed": kind, "number": text, "printer_id": printer, "invoice_type": "out_invoice"}

    def invoice(i, kind="out_invoice", total="5.00", user=1, parent=None, **more):
        return {"id": i, "type": kind, "amount_total": D(total), "write_uid": user, "refund_invoice_id": parent, **more}

    return tables(
        spark,
        fiscal_printer=[{"id": 1, "serial": "S1", "employee_id": 1, "merge_invoices_orders": True},
                        {"id": 3, "serial": "S3", "employee_id": 3, "merge_invoices_orders": False}],
        fiscal_document=[doc(2, "pending"), doc(3, "completed", 9, text="FAC/2020/000003"), doc(4, "failed"),
                         doc(5, "completed", 0), doc(11, "in_progress", kind="pos_order")],
        account_invoice=[
            invoice(1, total="0.00"), invoice(2), invoice(3), invoice(4), invoice(5), invoice(6, user=2),
            invoice(7, "out_refund", parent=3, name="r7", number="NC/7"), invoice(8, "out_refund", parent=4, name="r8"),
            invoice(9, "out_refund", parent=99), invoice(10, partner_id=1, number="FAC/10", amount_untaxed=D("4.00")),
            invoice(11), invoice(12, "out_refund", total="0.00", parent=3, number="NC/0")],
        account_invoice_refund=[
            {"id": 1, "description": "r7", "filter_refund": "refund", "date_invoice": DAY,
             "create_date": dt.datetime(2020, 5, 1, 7, 5)}],
        account_invoice_line=[{"id": 1, "invoice_id": 10, "price_unit": D("10.00"), "discount": D("5.00"), "quantity": D("3")},
                              {"id": 2, "invoice_id": 10, "price_unit": D("1.00"), "discount": D("0.50")}],
        account_invoice_tax=[{"invoice_id": 10, "tax_id": 2}, {"invoice_id": 10, "tax_id": 1}],
        account_tax=[{"id": 1, "amount": D("7.00")}, {"id": 2, "amount": D("10.00")}],
        account_invoice_payment_rel=[{"invoice_id": 10, "payment_id": p} for p in (1, 2, 3, 4, 5)],
        account_payment=[{"id": i, "amount": D(i), "journal_id": i} for i in (1, 2, 3, 4, 5)],
        account_journal=[{"id": i, "code": c} for i, c in ((1, "CSH12"), (2, "XBNK1"), (3, "TC-V"), (4, "ATD-"), (5, "TD-C"))],
        res_partner=[{"id": 1, "name": "P", "ruc": "", "province_id": 1}],
        province=[{"id": 1, "name": "Colón"}], district=[], sector=[], res_country=[])


def test_eligibility_order_of_reasons(shop):
    assert dict(values(fiscal.fiscal_eligibility(shop), "id", "eligibility")) == {
        1: "total_not_positive", 2: "printing_in_progress", 3: "printing_completed", 4: "noop", 5: "noop",
        6: "printer_not_assigned", 7: "ok", 8: "parent_not_printed", 9: "parent_not_printed", 10: "ok",
        11: "printing_in_progress", 12: "ok"}


def test_assembled_document(shop):
    made = {r.invoice_id: r for r in fiscal.fiscal_documents(shop).collect()}
    assert set(made) == {7, 10, 12}
    ten = made[10]
    assert (ten.partner_ruc, ten.partner_province, ten.partner_zip) == ("N/D", "Colón", "")
    assert (ten.payments_total, ten.cash_payment_total, ten.bank_payment_total, ten.credit_card_payment_total,
            ten.debit_card_payment_total) == (D(15), D(1), D(2), D(3), D(5))
    assert (ten.discount_total, ten.tax_percentage, ten.tax_count) == (D("0.505"), D("7.00"), 2)
    assert (ten.printer_serial_number, ten.master_filename_assigned, ten.lines_filename_assigned) == (
        "S1", "FACTI1000010", "FACMV1000010")
    seven = made[7]
    assert (seven.parent_invoice_filename_assigned, seven.parent_invoice_fiscal_printer_serial,
            seven.parent_invoice_fiscal_invoice_number) == ("FACTI1000003", "S1", 9)
    assert (seven.refund_type, seven.refund_note, seven.refund_date, seven.refund_time) == (
        "refund", "r7", "01/05/2020", "7:05")
    assert (made[12].filename_serial, made[12].master_filename_assigned) == (0, None)
    assert fiscal.fiscal_documents(shop, discount="invoice").filter("invoice_id = 10").first().discount_total == 0
    with pytest.raises(ValueError):
        fiscal.fiscal_documents(shop, discount="other")


@pytest.mark.parametrize("number, kind, sale, printer, master", [
    ("FAC/2020/000012", "account_invoice", "out_invoice", 3, "FACTI0000012"),
    ("FAC/2020/000012", "account_invoice", "out_invoice", 1, "FACTI1000012"),
    ("FAC/2020/000012", "pos_order", "out_refund", 1, "NCTI2000012"),
    ("1234567", "account_invoice", "out_invoice", 3, "FACTI01234567"),
    ("FAC/ABC", "account_invoice", "out_invoice", 1, None),
    ("FAC/0", "account_invoice", "out_invoice", 1, None),
    ("FAC/", "account_invoice", "out_invoice", 1, None),
    (None, "account_invoice", "out_invoice", 1, None),
])
def test_file_names(spark, shop, number, kind, sale, printer, master):
    one = table(spark, "fiscal_document", {"id": 1, "number": number, "documents_type_printed": kind,
                                           "invoice_type": sale, "printer_id": printer})
    row = fiscal.fiscal_filenames({**shop, "fiscal_document": one}).first()
    assert row.master_filename_assigned == master
    assert row.lines_filename_assigned == (master and master.replace("FACTI", "FACMV").replace("NCTI", "NCMV"))


def test_deletion(spark, shop):
    assert values(fiscal.documents_deletable(shop), "id", "unlinked_invoice_id") == [(102, 2), (103, 3), (104, 4), (105, 5)]
    assert values(fiscal.printers_deletable(shop), "id") == [(3,)]
    gone = spark.createDataFrame([(102,), (111,)], "id bigint")
    links = dict(values(fiscal.document_links_after_delete(shop, gone), "id", "fiscal_document_id"))
    # the document of an order leaves the link of its invoice
    assert (links[1], links[2], links[3], links[11]) == (None, None, 103, 111)


# --- partners, notes, stock -------------------------------------------------

@pytest.fixture(scope="module")
def people(spark):
    return tables(spark, res_partner=[
        {"id": 1, "ruc": "8-12 3", "email": "a@b.co", "birth_date": dt.date(2000, 2, 29), "sector_id": 1},
        {"id": 2, "ruc": "8123", "email": "A@b.com", "birth_date": dt.date(2023, 6, 1), "supplier": True, "sector_id": 2},
        {"id": 3, "ruc": "", "email": "x@y.museum", "supplier": True, "is_company": True, "dv": "1"},
        {"id": 4, "ruc": " -", "email": ""}, {"id": 5, "birth_date": dt.date(2030, 1, 1)}],
        res_company=[{"id": 1, "partner_id": 3}])


def test_ruc(people):
    assert values(partners.ruc_duplicates(people), "id", "holders") == [(1, 2), (2, 2)]
    again = partners.ruc_normalized({"res_partner": partners.ruc_normalized(people).selectExpr("id", "ruc_normalized ruc")})
    assert again.filter("not (ruc <=> ruc_normalized)").count() == 0


def test_email(people):
    assert values(partners.email_invalid(people), "id") == [(2,), (3,)]


def test_missing_fields(people):
    got = {(r.entity, r.id): r.missing_fields.split(",") for r in partners.partner_missing_fields(people).collect()}
    assert "dv" not in got["partner", 1] and {"dv", "partner_type", "partner_nationality"} <= set(got["partner", 2])
    assert "partner_nationality" not in got["partner", 3] and "ruc" in got["partner", 3]
    assert got["company", 1] == ["ruc", "phone"]


@pytest.mark.parametrize("day, ages", [
    (dt.date(2024, 2, 28), ["23 año(s) de edad", "0", "0", "0", "0"]),
    (dt.date(2024, 2, 29), ["24 año(s) de edad", "0", "0", "0", "0"]),
    (dt.date(2025, 2, 28), ["25 año(s) de edad", "1 año(s) de edad", "0", "0", "0"]),
])
def test_age_of_leap_day_births(people, day, ages):
    assert [a for _, a in values(partners.partner_age(people, day), "id", "age")] == ages


def test_addresses(spark):
    t = tables(spark, province=[{"id": 1, "name": "P", "country_id": 1}],
               district=[{"id": 1, "name": "D", "province_id": 1, "country_id": 1},
                         {"id": 2, "name": "E", "province_id": 1, "country_id": 2},
                         {"id": 3, "name": "F", "province_id": 1}],
               sector=[{"id": 1, "name": "S", "district_id": 1, "country_id": 1}], res_country=[{"id": 1}])
    assert values(partners.sector_full_name(t), "full_name") == [(" / D / S",)]
    assert values(partners.address_children(t, "district", 1), "id") == [(1,)]
    assert values(partners.address_children(t, "province"), "parent_id", "id") == [(1, 1)]
    assert values(partners.address_mismatches(t), "level", "id") == [("district", 2), ("district", 3)]
    with pytest.raises(ValueError):
        partners.address_children(t, "street")


@pytest.fixture(scope="module")
def routes(spark, people):
    zones = tables(
        spark, delivery_zone=[{"id": 2, "name": "B", "description": "tarde"}, {"id": 1, "name": "A", "description": "9 am"}],
        delivery_zone_sector=[{"zone_id": 2, "sector_id": 1}, {"zone_id": 1, "sector_id": 1}, {"zone_id": 1, "sector_id": 1}],
        sector=[{"id": 1, "name": "S"}])
    return {**people, **zones}


INFO = "\nRuta de entrega: A, información: 9 amRuta de entrega: B, información: tarde"


def test_delivery_notes(spark, routes):
    assert values(partners.zone_conflicts(routes), "sector_id", "zones") == [(1, 2)]
    t = {**routes, **tables(
        spark, sale_order=[{"id": 1, "partner_id": 1, "note": "n"}, {"id": 2, "partner_id": 3, "note": "n"},
                           {"id": 3, "partner_id": 1}],
        account_invoice=[{"id": 1, "partner_id": 1, "comment": "c"}, {"id": 2, "partner_id": 2, "comment": "c"}])}
    assert values(partners.order_delivery_notes(t), "id", "note") == [(1, "n" + INFO), (2, "n"), (3, INFO)]
    once = partners.invoice_delivery_notes(t)
    assert values(once, "id", "comment") == [(1, INFO + "\nc"), (2, "c")]
    noted = t["account_invoice"].drop("comment").join(once, "id")
    assert values(partners.invoice_delivery_notes({**t, "account_invoice": noted}), "id", "comment") == values(
        once, "id", "comment")


def test_warranty_notes(spark):
    t = tables(
        spark, product_brand=[{"id": 1, "support_warranty_info": "zz"}, {"id": 2, "support_warranty_info": ""}, {"id": 3},
                              {"id": 4, "support_warranty_info": "aa"}],
        product_template=[{"id": i, "product_brand_id": b} for i, b in ((1, 1), (2, 2), (3, 3), (4, 4), (5, 1), (6, None))],
        product_product=[{"id": i, "product_tmpl_id": i} for i in range(1, 7)],
        account_invoice_line=[{"id": i, "invoice_id": inv, "product_id": p} for i, inv, p in (
            (1, 1, 1), (2, 1, 4), (3, 1, 5), (4, 1, 2), (5, 2, 3), (6, 3, 1), (7, 2, 6))],
        account_invoice=[{"id": 1, "comment": "c"}, {"id": 2}, {"id": 3, "comment": "has zz"}, {"id": 4, "comment": "x"}])
    assert values(partners.invoice_warranty_notes(t), "id", "comment") == [
        (1, "c\naa\nzz"), (2, None), (3, "has zz"), (4, "x")]


def test_stock(spark):
    t = tables(
        spark, stock_warehouse=[{"id": 1, "name": "Norte", "lot_stock_id": 1}, {"id": 2, "name": "Norte 2", "lot_stock_id": 1},
                                {"id": 3, "name": "Vacío", "lot_stock_id": 8}],
        stock_location=[{"id": 1, "name": "loc A"}, {"id": 2, "name": "norte B"}, {"id": 3, "name": "vacío"}],
        stock_quant=[
            {"id": i, "product_id": 1, "location_id": loc, "company_id": 1, "quantity": D(q), "reserved_quantity": D(r)}
            for i, loc, q, r in ((1, 1, "2.5", "0"), (2, 1, "3.5", "0"), (3, 2, "1", "2.5"), (4, 3, "0", "0"))])
    assert values(stock.stock_available(t), "id", "label") == [
        (1, "Norte (2)"), (2, "Norte (4)"), (3, " (-2)"), (4, " (0)")]
    assert values(stock.stock_search(t, "NORTE"), "id") == [(1,), (2,)]
    assert values(stock.stock_search(t, "norte", limit=1), "id") == [(1,)]
    assert values(stock.stock_search(t, "norte b"), "id") == [(3,)]
    assert values(stock.stock_search(t, "vac"), "id") == [(4,)]       # the warehouse matches but holds nothing
    assert values(stock.stock_search(t, ""), "id") == [(1,), (2,), (3,), (4,)]
    assert values(stock.product_quants(t, 1), "id") == [(1,), (2,), (3,)]


def test_find_by_ruc_rejects_other_entities(people):
    with pytest.raises(ValueError):
        partners.find_by_ruc(people, "stores", "8")


def test_declared_limits(spark):
    from tallyhouse.schemas import ALLOWED, MAX_LENGTH
    t = {name: table(spark, name) for name, _ in [*ALLOWED, *MAX_LENGTH]}
    t["sale_order"] = table(spark, "sale_order", {"id": 1, "state": "sale"}, {"id": 2, "state": "lost"}, {"id": 3})
    t["res_partner"] = table(spark, "res_partner", {"id": 1, "dv": "123"})
    assert values(quality.declaration_violations(t), "table_name", "id", "reason") == [
        ("res_partner", 1, "too_long"), ("sale_order", 2, "not_allowed")]


# --- status -----------------------------------------------------------------

def test_credit_note_log(spark):
    def step(i, action, day, invoice=1, reason=None, reject=None):
        return {"id": i, "invoice_id": invoice, "action": action, "happened_on": dt.datetime(2020, 1, day),
                "reason": reason, "reject_reason": reject}

    t = tables(spark, credit_note_log=[
        step(1, "request", 1, reason="a"), step(2, "approve", 2), step(3, "reject", 3, reject="no"),
        step(4, "reject", 4, reject="never"), step(5, "request", 5, reason="b"), step(6, "approve", 6), step(7, "approve", 7),
        step(8, "request", 8, invoice=2, reason="c")])
    made = {r.id: r for r in status.credit_note_effects(t).collect()}
    day = lambda n: n and dt.datetime(2020, 1, n)
    expected = {
        1: ("rejected", "a", "no", 1, 2, 3), 3: ("rejected", "a", "never", 1, None, 4),
        4: ("rejected", "a", "never", 1, None, 4), 5: ("approved", "b", None, 5, 7, None),
        8: ("pending", "c", None, 8, None, None)}
    assert {i: (r.state, r.reason, r.reject_reason, r.requested_on, r.approved_on, r.rejected_on) for i, r in made.items()} == {
        i: (s, a, b, day(x), day(y), day(z)) for i, (s, a, b, x, y, z) in expected.items()}
    assert values(status.credit_note_invoice_state(t), "invoice_id", "credit_note_state") == [(1, "approved"), (2, "pending")]


def test_requests(spark):
    t = tables(spark, credit_note_request=[
        {"id": 1, "invoice_id": 1, "state": "pending"}, {"id": 2, "invoice_id": 1, "state": "approved", "reason": "x"},
        {"id": 3, "invoice_id": 2, "state": "pending"}, {"id": 4, "invoice_id": 2, "state": "rejected"}])
    assert values(status.credit_note_open_conflicts(t), "invoice_id", "open_requests") == [(1, 2)]
    assert values(status.credit_note_current(t), "invoice_id", "current_id", "current_state") == [
        (1, 2, "approved"), (2, 4, "rejected")]


def test_stamps(spark):
    t = tables(
        spark, stock_picking=[{"id": 1, "origin": "A", "factura": "old"}, {"id": 2, "origin": "A"}, {"id": 3, "factura": "keep"},
                              {"id": 4, "origin": "B", "factura": "b"}, {"id": 5, "origin": "C", "factura": "c"}],
        account_invoice=[
            {"id": 1, "origin": "A", "state": "open", "number": "N1", "write_date": dt.datetime(2020, 1, 2)},
            {"id": 2, "origin": "A", "state": "open", "number": "N2", "write_date": dt.datetime(2020, 1, 1)},
            {"id": 3, "origin": "B", "state": "paid", "number": "N3", "write_date": dt.datetime(2020, 1, 1)},
            {"id": 4, "origin": None, "state": "open", "number": "N4", "write_date": dt.datetime(2020, 1, 1)},
            {"id": 5, "origin": "C", "state": "open", "number": None, "write_date": dt.datetime(2020, 1, 1)}])
    assert values(status.stamp_pickings(t), "id", "factura") == [
        (1, "N1"), (2, "N1"), (3, "keep"), (4, "b"), (5, None)]
