"""Fixed schemas of the business tables, as Spark DDL, and their allowed values.

Ids are BIGINT, codes INT, money DECIMAL(15,2), percentages DECIMAL. Dates carry no
time zone; date-times are TIMESTAMP_NTZ.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

DDL = {
    "res_country": "id INT, name STRING, code STRING",
    "province": "id INT, name STRING, country_id INT",
    "district": "id INT, name STRING, province_id INT, country_id INT",
    "sector": "id INT, name STRING, province_id INT, district_id INT, country_id INT",
    "res_partner": (
        "id BIGINT, name STRING, supplier BOOLEAN, is_company BOOLEAN, ruc STRING, dv STRING, country_id INT, "
        "province_id INT, district_id INT, sector_id BIGINT, street STRING, zip STRING, reference STRING, "
        "home_number STRING, email STRING, phone STRING, mobile STRING, partner_type STRING, "
        "partner_nationality STRING, birth_date DATE"),
    "res_store": "id INT, name STRING",
    "res_users": "id INT, partner_id INT, login STRING, store_id INT",
    "res_company": "id INT, name STRING, partner_id INT",
    "account_payment_term": "id INT, name STRING, payment_term_type STRING",
    "account_invoice": (
        "id BIGINT, type STRING, state STRING, partner_id BIGINT, user_id BIGINT, write_uid BIGINT, company_id BIGINT, "
        "payment_term_id INT, number STRING, date_invoice DATE, create_date TIMESTAMP_NTZ, write_date TIMESTAMP_NTZ, "
        "amount_untaxed DECIMAL(15,2), amount_tax DECIMAL(15,2), amount_total DECIMAL(15,2), "
        "amount_discount DECIMAL(15,2), origin STRING, refund_invoice_id BIGINT, name STRING, comment STRING"),
    "account_invoice_line": (
        "id BIGINT, invoice_id BIGINT, name STRING, product_id BIGINT, account_id BIGINT, company_id BIGINT, "
        "quantity DECIMAL(15,2), price_unit DECIMAL(15,2), discount DECIMAL(6,2), price_subtotal DECIMAL(15,2), "
        "price_total DECIMAL(15,2), tax_id INT"),
    "account_invoice_line_tax": "invoice_line_id BIGINT, tax_id INT",
    "account_invoice_tax": "invoice_id BIGINT, tax_id INT, amount DECIMAL(15,2)",
    "account_invoice_payment_rel": "invoice_id BIGINT, payment_id BIGINT",
    "account_invoice_refund": (
        "id BIGINT, description STRING, filter_refund STRING, date_invoice DATE, create_date TIMESTAMP_NTZ"),
    "account_tax": "id INT, description STRING, amount DECIMAL(6,2), is_withholding_tax BOOLEAN",
    "account_account": (
        "id BIGINT, name STRING, partner_concept_id INT, company_id INT, internal_type STRING, deprecated BOOLEAN"),
    "partner_concept": "id INT, code STRING, name STRING, type INT",
    "account_journal": (
        "id INT, code STRING, name STRING, type STRING, at_least_one_outbound BOOLEAN, "
        "x_porcentaje_comision DECIMAL(6,4)"),
    "account_move": (
        "id BIGINT, name STRING, ref STRING, amount DECIMAL(15,2), date DATE, store_id BIGINT, partner_id BIGINT, "
        "journal_id BIGINT"),
    "account_payment": (
        "id BIGINT, move_name STRING, communication STRING, payment_type STRING, store_id BIGINT, "
        "amount DECIMAL(15,2), journal_id BIGINT, sale_order_id BIGINT, payment_date DATE"),
    "product_category": "id INT, name STRING, parent_id INT",
    "product_template": (
        "id BIGINT, name STRING, default_code STRING, categ_id INT, product_brand_id INT, list_price DECIMAL(15,2)"),
    "product_product": "id BIGINT, product_tmpl_id BIGINT, default_code STRING",
    "product_brand": "id INT, name STRING, support_warranty_info STRING",
    "commission_rule": "id INT, percentage DECIMAL(5,2), category_id INT, payment_term_id INT",
    "sale_order": (
        "id BIGINT, name STRING, partner_id BIGINT, payment_term_id INT, state STRING, invoice_status STRING, "
        "note STRING"),
    "sale_order_line": (
        "id BIGINT, order_id BIGINT, product_id BIGINT, product_uom_qty DECIMAL(15,2), price_unit DECIMAL(15,2), "
        "discount DECIMAL(6,2), tax_id INT"),
    "fiscal_printer": "id INT, serial STRING, employee_id INT, merge_invoices_orders BOOLEAN",
    "fiscal_document": (
        "id BIGINT, invoice_id BIGINT, printer_id BIGINT, write_uid BIGINT, print_status STRING, "
        "fiscal_invoice_number BIGINT, documents_type_printed STRING, create_date TIMESTAMP_NTZ, number STRING, "
        "invoice_type STRING, partner_name STRING, partner_ruc STRING, partner_street STRING, partner_zip STRING, "
        "partner_province STRING, partner_district STRING, partner_sector STRING, partner_country STRING, "
        "payments_total DECIMAL(28,2), cash_payment_total DECIMAL(28,2), bank_payment_total DECIMAL(28,2), "
        "credit_card_payment_total DECIMAL(28,2), debit_card_payment_total DECIMAL(28,2), amount_total DECIMAL(15,2), "
        "amount_untaxed DECIMAL(15,2), amount_tax DECIMAL(15,2), discount_total DECIMAL(28,6), "
        "tax_percentage DECIMAL(6,2), refund_type STRING, refund_note STRING, "
        "parent_invoice_filename_assigned STRING, parent_invoice_fiscal_printer_serial STRING, "
        "parent_invoice_fiscal_invoice_number BIGINT, refund_date STRING, refund_time STRING"),
    "stock_location": "id INT, name STRING",
    "stock_warehouse": "id INT, name STRING, lot_stock_id INT, store_id INT",
    "stock_quant": (
        "id BIGINT, product_id BIGINT, location_id INT, company_id INT, quantity DECIMAL(15,2), "
        "reserved_quantity DECIMAL(15,2)"),
    "stock_picking": "id BIGINT, origin STRING, factura STRING",
    "delivery_zone": "id INT, name STRING, description STRING",
    "delivery_zone_sector": "zone_id INT, sector_id INT",
    "credit_note_request": (
        "id BIGINT, invoice_id BIGINT, state STRING, reason STRING, requested_on TIMESTAMP_NTZ"),
    "credit_note_log": (
        "id BIGINT, invoice_id BIGINT, action STRING, happened_on TIMESTAMP_NTZ, reason STRING, reject_reason STRING"),
    "credit_note_attempt": (
        "id BIGINT, invoice_id BIGINT, action STRING, happened_on TIMESTAMP_NTZ, reason STRING, reject_reason STRING"),
    "sale_order_log": (
        "id BIGINT, order_id BIGINT, changed_on TIMESTAMP_NTZ, state STRING, invoice_status STRING, payment_term_id INT"),
    "withholding_certificate": (
        "id BIGINT, invoice_id BIGINT, account_tax_id INT, certificated_on DATE, create_date TIMESTAMP_NTZ, "
        "state STRING, company_id BIGINT, comments STRING"),
    "cash_report_request": "id BIGINT, store_id BIGINT, start_on DATE, end_on DATE",
}

# Columns that operators add and a job stores. A table that lacks them is complete: they are then computed. They are
# never added as NULL, since a stored NULL means something else.
STORED = {
    "account_invoice": "withholding_tax DECIMAL(15,2), has_withholding_certificate BOOLEAN, credit_note_state STRING, print_status STRING",
    "res_partner": "sex STRING",
    "account_invoice_line": "commission_id INT, commission_percentage DECIMAL(5,2), commission_total DECIMAL(22,6)",
    "sale_order": "first_payment_date DATE, canceled_at DATE, notified_at DATE",
    "fiscal_document": "filename_serial BIGINT, master_filename_assigned STRING, lines_filename_assigned STRING",
    "withholding_certificate": "number STRING",
}

# The selections each column may hold (NULL is always allowed).
ALLOWED = {
    ("account_payment_term", "payment_term_type"): ("cash_payment", "credit_payment"),
    ("partner_concept", "type"): (1, 2),
    ("credit_note_request", "state"): ("draft", "pending", "approved", "rejected"),
    ("sale_order", "state"): ("draft", "approved", "pending", "sent", "sale", "done", "cancel"),
    ("withholding_certificate", "state"): ("draft", "approved"),
    ("fiscal_document", "print_status"): ("pending", "in_progress", "completed", "failed"),
    ("fiscal_document", "documents_type_printed"): ("account_invoice", "pos_order"),
    ("fiscal_document", "invoice_type"): ("out_invoice", "out_refund"),
    ("res_partner", "partner_type"): ("natural", "juridica", "extranjero"),
    ("res_partner", "partner_nationality"): ("local", "extranjero"),
    ("res_partner", "sex"): ("Masculino", "Femenino"),
    ("account_invoice", "credit_note_state"): ("draft", "pending", "approved"),
    ("account_invoice", "print_status"): ("incomplete", "pending", "in_progress", "completed", "failed"),
}

# The longest text each column may hold.
MAX_LENGTH = {
    ("res_partner", "ruc"): 20,
    ("res_partner", "dv"): 2,
    ("province", "name"): 255,
    ("district", "name"): 255,
    ("sector", "name"): 255,
    ("partner_concept", "code"): 20,
    ("fiscal_printer", "serial"): 255,
    ("fiscal_document", "partner_name"): 255,
    ("fiscal_document", "partner_ruc"): 20,
    ("fiscal_document", "number"): 100,
}


def schema_of(table: str) -> StructType:
    return StructType.fromDDL(DDL[table])


def stored_schema_of(table: str) -> StructType:
    """The columns that operators add to the table."""
    return StructType.fromDDL(STORED[table]) if table in STORED else StructType()
