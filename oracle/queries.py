"""One SQL text per registered query, written from the meaning of the operator.

Each text names business tables; `build_oracle` puts the SELECTs of those it needs
in front, as common table expressions.
"""

import re

from oracle.bindings import BINDINGS

AS_OF = "date '1997-02-12'"
REPORT_STORE = "3"
REPORT_FROM = "date '1996-01-01'"
REPORT_TO = "date '1997-12-31'"
AGE_DAY = "date '2024-02-29'"

# Steps that several texts share.
STEPS = {
    "lines_72": """
select l.id, l.id account_invoice_line_id, i.id account_invoice_id, a.id account_account_id, c.id partner_concept_id, p.id res_partner_id,
 co.id company_id, case when p.is_company is true then 1 else 2 end partner_type, p.ruc partner_ruc, p.dv partner_dv, p.name partner_name,
 c.type partner_concept_type, case when regexp_full_match(c.code,'[0-9]{1,3}') then cast(c.code as int) end partner_concept_code,
 l.price_subtotal account_invoice_line_price, case i.state when 'paid' then 1 when 'open' then 2 end account_invoice_state,
 i.number account_invoice_number, l.name account_invoice_line_name, c.name partner_concept_name, a.name account_account_name,
 i.date_invoice account_invoice_date, i.create_date account_invoice_create_date
from account_invoice_line l join account_account a on a.id=l.account_id
join account_invoice i on i.id=l.invoice_id and i.type='in_invoice' and i.state in ('open','paid')
join res_partner p on p.id=i.partner_id and p.supplier is true
join partner_concept c on c.id=a.partner_concept_id join res_company co on co.id=l.company_id""",
    "tree": """
select id category_id, id ancestor_id, 0 depth from product_category
union all select id, parent_id, 1 from product_category where parent_id is not null
union all select c.id, p.parent_id, 2 from product_category c join product_category p on p.id=c.parent_id where p.parent_id is not null
union all select c.id, g.parent_id, 3 from product_category c join product_category p on p.id=c.parent_id
 join product_category g on g.id=p.parent_id where g.parent_id is not null""",
    "rules_kept": """
select * from commission_rule r where percentage>0 and not exists (
 select 1 from commission_rule s where s.percentage>0 and s.category_id=r.category_id and s.payment_term_id=r.payment_term_id and s.id<r.id)""",
    "nearest": """
select category_id, payment_term_id, rule_id, percentage from (
 select t.category_id, r.payment_term_id, r.id rule_id, r.percentage,
  row_number() over (partition by t.category_id, r.payment_term_id order by t.depth) rn
 from tree t join rules_kept r on r.category_id=t.ancestor_id) q where rn=1""",
    "assigned": """
select l.*, n.rule_id commission_id, coalesce(n.percentage, cast(0 as decimal(5,2))) commission_percentage,
 cast(coalesce(l.price_subtotal*n.percentage*0.01,0) as decimal(22,6)) commission_total
from account_invoice_line l
left join account_invoice i on i.id=l.invoice_id and i.state='paid'
left join product_product pp on pp.id=l.product_id left join product_template pt on pt.id=pp.product_tmpl_id
left join nearest n on n.category_id=pt.categ_id and n.payment_term_id=i.payment_term_id""",
    "lines_commission": """
select l.id, l.id account_invoice_line_id, i.id invoice_id, l.product_id, l.commission_id, pt.categ_id category_id, i.user_id vendor_id,
 i.payment_term_id, l.name product_name, pc.name category_name, i.number invoice_number, p.name vendor_name, t.name payment_term_name,
 i.state invoice_state, i.date_invoice invoice_date, l.quantity, l.price_unit product_price_unit, l.price_subtotal subtotal,
 l.price_total total, l.discount, l.commission_percentage, l.commission_total
from assigned l join commission_rule r on r.id=l.commission_id join product_product pp on pp.id=l.product_id
join product_template pt on pt.id=pp.product_tmpl_id join product_category pc on pc.id=pt.categ_id
join account_invoice i on i.id=l.invoice_id and i.state='paid' join res_users u on u.id=i.user_id
join res_partner p on p.id=u.partner_id join account_payment_term t on t.id=i.payment_term_id""",
    "signed_moves": """
select id move_id, name, date date_invoice, store_id, partner_id, journal_id, amount, case when coalesce(contains(ref,'Inversa'),false) then -1 else 1 end sign
from account_move""",
    "movements": """
select p.id, coalesce(p.communication,'ABONO') invoice_number, c.name partner_name, j.name journal_name, m.date_invoice, m.store_id, p.payment_type,
 cast(round(m.amount,2) * least(m.sign, case when p.payment_type='outbound' then -1 else 1 end) as decimal(15,2)) amount_total, m.move_id
from signed_moves m join (select id, name from account_journal where type in ('bank','cash')) j on j.id=m.journal_id
left join account_payment p on p.move_name=m.name left join res_partner c on c.id=m.partner_id where m.amount<>0""",
    "pays": """
select p.id, j.id payment_journal_id, j.name journal_name, cast(sum(m.sign*round(m.amount,2)) as decimal(28,2)) subtotal,
 cast(sum(m.sign*round(m.amount*j.x_porcentaje_comision,2)) as decimal(28,2)) percentage_amount,
 cast(sum(m.sign*round(m.amount*(1-j.x_porcentaje_comision),2)) as decimal(28,2)) payment_amount, m.store_id, m.date_invoice
from signed_moves m join account_journal j on j.id=m.journal_id and not j.at_least_one_outbound
left join account_payment p on p.move_name=m.name group by all""",
    "taxed": """
select i.id, x.tax_id, i.write_uid, e.store_id, i.number invoice_number, i.date_invoice, x.description tax_description, x.amount tax_amount,
 i.amount_tax invoice_amount_tax, e.store_name
from account_invoice i
join (select y.invoice_id, y.tax_id, y.amount, t.description from account_invoice_tax y join account_tax t on t.id=y.tax_id) x on x.invoice_id=i.id
join (select u.id, u.store_id, s.name store_name from res_users u join res_store s on s.id=u.store_id) e on e.id=i.write_uid
where i.type='out_invoice' and i.state='paid' and i.partner_id in (select id from res_partner)""",
    "stored_lines": """
select l.*, cast(case when id%4=0 then 111 when id%4=2 then 131 end as int) commission_id, cast(case when id%2=0 then 7.5 else 0 end as decimal(5,2)) commission_percentage,
 cast(case when id%2=0 then price_subtotal*0.5 else 0 end as decimal(22,6)) commission_total from account_invoice_line l""",
    "stored_orders": """
select o.*, case when id%4=0 then date '1996-11-14' end first_payment_date,
 case when id%4=0 then date '1997-02-12' when id%4=1 then date '1997-01-01' end canceled_at, case when id%4=0 then date '1997-02-02' end notified_at
from sale_order o""",
    "stored_certificates": """
select c.*, case when id%2=0 then concat('CRET/',cast(year(create_date) as varchar),'/',lpad(cast(id%40+1 as varchar),4,'0')) end number
from withholding_certificate c""",
    "stored_named": """
select * exclude (master_filename_assigned, lines_filename_assigned), concat('ST',cast(id as varchar)) master_filename_assigned,
 concat('SL',cast(id as varchar)) lines_filename_assigned from named""",
    "first_paid": """
select o.id order_id, q.id payment_id, q.payment_date first_payment_date
from sale_order o join account_payment_term t on t.id=o.payment_term_id and t.payment_term_type='credit_payment'
join (select *, row_number() over (partition by sale_order_id order by id) rn from account_payment where sale_order_id is not null) q
 on q.sale_order_id=o.id and q.rn=1
where o.state='sale' and o.invoice_status='to invoice'""",
    "decided": """
with w as (select *, max(case when action in ('request','reject') then id end) over p last_id, max(case when action='approve' then id end) over p last_ok
 from credit_note_attempt window p as (partition by invoice_id order by id rows between unbounded preceding and 1 preceding))
select w.*, case when w.action='request' and (b.action='request' or w.last_ok>w.last_id) then 'open_request'
 when w.action='approve' and w.last_id is null then 'no_request' end refusal
from w left join credit_note_attempt b on b.id=w.last_id""",
    "accepted_rows": """
select l.*, count(case when action in ('request','reject') then 1 end) over w record_no, count(case when action='request' then 1 end) over w request_no
from (select * from decided where refusal is null) l window w as (partition by invoice_id order by id)""",
    "first_paid_then": """
select q.sale_order_id order_id, q.id payment_id, q.payment_date first_payment_date
from (select *, row_number() over (partition by sale_order_id order by id) rn from account_payment where sale_order_id is not null) q
join sale_order o on o.id=q.sale_order_id
join (select l.*, p.id pid, row_number() over (partition by p.id order by l.changed_on desc, l.id desc) n
 from account_payment p join sale_order_log l on l.order_id=p.sale_order_id and l.changed_on<=p.payment_date) s on s.pid=q.id and s.n=1
join account_payment_term t on t.id=s.payment_term_id and t.payment_term_type='credit_payment'
where q.rn=1 and s.state='sale' and s.invoice_status='to invoice'""",
    "deadlines": """
select o.*, f.first_payment_date, cast(f.first_payment_date+90 as date) canceled_at, cast(f.first_payment_date+80 as date) notified_at
from sale_order o left join first_paid f on f.order_id=o.id""",
    "due": """
select o.id, o.canceled_at from deadlines o join account_payment_term t on t.id=o.payment_term_id and t.payment_term_type='credit_payment'
where o.state='sale' and o.invoice_status='to invoice'""",
    "withheld": """
select i.id, i.type, cast(case when i.type='in_invoice' then coalesce(q.amount,0) else 0 end as decimal(15,2)) withholding_tax
from account_invoice i left join (
 select x.invoice_id, x.amount, row_number() over (partition by x.invoice_id order by x.tax_id desc) rn
 from account_invoice_tax x join account_tax t on t.id=x.tax_id where t.is_withholding_tax) q on q.invoice_id=i.id and q.rn=1""",
    "eligible_bills": """
select i.id, i.number, i.partner_id, i.state, w.withholding_tax from account_invoice i join withheld w on w.id=i.id
where w.withholding_tax<0 and i.state in ('open','paid')
and i.id not in (select invoice_id from withholding_certificate where state='approved')""",
    "numbered_certificates": """
select id, cast(year(create_date) as int) as year, row_number() over (partition by year(create_date) order by create_date, id) sequence
from withholding_certificate""",
    "doc_last": """
select invoice_id, id doc_id, print_status, fiscal_invoice_number from document_core d
where id=(select max(id) from document_core e where e.invoice_id=d.invoice_id)""",
    "eligibility": """
select i.id, i.type, case
 when i.amount_total<=0 and i.type='out_invoice' then 'total_not_positive'
 when d.doc_id is not null then case when d.print_status in ('pending','in_progress') then 'printing_in_progress'
  when d.print_status='completed' and d.fiscal_invoice_number>0 then 'printing_completed' else 'noop' end
 when p.id is null then 'printer_not_assigned'
 when i.type='out_refund' and (r.doc_id is null or r.fiscal_invoice_number=0) then 'parent_not_printed'
 else 'ok' end eligibility
from account_invoice i left join doc_last d on d.invoice_id=i.id
left join (select employee_id, min(id) id from fiscal_printer group by 1) p on p.employee_id=i.write_uid
left join doc_last r on r.invoice_id=i.refund_invoice_id""",
    "pay_classes": """
select r.invoice_id, cast(sum(p.amount) as decimal(28,2)) payments_total,
 cast(sum(case when position('CSH1' in j.code)>0 then p.amount else 0 end) as decimal(28,2)) cash_payment_total,
 cast(sum(case when position('BNK1' in j.code)>0 then p.amount else 0 end) as decimal(28,2)) bank_payment_total,
 cast(sum(case when position('TC-' in substr(j.code,1,3))>0 then p.amount else 0 end) as decimal(28,2)) credit_card_payment_total,
 cast(sum(case when position('TD-' in substr(j.code,1,3))>0 then p.amount else 0 end) as decimal(28,2)) debit_card_payment_total
from account_invoice_payment_rel r join account_payment p on p.id=r.payment_id left join account_journal j on j.id=p.journal_id group by 1""",
    "discounts": """
select invoice_id, cast(sum(price_unit*discount*0.01) as decimal(28,6)) discount_total from account_invoice_line group by 1""",
    "named": """
select b.*, case when filename_serial>0 then concat(case when invoice_type='out_invoice' then 'FACTI' else 'NCTI' end,tail) end master_filename_assigned,
 case when filename_serial>0 then concat(case when invoice_type='out_invoice' then 'FACMV' else 'NCMV' end,tail) end lines_filename_assigned
from (select q.*, concat(case when not coalesce(merged,false) then '0' when documents_type_printed='pos_order' then '2' else '1' end,
  lpad(cast(filename_serial as varchar),cast(greatest(6,length(cast(filename_serial as varchar))) as int),'0')) tail
 from (select d.*, p.merge_invoices_orders merged, coalesce(try_cast(regexp_extract(d.number,'[^/]*$') as bigint),0) filename_serial
  from document_core d left join fiscal_printer p on p.id=d.printer_id) q) b""",
    "links": """
select i.id invoice_id, i.refund_invoice_id parent_invoice_id, n.master_filename_assigned parent_invoice_filename_assigned,
 p.serial parent_invoice_fiscal_printer_serial, n.fiscal_invoice_number parent_invoice_fiscal_invoice_number, f.filter_refund refund_type,
 f.description refund_note, strftime(f.date_invoice,'%d/%m/%Y') refund_date,
 concat(cast(hour(f.create_date) as varchar),':',lpad(cast(minute(f.create_date) as varchar),2,'0')) refund_time_text, f.create_date
from account_invoice i left join named n on n.invoice_id=i.refund_invoice_id left join fiscal_printer p on p.id=n.printer_id
left join account_invoice_refund f on f.description=i.name where i.type='out_refund'""",
    "details": """
select i.id invoice_id, i.type invoice_type, i.number, p.name partner_name, case when coalesce(p.ruc,'')='' then 'N/D' else p.ruc end partner_ruc,
 coalesce(p.street,'') partner_street, coalesce(p.zip,'') partner_zip, coalesce(pr.name,'') partner_province, coalesce(di.name,'') partner_district,
 coalesce(se.name,'') partner_sector, coalesce(co.name,'') partner_country,
 cast(coalesce(c.payments_total,0) as decimal(28,2)) payments_total, cast(coalesce(c.cash_payment_total,0) as decimal(28,2)) cash_payment_total,
 cast(coalesce(c.bank_payment_total,0) as decimal(28,2)) bank_payment_total,
 cast(coalesce(c.credit_card_payment_total,0) as decimal(28,2)) credit_card_payment_total,
 cast(coalesce(c.debit_card_payment_total,0) as decimal(28,2)) debit_card_payment_total,
 i.amount_total, i.amount_untaxed, i.amount_tax, i.amount_discount,
 cast(coalesce(ds.discount_total,0) as decimal(28,6)) discount_total, cast(coalesce(x.rate,0) as decimal(6,2)) tax_percentage,
 cast(coalesce(x.n,0) as bigint) tax_count, k.refund_type, k.refund_note, k.parent_invoice_filename_assigned, k.parent_invoice_fiscal_printer_serial,
 cast(coalesce(k.parent_invoice_fiscal_invoice_number,0) as bigint) parent_invoice_fiscal_invoice_number, k.refund_date,
 case when k.create_date is not null then k.refund_time_text end refund_time
from account_invoice i left join res_partner p on p.id=i.partner_id left join province pr on pr.id=p.province_id
left join district di on di.id=p.district_id left join sector se on se.id=p.sector_id left join res_country co on co.id=p.country_id
left join pay_classes c on c.invoice_id=i.id left join discounts ds on ds.invoice_id=i.id
left join (select y.invoice_id, arg_min(t.amount,y.tax_id) rate, count(*) n from account_invoice_tax y join account_tax t on t.id=y.tax_id group by 1) x on x.invoice_id=i.id
left join links k on k.invoice_id=i.id""",
    "new_documents": """
select d.*, i.write_uid user_id, p.id printer_id, p.serial printer_serial_number, p.merge_invoices_orders merged,
 cast(regexp_extract(d.number,'[^/]*$') as bigint) filename_serial
from eligibility e join details d on d.invoice_id=e.id join account_invoice i on i.id=e.id
join fiscal_printer p on p.employee_id=i.write_uid where e.eligibility='ok'""",
    "infos": """
select r.sector_id, concat(chr(10), string_agg(concat('Ruta de entrega: ',coalesce(z.name,''),', información: ',coalesce(z.description,'')),'' order by z.id)) info
from (select distinct zone_id, sector_id from delivery_zone_sector) r join delivery_zone z on z.id=r.zone_id group by 1""",
    "quant_labels": """
select q.id, q.location_id, w.name warehouse_name,
 concat(coalesce(w.name,''),' (',cast(cast(round_even(q.quantity-q.reserved_quantity,0) as bigint) as varchar),')') as label
from stock_quant q left join stock_warehouse w on w.lot_stock_id=q.location_id""",
    "log_rows": """
select l.*, count(case when action in ('request','reject') then 1 end) over w record_no, count(case when action='request' then 1 end) over w request_no
from credit_note_log l window w as (partition by invoice_id order by id)""",
    "stamped": """
select origin, arg_max(number, (write_date, id)) number from account_invoice where state='open' and origin is not null group by 1""",
}

DETAIL_COLUMNS = (
    "invoice_id, invoice_type, number, partner_name, partner_ruc, partner_street, partner_zip, partner_province, partner_district, "
    "partner_sector, partner_country, payments_total, cash_payment_total, bank_payment_total, credit_card_payment_total, "
    "debit_card_payment_total, amount_total, amount_untaxed, amount_tax, {discount} discount_total, tax_percentage, tax_count, "
    "refund_type, refund_note, parent_invoice_filename_assigned, parent_invoice_fiscal_printer_serial, "
    "parent_invoice_fiscal_invoice_number, refund_date, refund_time")


def _new_documents(discount: str) -> str:
    tail = ("concat(case when not merged then '0' else '1' end, "
            "lpad(cast(filename_serial as varchar),cast(greatest(6,length(cast(filename_serial as varchar))) as int),'0'))")
    return f"""
select {DETAIL_COLUMNS.format(discount=discount)}, user_id, printer_id, printer_serial_number,
 'account_invoice' documents_type_printed, 'pending' print_status, cast(0 as bigint) fiscal_invoice_number, filename_serial,
 concat(case when invoice_type='out_invoice' then 'FACTI' else 'NCTI' end, {tail}) master_filename_assigned,
 concat(case when invoice_type='out_invoice' then 'FACMV' else 'NCMV' end, {tail}) lines_filename_assigned
from new_documents where filename_serial>0"""


def _report_filter() -> str:
    return f"store_id={REPORT_STORE} and date_invoice between {REPORT_FROM} and {REPORT_TO}"


def _section(section: str, measure: str, source: str, key: str, name: str) -> str:
    where = _report_filter()
    return f"""
select '{section}' section, cast({key} as bigint) item_id, max({name}) as name, cast(coalesce(sum({measure}),0) as decimal(28,2)) total, false is_total
from {source} where {where} group by {key}
union all
select '{section}', null, null, cast(coalesce(sum({measure}),0) as decimal(28,2)), true from {source} where {where}"""


def _pivot(source: str, rows: str, measures: str) -> str:
    flags = " + ".join(f"(1-grouping({r}))" for r in rows.split(", "))
    return f"select {rows}, cast({flags} as int) as level, {measures} from {source} group by rollup({rows})"


def _missing(tests: dict[str, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"case when {test} then '{name}' end" for name, test in tests.items()) + ")"


def _blank(column: str) -> str:
    return f"coalesce(cast({column} as varchar),'')=''"


def _count_tables() -> str:
    names = [n for n in BINDINGS if n not in ("numbered_lineitem", "invoice_header", "document_core")] + ["fiscal_document"]
    source = {"fiscal_document": "document_core"}
    stored = {"account_invoice_line": ("stored_lines", "sum(commission_id)"), "sale_order": ("stored_orders", "count(canceled_at)"),
              "fiscal_document": ("document_core", "sum(id%100)"), "withholding_certificate": ("stored_certificates", "count(number)")}
    return " union all ".join(
        f"select '{n}' table_name, count(*) row_count, cast({stored.get(n, (n, 'null'))[1]} as bigint) stored_sum "
        f"from {stored[n][0] if n in stored else source.get(n, n)}" for n in names)


def _children(child: str, parent: str, link: str, country: str, extra: str = "") -> str:
    return (f"select p.id parent_id, c.id, c.name from {child} c join {parent} p on p.id=c.{link} "
            f"where c.country_id={country}{extra}")


def _search(name: str, limit: str = "") -> str:
    return f"""
select id, label from (
 select id, label from quant_labels where location_id in (select lot_stock_id from stock_warehouse where name ilike '%{name}%')
 union all
 select q.id, q.label from quant_labels q join stock_location l on l.id=q.location_id where l.name ilike '%{name}%'
  and not exists (select 1 from quant_labels r join stock_warehouse w on w.lot_stock_id=r.location_id where w.name ilike '%{name}%')) x
{limit}"""


def _with_notes(table: str, text: str) -> str:
    return (f"select r.id, {text} from {table} r left join res_partner p on p.id=r.partner_id "
            "left join infos f on f.sector_id=p.sector_id")


EVERYBODY = ("country_id", "province_id", "district_id", "sector_id", "ruc", "phone", "mobile", "email", "street", "reference",
             "home_number")
PARTNER_TESTS = {n: _blank(f"p.{n}") for n in EVERYBODY} | {
    "dv": f"coalesce(p.supplier,false) and {_blank('p.dv')}",
    "partner_type": f"coalesce(p.supplier,false) and {_blank('p.partner_type')}",
    "partner_nationality": f"coalesce(p.supplier,false) and not coalesce(p.is_company,false) and {_blank('p.partner_nationality')}",
}
COMPANY_TESTS = {n: _blank(f"p.{n}") for n in ("ruc", "dv", "email", "phone")}

STAMPED = """
select p.id, p.origin, case when s.origin is not null then s.number else p.factura end factura
from stock_picking p left join stamped s on s.origin=p.origin"""

BY_RUC = "select r.id, r.{label} as name, r.partner_id, p.ruc partner_ruc from {table} r join res_partner p on p.id=r.partner_id where p.ruc ilike '%8-12%'"

NOT_PRINTED = """
select id, invoice_id, printer_id, write_uid, print_status, documents_type_printed, number, create_date from document_core
where print_status in ('pending','in_progress','failed') and write_uid=7"""

PENDING = "print_status='pending' and printer_id is not null and documents_type_printed='account_invoice' and fiscal_invoice_number=0"

QUERIES = {
    "load_tables": _count_tables(),
    "write_report": """
select cast(date_trunc('month',account_invoice_date) as date) report_month, account_invoice_date, id, account_invoice_line_price, partner_concept_code
from lines_72""",
    "annex72_lines": "select * from lines_72",
    "commission_lines": "select * from lines_commission",
    "orders_to_cancel": f"select id from due where canceled_at={AS_OF} order by id",
    "orders_to_cancel_catch_up": f"select id from due where canceled_at<={AS_OF} order by id",
    "cash_movements": "select * exclude (move_id) from movements order by partner_name, amount_total",
    "cash_payments": "select * from pays",
    "cash_taxes": "select * from taxed",
    "print_in_progress": """
select row_number() over (order by d.create_date, d.id) as position, d.id, d.master_filename_assigned, u.login user_login, p.serial fiscal_printer_serial
from named d join res_users u on u.id=d.write_uid join fiscal_printer p on p.id=d.printer_id
where d.print_status='in_progress' and d.fiscal_invoice_number=0""",
    "print_pending": f"""
select row_number() over (order by n.create_date, n.id) as position, n.id, d.partner_name, d.partner_ruc, d.partner_street, d.partner_zip,
 d.partner_province, d.partner_district, d.partner_sector, d.partner_country, d.payments_total, d.cash_payment_total, d.bank_payment_total,
 d.credit_card_payment_total, d.debit_card_payment_total, d.amount_total, d.amount_untaxed, d.amount_tax, d.discount_total, d.tax_percentage,
 d.invoice_type, d.refund_type, d.refund_note, d.parent_invoice_filename_assigned, d.parent_invoice_fiscal_printer_serial,
 d.parent_invoice_fiscal_invoice_number, d.refund_date, d.refund_time, n.master_filename_assigned, n.lines_filename_assigned, u.login user_login
from (select * from named where {PENDING}) n join details d on d.invoice_id=n.invoice_id
join account_invoice i on i.id=n.invoice_id and i.state in ('open','paid') join res_users u on u.id=n.write_uid""",
    "print_pending_lines": f"""
select row_number() over (order by n.create_date, n.id, l.id, lt.tax_id nulls last) as position, l.id, n.id fiscal_document_id, pt.default_code product_code,
 pp.default_code product_code_2, replace(l.name,chr(10),'') product_name, l.price_unit product_price, l.quantity, 'UNIDADES' unit_type,
 cast(2 as int) group_type, t.amount tax_percentage, n.master_filename_assigned, n.lines_filename_assigned, u.login user_login
from account_invoice_line l join account_invoice i on i.id=l.invoice_id join (select * from named where {PENDING}) n on n.invoice_id=i.id
join product_product pp on pp.id=l.product_id join product_template pt on pt.id=pp.product_tmpl_id join res_users u on u.id=n.write_uid
left join account_invoice_line_tax lt on lt.invoice_line_id=l.id left join account_tax t on t.id=lt.tax_id""",
    "annex72_pivot": _pivot(
        "lines_72", "partner_name, partner_ruc, partner_dv",
        "cast(sum(account_invoice_line_price) as decimal(28,2)) account_invoice_line_price, cast(sum(partner_type) as bigint) partner_type, "
        "cast(sum(partner_concept_type) as bigint) partner_concept_type, cast(sum(partner_concept_code) as bigint) partner_concept_code, "
        "cast(sum(account_invoice_state) as bigint) account_invoice_state"),
    "annex72_pivot_kept": _pivot(
        "lines_72", "partner_name, partner_ruc, partner_dv",
        "cast(sum(account_invoice_line_price) as decimal(28,2)) account_invoice_line_price, cast(sum(partner_type) as bigint) partner_type, "
        "cast(sum(partner_concept_type) as bigint) partner_concept_type, cast(sum(partner_concept_code) as bigint) partner_concept_code, "
        "cast(sum(account_invoice_state) as bigint) account_invoice_state"),
    "commission_pivot": _pivot(
        "(select cast(date_trunc('month',invoice_date) as date) invoice_date, vendor_name, total, commission_total from lines_commission)",
        "invoice_date, vendor_name",
        "cast(sum(total) as decimal(28,2)) total, cast(sum(commission_total) as decimal(32,6)) commission_total"),
    "commission_pivot_kept": _pivot(
        "(select cast(date_trunc('month',invoice_date) as date) invoice_date, vendor_name, total, commission_total from lines_commission)",
        "invoice_date, vendor_name",
        "cast(sum(total) as decimal(28,2)) total, cast(sum(commission_total) as decimal(32,6)) commission_total"),
    "commission_pivot_week": _pivot(
        "(select cast(date_trunc('week',invoice_date) as date) invoice_date, vendor_name, total, commission_total from lines_commission)",
        "invoice_date, vendor_name",
        "cast(sum(total) as decimal(28,2)) total, cast(sum(commission_total) as decimal(32,6)) commission_total"),
    "cash_report": " union all ".join([
        _section("subtotal", "subtotal", "pays", "payment_journal_id", "journal_name"),
        _section("commission", "percentage_amount", "pays", "payment_journal_id", "journal_name"),
        _section("payment", "payment_amount", "pays", "payment_journal_id", "journal_name"),
        _section("tax", "tax_amount", "taxed", "tax_id", "tax_description"),
        f"select 'movements', null, null, cast(coalesce(sum(amount_total),0) as decimal(28,2)), true from movements where {_report_filter()}"]),
    "cash_movements_detail": f"""
select row_number() over (order by id nulls last, partner_name nulls last, amount_total, date_invoice, invoice_number, journal_name, move_id) number,
 invoice_number, partner_name, journal_name, date_invoice, cast(amount_total as decimal(28,2)) amount_total, false is_total
from movements where {_report_filter()}
union all select null, null, null, null, null, cast(coalesce(sum(amount_total),0) as decimal(28,2)), true from movements where {_report_filter()}""",
    "cash_range_check": "select *, 'end_before_start' reason from cash_report_request where end_on<start_on",
    "category_ancestors": "select * from tree",
    "category_ancestors_updated": "select * from tree",
    "commission_assign": "select * from assigned",
    "commission_rule_conflicts": """
select * from (select r.id, r.category_id, r.payment_term_id, r.percentage, concat_ws(',',
 case when (select count(*) from commission_rule s where s.category_id=r.category_id and s.payment_term_id=r.payment_term_id)>1 then 'duplicate' end,
 case when r.percentage<=0 then 'percentage_not_positive' end) reason from commission_rule r) q where reason<>''""",
    "commission_rules_in_use": """
select r.id, r.category_id, r.payment_term_id, r.percentage, count(*) line_count
from commission_rule r join assigned l on l.commission_id=r.id group by all""",
    "order_first_payment": "select * from first_paid",
    "order_deadlines": "select * from deadlines",
    "order_first_payment_as_of": "select * from first_paid_then",
    "order_deadlines_as_of": """
select o.*, f.first_payment_date, cast(f.first_payment_date+90 as date) canceled_at, cast(f.first_payment_date+80 as date) notified_at
from sale_order o left join first_paid_then f on f.order_id=o.id""",
    "cancel_orders": f"""
select id, name, partner_id, payment_term_id, case when id in (select id from due where canceled_at={AS_OF}) then 'cancel' else state end state,
 invoice_status, note from sale_order""",
    "payable_orders": """
select id, name, partner_id, payment_term_id, state, invoice_status from sale_order where state='sale' and invoice_status='to invoice'
and payment_term_id in (select id from account_payment_term where payment_term_type='credit_payment')""",
    "payable_orders_of_partner": """
select id, name, partner_id, payment_term_id, state, invoice_status from sale_order where state='sale' and invoice_status='to invoice'
and payment_term_id in (select id from account_payment_term where payment_term_type='credit_payment') and partner_id=12""",
    "order_line_amounts": """
select id, order_id, product_id, price_reduced, price_subtotal, price_tax, cast(price_subtotal+price_tax as decimal(15,2)) price_total
from (select *, cast(round(price_subtotal*coalesce(rate,0)*0.01,2) as decimal(15,2)) price_tax
 from (select *, cast(round(price_reduced*product_uom_qty,2) as decimal(15,2)) price_subtotal
  from (select l.id, l.order_id, l.product_id, l.product_uom_qty, t.amount rate,
   cast(l.price_unit*(100-coalesce(l.discount,0))*0.01 as decimal(21,6)) price_reduced
   from sale_order_line l left join account_tax t on t.id=l.tax_id) a) b) c""",
    "price_floor_violations": """
select l.id, l.order_id, l.product_id, l.price_unit, t.list_price, 'below_list_price' reason
from sale_order_line l join product_product p on p.id=l.product_id join product_template t on t.id=p.product_tmpl_id where l.price_unit<t.list_price""",
    "withholding_amounts": "select * from withheld",
    "withholding_eligible": "select * from eligible_bills",
    "withholding_eligible_supplier": "select * from eligible_bills where partner_id=1000005",
    "withholding_certificates": """
select c.id, concat('CRET/',cast(n.year as varchar),'/',lpad(cast(n.sequence as varchar),cast(greatest(4,length(cast(n.sequence as varchar))) as int),'0')) number,
 c.state, c.certificated_on, c.company_id, co.name company_name, o.ruc company_ruc, o.dv company_dv, i.partner_id supplier_id, s.name supplier_name,
 s.ruc supplier_ruc, s.dv supplier_dv, c.account_tax_id, t.description tax_description, coalesce(t.amount,0) withholding_percentage,
 c.invoice_id, i.number invoice_number, i.amount_untaxed invoice_subtotal, w.withholding_tax withholding_amount,
 cast(i.amount_untaxed as varchar) invoice_subtotal_formatted, concat(cast(-t.amount as varchar),' %') withholding_percentage_formatted,
 cast(-w.withholding_tax as varchar) withholding_amount_formatted, strftime(c.create_date,'%d/%m/%Y') create_date_formatted, c.comments
from withholding_certificate c join numbered_certificates n on n.id=c.id left join res_company co on co.id=c.company_id
left join res_partner o on o.id=co.partner_id left join account_invoice i on i.id=c.invoice_id left join res_partner s on s.id=i.partner_id
left join account_tax t on t.id=c.account_tax_id left join withheld w on w.id=c.invoice_id""",
    "certificate_numbers": """
select id, year, sequence, concat('CRET/',cast(year as varchar),'/',lpad(cast(sequence as varchar),cast(greatest(4,length(cast(sequence as varchar))) as int),'0')) number
from numbered_certificates""",
    "certificate_numbers_existing": """
select id, year, sequence, concat('CRET/',cast(year as varchar),'/',lpad(cast(sequence as varchar),cast(greatest(4,length(cast(sequence as varchar))) as int),'0')) number
from (select n.id, n.year, n.sequence+coalesce(g.used,0) sequence from numbered_certificates n left join (
 select year(i.date_invoice) as year, max(month(i.date_invoice)) used from account_invoice i
 join account_invoice_tax t on t.invoice_id=i.id and t.tax_id=8 group by 1) g on g.year=n.year) q""",
    "certificate_flags": """
select id, id in (select invoice_id from withholding_certificate where state='approved') has_withholding_certificate from account_invoice""",
    "certificates_deletable": "select id, invoice_id, state from withholding_certificate where state<>'approved'",
    "fiscal_eligibility": "select * from eligibility",
    "payment_class_totals": "select * from pay_classes",
    "invoice_discount_total": "select * from discounts",
    "refund_links": """
select invoice_id, parent_invoice_id, parent_invoice_filename_assigned, parent_invoice_fiscal_printer_serial, parent_invoice_fiscal_invoice_number,
 refund_type, refund_note, refund_date, case when create_date is not null then refund_time_text end refund_time from links""",
    "fiscal_documents": _new_documents("discount_total"),
    "fiscal_documents_invoice_discount": _new_documents("cast(amount_discount as decimal(28,6))"),
    "fiscal_filenames": "select id, number, filename_serial, master_filename_assigned, lines_filename_assigned from named",
    "print_queue_by_user": NOT_PRINTED,
    "print_queue_by_user_invoices": NOT_PRINTED + " and documents_type_printed='account_invoice'",
    "documents_deletable": """
select id, print_status, case when documents_type_printed='account_invoice' then invoice_id end unlinked_invoice_id
from document_core where print_status<>'in_progress'""",
    "document_links_after_delete": """
select i.id, case when d.print_status='failed' and d.documents_type_printed='account_invoice' then null else d.id end fiscal_document_id
from account_invoice i left join document_core d on d.invoice_id=i.id""",
    "printers_deletable": """
select id, serial, employee_id from fiscal_printer where id not in (select printer_id from document_core where printer_id is not null)""",
    "ruc_normalized": "select id, ruc, replace(replace(ruc,'-',''),' ','') ruc_normalized from res_partner",
    "ruc_duplicates": """
select id, ruc, ruc_normalized, holders from (select id, ruc, replace(replace(ruc,'-',''),' ','') ruc_normalized,
 count(*) over (partition by replace(replace(ruc,'-',''),' ','')) holders from res_partner where replace(replace(ruc,'-',''),' ','')<>'') q where holders>1""",
    "email_invalid": r"""
select id, email, 'invalid_format' reason from res_partner where email<>'' and not
 regexp_matches(email,'^[_a-z0-9-]+(\.[_a-z0-9-]+)*@[a-z0-9-]+(\.[a-z0-9-]+)*(\.[a-z]{2,4})$')""",
    "partner_missing_fields": f"""
select * from (select 'partner' entity, p.id, {_missing(PARTNER_TESTS)} missing_fields from res_partner p
union all select 'company', c.id, {_missing(COMPANY_TESTS)} from res_company c left join res_partner p on p.id=c.partner_id) q where missing_fields<>''""",
    "partner_age": f"""
select id, birth_date, case when full_years>0 then concat(cast(full_years as varchar),' año(s) de edad') else '0' end age
from (select id, birth_date, y - case when birth_date + to_years(cast(y as int)) > {AGE_DAY} then 1 else 0 end full_years
 from (select id, birth_date, year({AGE_DAY})-year(birth_date) y from res_partner) a) b""",
    "sector_full_name": """
select s.id, concat(coalesce(p.name,''),' / ',coalesce(d.name,''),' / ',coalesce(s.name,'')) full_name
from sector s left join province p on p.id=s.province_id left join district d on d.id=s.district_id""",
    "address_children": _children("district", "province", "province_id", "p.country_id"),
    "address_children_provinces": _children("province", "res_country", "country_id", "p.id"),
    "address_children_sectors": _children("sector", "district", "district_id", "p.country_id", " and p.id=12"),
    "address_mismatches": """
select 'district' as level, c.id, p.id parent_id, c.country_id, p.country_id parent_country_id from district c join province p on p.id=c.province_id where c.country_id<>p.country_id
union all select 'sector', c.id, p.id, c.country_id, p.country_id from sector c join district p on p.id=c.district_id where c.country_id<>p.country_id""",
    "default_country": "select min(id) id from res_country where code='PA' having count(*)>0",
    "zone_conflicts": """
select r.sector_id, s.name, count(distinct r.zone_id) zones from delivery_zone_sector r join sector s on s.id=r.sector_id group by 1,2 having count(distinct r.zone_id)>1""",
    "order_delivery_notes": _with_notes("sale_order", "concat(coalesce(r.note,''),coalesce(f.info,'')) note"),
    "invoice_delivery_notes": _with_notes(
        "account_invoice", "case when f.info is null or contains(coalesce(r.comment,''),f.info) then coalesce(r.comment,'') "
        "else concat(f.info,chr(10),coalesce(r.comment,'')) end as comment"),
    "invoice_warranty_notes": """
select i.id, case when w.text is null or contains(coalesce(i.comment,''),w.text) then i.comment else concat(coalesce(i.comment,''),chr(10),w.text) end as comment
from account_invoice i left join (select invoice_id, string_agg(support_warranty_info,chr(10) order by support_warranty_info) as text
 from (select distinct l.invoice_id, b.id, b.support_warranty_info from account_invoice_line l join product_product p on p.id=l.product_id
  join product_template t on t.id=p.product_tmpl_id join product_brand b on b.id=t.product_brand_id where length(b.support_warranty_info)>0) q group by 1) w
on w.invoice_id=i.id""",
    "stock_available": "select id, label from quant_labels",
    "stock_search": _search("wh a"),
    "stock_search_limit": _search("wh a", "order by id limit 100"),
    "stock_search_location": _search("loc/"),
    "product_quants": """
select id, product_id, location_id, company_id, quantity, reserved_quantity from stock_quant where company_id is not null and quantity>0 and product_id is not null""",
    "product_quants_of_product": """
select id, product_id, location_id, company_id, quantity, reserved_quantity from stock_quant where company_id is not null and quantity>0 and product_id=42""",
    "supplier_accounts": """
select id, name, company_id from account_account where internal_type='other' and deprecated is distinct from true and company_id in (select id from res_company)""",
    "find_by_ruc": "select id, name, id partner_id, ruc partner_ruc from res_partner where ruc ilike '%8-12%'",
    "find_by_ruc_indexed": BY_RUC.format(label="name", table="sale_order"),
    "stock_search_indexed": _search("wh a"),
    "find_by_ruc_orders": BY_RUC.format(label="name", table="sale_order"),
    "find_by_ruc_invoices": BY_RUC.format(label="number", table="account_invoice"),
    "company_tax_ids": "select c.id, p.ruc, p.dv from res_company c left join res_partner p on p.id=c.partner_id",
    "declaration_violations": """
select 'res_partner' table_name, 'dv' column_name, id, dv as value, 'too_long' reason from res_partner where length(dv)>2
union all select 'res_partner', 'ruc', id, ruc, 'too_long' from res_partner where length(ruc)>20
union all select 'res_partner', 'partner_nationality', id, partner_nationality, 'not_allowed' from res_partner where partner_nationality not in ('local','extranjero')
union all select 'res_partner', 'partner_type', id, partner_type, 'not_allowed' from res_partner where partner_type not in ('natural','juridica','extranjero')
union all select 'sale_order', 'state', id, state, 'not_allowed' from sale_order where state not in ('draft','approved','pending','sent','sale','done','cancel')""",
    "declaration_violations_stored": """
select 'res_partner' table_name, 'dv' column_name, id, dv as value, 'too_long' reason from res_partner where length(dv)>2
union all select 'res_partner', 'ruc', id, ruc, 'too_long' from res_partner where length(ruc)>20
union all select 'res_partner', 'partner_nationality', id, partner_nationality, 'not_allowed' from res_partner where partner_nationality not in ('local','extranjero')
union all select 'res_partner', 'partner_type', id, partner_type, 'not_allowed' from res_partner where partner_type not in ('natural','juridica','extranjero')
union all select 'sale_order', 'state', id, state, 'not_allowed' from sale_order where state not in ('draft','approved','pending','sent','sale','done','cancel')
union all select 'res_partner', 'sex', id, 'F', 'not_allowed' from res_partner where id%7=1
union all select 'account_invoice', 'credit_note_state', id, 'rejected', 'not_allowed' from account_invoice where id%9=1
union all select 'account_invoice', 'print_status', id, 'printed', 'not_allowed' from account_invoice where id%11=1""",
    "credit_note_open_conflicts": """
select invoice_id, count(*) open_requests from credit_note_request where state in ('pending','approved') group by 1 having count(*)>1""",
    "credit_note_current": """
select invoice_id, id current_id, state current_state, reason current_reason, requested_on current_requested_on
from (select *, row_number() over (partition by invoice_id order by id desc) rn from credit_note_request) q where rn=1""",
    "credit_note_effects": """
select r.id, r.invoice_id,
 case when n.id is not null then 'rejected' when a.approved_on is not null then 'approved' when r.action='reject' then 'rejected' else 'pending' end state,
 q.reason, coalesce(n.reject_reason, r.reject_reason) reject_reason, q.happened_on requested_on, a.approved_on,
 coalesce(n.happened_on, case when r.action='reject' then r.happened_on end) rejected_on
from (select * from log_rows where action in ('request','reject')) r
left join (select * from log_rows where action='reject') n on n.invoice_id=r.invoice_id and n.record_no=r.record_no+1
left join (select invoice_id, record_no, arg_max(happened_on,id) approved_on from log_rows where action='approve' group by 1,2) a
 on a.invoice_id=r.invoice_id and a.record_no=r.record_no
left join (select * from log_rows where action='request') q on q.invoice_id=r.invoice_id and q.request_no=r.request_no""",
    "credit_note_effects_of_attempts": """
select r.id, r.invoice_id,
 case when n.id is not null then 'rejected' when a.approved_on is not null then 'approved' when r.action='reject' then 'rejected' else 'pending' end state,
 q.reason, coalesce(n.reject_reason, r.reject_reason) reject_reason, q.happened_on requested_on, a.approved_on,
 coalesce(n.happened_on, case when r.action='reject' then r.happened_on end) rejected_on
from (select * from accepted_rows where action in ('request','reject')) r
left join (select * from accepted_rows where action='reject') n on n.invoice_id is not distinct from r.invoice_id and n.record_no=r.record_no+1
left join (select invoice_id, record_no, arg_max(happened_on,id) approved_on from accepted_rows where action='approve' group by 1,2) a
 on a.invoice_id is not distinct from r.invoice_id and a.record_no=r.record_no
left join (select * from accepted_rows where action='request') q on q.invoice_id is not distinct from r.invoice_id and q.request_no=r.request_no""",
    "credit_note_decisions": """
select id, invoice_id, action, happened_on, reason, reject_reason, refusal is null accepted, refusal from decided""",
    "credit_note_invoice_state": """
select invoice_id, case arg_max(action,id) when 'request' then 'pending' when 'approve' then 'approved' else 'draft' end credit_note_state
from credit_note_log group by 1""",
    "stamp_pickings": STAMPED,
    "stamp_pickings_stream": STAMPED,
    "stamp_streams": """
select p.id, p.origin, case when s.write_date>=timestamp '1992-01-01'+to_days(cast(p.id%2500 as int)) then s.number else p.factura end factura
from stock_picking p left join (select origin, arg_max(number, (write_date, id)) number, max(write_date) write_date
 from account_invoice where state='open' and origin is not null group by 1) s on s.origin=p.origin""",
    "number_rows": "select row_number() over (order by create_date, id) as position, id, create_date from account_invoice",
}

QUERIES |= {
    "commission_lines_stored": STEPS["lines_commission"].replace("from assigned l", "from stored_lines l"),
    "orders_to_cancel_stored": f"""
select o.id from stored_orders o join account_payment_term t on t.id=o.payment_term_id and t.payment_term_type='credit_payment'
where o.state='sale' and o.invoice_status='to invoice' and o.canceled_at={AS_OF} order by o.id""",
    "print_pending_stored": QUERIES["print_pending"].replace("from named where", "from stored_named where"),
    "commission_assign_second_run": """
select s.* exclude (commission_id, commission_percentage, commission_total), coalesce(s.commission_id, a.commission_id) commission_id,
 case when s.commission_id is null then a.commission_percentage else s.commission_percentage end commission_percentage,
 case when s.commission_id is null then a.commission_total else s.commission_total end commission_total
from stored_lines s join assigned a on a.id=s.id""",
    "order_deadlines_second_run": """
select o.* exclude (first_payment_date, canceled_at, notified_at), coalesce(o.first_payment_date, f.first_payment_date) first_payment_date,
 coalesce(o.canceled_at, cast(coalesce(o.first_payment_date, f.first_payment_date)+90 as date)) canceled_at,
 coalesce(o.notified_at, cast(coalesce(o.first_payment_date, f.first_payment_date)+80 as date)) notified_at
from stored_orders o left join first_paid f on f.order_id=o.id""",
    "certificate_numbers_second_run": """
select id, year, sequence, concat('CRET/',cast(year as varchar),'/',lpad(cast(sequence as varchar),cast(greatest(4,length(cast(sequence as varchar))) as int),'0')) number
from (select id, cast(year(create_date) as int) as year, case when number is not null then id%40+1 else
 coalesce(max(case when number is not null then id%40+1 end) over (partition by year(create_date)), 0)
 + row_number() over (partition by year(create_date), number is null order by create_date, id) end sequence from stored_certificates) q""",
}

_TEXTS = {**BINDINGS, **STEPS}


def _needs(text: str) -> list[str]:
    sources = set(re.findall(r"(?:from|join)\s+([a-z_][a-z_0-9]*)", text))
    return [name for name in _TEXTS if name in sources]


def _collect(text: str, found: dict[str, str]) -> None:
    for name in _needs(text):
        if name not in found:
            _collect(_TEXTS[name], found)
            found[name] = _TEXTS[name]


def with_bindings(text: str) -> str:
    found: dict[str, str] = {}
    _collect(text, found)
    ctes = ",\n".join(f"{name} as ({body.strip()})" for name, body in found.items())
    return f"with {ctes}\n{text.strip()}" if ctes else text.strip()


def build_oracle() -> dict[str, str]:
    return {name: with_bindings(text) for name, text in QUERIES.items()}
