"""The business tables as SELECTs over the star schema, in DuckDB's SQL."""

BINDINGS = {
    "res_country": """
select r_regionkey+1 id, r_name as name, case when r_regionkey=0 then 'PA' else upper(substr(r_name,1,2)) end code from region""",
    "province": "select n_nationkey+1 id, n_name as name, n_regionkey+1 country_id from nation",
    "district": """
select n_nationkey*10+k id, concat('D',cast(k as varchar),'-',n_name) as name, n_nationkey+1 province_id,
 case when n_nationkey%7=3 and k=2 then (n_regionkey+1)%5+1 else n_regionkey+1 end country_id
from nation cross join (values (1),(2)) t(k)""",
    "sector": """
select d.id*10+k id, concat('S',cast(k as varchar)) as name, case when d.id%11=0 then null else d.province_id end province_id,
 d.id district_id, d.country_id from district d cross join (values (1),(2),(3)) t(k)""",
    "delivery_zone": """
select id, concat('Ruta ',cast(id as varchar)) as name, case when id<>4 then concat('Lunes ',cast(id as varchar),' pm') end description
from (values (1),(2),(3),(4),(5),(6)) t(id)""",
    "delivery_zone_sector": """
select country_id zone_id, id sector_id from sector where id%3<>0 union all select 6, id from sector where id%8=1""",
    "res_partner": """
select c_custkey+1 id, c_name as name, false supplier, c_nationkey%2=0 is_company,
 case when c_custkey%10=9 then concat('8 ',cast(c_custkey-1 as varchar),'-1') else concat('8-',cast(c_custkey as varchar),' 1') end ruc,
 case when c_custkey%70=3 then '100' else cast(c_custkey%100 as varchar) end dv, case when c_custkey%14=0 then null else 1 end country_id, c_nationkey+1 province_id,
 c_nationkey*10+1+c_custkey%2 district_id, (c_nationkey*10+1+c_custkey%2)*10+1+c_custkey%3 sector_id,
 case when c_custkey%5=0 then null else concat('Calle ',cast(c_custkey%50 as varchar)) end street,
 case when c_custkey%4=0 then '0801' end zip, case when c_custkey%15=0 then null else 'frente al parque' end reference,
 cast(c_custkey%200 as varchar) home_number,
 case when c_custkey%9=0 then concat('User',cast(c_custkey as varchar),'@x.com') when c_custkey%9=1 then null else concat('u',cast(c_custkey as varchar),'@mail.example.com') end email,
 case when c_custkey%8=0 then null else concat('2',cast(c_custkey as varchar)) end phone,
 case when c_custkey%6=0 then '' else concat('6',cast(c_custkey as varchar)) end mobile,
 case when c_custkey%2=0 then 'natural' end partner_type, case when c_custkey%3=0 then 'local' when c_custkey%50=1 then 'nacional' end partner_nationality,
 case when c_custkey%12=0 then null else date '1940-02-29' + cast((c_custkey*37)%29000 as int) end birth_date
from customer
union all
select 1000001+s_suppkey, s_name, true, case when s_suppkey%3=0 then null else s_suppkey%3=1 end,
 concat('8-',cast(s_suppkey as varchar)), cast(s_suppkey%100 as varchar), null, null, null, null, null, null, null, null, null,
 null, null, case when s_suppkey%4=0 then null else 'juridica' end, case when s_suppkey%2=0 then 'extranjero' end, null
from supplier""",
    "res_store": "select r_regionkey+1 id, concat('Store ',r_name) as name from region",
    "res_users": """
select n_nationkey+1 id, n_nationkey+1 partner_id, concat('u',cast(n_nationkey as varchar)) login, n_regionkey+1 store_id from nation""",
    "res_company": """
select r_regionkey+1 id, concat('Company ',cast(r_regionkey+1 as varchar)) as name, r_regionkey+1 partner_id from region where r_regionkey<2""",
    "product_category": """
select distinct 1 id, 'All' as name, cast(null as int) parent_id from part
union all select distinct case substr(p_type,1,1) when 'E' then 2 when 'L' then 3 when 'M' then 4 when 'P' then 5 else case when p_type like 'SM%' then 6 else 7 end end, p_type, 1 from part
union all select distinct (case substr(p_type,1,1) when 'E' then 2 when 'L' then 3 when 'M' then 4 when 'P' then 5 else case when p_type like 'SM%' then 6 else 7 end end)*100+p_size%5,
 concat('leaf',cast((case substr(p_type,1,1) when 'E' then 2 when 'L' then 3 when 'M' then 4 when 'P' then 5 else case when p_type like 'SM%' then 6 else 7 end end)*100+p_size%5 as varchar)), case substr(p_type,1,1) when 'E' then 2 when 'L' then 3 when 'M' then 4 when 'P' then 5 else case when p_type like 'SM%' then 6 else 7 end end from part""",
    "product_template": """
select p_partkey id, p_name as name, concat('P',cast(p_partkey as varchar)) default_code,
 (case substr(p_type,1,1) when 'E' then 2 when 'L' then 3 when 'M' then 4 when 'P' then 5 else case when p_type like 'SM%' then 6 else 7 end end)*100+p_size%5 categ_id,
 cast(substr(p_brand,7) as int) product_brand_id, cast(p_retailprice as decimal(15,2)) list_price from part""",
    "product_product": """
select p_partkey id, p_partkey product_tmpl_id, case when p_size%2=0 then concat('V',cast(p_partkey as varchar)) end default_code from part""",
    "product_brand": """
select distinct cast(substr(p_brand,7) as int) id, p_brand as name,
 case when cast(substr(p_brand,7) as int)%5=0 then '' when cast(substr(p_brand,7) as int)%7=0 then null else concat('Garantia ',p_brand) end support_warranty_info from part""",
    "stock_location": "select r_regionkey+11 id, concat('LOC/',r_name,'/Stock') as name from region",
    "stock_warehouse": """
select r_regionkey+1 id, concat('WH ',r_name) as name, r_regionkey+11 lot_stock_id, r_regionkey+1 store_id from region""",
    "stock_quant": """
select p_partkey*5+r id, p_partkey product_id, r+11 location_id, case when (p_partkey+r)%11=0 then null else r%2+1 end company_id,
 cast(cast((p_partkey*7+r)%50 as decimal(15,2))+cast(0.5 as decimal(2,1))*(p_partkey%2) as decimal(15,2)) quantity,
 cast((p_partkey+r)%4 as decimal(15,2)) reserved_quantity from part cross join (values (0),(1),(2),(3),(4)) t(r)""",
    "stock_picking": """
select o_orderkey id, case when o_orderkey%50=0 then null else concat('SO',cast(o_orderkey as varchar)) end origin,
 cast(null as varchar) factura from orders where o_orderkey%4<>3""",
    "account_payment_term": """
select * from (values (1,'1-URGENT','cash_payment'),(2,'2-HIGH','cash_payment'),(3,'3-MEDIUM','credit_payment'),
 (4,'4-NOT SPECIFIED','credit_payment'),(5,'5-LOW','credit_payment')) t(id,name,payment_term_type)""",
    "commission_rule": """
select (c.id*10+t)*10+k id, cast((c.id*13+t*7+k)%21*0.25 as decimal(5,2)) percentage, c.id category_id, t payment_term_id
from product_category c cross join (values (1),(2),(3),(4),(5)) a(t) cross join (values (1),(2)) b(k)
where (c.id=1 and t in (1,3) or c.id between 2 and 99 and (c.id*7+t)%3=0 or c.id>99 and (c.id+t)%5=0) and (k=1 or (c.id+t)%4=0)""",
    "account_journal": """
select * from (values (1,'CSH1','Efectivo','cash',true,0.0000),(2,'BNK1','Banco','bank',false,0.0150),(3,'TC-V','Visa','bank',false,0.0325),
 (4,'TD-C','Clave','bank',false,0.0200),(5,'MISC','Varios','general',false,null),(6,'CSH12','Caja 2','cash',false,0.0000)) t(id,code,name,type,at_least_one_outbound,x_porcentaje_comision)""",
    "account_tax": """
select id, concat('ITBMS ',cast(id as varchar)) description, case when id=8 then cast(-8 as decimal(6,2)) else cast(id as decimal(6,2)) end amount,
 id=8 is_withholding_tax from (values (0),(1),(2),(3),(4),(5),(6),(7),(8)) t(id)""",
    "partner_concept": """
select * from (values (1,'001','Concepto A',1),(2,'12','Concepto B',2),(3,'7','Concepto C',1),(4,'1234','Concepto D',2),(5,'A9','Concepto E',null)) t(id,code,name,type)""",
    "account_account": """
select id, concat('acct',cast(id as varchar)) as name, case when id%3=0 then null else id%5+1 end partner_concept_id,
 case when id%13=0 then 3 else cast(id%2+1 as int) end company_id, case when id%4=0 then 'payable' else 'other' end internal_type, case when id%5<>1 then id%7=0 end deprecated
from (select distinct p_partkey%40+1 id from part) x""",
    "fiscal_printer": """
select n_nationkey+1 id, concat('SER',cast(n_nationkey as varchar)) serial, n_nationkey+1 employee_id, n_nationkey%2=0 merge_invoices_orders
from nation where n_nationkey%6<>5""",
    "numbered_lineitem": """
select *, l_orderkey*1000+row_number() over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_quantity,l_discount,l_tax,l_shipdate,l_returnflag,l_linestatus) line_id from lineitem""",
    "account_invoice_line": """
select *, cast(price_subtotal+round(price_subtotal*(case when tax_id=8 then -8 else tax_id end)*0.01,2) as decimal(15,2)) price_total
from (select line_id id, l_orderkey invoice_id, concat('Item',chr(10),cast(l_partkey as varchar)) as name, l_partkey product_id,
 l_partkey%40+1 account_id, l_orderkey%2+1 company_id, cast(l_quantity as decimal(15,2)) quantity, cast(l_extendedprice as decimal(15,2)) price_unit,
 cast(l_discount*100 as decimal(6,2)) discount,
 cast(round(cast(l_extendedprice as decimal(15,2))*(1-cast(l_discount as decimal(6,4))),2) as decimal(15,2)) price_subtotal,
 cast(round(l_tax*100) as int) tax_id from numbered_lineitem) b""",
    "account_invoice_line_tax": """
select id invoice_line_id, tax_id from account_invoice_line where tax_id>0
union all select id, (tax_id+3)%8 from account_invoice_line where invoice_id%7=0 and tax_id>0""",
    "account_invoice_tax": """
select invoice_id, tax_id, cast(case when tax_id=8 then -1 else 1 end * sum(round(price_subtotal*tax_id*0.01,2)) as decimal(15,2)) amount
from account_invoice_line where tax_id>0 group by invoice_id,tax_id""",
    "invoice_header": """
select o_orderkey id,
 case when o_orderkey%10<5 then 'out_invoice' when o_orderkey%10<9 then 'in_invoice' else 'out_refund' end as type,
 case o_orderstatus when 'F' then 'paid' when 'O' then 'open' else 'draft' end state,
 case when o_orderkey%10 between 5 and 8 then 1000001+o_custkey%(select count(*) from supplier) else o_custkey+1 end partner_id,
 o_custkey%25+1 user_id, o_custkey%23+1 write_uid, o_orderkey%2+1 company_id,
 case when o_orderkey%17=0 then null else cast(substr(o_orderpriority,1,1) as int) end payment_term_id,
 concat(case when o_orderkey%10=9 then 'NC/' else 'FAC/' end, cast(year(o_orderdate) as varchar),'/',lpad(cast(o_orderkey as varchar),cast(greatest(6,length(cast(o_orderkey as varchar))) as int),'0')) number,
 cast(o_orderdate as date) date_invoice, o_orderdate create_date, o_orderdate + to_days(cast(o_orderkey%30 as int)) write_date,
 cast(o_totalprice as decimal(15,2)) amount_total, concat('SO',cast(o_orderkey as varchar)) origin,
 case when o_orderkey%10=9 then o_orderkey-9 end refund_invoice_id, concat('ref',cast(o_orderkey as varchar)) as name,
 case when o_orderkey%3=0 then 'nota' end as comment from orders""",
    "account_invoice": """
select h.*, cast(coalesce(l.untaxed,0) as decimal(15,2)) amount_untaxed, cast(coalesce(x.tax,0) as decimal(15,2)) amount_tax,
 cast(coalesce(l.discount,0) as decimal(15,2)) amount_discount
from invoice_header h
left join (select invoice_id, sum(price_subtotal) untaxed, sum(price_unit-price_subtotal) discount from account_invoice_line group by 1) l on l.invoice_id=h.id
left join (select invoice_id, sum(amount) tax from account_invoice_tax group by 1) x on x.invoice_id=h.id""",
    "account_invoice_refund": """
select id, name description, case when id%4=1 then 'refund' else 'cancel' end filter_refund, date_invoice,
 create_date + to_hours(cast(id%24 as int)) + to_minutes(cast(id%60 as int)) create_date from invoice_header where type='out_refund' and id%3<>0""",
    "account_invoice_payment_rel": """
select cast(sale_order_id as bigint) invoice_id, id payment_id from account_payment where sale_order_id is not null""",
    "document_core": """
select id, id invoice_id, case when id%8=7 then null else write_uid end printer_id, write_uid,
 case id%4 when 0 then 'pending' when 1 then 'in_progress' when 2 then 'completed' else 'failed' end print_status,
 case when id%4=2 then id else 0 end fiscal_invoice_number,
 case when id%9=0 then 'pos_order' else 'account_invoice' end documents_type_printed, create_date, number, type invoice_type
from invoice_header where type<>'in_invoice' and payment_term_id is distinct from 5""",
    "account_move": """
select o_orderkey id, concat('MV/',cast(o_orderkey as varchar)) as name,
 case when o_orderkey%19=0 then concat('Reversión Inversa ',cast(o_orderkey as varchar)) when o_orderkey%5=0 then null else concat('r',cast(o_orderkey as varchar)) end ref,
 case when o_orderkey%31=0 then cast(0 as decimal(15,2)) else cast(o_totalprice as decimal(15,2)) end amount,
 cast(o_orderdate as date) as date, o_custkey%5+1 store_id, o_custkey+1 partner_id, o_custkey%6+1 journal_id from orders where o_orderstatus<>'P'""",
    "account_payment": """
select o_orderkey*10+k id, concat('MV/',cast(o_orderkey as varchar)) move_name, case when o_orderkey%4=0 then null else concat('SO',cast(o_orderkey as varchar)) end communication,
 case when o_orderkey%13=0 then 'outbound' else 'inbound' end payment_type, o_custkey%5+1 store_id, cast(o_totalprice as decimal(15,2)) amount,
 o_custkey%6+1 journal_id, case when o_orderkey%3<>0 then o_orderkey end sale_order_id, cast(o_orderdate as date)+k*10 payment_date
from orders cross join (values (1),(2)) t(k) where o_orderstatus<>'P' and o_orderkey%6<>0 and (k=1 or o_orderkey%29=0)""",
    "sale_order": """
select o_orderkey id, concat('SO',cast(o_orderkey as varchar)) as name, o_custkey+1 partner_id, cast(substr(o_orderpriority,1,1) as int) payment_term_id,
 case o_orderstatus when 'P' then 'draft' else 'sale' end state, case when o_orderkey%5=0 then 'invoiced' else 'to invoice' end invoice_status,
 case when o_orderkey%2=0 then 'nota' end note from orders""",
    "sale_order_line": """
select line_id id, l_orderkey order_id, l_partkey product_id, cast(l_quantity as decimal(15,2)) product_uom_qty,
 cast(cast(p_retailprice as decimal(15,2))+(l_linenumber-2)*5 as decimal(15,2)) price_unit, cast(l_discount*100 as decimal(6,2)) discount,
 cast(round(l_tax*100) as int) tax_id from numbered_lineitem join part on p_partkey=l_partkey""",
    "cash_report_request": """
select line_id id, o_custkey%5+1 store_id, cast(o_orderdate as date) start_on, cast(l_shipdate as date) end_on
from numbered_lineitem join orders on o_orderkey=l_orderkey""",
    "credit_note_request": """
select o_orderkey*10+k id, o_orderkey invoice_id,
 case when k=1 then case when o_orderkey%120=0 then 'rejected' else 'pending' end else case when o_orderkey%180=0 then 'approved' else 'rejected' end end state,
 case when o_orderkey%100=0 then null else concat('motivo ',cast(k as varchar)) end reason, o_orderdate+to_days(k) requested_on
from orders cross join (values (1),(2)) t(k) where o_orderkey%20=0 and (k=1 or o_orderkey%3=0)""",
    "credit_note_log": """
select id, invoice_id, action, happened_on, case when action='request' then concat('motivo ',cast(id as varchar)) end reason,
 case when action='reject' then concat('rechazo ',cast(id as varchar)) end reject_reason
from (select o_orderkey*10+k id, o_orderkey invoice_id,
  case when k=1 then 'request' when k=2 then case when o_orderkey%2=0 then 'approve' else 'reject' end when k=3 then 'reject'
   when k=4 then case when o_orderkey%4<2 then 'request' else 'reject' end else 'approve' end as action,
  o_orderdate+to_days(k) happened_on
 from orders cross join (values (1),(2),(3),(4),(5)) t(k) where k<=o_orderkey%5+1) b""",
    "credit_note_attempt": """
select id, invoice_id, action, happened_on, case when action='request' then concat('motivo ',cast(id as varchar)) end reason,
 case when action='reject' then concat('rechazo ',cast(id as varchar)) end reject_reason
from (select o_orderkey*10+k id, case when o_orderkey%3=0 then 3 when o_orderkey%101=0 then null else o_orderkey end invoice_id,
  case (o_orderkey//3+k*k*(o_orderkey%7+1))%5 when 2 then 'approve' when 3 then 'reject' else 'request' end as action, o_orderdate+to_days(k) happened_on
 from orders cross join (values (1),(2),(3),(4),(5),(6)) t(k)) b""",
    "sale_order_log": """
select o_orderkey*10+k id, o_orderkey order_id, o_orderdate+to_days(case k when 1 then 0 when 2 then cast(o_orderkey%25 as int) else 40 end) changed_on,
 case k when 1 then 'draft' else 'sale' end state, case k when 1 then 'no' when 2 then 'to invoice' else 'invoiced' end invoice_status,
 case when k=2 and o_orderkey%11=0 then 2 else cast(substr(o_orderpriority,1,1) as int) end payment_term_id
from orders cross join (values (1),(2),(3)) t(k) where k=1 or (k=2 and o_orderkey%7<>0) or (k=3 and o_orderkey%5=0)""",
    "withholding_certificate": """
select i.id, i.id invoice_id, t.tax_id account_tax_id, i.date_invoice+15 certificated_on, i.create_date,
 case when i.id%4=0 then 'draft' else 'approved' end state, i.id%2+1 company_id, case when i.id%5=0 then 'Contabilidad' end comments
from invoice_header i join account_invoice_tax t on t.invoice_id=i.id and t.tax_id=8 where i.type='in_invoice' and i.id%3=0""",
}
