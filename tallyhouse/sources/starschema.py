"""The business tables derived from an order/lineitem star schema.

Test and benchmark input: the same columns an ERP database would deliver, computed
from `region nation customer supplier part orders lineitem`. Tables are built on
first use. Those an ERP stores but that need a shuffle to derive here (line ids,
invoice totals, invoice taxes, printed documents) are written once per session to
the shared folder and read from there. So are small tables taken from a large one,
whose size the optimizer could not tell otherwise.
"""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhouse.operators import fiscal
from tallyhouse.schemas import DDL, schema_of
from tallyhouse.session import stage, widen
from tallyhouse.sources.tables import conform

# Large tables are written once and read often.
TABLE_CODEC = "zstd"
# Columns of an invoice that are sums of its lines.
INVOICE_SUMS = ("amount_untaxed", "amount_tax", "amount_discount")

_BUILDERS: dict[str, Callable[[StarTables], DataFrame]] = {}
_OPEN: dict[tuple[str, str], StarTables] = {}


def _table(build: Callable[[StarTables], DataFrame]) -> Callable[[StarTables], DataFrame]:
    _BUILDERS[build.__name__.lstrip("_")] = build
    return build


def star_tables(spark: SparkSession, directory: str) -> StarTables:
    """The tables over `directory`, shared by all callers in one application."""
    key = (spark.sparkContext.applicationId, directory)
    if key not in _OPEN:
        _OPEN[key] = tables = StarTables(spark, directory)
        widen(spark, tables.raw("lineitem").count())
    return _OPEN[key]


class StarTables(Mapping[str, DataFrame]):
    def __init__(self, spark: SparkSession, directory: str) -> None:
        self.spark = spark
        self.directory = directory
        self._built: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            df = _BUILDERS[name](self)
            if name in DDL:
                schema = schema_of(name)
                df = conform(df, schema, optional=schema.names).select(*schema.names)
            self._built[name] = df
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(DDL)

    def __len__(self) -> int:
        return len(DDL)

    def fixed(self, columns: str, rows: str) -> DataFrame:
        """A configuration table of a few fixed rows."""
        return self.spark.sql(f"select * from values {rows} as t({columns})")


# --- places -----------------------------------------------------------------

@_table
def res_country(t: StarTables) -> DataFrame:
    return t.raw("region").selectExpr(
        "r_regionkey+1 id", "r_name name",
        "case when r_regionkey=0 then 'PA' else upper(substr(r_name,1,2)) end code")


@_table
def province(t: StarTables) -> DataFrame:
    return t.raw("nation").selectExpr("n_nationkey+1 id", "n_name name", "n_regionkey+1 country_id")


@_table
def district(t: StarTables) -> DataFrame:
    return t.raw("nation").selectExpr("*", "explode(array(1,2)) k").selectExpr(
        "n_nationkey*10+k id", "concat('D',cast(k as string),'-',n_name) name", "n_nationkey+1 province_id",
        "case when n_nationkey%7=3 and k=2 then (n_regionkey+1)%5+1 else n_regionkey+1 end country_id")


@_table
def sector(t: StarTables) -> DataFrame:
    return t["district"].selectExpr("*", "explode(array(1,2,3)) k").selectExpr(
        "id*10+k id", "concat('S',cast(k as string)) name",
        "case when id%11=0 then null else province_id end province_id", "id district_id", "country_id")


@_table
def delivery_zone(t: StarTables) -> DataFrame:
    return t.spark.range(1, 7).selectExpr(
        "id", "concat('Ruta ',cast(id as string)) name", "case when id<>4 then concat('Lunes ',cast(id as string),' pm') end description")


@_table
def delivery_zone_sector(t: StarTables) -> DataFrame:
    sectors = t["sector"]
    return sectors.filter("id%3<>0").selectExpr("country_id zone_id", "id sector_id").union(
        sectors.filter("id%8=1").selectExpr("6 zone_id", "id sector_id"))


# --- people and companies ---------------------------------------------------

@_table
def res_partner(t: StarTables) -> DataFrame:
    customers = t.raw("customer").selectExpr(
        "c_custkey+1 id", "c_name name", "false supplier", "c_nationkey%2=0 is_company",
        "case when c_custkey%10=9 then concat('8 ',cast(c_custkey-1 as string),'-1') "
        "else concat('8-',cast(c_custkey as string),' 1') end ruc",
        "case when c_custkey%70=3 then '100' else cast(c_custkey%100 as string) end dv",
        "case when c_custkey%14=0 then null else 1 end country_id",
        "c_nationkey+1 province_id", "c_nationkey*10+1+c_custkey%2 district_id",
        "(c_nationkey*10+1+c_custkey%2)*10+1+c_custkey%3 sector_id",
        "case when c_custkey%5=0 then null else concat('Calle ',cast(c_custkey%50 as string)) end street",
        "case when c_custkey%4=0 then '0801' end zip",
        "case when c_custkey%15=0 then null else 'frente al parque' end reference",
        "cast(c_custkey%200 as string) home_number",
        "case when c_custkey%9=0 then concat('User',cast(c_custkey as string),'@x.com') "
        "when c_custkey%9=1 then null else concat('u',cast(c_custkey as string),'@mail.example.com') end email",
        "case when c_custkey%8=0 then null else concat('2',cast(c_custkey as string)) end phone",
        "case when c_custkey%6=0 then '' else concat('6',cast(c_custkey as string)) end mobile",
        "case when c_custkey%2=0 then 'natural' end partner_type",
        "case when c_custkey%3=0 then 'local' when c_custkey%50=1 then 'nacional' end partner_nationality",
        "case when c_custkey%12=0 then null "
        "else date'1940-02-29' + cast((c_custkey*37)%29000 as int) end birth_date")
    suppliers = t.raw("supplier").selectExpr(
        "1000001+s_suppkey id", "s_name name", "true supplier",
        "case when s_suppkey%3=0 then null else s_suppkey%3=1 end is_company",
        "concat('8-',cast(s_suppkey as string)) ruc", "cast(s_suppkey%100 as string) dv",
        "case when s_suppkey%4=0 then null else 'juridica' end partner_type",
        "case when s_suppkey%2=0 then 'extranjero' end partner_nationality")
    return customers.unionByName(suppliers, allowMissingColumns=True)


@_table
def res_store(t: StarTables) -> DataFrame:
    return t.raw("region").selectExpr("r_regionkey+1 id", "concat('Store ',r_name) name")


@_table
def res_users(t: StarTables) -> DataFrame:
    return t.raw("nation").selectExpr(
        "n_nationkey+1 id", "n_nationkey+1 partner_id", "concat('u',cast(n_nationkey as string)) login",
        "n_regionkey+1 store_id")


@_table
def res_company(t: StarTables) -> DataFrame:
    return t.raw("region").filter("r_regionkey<2").selectExpr(
        "r_regionkey+1 id", "concat('Company ',cast(r_regionkey+1 as string)) name", "r_regionkey+1 partner_id")


# --- products and stock -----------------------------------------------------

# A part's type as a category; its size picks a category below that.
TYPE_CATEGORY = ("(case substr(p_type,1,1) when 'E' then 2 when 'L' then 3 when 'M' then 4 when 'P' then 5 "
                 "else case when p_type like 'SM%' then 6 else 7 end end)")


@_table
def product_category(t: StarTables) -> DataFrame:
    kinds = t.raw("part").selectExpr(f"{TYPE_CATEGORY} c", "p_type", "p_size%5 b").distinct()
    levels = kinds.selectExpr(
        "inline(array(named_struct('id',1,'name','All','parent_id',cast(null as int)),"
        "named_struct('id',c,'name',p_type,'parent_id',1),"
        "named_struct('id',c*100+b,'name',concat('leaf',cast(c*100+b as string)),'parent_id',c)))")
    return stage(levels.distinct(), "category")


@_table
def product_template(t: StarTables) -> DataFrame:
    return t.raw("part").selectExpr(
        "p_partkey id", "p_name name", "concat('P',cast(p_partkey as string)) default_code",
        f"{TYPE_CATEGORY}*100+p_size%5 categ_id",
        "cast(substr(p_brand,7) as int) product_brand_id", "cast(p_retailprice as decimal(15,2)) list_price")


@_table
def product_product(t: StarTables) -> DataFrame:
    return t.raw("part").selectExpr(
        "p_partkey id", "p_partkey product_tmpl_id",
        "case when p_size%2=0 then concat('V',cast(p_partkey as string)) end default_code")


@_table
def product_brand(t: StarTables) -> DataFrame:
    return stage(t.raw("part").select("p_brand").distinct().selectExpr(
        "cast(substr(p_brand,7) as int) id", "p_brand name",
        "case when cast(substr(p_brand,7) as int)%5=0 then '' when cast(substr(p_brand,7) as int)%7=0 then null "
        "else concat('Garantia ',p_brand) end support_warranty_info"), "brand")


@_table
def stock_location(t: StarTables) -> DataFrame:
    return t.raw("region").selectExpr("r_regionkey+11 id", "concat('LOC/',r_name,'/Stock') name")


@_table
def stock_warehouse(t: StarTables) -> DataFrame:
    return t.raw("region").selectExpr(
        "r_regionkey+1 id", "concat('WH ',r_name) name", "r_regionkey+11 lot_stock_id", "r_regionkey+1 store_id")


@_table
def stock_quant(t: StarTables) -> DataFrame:
    return t.raw("part").selectExpr("p_partkey", "explode(array(0,1,2,3,4)) r").selectExpr(
        "p_partkey*5+r id", "p_partkey product_id", "r+11 location_id",
        "case when (p_partkey+r)%11=0 then null else r%2+1 end company_id",
        "cast((p_partkey*7+r)%50 as decimal(15,2))+cast(0.5 as decimal(2,1))*(p_partkey%2) quantity",
        "cast((p_partkey+r)%4 as decimal(15,2)) reserved_quantity")


@_table
def stock_picking(t: StarTables) -> DataFrame:
    return t.raw("orders").filter("o_orderkey%4<>3").selectExpr(
        "o_orderkey id", "case when o_orderkey%50=0 then null else concat('SO',cast(o_orderkey as string)) end origin",
        "cast(null as string) factura")


# --- configuration ----------------------------------------------------------

@_table
def account_payment_term(t: StarTables) -> DataFrame:
    return t.fixed("id, name, payment_term_type",
                   "(1,'1-URGENT','cash_payment'),(2,'2-HIGH','cash_payment'),(3,'3-MEDIUM','credit_payment'),"
                   "(4,'4-NOT SPECIFIED','credit_payment'),(5,'5-LOW','credit_payment')")


@_table
def commission_rule(t: StarTables) -> DataFrame:
    """Rules on all levels of the category tree; some repeated, some of 0 percent."""
    return t["product_category"].selectExpr("id category_id", "explode(array(1,2,3,4,5)) payment_term_id").filter(
        "category_id=1 and payment_term_id in (1,3) or category_id between 2 and 99 and (category_id*7+payment_term_id)%3=0 "
        "or category_id>99 and (category_id+payment_term_id)%5=0").selectExpr(
        "*", "explode(case when (category_id+payment_term_id)%4=0 then array(1,2) else array(1) end) k").selectExpr(
        "(category_id*10+payment_term_id)*10+k id",
        "cast((category_id*13+payment_term_id*7+k)%21*0.25 as decimal(5,2)) percentage", "category_id", "payment_term_id")


@_table
def account_journal(t: StarTables) -> DataFrame:
    return t.fixed("id, code, name, type, at_least_one_outbound, x_porcentaje_comision",
                   "(1,'CSH1','Efectivo','cash',true,0.0000),(2,'BNK1','Banco','bank',false,0.0150),"
                   "(3,'TC-V','Visa','bank',false,0.0325),(4,'TD-C','Clave','bank',false,0.0200),"
                   "(5,'MISC','Varios','general',false,null),(6,'CSH12','Caja 2','cash',false,0.0000)")


@_table
def account_tax(t: StarTables) -> DataFrame:
    return t.spark.range(0, 9).selectExpr(
        "id", "concat('ITBMS ',cast(id as string)) description", "case when id=8 then -8.00 else id end amount",
        "id=8 is_withholding_tax")


@_table
def partner_concept(t: StarTables) -> DataFrame:
    return t.fixed("id, code, name, type", "(1,'001','Concepto A',1),(2,'12','Concepto B',2),"
                                           "(3,'7','Concepto C',1),(4,'1234','Concepto D',2),(5,'A9','Concepto E',null)")


@_table
def account_account(t: StarTables) -> DataFrame:
    return stage(t.raw("part").selectExpr("p_partkey%40+1 id").distinct().selectExpr(
        "id", "concat('acct',cast(id as string)) name", "case when id%3=0 then null else id%5+1 end partner_concept_id",
        "case when id%13=0 then 3 else id%2+1 end company_id",
        "case when id%4=0 then 'payable' else 'other' end internal_type", "case when id%5<>1 then id%7=0 end deprecated"), "account")


@_table
def fiscal_printer(t: StarTables) -> DataFrame:
    return t.raw("nation").filter("n_nationkey%6<>5").selectExpr(
        "n_nationkey+1 id", "concat('SER',cast(n_nationkey as string)) serial", "n_nationkey+1 employee_id",
        "n_nationkey%2=0 merge_invoices_orders")


# --- invoices ---------------------------------------------------------------

@_table
def numbered_lineitem(t: StarTables) -> DataFrame:
    """lineitem with a line id: its rank over all columns within the order.

    An order's lines meet in one task, once. Lines that are equal on every column are told apart by their rank only, so any order of those will do.
    """
    within = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate", "l_returnflag",
        "l_linestatus")
    ranked = t.raw("lineitem").withColumn("line_id", F.col("l_orderkey") * 1000 + F.row_number().over(within))
    return stage(ranked, "lineitem", TABLE_CODEC)


def _lines(rows: DataFrame, line_id: str) -> DataFrame:
    return rows.selectExpr(
        f"{line_id} id", "l_orderkey invoice_id", "concat('Item',chr(10),cast(l_partkey as string)) name",
        "l_partkey product_id", "l_partkey%40+1 account_id", "l_orderkey%2+1 company_id",
        "cast(l_quantity as decimal(15,2)) quantity", "cast(l_extendedprice as decimal(15,2)) price_unit",
        "cast(l_discount*100 as decimal(6,2)) discount",
        "cast(round(cast(l_extendedprice as decimal(15,2))*(1-cast(l_discount as decimal(6,4))),2) as decimal(15,2)) "
        "price_subtotal",
        "cast(round(l_tax*100) as int) tax_id").selectExpr(
        "*", "price_subtotal+round(price_subtotal*(case when tax_id=8 then -8 else tax_id end)*0.01,2) price_total")


@_table
def account_invoice_line(t: StarTables) -> DataFrame:
    return _lines(t["numbered_lineitem"], "line_id")


@_table
def line_without_id(t: StarTables) -> DataFrame:
    """The invoice lines for sums that do not ask for their ids, so that no line has to be numbered. The id is NULL."""
    schema = schema_of("account_invoice_line")
    return conform(_lines(t.raw("lineitem"), "cast(null as bigint)"), schema).select(*schema.names)


def _totals(t: StarTables) -> DataFrame:
    lines = t["line_without_id"].select("invoice_id", "tax_id", "price_unit", "price_subtotal").repartition("invoice_id")
    return lines.groupBy("invoice_id", "tax_id").agg(
        F.sum("price_subtotal").alias("untaxed"), F.sum(F.expr("price_unit-price_subtotal")).alias("discount"),
        F.sum(F.expr("round(price_subtotal*tax_id*0.01,2)")).alias("total"))


@_table
def line_totals(t: StarTables) -> DataFrame:
    """Sums of the lines of each invoice and tax; the rows of an invoice lie together."""
    return stage(_totals(t), "line_totals", TABLE_CODEC)


@_table
def account_invoice_line_tax(t: StarTables) -> DataFrame:
    lines = t["account_invoice_line"]
    return lines.filter("tax_id>0").selectExpr("id invoice_line_id", "tax_id").union(
        lines.filter("invoice_id%7=0 and tax_id>0").selectExpr("id invoice_line_id", "(tax_id+3)%8 tax_id"))


def _taxes(totals: DataFrame) -> DataFrame:
    return totals.filter("tax_id>0").selectExpr(
        "invoice_id", "tax_id", "cast(case when tax_id=8 then -total else total end as decimal(15,2)) amount")


@_table
def account_invoice_tax(t: StarTables) -> DataFrame:
    return _taxes(t["line_totals"])


@_table
def unwritten_tax(t: StarTables) -> DataFrame:
    """`account_invoice_tax` for plans that end up not reading it: nothing is written for them."""
    return _taxes(_totals(t))


def _headers(t: StarTables, orders: DataFrame, *more: str) -> DataFrame:
    suppliers = t.raw("supplier").groupBy().agg(F.count("*").alias("n")).first().n
    return orders.selectExpr(
        "o_orderkey id",
        "case when o_orderkey%10<5 then 'out_invoice' when o_orderkey%10<9 then 'in_invoice' else 'out_refund' end type",
        "case o_orderstatus when 'F' then 'paid' when 'O' then 'open' else 'draft' end state",
        f"case when o_orderkey%10 between 5 and 8 then 1000001+o_custkey%{suppliers} else o_custkey+1 end partner_id",
        "o_custkey%25+1 user_id", "o_custkey%23+1 write_uid", "o_orderkey%2+1 company_id",
        "case when o_orderkey%17=0 then null else cast(substr(o_orderpriority,1,1) as int) end payment_term_id",
        "concat(case when o_orderkey%10=9 then 'NC/' else 'FAC/' end, cast(year(o_orderdate) as string),'/',"
        "lpad(cast(o_orderkey as string),greatest(6,length(cast(o_orderkey as string))),'0')) number",
        "cast(o_orderdate as date) date_invoice", "o_orderdate create_date",
        "o_orderdate + make_interval(0,0,0,cast(o_orderkey%30 as int)) write_date",
        "cast(o_totalprice as decimal(15,2)) amount_total", "concat('SO',cast(o_orderkey as string)) origin",
        "case when o_orderkey%10=9 then o_orderkey-9 end refund_invoice_id",
        "concat('ref',cast(o_orderkey as string)) name", "case when o_orderkey%3=0 then 'nota' end comment", *more)


@_table
def invoice_header(t: StarTables) -> DataFrame:
    return _headers(t, t.raw("orders"))


@_table
def account_invoice(t: StarTables) -> DataFrame:
    """The headers with sums of their lines. The narrow orders meet the sums before they become headers."""
    held = t["account_invoice_tax"].withColumnRenamed("invoice_id", "_of").select("_of", F.col("amount").alias("_tax"))
    sums = t["line_totals"].selectExpr("invoice_id _of", "untaxed", "discount").unionByName(held, allowMissingColumns=True).groupBy("_of").agg(
        *[F.sum(c).alias(c) for c in ("untaxed", "_tax", "discount")])
    met = t.raw("orders").join(sums, F.col("o_orderkey") == F.col("_of"), "left")
    return stage(_headers(t, met, *[
        f"cast(coalesce({source},0) as decimal(15,2)) {name}"
        for source, name in (("untaxed", "amount_untaxed"), ("_tax", "amount_tax"), ("discount", "amount_discount"))]), "invoice", TABLE_CODEC)


@_table
def account_invoice_refund(t: StarTables) -> DataFrame:
    return t["invoice_header"].filter("type='out_refund' and id%3<>0").selectExpr(
        "id", "name description", "case when id%4=1 then 'refund' else 'cancel' end filter_refund", "date_invoice",
        "create_date + make_interval(0,0,0,0,cast(id%24 as int),cast(id%60 as int)) create_date")


@_table
def account_invoice_payment_rel(t: StarTables) -> DataFrame:
    return t["account_payment"].filter("sale_order_id is not null").selectExpr(
        "sale_order_id invoice_id", "id payment_id")


@_table
def document_core(t: StarTables) -> DataFrame:
    """Printed documents: customer invoices and refunds, but for those on term 5."""
    return t["invoice_header"].filter("type<>'in_invoice' and not (payment_term_id <=> 5)").selectExpr(
        "id", "id invoice_id", "case when id%8=7 then null else write_uid end printer_id", "write_uid",
        "case id%4 when 0 then 'pending' when 1 then 'in_progress' when 2 then 'completed' else 'failed' end print_status",
        "case when id%4=2 then id else 0 end fiscal_invoice_number",
        "case when id%9=0 then 'pos_order' else 'account_invoice' end documents_type_printed", "create_date", "number",
        "type invoice_type")


@_table
def fiscal_document(t: StarTables) -> DataFrame:
    core = t["document_core"]
    # Details are of single invoices, and none of these is a supplier's. No detail asks for a line's id.
    details = fiscal.document_details({
        **_needed(t, tuple(n for n in fiscal.DETAIL_TABLES if n != "account_invoice_line")), "fiscal_document": core,
        "account_invoice": t["account_invoice"].filter("type<>'in_invoice'"), "account_invoice_line": t["line_without_id"]})
    return stage(core.join(details.drop("number", "invoice_type", "tax_count", "user_id"), "invoice_id"), "document", TABLE_CODEC)


@_table
def invoice_without_sums(t: StarTables) -> DataFrame:
    """`account_invoice` without the columns that are sums of lines: the same rows, and no line is read."""
    schema = schema_of("account_invoice")
    return conform(t["invoice_header"], schema, optional=INVOICE_SUMS).select(*[c for c in schema.names if c not in INVOICE_SUMS])


@_table
def document_without_details(t: StarTables) -> DataFrame:
    """`fiscal_document` without what is printed of the invoice: the same rows, of which nothing is summed up or written.

    The rows come from the same joins, so keys that repeat give as many. Sums that no column asks for drop out of the plan.
    """
    core = t["document_core"]
    unsummed = conform(t["invoice_header"].filter("type<>'in_invoice'"), schema_of("account_invoice"), optional=INVOICE_SUMS)
    details = fiscal.document_details({
        **_needed(t, tuple(n for n in fiscal.DETAIL_TABLES if n not in ("account_invoice", "account_invoice_line", "account_invoice_tax"))),
        "fiscal_document": core, "account_invoice": unsummed, "account_invoice_line": t["line_without_id"], "account_invoice_tax": t["unwritten_tax"]})
    schema = schema_of("fiscal_document")
    return conform(core.join(details.select("invoice_id"), "invoice_id"), schema, optional=schema.names).select(
        *[c for c in schema.names if c in core.columns])


def without_sums(t: StarTables) -> Mapping[str, DataFrame]:
    """The tables for operators that ask an invoice or a document for its own columns only."""
    return ChainMap({"account_invoice": t["invoice_without_sums"], "fiscal_document": t["document_without_details"]}, t)


def _needed(t: StarTables, names: tuple[str, ...]) -> dict[str, DataFrame]:
    return {name: t[name] for name in names}


# --- money movements and orders ---------------------------------------------

@_table
def account_move(t: StarTables) -> DataFrame:
    return t.raw("orders").filter("o_orderstatus<>'P'").selectExpr(
        "o_orderkey id", "concat('MV/',cast(o_orderkey as string)) name",
        "case when o_orderkey%19=0 then concat('Reversión Inversa ',cast(o_orderkey as string)) "
        "when o_orderkey%5=0 then null else concat('r',cast(o_orderkey as string)) end ref",
        "case when o_orderkey%31=0 then 0 else cast(o_totalprice as decimal(15,2)) end amount",
        "cast(o_orderdate as date) date", "o_custkey%5+1 store_id", "o_custkey+1 partner_id", "o_custkey%6+1 journal_id")


@_table
def account_payment(t: StarTables) -> DataFrame:
    return t.raw("orders").filter("o_orderstatus<>'P' and o_orderkey%6<>0").selectExpr(
        "*", "explode(case when o_orderkey%29=0 then array(1,2) else array(1) end) k").selectExpr(
        "o_orderkey*10+k id", "concat('MV/',cast(o_orderkey as string)) move_name",
        "case when o_orderkey%4=0 then null else concat('SO',cast(o_orderkey as string)) end communication",
        "case when o_orderkey%13=0 then 'outbound' else 'inbound' end payment_type", "o_custkey%5+1 store_id",
        "cast(o_totalprice as decimal(15,2)) amount", "o_custkey%6+1 journal_id",
        "case when o_orderkey%3<>0 then o_orderkey end sale_order_id", "cast(o_orderdate as date)+k*10 payment_date")


@_table
def sale_order(t: StarTables) -> DataFrame:
    return t.raw("orders").selectExpr(
        "o_orderkey id", "concat('SO',cast(o_orderkey as string)) name", "o_custkey+1 partner_id",
        "cast(substr(o_orderpriority,1,1) as int) payment_term_id",
        "case o_orderstatus when 'P' then 'draft' else 'sale' end state",
        "case when o_orderkey%5=0 then 'invoiced' else 'to invoice' end invoice_status",
        "case when o_orderkey%2=0 then 'nota' end note")


@_table
def sale_order_line(t: StarTables) -> DataFrame:
    parts = t.raw("part").selectExpr("p_partkey", "cast(p_retailprice as decimal(15,2)) retail")
    lines = t["numbered_lineitem"]
    return lines.join(parts, lines.l_partkey == parts.p_partkey).selectExpr(
        "line_id id", "l_orderkey order_id", "l_partkey product_id", "cast(l_quantity as decimal(15,2)) product_uom_qty",
        "retail+(l_linenumber-2)*5 price_unit", "cast(l_discount*100 as decimal(6,2)) discount",
        "cast(round(l_tax*100) as int) tax_id")


@_table
def cash_report_request(t: StarTables) -> DataFrame:
    """Requested report ranges: order date to the ship date of each line."""
    orders = t.raw("orders").selectExpr("o_orderkey", "o_custkey%5+1 store_id", "cast(o_orderdate as date) start_on")
    lines = t["numbered_lineitem"].selectExpr("line_id id", "l_orderkey", "cast(l_shipdate as date) end_on")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey)


# --- requests and certificates ----------------------------------------------

@_table
def credit_note_request(t: StarTables) -> DataFrame:
    return t.raw("orders").filter("o_orderkey%20=0").selectExpr(
        "*", "explode(case when o_orderkey%3=0 then array(1,2) else array(1) end) k").selectExpr(
        "o_orderkey*10+k id", "o_orderkey invoice_id",
        "case when k=1 then case when o_orderkey%120=0 then 'rejected' else 'pending' end "
        "else case when o_orderkey%180=0 then 'approved' else 'rejected' end end state",
        "case when o_orderkey%100=0 then null else concat('motivo ',cast(k as string)) end reason",
        "o_orderdate + make_interval(0,0,0,k) requested_on")


@_table
def credit_note_log(t: StarTables) -> DataFrame:
    """What happened to the requests for each order: request, then by the order's key
    approvals and rejections."""
    return t.raw("orders").selectExpr(
        "*", "explode(slice(array(1,2,3,4,5),1,cast(o_orderkey%5+1 as int))) k").selectExpr(
        "o_orderkey*10+k id", "o_orderkey invoice_id",
        "case when k=1 then 'request' when k=2 then case when o_orderkey%2=0 then 'approve' else 'reject' end "
        "when k=3 then 'reject' when k=4 then case when o_orderkey%4<2 then 'request' else 'reject' end "
        "else 'approve' end action",
        "o_orderdate + make_interval(0,0,0,k) happened_on", "k", "o_orderkey").selectExpr(
        "id", "invoice_id", "action", "happened_on",
        "case when action='request' then concat('motivo ',cast(id as string)) end reason",
        "case when action='reject' then concat('rechazo ',cast(id as string)) end reject_reason")


@_table
def credit_note_attempt(t: StarTables) -> DataFrame:
    """What was tried on the requests of each order, in an order that refuses some; a third of all on one invoice."""
    return t.raw("orders").selectExpr("*", "explode(array(1,2,3,4,5,6)) k").selectExpr(
        "o_orderkey*10+k id", "case when o_orderkey%3=0 then 3 when o_orderkey%101=0 then null else o_orderkey end invoice_id",
        "case (o_orderkey div 3+k*k*(o_orderkey%7+1))%5 when 2 then 'approve' when 3 then 'reject' else 'request' end action",
        "o_orderdate + make_interval(0,0,0,k) happened_on").selectExpr(
        "id", "invoice_id", "action", "happened_on",
        "case when action='request' then concat('motivo ',cast(id as string)) end reason",
        "case when action='reject' then concat('rechazo ',cast(id as string)) end reject_reason")


@_table
def sale_order_log(t: StarTables) -> DataFrame:
    """The states of each order: a draft on its day, later confirmed, at last invoiced; some never get that far."""
    return t.raw("orders").selectExpr("*", "explode(array(1,2,3)) k").filter(
        "k=1 or (k=2 and o_orderkey%7<>0) or (k=3 and o_orderkey%5=0)").selectExpr(
        "o_orderkey*10+k id", "o_orderkey order_id",
        "o_orderdate + make_interval(0,0,0,case k when 1 then 0 when 2 then cast(o_orderkey%25 as int) else 40 end) changed_on",
        "case k when 1 then 'draft' else 'sale' end state",
        "case k when 1 then 'no' when 2 then 'to invoice' else 'invoiced' end invoice_status",
        "case when k=2 and o_orderkey%11=0 then 2 else cast(substr(o_orderpriority,1,1) as int) end payment_term_id")


@_table
def withholding_certificate(t: StarTables) -> DataFrame:
    invoices = t["invoice_header"].filter("type='in_invoice' and id%3=0")
    # Whether an invoice has the tax, not how much: only the lines with that tax are grouped, by their keys.
    held = t["line_without_id"].filter("tax_id=8").select(F.col("invoice_id").alias("of"), "tax_id").distinct()
    return invoices.join(held, invoices.id == held.of).selectExpr(
        "id", "id invoice_id", "tax_id account_tax_id", "date_invoice+15 certificated_on", "create_date",
        "case when id%4=0 then 'draft' else 'approved' end state", "id%2+1 company_id",
        "case when id%5=0 then 'Contabilidad' end comments")
