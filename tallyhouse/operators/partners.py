"""Partner, address and delivery-zone quality; notes on orders and invoices."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.columns import EMAIL_PATTERN, as_date, is_blank, plain_ruc, whole_years
from tallyhouse.operators.products import product_attributes
from tallyhouse.plans.joins import skewed_join
from tallyhouse.sources.key_index import with_stored
from tallyhouse.sources.search_index import find_in

Tables = Mapping[str, DataFrame]


def ruc_normalized(t: Tables) -> DataFrame:
    """RUC of each partner as it is stored: without dashes and spaces."""
    return t["res_partner"].select("id", "ruc", plain_ruc(F.col("ruc")).alias("ruc_normalized"))


def ruc_duplicates(t: Tables) -> DataFrame:
    """Partners whose RUC another partner holds too, however it is spelled."""
    plain = ruc_normalized(t).filter("ruc_normalized <> ''")
    shared = plain.groupBy(F.col("ruc_normalized").alias("_ruc")).agg(F.count("*").alias("holders")).filter("holders > 1")
    return skewed_join(plain, shared, "ruc_normalized", "_ruc", spread_by="id", how="inner").select(
        "id", "ruc", "ruc_normalized", "holders")


def ruc_key() -> list[Column]:
    """What no two partners share."""
    return [plain_ruc(F.col("ruc"))]


def zone_key() -> list[Column]:
    """What no two zones share."""
    return [F.col("sector_id")]


def new_ruc_duplicates(t: Tables, stored: str) -> DataFrame:
    """`ruc_duplicates` for new or changed partners (`t`) against those that `write_keys` stored by `ruc_key`."""
    new = t["res_partner"]
    found = ruc_duplicates({"res_partner": with_stored(new, stored, ruc_key())})
    return found.join(new.select(F.col("id").alias("_new")), F.col("id") == F.col("_new"), "left_semi")


def email_invalid(t: Tables) -> DataFrame:
    """Partners with an e-mail address that does not have the expected form."""
    return t["res_partner"].filter(~is_blank(F.col("email")) & ~F.rlike("email", F.lit(EMAIL_PATTERN))).select(
        "id", "email", F.lit("invalid_format").alias("reason"))


def _missing(fields: dict[str, Column]) -> Column:
    return F.concat_ws(",", *[F.when(test, name) for name, test in fields.items()])


def partner_missing_fields(t: Tables) -> DataFrame:
    """Partners and companies with required fields left empty, and which.

    Everybody needs the address, RUC and contact fields. Suppliers need DV and partner
    type as well, and those that are no company a nationality.
    """
    # The fields the partner form requires.
    everybody = ("country_id", "province_id", "district_id", "sector_id", "ruc", "phone", "mobile", "email", "street",
                 "reference", "home_number")
    supplier = F.coalesce("supplier", F.lit(False))
    person = ~F.coalesce("is_company", F.lit(False))
    fields = {name: is_blank(F.col(name)) for name in everybody}
    fields |= {
        "dv": supplier & is_blank(F.col("dv")),
        "partner_type": supplier & is_blank(F.col("partner_type")),
        "partner_nationality": supplier & person & is_blank(F.col("partner_nationality")),
    }
    partners = t["res_partner"].select(F.lit("partner").alias("entity"), "id", _missing(fields).alias("missing_fields"))
    # The fields the company form requires; they live on its partner.
    required = {name: is_blank(F.col(name)) for name in ("ruc", "dv", "email", "phone")}
    owners = t["res_partner"].select(F.col("id").alias("_owner"), *required)
    companies = (
        t["res_company"].join(owners, F.col("partner_id") == F.col("_owner"), "left")
        .select(F.lit("company").alias("entity"), F.col("id").cast("bigint").alias("id"),
                _missing(required).alias("missing_fields")))
    return partners.unionByName(companies).filter("missing_fields <> ''")


def partner_age(t: Tables, as_of: dt.date) -> DataFrame:
    """Age text of each partner on a day; `0` below one year or without a birth date."""
    years = whole_years(F.col("birth_date"), as_date(as_of))
    text = F.when(years > 0, F.concat(years.cast("string"), F.lit(" año(s) de edad"))).otherwise("0")
    return t["res_partner"].select("id", "birth_date", text.alias("age"))


def sector_full_name(t: Tables) -> DataFrame:
    """`province / district / sector`; a missing parent leaves its place empty."""
    provinces = t["province"].select(F.col("id").alias("_p"), F.col("name").alias("_province"))
    districts = t["district"].select(F.col("id").alias("_d"), F.col("name").alias("_district"))
    empty = F.lit("")
    return (
        t["sector"].join(provinces, F.col("province_id") == F.col("_p"), "left")
        .join(districts, F.col("district_id") == F.col("_d"), "left")
        .select("id", F.concat_ws(" / ", F.coalesce("_province", empty), F.coalesce("_district", empty),
                                  F.coalesce("name", empty)).alias("full_name")))


# level -> (child table, its parent column, parent table)
LEVELS = {
    "province": ("province", "country_id", "res_country"),
    "district": ("district", "province_id", "province"),
    "sector": ("sector", "district_id", "district"),
}


def _children(t: Tables, level: str) -> DataFrame:
    """Children with their parent's country; a country is its own."""
    child, parent_column, parent = LEVELS[level]
    own_country = "id" if parent == "res_country" else "country_id"
    parents = t[parent].select(F.col("id").alias("parent_id"), F.col(own_country).alias("parent_country_id"))
    children = t[child].select(F.col("id"), F.col("name"), F.col(parent_column).alias("_parent"), "country_id")
    return children.join(parents, F.col("_parent") == F.col("parent_id"))


def _same_country() -> Column:
    return F.coalesce(F.col("country_id") == F.col("parent_country_id"), F.lit(False))


def address_children(t: Tables, level: str, parent_id: int | None = None) -> DataFrame:
    """Choices below a country, province or district: the children in its country."""
    if level not in LEVELS:
        raise ValueError(f"level must be one of {tuple(LEVELS)}")
    children = _children(t, level).filter(_same_country())
    if parent_id is not None:
        children = children.filter(F.col("parent_id") == parent_id)
    return children.select("parent_id", "id", "name")


def address_mismatches(t: Tables) -> DataFrame:
    """Districts and sectors hidden from the choices: their country is not their parent's."""
    parts = [
        _children(t, level).filter(~_same_country()).select(
            F.lit(level).alias("level"), "id", "parent_id", "country_id", "parent_country_id")
        for level in ("district", "sector")]
    return parts[0].unionByName(parts[1])


def default_country(t: Tables) -> DataFrame:
    """The country new partners and zones start with."""
    # Fixed value: the code of Panama.
    return t["res_country"].filter(F.col("code") == "PA").select("id").orderBy("id").limit(1)


def zone_conflicts(t: Tables) -> DataFrame:
    """Sectors that belong to more than one delivery zone."""
    names = t["sector"].select("id", "name")
    shared = (
        t["delivery_zone_sector"].distinct().groupBy("sector_id").agg(F.count("*").alias("zones")).filter("zones > 1"))
    return shared.join(names, F.col("sector_id") == F.col("id")).select("sector_id", "name", "zones")


def new_zone_conflicts(t: Tables, stored: str) -> DataFrame:
    """`zone_conflicts` of the sectors that new links (`t`) name, against the links that `write_keys` stored by `zone_key`."""
    links = with_stored(t["delivery_zone_sector"], stored, zone_key(), row_id=None)
    return zone_conflicts({**t, "delivery_zone_sector": links})


def _delivery_infos(t: Tables) -> DataFrame:
    """Delivery text per sector: its zones, in order of id, one after the other."""
    zones = t["delivery_zone"].select("id", F.concat(
        F.lit("Ruta de entrega: "), F.coalesce("name", F.lit("")), F.lit(", información: "),
        F.coalesce("description", F.lit(""))).alias("_text"))
    return (
        t["delivery_zone_sector"].distinct().join(zones, F.col("zone_id") == F.col("id"))
        .groupBy(F.col("sector_id").cast("bigint").alias("info_sector_id"))
        .agg(F.expr("listagg(_text, '') within group (order by zone_id)").alias("_info"))
        .select("info_sector_id", F.concat(F.lit("\n"), F.col("_info")).alias("delivery_info")))


def _with_delivery(t: Tables, records: DataFrame) -> DataFrame:
    # Partners without a sector, all suppliers among them, have no text to find.
    sectors = t["res_partner"].filter("sector_id is not null").select(F.col("id").alias("_partner"), "sector_id")
    return (
        records.join(sectors, F.col("partner_id") == F.col("_partner"), "left")
        .transform(skewed_join, _delivery_infos(t), "sector_id", "info_sector_id", spread_by="id"))


def order_delivery_notes(t: Tables) -> DataFrame:
    """The order's note with the delivery zones of the partner's sector behind it."""
    orders = t["sale_order"].select("id", "partner_id", F.coalesce("note", F.lit("")).alias("_note"))
    return _with_delivery(t, orders).select(
        "id", F.concat(F.col("_note"), F.coalesce("delivery_info", F.lit(""))).alias("note"))


def invoice_delivery_notes(t: Tables) -> DataFrame:
    """The invoice's comment with the delivery zones in front, unless it has them."""
    invoices = t["account_invoice"].select("id", "partner_id", F.coalesce("comment", F.lit("")).alias("_comment"))
    info = F.col("delivery_info")
    new = F.when(info.isNotNull() & ~F.col("_comment").contains(info), F.concat(info, F.lit("\n"), F.col("_comment")))
    return _with_delivery(t, invoices).select("id", new.otherwise(F.col("_comment")).alias("comment"))


def invoice_warranty_notes(t: Tables) -> DataFrame:
    """The invoice's comment with the warranty texts of its brands behind it, unless
    it has them. Each brand counts once per invoice; the texts are in order."""
    brands = t["product_brand"].filter("support_warranty_info <> ''").select(
        F.col("id").alias("brand_id"), F.col("support_warranty_info").alias("_text"))
    texts = (
        t["account_invoice_line"].select("invoice_id", "product_id")
        .join(product_attributes(t, product_brand_id="product_brand_id"), F.col("product_id") == F.col("product_key"))
        .select("invoice_id", "product_brand_id").distinct()
        .join(brands, F.col("product_brand_id") == F.col("brand_id"))
        .groupBy(F.col("invoice_id").alias("_invoice"))
        .agg(F.expr("listagg(_text, '\n') within group (order by _text)").alias("_warranty")))
    comment = F.coalesce("comment", F.lit(""))
    warranty = F.col("_warranty")
    new = F.when(warranty.isNotNull() & ~comment.contains(warranty), F.concat(comment, F.lit("\n"), warranty))
    return t["account_invoice"].select("id", "comment").join(texts, F.col("id") == F.col("_invoice"), "left").select(
        "id", new.otherwise(F.col("comment")).alias("comment"))


def find_by_ruc(t: Tables, entity: str, text: str, index: str | None = None) -> DataFrame:
    """Orders, invoices or partners by the RUC of their partner. `index`: a folder with an index of `res_partner`, to search in that."""
    partners = find_in(t, "res_partner", "ruc", text, index)
    if entity == "partners":
        return partners.select("id", "name", F.col("id").alias("partner_id"), F.col("ruc").alias("partner_ruc"))
    if entity not in ("orders", "invoices"):
        raise ValueError("entity must be 'orders', 'invoices' or 'partners'")
    table, label = ("sale_order", "name") if entity == "orders" else ("account_invoice", "number")
    found = partners.select(F.col("id").alias("_partner"), F.col("ruc").alias("partner_ruc"))
    return t[table].select("id", F.col(label).alias("name"), "partner_id").join(
        found, F.col("partner_id") == F.col("_partner")).select("id", "name", "partner_id", "partner_ruc")


def company_tax_ids(t: Tables) -> DataFrame:
    """RUC and DV of each company, held by its partner."""
    owners = t["res_partner"].select(F.col("id").alias("_owner"), "ruc", "dv")
    return t["res_company"].join(owners, F.col("partner_id") == F.col("_owner"), "left").select("id", "ruc", "dv")


def supplier_accounts(t: Tables, company_id: int | None = None) -> DataFrame:
    """Accounts a supplier bill of the company may use."""
    accounts = t["account_account"].filter((F.col("internal_type") == "other") & ~F.coalesce("deprecated", F.lit(False)))
    if company_id is not None:
        accounts = accounts.filter(F.col("company_id") == company_id)
    companies = t["res_company"].select(F.col("id").alias("_company"))
    return accounts.join(companies, F.col("company_id") == F.col("_company"), "left_semi").select(
        "id", "name", "company_id")
