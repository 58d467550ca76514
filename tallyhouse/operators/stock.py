"""Stock labels and searches."""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.sources.search_index import find_in

Tables = Mapping[str, DataFrame]


def _labelled(t: Tables) -> DataFrame:
    warehouses = (
        t["stock_warehouse"].groupBy(F.col("lot_stock_id").alias("_location"))
        .agg(F.min_by("name", "id").alias("warehouse_name")))
    free = F.bround(F.col("quantity") - F.col("reserved_quantity"), 0).cast("bigint")
    label = F.concat(F.coalesce("warehouse_name", F.lit("")), F.lit(" ("), free.cast("string"), F.lit(")"))
    return t["stock_quant"].join(warehouses, F.col("location_id") == F.col("_location"), "left").withColumn("label", label)


def stock_available(t: Tables) -> DataFrame:
    """Label of each quant: its warehouse and what is free, rounded half to even."""
    return _labelled(t).select("id", "label")


def stock_search(t: Tables, name: str, limit: int | None = None, index: str | None = None) -> DataFrame:
    """Quants of the warehouses whose name matches; if these hold none, quants whose
    location's name matches. All of them, or the first `limit` by id, as a search box shows.

    The places that match are found first, and only the quants in them get a label. Whether any quant is in a matching
    warehouse is one grouped row. `index`: a folder with indexes of `stock_location` and `stock_warehouse`, to search in those.
    """
    by_name = find_in(t, "stock_location", "name", name, index).select(F.col("id").alias("_place"), F.lit(1).alias("_kind"))
    if name:
        warehouses = find_in(t, "stock_warehouse", "name", name, index).select(
            F.col("lot_stock_id").alias("_place"), F.lit(0).alias("_kind"))
        by_name = warehouses.unionByName(by_name)
    places = by_name.groupBy("_place").agg(F.min("_kind").alias("_kind"))
    held = t["stock_quant"].join(places, F.col("location_id") == F.col("_place"))
    best = held.agg(F.min("_kind").alias("_best"))
    found = held.join(F.broadcast(best), F.col("_kind") == F.col("_best")).select(t["stock_quant"].columns)
    if limit is not None:
        found = found.orderBy("id").limit(limit)
    return _labelled(ChainMap({"stock_quant": found}, t)).select("id", "label")


def product_quants(t: Tables, product_id: int | None = None) -> DataFrame:
    """Quants of a product (or of all) that belong to a company and are not empty."""
    quants = t["stock_quant"].filter("product_id is not null and company_id is not null and quantity > 0")
    if product_id is not None:
        quants = quants.filter(F.col("product_id") == product_id)
    return quants.select("id", "product_id", "location_id", "company_id", "quantity", "reserved_quantity")
