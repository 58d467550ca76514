"""Products with the attributes of their templates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.session import stage_once


def product_attributes(t: Mapping[str, DataFrame], **columns: str) -> DataFrame:
    """`product_key` and the given template columns (`new_name="template_column"`) of
    every product, with the product's own code as `variant_code`.

    The two tables meet before the lines do, so that lines are shuffled by product
    once at most. The result is written out, once for the same tables: its real size then decides whether the
    lines need that shuffle at all.
    """
    products = t["product_product"].select(
        F.col("id").alias("product_key"), "product_tmpl_id", F.col("default_code").alias("variant_code"))
    templates = t["product_template"].select(
        F.col("id").alias("_template"), *[F.col(source).alias(name) for name, source in columns.items()])
    return stage_once(
        [t["product_product"], t["product_template"]], "products",
        lambda: products.join(templates, F.col("product_tmpl_id") == F.col("_template"))
        .select("product_key", "variant_code", *columns), **columns)
