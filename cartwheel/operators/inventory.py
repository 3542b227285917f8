"""Inventory report: stock thresholds, low stock, out of stock, stock value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwheel.functions.cols import js_round, one_row_join

# Fixed values of the reference: tag pattern -> low-stock threshold, first
# match wins, otherwise DEFAULT_THRESHOLD.
THRESHOLD_RULES = (("popular", 20), ("suits", 15))
DEFAULT_THRESHOLD = 10


def tag_matches(tags: Column, word: str, text: bool = False) -> Column:
    """``tags LIKE '%word%'``: any tag value of a tag array contains the word,
    or (``text``) the tags' text does."""
    return tags.like(f"%{word}%") if text else F.exists(tags, lambda t: t["value"].like(f"%{word}%"))


def has_text_tags(products: DataFrame) -> bool:
    return isinstance(products.schema["tags"].dataType, T.StringType)


def stock_threshold(tags: Column, rules=THRESHOLD_RULES, default: int = DEFAULT_THRESHOLD,
                    text: bool = False) -> Column:
    """CASE over the tag rules, first match wins."""
    expr = None
    for word, limit in rules:
        cond = tag_matches(tags, word, text)
        expr = F.when(cond, F.lit(limit)) if expr is None else expr.when(cond, F.lit(limit))
    return expr.otherwise(F.lit(default)) if expr is not None else F.lit(default)


def _variant_product(variants: DataFrame, products: DataFrame) -> DataFrame:
    v = variants.select(F.col("id").alias("variant_id"), "product_id",
                        F.col("title").alias("variant_title"), "sku", "inventory_quantity",
                        "manage_inventory")
    p = products.select(F.col("id").alias("product_id"), "title", "handle", "tags")
    return v.join(p, "product_id")


def low_stock(variants: DataFrame, products: DataFrame, rules=THRESHOLD_RULES) -> DataFrame:
    """managed variants at or below their product's threshold, lowest stock first."""
    j = _variant_product(variants.filter(F.col("manage_inventory") == F.lit(True)), products)
    j = j.withColumn("threshold", stock_threshold(F.col("tags"), rules, text=has_text_tags(products)))
    return (j.filter(F.col("inventory_quantity") <= F.col("threshold"))
            .orderBy(F.col("inventory_quantity").asc_nulls_last(), F.col("variant_id").asc_nulls_last())
            .select("variant_id", "title", "handle", "variant_title", "sku",
                    F.coalesce(F.col("inventory_quantity"), F.lit(0)).alias("current_stock"),
                    "threshold"))


def out_of_stock(variants: DataFrame, products: DataFrame) -> DataFrame:
    """managed variants with no stock left, by product title."""
    v = variants.filter((F.col("inventory_quantity") <= 0) & (F.col("manage_inventory") == F.lit(True)))
    j = _variant_product(v, products)
    return (j.orderBy(F.col("title").asc_nulls_last(), F.col("variant_id").asc_nulls_last())
            .select("variant_id", "title", "handle", "variant_title", "sku"))


def inventory_value(variants: DataFrame, prices: DataFrame, currency: str = "usd") -> DataFrame:
    """Stock value (sum of ``quantity * amount div 100`` per joined row,
    integer division per row), joined-row count and unit count over managed
    variants left-joined to their prices in ``currency``.

    A variant with several matching prices contributes once per price (the
    reference's left join fans out), one without contributes once with
    amount 0. Prices are first reduced to (variant, amount, copies) so a
    variant with very many price rows is collapsed map-side before the join.
    """
    p = (prices.filter(F.col("currency_code") == currency)
         .groupBy("variant_id", "amount").agg(F.count(F.lit(1)).alias("copies")))
    v = variants.filter(F.col("manage_inventory") == F.lit(True)).select(
        F.col("id").alias("variant_id"), F.col("inventory_quantity").alias("qty"))
    j = v.join(p, "variant_id", "left")
    copies = F.coalesce(F.col("copies"), F.lit(1))
    per_row_value = F.expr("CAST(qty AS BIGINT) * coalesce(amount, 0) div 100")
    agg = j.agg(
        F.sum(per_row_value * copies).alias("total_value"),
        F.sum(copies).alias("total_variants"),
        F.sum(F.col("qty").cast("bigint") * copies).alias("total_units"),
    )
    return agg.select(
        js_round(F.coalesce(F.col("total_value").cast("double"), F.lit(0.0))).alias("total_value"),
        F.coalesce(F.col("total_variants"), F.lit(0)).cast("bigint").alias("total_variants"),
        F.coalesce(F.col("total_units"), F.lit(0)).cast("bigint").alias("total_units"),
    )


def inventory_summary(variants: DataFrame, products: DataFrame, prices: DataFrame,
                      rules=THRESHOLD_RULES, currency: str = "usd") -> DataFrame:
    """Stock value plus the sizes of the low-stock and out-of-stock lists."""
    low = low_stock(variants, products, rules).agg(F.count(F.lit(1)).alias("low_stock_count"))
    out = out_of_stock(variants, products).agg(F.count(F.lit(1)).alias("out_of_stock_count"))
    return one_row_join(inventory_value(variants, prices, currency), low, out)
