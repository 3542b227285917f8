"""SRC3: the seed catalogue (one nested JSON document) as shop tables.

``read_seed`` reads the single document with an explicit schema;
``seed_tables`` explodes it into one DataFrame per entity. A document is
one record, so its lists are exploded by one task: fine for a seed file.
Large catalogues come as JSON lines, one product per line
(``read_product_lines`` / ``parse_products``), which Spark splits across
tasks like any other text input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


S = T.StringType()
STR_MAP = T.MapType(S, S)


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


PRICE = _struct(("currency_code", S), ("amount", T.LongType()))
VARIANT = _struct(("id", S), ("title", S), ("sku", S), ("inventory_quantity", T.IntegerType()),
                  ("manage_inventory", T.BooleanType()), ("allow_backorder", T.BooleanType()),
                  ("options", T.ArrayType(_struct(("option_id", S), ("value", S)))),
                  ("prices", T.ArrayType(PRICE)))
PRODUCT = _struct(("id", S), ("title", S), ("subtitle", S), ("description", S), ("handle", S), ("status", S),
                  ("category_id", S), ("collection_id", S), ("is_giftcard", T.BooleanType()),
                  ("type", S),
                  ("tags", T.ArrayType(_struct(("id", S), ("value", S)))),
                  ("options", T.ArrayType(_struct(("id", S), ("title", S)))),
                  ("variants", T.ArrayType(VARIANT)))
SEED_SCHEMA = _struct(
    ("store", _struct(("currencies", T.ArrayType(S)), ("default_currency_code", S), ("default_region", S))),
    ("regions", T.ArrayType(_struct(("id", S), ("name", S), ("currency_code", S), ("tax_rate", T.DoubleType()),
                                    ("countries", T.ArrayType(S)), ("fulfillment_providers", T.ArrayType(S)),
                                    ("payment_providers", T.ArrayType(S))))),
    ("shipping_options", T.ArrayType(_struct(
        ("id", S), ("name", S), ("region_id", S), ("provider_id", S), ("profile_id", S), ("price_type", S),
        ("amount", T.LongType()), ("data", STR_MAP),
        ("requirements", T.ArrayType(_struct(("type", S), ("amount", T.LongType()))))))),
    ("users", T.ArrayType(_struct(("id", S), ("email", S), ("first_name", S), ("last_name", S), ("role", S)))),
    ("product_categories", T.ArrayType(_struct(("id", S), ("name", S), ("description", S), ("handle", S),
                                               ("is_active", T.BooleanType()), ("is_internal", T.BooleanType())))),
    ("product_collections", T.ArrayType(_struct(("id", S), ("title", S), ("handle", S), ("metadata", STR_MAP)))),
    ("products", T.ArrayType(PRODUCT)),
)


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    """The seed document as one row (only the schema's fields are read;
    e.g. user passwords are never parsed)."""
    return spark.read.schema(SEED_SCHEMA).option("multiLine", True).json(path)


def _explode(doc: DataFrame, field: str) -> DataFrame:
    return doc.select(F.explode(field).alias("x")).select("x.*")


def product_tables(products: DataFrame) -> dict[str, DataFrame]:
    """products (one row per product, PRODUCT columns) -> product, variant,
    price, tag, product_option and variant_option_value tables."""
    product = products.select("id", "title", "subtitle", "description", "handle", "status", "category_id",
                              "collection_id", "is_giftcard", "type", "tags").dropDuplicates(["id"])
    v = products.select(F.col("id").alias("product_id"), F.posexplode("variants").alias("rank", "v"))
    variant = v.select(F.col("v.id").alias("id"), "product_id", "rank", "v.title", "v.sku",
                       "v.inventory_quantity", "v.manage_inventory", "v.allow_backorder").dropDuplicates(["id"])
    price = v.select(F.col("v.id").alias("variant_id"), F.explode("v.prices").alias("p")).select(
        "variant_id", "p.currency_code", "p.amount")
    option_value = v.select(F.col("v.id").alias("variant_id"), F.explode("v.options").alias("o")).select(
        "variant_id", "o.option_id", "o.value")
    tag = products.select(F.col("id").alias("product_id"), F.explode("tags").alias("t")).select(
        "product_id", F.col("t.id").alias("tag_id"), F.col("t.value").alias("value"))
    option = products.select(F.col("id").alias("product_id"), F.explode("options").alias("o")).select(
        "product_id", F.col("o.id").alias("option_id"), F.col("o.title").alias("title"))
    return {"product": product, "product_variant": variant, "money_amount": price, "product_tag": tag,
            "product_option": option, "product_option_value": option_value}


def seed_tables(doc: DataFrame) -> dict[str, DataFrame]:
    """All entities of a seed document, one DataFrame each."""
    out = {
        "store": doc.select("store.*"),
        "region": _explode(doc, "regions"),
        "shipping_option": _explode(doc, "shipping_options"),
        "user": _explode(doc, "users"),
        "product_category": _explode(doc, "product_categories"),
        "product_collection": _explode(doc, "product_collections"),
    }
    products = _explode(doc, "products")
    out.update(product_tables(products))
    regions = out["region"]
    out["country"] = regions.select(F.col("id").alias("region_id"), F.explode("countries").alias("iso_2"))
    out["region_fulfillment_providers"] = regions.select(
        F.col("id").alias("region_id"), F.explode("fulfillment_providers").alias("provider_id"))
    out["region_payment_providers"] = regions.select(
        F.col("id").alias("region_id"), F.explode("payment_providers").alias("provider_id"))
    out["store_currencies"] = doc.select(F.explode("store.currencies").alias("currency_code"))
    return out


def parse_products(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON-lines products (one product document per row) -> PRODUCT rows."""
    return lines.select(F.from_json(F.col(column), PRODUCT).alias("p")).select("p.*")


def read_product_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PRODUCT).json(path)


def product_documents(products: DataFrame, variants: DataFrame, prices: DataFrame) -> DataFrame:
    """The inverse: one JSON document per product with its variants and prices
    nested (the seed's product shape). Prices are grouped per variant and
    variants per product; both lists belong to one document by definition."""
    pv = prices.groupBy("variant_id").agg(
        F.sort_array(F.collect_list(F.struct("currency_code", "amount"))).alias("prices"))
    v = variants.join(pv, variants.id == pv.variant_id, "left").select(
        "product_id", F.struct(F.col("id").cast("string").alias("id"), "title", "sku", "inventory_quantity",
                               "manage_inventory", F.lit(False).alias("allow_backorder"),
                               F.array().cast(VARIANT["options"].dataType).alias("options"),
                               F.coalesce("prices", F.array().cast(T.ArrayType(PRICE))).alias("prices"))
        .alias("v"))
    per_product = v.groupBy("product_id").agg(F.sort_array(F.collect_list("v")).alias("variants"))
    p = products.join(per_product, products.id == per_product.product_id, "left")
    doc = F.struct(F.col("id").cast("string").alias("id"), "title", F.lit(None).cast("string").alias("subtitle"),
                   F.lit(None).cast("string").alias("description"), "handle",
                   F.lit("published").alias("status"), F.lit(None).cast("string").alias("category_id"),
                   F.lit(None).cast("string").alias("collection_id"), F.lit(False).alias("is_giftcard"),
                   "type", "tags", F.array().cast(PRODUCT["options"].dataType).alias("options"),
                   F.coalesce("variants", F.array().cast(T.ArrayType(VARIANT))).alias("variants"))
    return p.select(F.to_json(doc).alias("value"))


# ------------------------------------------------------------ open documents
ANY_MAP = T.MapType(S, T.VariantType())


def read_documents(spark: SparkSession, path: str, one_document: bool = False) -> DataFrame:
    """JSON documents under ``path`` as a VARIANT column ``doc``: one a line, or
    each file one document. Every key is kept, whatever the schema knows."""
    return spark.read.option("singleVariantColumn", "doc").option("multiLine", one_document).json(path)


def seed_products(doc: DataFrame) -> DataFrame:
    """The product documents of seed documents, as VARIANT ``doc``."""
    return doc.select(F.explode(F.variant_get("doc", "$.products", "array<variant>")).alias("doc"))


def open_products(docs: DataFrame) -> DataFrame:
    """PRODUCT rows of VARIANT product documents, and ``more``: the keys that
    the schema does not know, as a map of VARIANT values. The variants' own
    unknown keys are in ``more_variants``, one map a variant."""
    known, known_variant = (F.array(*[F.lit(f.name) for f in t.fields]) for t in (PRODUCT, VARIANT))

    def rest(value, names):
        return F.map_filter(value.cast(ANY_MAP), lambda k, v: ~F.array_contains(names, k))

    variants = F.variant_get("doc", "$.variants", "array<variant>")
    return docs.select(F.col("doc").cast(PRODUCT).alias("p"), rest(F.col("doc"), known).alias("more"),
                       F.transform(variants, lambda v: rest(v, known_variant)).alias("more_variants")).select("p.*", "more", "more_variants")


def open_documents(rows: DataFrame) -> DataFrame:
    """The inverse of :func:`open_products`: documents as JSON text (``value``),
    unknown keys included. Keys without a value are left out."""
    def joined(known, more):
        return F.map_concat(F.from_json(F.to_json(known), ANY_MAP), F.coalesce(more, F.from_json(F.lit("{}"), ANY_MAP)))

    variants = F.zip_with("variants", "more_variants", lambda v, m: joined(v, m))
    plain = [f.name for f in PRODUCT.fields if f.name != "variants"]
    held = F.map_concat(joined(F.struct(*plain), F.col("more")),
                        F.when(F.col("variants").isNotNull(), F.map_from_arrays(F.array(F.lit("variants")), F.array(F.parse_json(F.to_json(variants)))))
                        .otherwise(F.from_json(F.lit("{}"), ANY_MAP)))
    return rows.select(F.to_json(held).alias("value"))
