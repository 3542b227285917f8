"""The shop's own tables from a folder of Parquet or JSON-lines data (SRC1, SRC2).

``Tables`` offers the same attributes as the test mapping
(:class:`cartwheel.sources.commerce.Commerce`), so every operator and report
runs on either. A table is ``<folder>/<name>``; columns that the operators use
must be there and are brought to their type, further columns pass through.
Numbers may arrive as text (a database driver's decimals): what does not parse
counts as 0, an absent value stays NULL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwheel.functions.cols import number_or_zero
from cartwheel.session import configure

TS = "timestamp_ntz"
#: table -> (column, type or None to take it as it is)
SCHEMAS: dict[str, tuple[tuple[str, str | None], ...]] = {
    "order": (("id", None), ("customer_id", None), ("status", "string"), ("total", "bigint"), ("created_at", TS)),
    "line_item": (("order_id", None), ("variant_id", None), ("quantity", "int"), ("total", "bigint"), ("unit_price", "bigint")),
    "product": (("id", None), ("title", "string"), ("handle", "string"), ("tags", None), ("type", "string")),
    "product_variant": (("id", None), ("product_id", None), ("title", "string"), ("sku", "string"),
                        ("inventory_quantity", "int"), ("manage_inventory", "boolean")),
    "money_amount": (("variant_id", None), ("currency_code", "string"), ("amount", "bigint")),
    "customer": (("id", None), ("email", "string"), ("first_name", "string"), ("last_name", "string"),
                 ("created_at", TS), ("phone", "string")),
    "region": (("id", None), ("name", "string"), ("currency_code", "string"), ("tax_rate", "double"), ("created_at", TS)),
    "country": (("iso_2", "string"), ("region_id", None)),
    "currency": (("code", "string"), ("symbol", "string"), ("symbol_native", "string"), ("name", "string")),
    "store": (("id", None), ("name", "string"), ("default_currency_code", "string")),
    "store_currencies": (("store_id", None), ("currency_code", "string")),
    "shipping_option": (("id", None), ("name", "string"), ("region_id", None), ("profile_id", None), ("deleted_at", TS)),
    "shipping_profile": (("id", None), ("name", "string"), ("type", "string"), ("deleted_at", TS)),
    "fulfillment_provider": (("id", None), ("is_installed", "boolean")),
    "payment_provider": (("id", None), ("is_installed", "boolean")),
    "region_fulfillment_providers": (("region_id", None), ("provider_id", "string")),
    "region_payment_providers": (("region_id", None), ("provider_id", "string")),
    "user": (("id", None), ("email", "string"), ("first_name", "string"), ("last_name", "string"), ("role", "string")),
}
NUMBERS = ("int", "bigint", "double")


class Tables:
    """Lazily read shop tables under ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, fmt: str = "parquet"):
        self.spark, self.folder, self.fmt = configure(spark), folder.rstrip("/"), fmt

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.format(self.fmt).load(f"{self.folder}/{name}")
        missing = [c for c, _ in SCHEMAS[name] if c not in df.columns]
        if missing:
            raise ValueError(f"table {name} lacks {', '.join(missing)}")
        for column, kind in SCHEMAS[name]:
            found = df.schema[column].dataType
            if kind in NUMBERS and isinstance(found, T.StringType):
                df = df.withColumn(column, F.when(F.col(column).isNotNull(), number_or_zero(column).cast(kind)))
            elif kind is not None and found.simpleString() != kind:
                df = df.withColumn(column, F.col(column).cast(kind))
        return df


def _attribute(table: str):
    return cached_property(lambda self: self.table(table))


for _name, _table in {
    "orders": "order", "line_items": "line_item", "products": "product", "variants": "product_variant",
    "prices": "money_amount", "customers": "customer", "regions": "region", "countries": "country",
    "currencies": "currency", "stores": "store", "store_currencies": "store_currencies",
    "shipping_options": "shipping_option", "shipping_profiles": "shipping_profile",
    "fulfillment_providers": "fulfillment_provider", "payment_providers": "payment_provider",
    "region_fulfillment_providers": "region_fulfillment_providers",
    "region_payment_providers": "region_payment_providers", "users": "user",
}.items():
    _property = _attribute(_table)
    setattr(Tables, _name, _property)
    _property.__set_name__(Tables, _name)
