"""Event sources: order lifecycle events and cart events, batch or stream.

The reference receives these one at a time from an event bus. Here they are
rows with an explicit schema, read as a static DataFrame (batch) or with
``readStream`` (micro-batches); every downstream operator is a
DataFrame -> DataFrame function, so both paths share the same plan.

Test-data mapping (fixed values of this repo):

* order events come from ``orders``: every order is placed; 'P' orders also
  have their payment captured, 'F' orders are also canceled (one day later).
* cart events come from ``events``: click -> cart.item_added, error ->
  cart.item_removed, purchase -> cart.item_updated, view -> product view,
  signup -> search. ``props.k`` is the variant; quantities are derived from
  ``value`` (added/removed: value div 25 + 1; updated: the units digit is the
  new quantity and the first decimal digit the previous one).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDER_EVENT_NAMES = ("order.placed", "order.payment_captured", "order.completed", "order.canceled")
CART_EVENT_NAMES = ("cart.item_added", "cart.item_removed", "cart.item_updated")

METADATA = T.StructType([T.StructField(n, T.StringType()) for n in
                         ("clientIp", "userAgent", "fbc", "fbp", "sessionId", "gaSessionId", "userId")])

ORDER_EVENT_SCHEMA = T.StructType([
    T.StructField("event_name", T.StringType()),
    T.StructField("id", T.LongType()),
    T.StructField("customer_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("metadata", METADATA),
])

CART_EVENT_SCHEMA = T.StructType([
    T.StructField("event_name", T.StringType()),
    T.StructField("id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("previousQuantity", T.IntegerType()),
    T.StructField("item", T.StructType([
        T.StructField("variant_id", T.LongType()),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("metadata", METADATA),
    ])),
])

#: Text of a JSON line that is no message; NULL for messages.
CORRUPT = "_corrupt_record"

# Raw `events` rows as a stream source (file source needs the schema).
RAW_EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def order_events(orders_raw: DataFrame) -> DataFrame:
    """SRC4: lifecycle events from the TPC-H ``orders`` rows."""
    names = F.when(F.col("o_orderstatus") == "P",
                   F.array(F.lit("order.placed"), F.lit("order.payment_captured"))) \
        .when(F.col("o_orderstatus") == "F", F.array(F.lit("order.placed"), F.lit("order.canceled"))) \
        .otherwise(F.array(F.lit("order.placed")))
    x = orders_raw.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority",
                          F.posexplode(names).alias("step", "event_name"))
    meta = F.struct(
        F.lit(None).cast("string").alias("clientIp"),
        F.lit(None).cast("string").alias("userAgent"),
        F.lit(None).cast("string").alias("fbc"),
        F.concat(F.lit("fb.1."), F.col("o_custkey").cast("string")).alias("fbp"),
        F.when(F.col("o_orderpriority") != "1-URGENT",
               F.concat(F.lit("s"), F.col("o_orderkey").cast("string"))).alias("sessionId"),
        F.concat(F.lit("ga"), F.col("o_orderkey").cast("string")).alias("gaSessionId"),
        F.lit(None).cast("string").alias("userId"),
    )
    return x.select(
        "event_name",
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("customer_id"),
        F.expr("timestampadd(DAY, step, o_orderdate)").alias("ts"),
        meta.alias("metadata"),
    )


def cart_events(events_raw: DataFrame) -> DataFrame:
    """SRC5: cart item events from the ``events`` table (batch or stream)."""
    et = F.col("event_type")
    name = (F.when(et == "click", "cart.item_added").when(et == "error", "cart.item_removed")
            .when(et == "purchase", "cart.item_updated"))
    updated = et == "purchase"
    qty = F.when(updated, F.expr("CAST(floor(value) AS INT) % 10")) \
        .otherwise(F.expr("CAST(floor(value / 25) AS INT) + 1"))
    prev = F.when(updated, F.expr("CAST(floor(value * 10) AS INT) % 10"))
    meta = F.struct(
        F.lit(None).cast("string").alias("clientIp"),
        F.lit(None).cast("string").alias("userAgent"),
        F.lit(None).cast("string").alias("fbc"),
        F.lit(None).cast("string").alias("fbp"),
        F.concat(F.lit("s"), F.col("user_id").cast("string"), F.lit("-"),
                 F.date_format("ts", "yyyyMMdd")).alias("sessionId"),
        F.lit(None).cast("string").alias("gaSessionId"),
        F.col("user_id").cast("string").alias("userId"),
    )
    return (events_raw.filter(et.isin("click", "error", "purchase"))
            .select(name.alias("event_name"), F.col("event_id").alias("id"), "ts",
                    prev.cast("int").alias("previousQuantity"),
                    F.struct(F.get_json_object("props", "$.k").cast("bigint").alias("variant_id"),
                             qty.cast("int").alias("quantity"), meta.alias("metadata")).alias("item")))


def view_events(events_raw: DataFrame) -> DataFrame:
    """Product page views (``view`` rows): id, ts, user, product."""
    return (events_raw.filter(F.col("event_type") == "view")
            .select(F.col("event_id").alias("id"), "ts", F.col("user_id").cast("string").alias("user_id"),
                    F.get_json_object("props", "$.k").cast("bigint").alias("product_id"),
                    F.concat(F.lit("s"), F.col("user_id").cast("string"), F.lit("-"),
                             F.date_format("ts", "yyyyMMdd")).alias("session_id")))


def search_events(events_raw: DataFrame) -> DataFrame:
    """Searches (``signup`` rows): the term is the title of product ``props.k``."""
    return (events_raw.filter(F.col("event_type") == "signup")
            .select(F.col("event_id").alias("id"), "ts", F.col("user_id").cast("string").alias("user_id"),
                    F.get_json_object("props", "$.k").cast("bigint").alias("product_id")))


def request_log(events_raw: DataFrame) -> DataFrame:
    """Request log for rate limiting: every event is one request of its user;
    signups are admin logins, errors admin calls, the rest shop calls."""
    kind = F.col("event_type")
    path = (F.when(kind == "signup", "/admin/auth/session").when(kind == "error", "/admin/orders")
            .otherwise(F.concat(F.lit("/store/"), kind)))
    return events_raw.select(F.col("user_id").cast("string").alias("client"), path.alias("path"), F.col("ts"))


def _read_json_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int, keep_malformed: bool) -> DataFrame:
    reader = spark.readStream.option("maxFilesPerTrigger", max_files)
    if keep_malformed:
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    return reader.schema(schema).json(path)


def read_order_events(spark: SparkSession, path: str, max_files_per_trigger: int = 64, keep_malformed: bool = False) -> DataFrame:
    """The shop's own order events (JSON lines of ORDER_EVENT_SCHEMA) as a
    stream; with ``keep_malformed`` the text of bad lines is a column."""
    return _read_json_stream(spark, path, ORDER_EVENT_SCHEMA, max_files_per_trigger, keep_malformed)


def read_cart_events(spark: SparkSession, path: str, max_files_per_trigger: int = 64, keep_malformed: bool = False) -> DataFrame:
    """The shop's own cart events (JSON lines of CART_EVENT_SCHEMA) as a stream."""
    return _read_json_stream(spark, path, CART_EVENT_SCHEMA, max_files_per_trigger, keep_malformed)


def read_events_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 64) -> DataFrame:
    """Raw ``events`` rows as a stream (parquet file source with a schema); a
    backlog becomes several micro-batches."""
    return (spark.readStream.schema(RAW_EVENT_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(path))
