"""Event enrichment and conversion payloads.

Two payload formats are produced: the pixel "conversions" format (hashed
user data + custom data) and the measurement-protocol format (client id +
one event with params). Each builder maps a DataFrame of enriched events to
a DataFrame with one payload struct per event; ``to_json`` of that struct is
what an outbox writer stores. No UDFs: hashing is ``sha2``, lists are
``transform`` / ``aggregate``, JS ``||`` defaults are ``js_or``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwheel.functions.cols import js_or, left_join_spread, pii_hash, salted_join
from cartwheel.session import shuffles_dropped


@dataclass(frozen=True)
class PayloadConfig:
    """Shop-specific constants of the payloads (set by the deploying shop)."""
    event_source_url: str = "https://shop.example.com"
    store_affiliation: str = "Online Store"
    item_affiliation: str = "Online Store"
    default_category: str = "General"


DEFAULT_CONFIG = PayloadConfig()

CONTENTS = T.ArrayType(T.StructType([
    T.StructField("id", T.StringType()), T.StructField("quantity", T.LongType()),
    T.StructField("item_price", T.DoubleType())]))
GA_ITEMS = T.ArrayType(T.StructType([
    T.StructField("item_id", T.StringType()), T.StructField("item_name", T.StringType()),
    T.StructField("affiliation", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("quantity", T.IntegerType()), T.StructField("price", T.DoubleType()),
    T.StructField("index", T.IntegerType())]))
# Fixed values of the reference.
ENGAGEMENT_TIME_MSEC = 100
ACTION_SOURCE = "website"
DEFAULT_CURRENCY = "USD"
DEFAULT_CONTENT_TYPE = "product"


# ---------------------------------------------------------------- cart delta
def cart_delta(cart_events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Cart actions. ``item_updated`` becomes an add of the increase or a
    remove of the decrease (nothing when equal or unknown); adds and removes
    pass through. Stateless: the previous quantity is in the message.

    Output: id, ts, action ('add' | 'remove'), variant_id, quantity, metadata
    and the columns in ``keep``.
    """
    diff = F.col("item.quantity") - F.col("previousQuantity")
    name = F.col("event_name")
    action = (F.when(name == "cart.item_added", "add").when(name == "cart.item_removed", "remove")
              .when((name == "cart.item_updated") & (diff > 0), "add")
              .when((name == "cart.item_updated") & (diff < 0), "remove"))
    qty = F.when(name == "cart.item_updated", F.abs(diff)).otherwise(F.col("item.quantity"))
    return (cart_events.select("id", "ts", action.alias("action"),
                               F.col("item.variant_id").alias("variant_id"), qty.cast("int").alias("quantity"),
                               F.col("item.metadata").alias("metadata"), *keep)
            .filter(F.col("action").isNotNull()))


# ------------------------------------------------------------- catalogue side
def first_prices(prices: DataFrame) -> DataFrame:
    """variant_id -> amount of its first price (prices ordered by currency
    code, then amount), reduced with ``min_by`` (partial aggregation)."""
    return prices.groupBy("variant_id").agg(
        F.min_by("amount", F.struct("currency_code", "amount")).alias("first_amount"))


def variant_catalog(variants: DataFrame, products: DataFrame, prices: DataFrame) -> DataFrame:
    """The static side of the event joins: one row per variant with its
    product and first price. Build once per batch / trigger; on a cluster
    persist or write it, since every micro-batch probes it."""
    v = variants.select(F.col("id").alias("variant_id"), "product_id", "sku")
    p = products.select(F.col("id").alias("product_id"), F.col("title").alias("product_title"),
                        F.col("type").alias("product_type"))
    return v.join(p, "product_id").join(first_prices(prices), "variant_id", "left")


def cart_enriched(actions: DataFrame, catalog: DataFrame, salt_buckets: int = 1) -> DataFrame:
    """Cart actions joined to their variant, product and first price.
    Inner join: an event whose variant lookup fails is skipped, as the
    reference's handler gives up on a failed lookup. ``salt_buckets`` > 1
    spreads a hot variant over several tasks (useful in streaming, where
    adaptive skew handling does not apply)."""
    return salted_join(actions, catalog, "variant_id", salt_buckets)


def _price_units(amount: Column) -> Column:
    """``amount / 100 || 0``: a missing price is NaN in JS, then 0."""
    return F.coalesce(amount / F.lit(100.0), F.lit(0.0))


def _item_id(sku: Column, fallback: Column) -> Column:
    return js_or(sku, fallback.cast("string"), "string")


# --------------------------------------------------------- pixel conversions
def conversion_envelope(event_name: Column, event_time: Column, user: dict[str, Column],
                        custom: dict[str, Column], cfg: PayloadConfig = DEFAULT_CONFIG) -> Column:
    """E5: one conversion event. Personal fields are SHA-256 of the (lower-
    cased, except phone and zip) text and absent when empty; custom data
    gets the reference's defaults. The access token is not part of it."""
    def u(name):
        return user.get(name, F.lit(None).cast("string"))

    user_data = F.struct(
        pii_hash(u("email")).alias("em"),
        pii_hash(u("phone"), lower=False).alias("ph"),
        pii_hash(u("firstName")).alias("fn"),
        pii_hash(u("lastName")).alias("ln"),
        pii_hash(u("city")).alias("ct"),
        pii_hash(u("state")).alias("st"),
        pii_hash(u("zip"), lower=False).alias("zp"),
        pii_hash(u("country")).alias("country"),
        u("clientIp").alias("client_ip_address"),
        u("userAgent").alias("client_user_agent"),
        u("fbc").alias("fbc"),
        u("fbp").alias("fbp"),
    )
    string_list = T.ArrayType(T.StringType())
    custom_data = F.struct(
        js_or(custom.get("currency", F.lit(None).cast("string")), DEFAULT_CURRENCY, "string").alias("currency"),
        js_or(custom.get("value", F.lit(None).cast("double")), 0.0, "number").alias("value"),
        js_or(custom.get("contentType", F.lit(None).cast("string")), DEFAULT_CONTENT_TYPE, "string")
        .alias("content_type"),
        F.coalesce(custom.get("contentIds", F.lit(None).cast(string_list)), F.array().cast(string_list))
        .alias("content_ids"),
        F.coalesce(custom.get("contents", F.lit(None).cast(CONTENTS)), F.array().cast(CONTENTS)).alias("contents"),
        js_or(custom.get("numItems", F.lit(None).cast("bigint")), F.lit(1).cast("bigint"), "number")
        .alias("num_items"),
        custom.get("orderId", F.lit(None).cast("string")).alias("order_id"),
    )
    return F.struct(
        event_name.alias("event_name"),
        event_time.alias("event_time"),
        F.lit(ACTION_SOURCE).alias("action_source"),
        F.lit(cfg.event_source_url).alias("event_source_url"),
        user_data.alias("user_data"),
        custom_data.alias("custom_data"),
    )


def _meta_user(meta: Column) -> dict[str, Column]:
    return {k: meta[k] for k in ("clientIp", "userAgent", "fbc", "fbp")}


def add_to_cart_conversion(enriched: DataFrame, cfg: PayloadConfig = DEFAULT_CONFIG, keep: tuple[str, ...] = ()) -> DataFrame:
    """E3 (+E5): AddToCart for every 'add' action. Quantity in the payload
    is always 1 and the value is the first price (0 when none). Columns in
    ``keep`` pass by, here and in the other builders that take it."""
    a = enriched.filter(F.col("action") == "add")
    price = _price_units(F.col("first_amount"))
    item_id = _item_id(F.col("sku"), F.col("variant_id"))
    contents = F.array(F.struct(item_id.alias("id"), F.lit(1).cast("bigint").alias("quantity"),
                                price.alias("item_price")))
    payload = conversion_envelope(
        F.lit("AddToCart"), F.unix_timestamp(F.col("ts").cast("timestamp")),
        _meta_user(F.col("metadata")),
        {"currency": F.lit("USD"), "value": price, "contentType": F.lit("product"),
         "contentIds": F.array(item_id), "contents": contents, "numItems": F.lit(1).cast("bigint")}, cfg)
    return a.select("id", *keep, payload.alias("payload"))


def viewed_products(views: DataFrame, catalog: DataFrame) -> DataFrame:
    """Views (one row each) with the viewed product's title, type, sku and
    first price: the event's own variant where it names one, else the
    product's variant with the smallest id, so an event gives one payload
    however many variants the product has."""
    fields = ["variant_id", "sku", "product_title", "product_type", "first_amount"]
    one = catalog.groupBy("product_id").agg(F.min_by(F.struct(*fields), "variant_id").alias("__p"))
    if "variant_id" not in views.columns:
        j = left_join_spread(views, one, "product_id")
        return j.select("*", *[F.col(f"__p.{f}").alias(f) for f in fields]).drop("__p")
    own = catalog.select(F.col("variant_id").alias("__v"), F.struct(*fields).alias("__own"))
    v = left_join_spread(views.withColumnRenamed("variant_id", "__v"), own, "__v")
    j = left_join_spread(v, one, "product_id").withColumn("__p", F.coalesce("__own", "__p"))
    return j.select("*", *[F.col(f"__p.{f}").alias(f) for f in fields]).drop("__p", "__own", "__v")


def view_content_conversion(views: DataFrame, catalog: DataFrame, cfg: PayloadConfig = DEFAULT_CONFIG) -> DataFrame:
    """One ViewContent per view, keyed by the product id; value is the
    first price of the viewed variant (0 when none)."""
    j = viewed_products(views, catalog)
    price = _price_units(F.col("first_amount"))
    pid = F.col("product_id").cast("string")
    contents = F.array(F.struct(pid.alias("id"), F.lit(1).cast("bigint").alias("quantity"),
                                price.alias("item_price")))
    payload = conversion_envelope(
        F.lit("ViewContent"), F.unix_timestamp(F.col("ts").cast("timestamp")), {},
        {"currency": F.lit("USD"), "value": price, "contentType": F.lit("product"),
         "contentIds": F.array(pid), "contents": contents, "numItems": F.lit(1).cast("bigint")}, cfg)
    return j.select("id", payload.alias("payload"))


# -------------------------------------------------------------- orders
#: Lines of an order that one task may hold before the last concatenation.
ITEMS_PER_TASK = 4096
UNNUMBERED_RUNS = 1024
#: Huge orders whose counted ids may be broadcast (8 bytes each).
BROADCAST_ORDERS = 1_000_000


def order_item_rows(line_items: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per order line with its ``position`` (from 0) in the whole
    order, the order of line number, then variant, quantity and price.

    The position is the rank within a run of ``ITEMS_PER_TASK`` line numbers
    plus the sizes of the order's earlier runs, so a huge order is dealt out
    over tasks by (order, run) and never sorted by one of them. Lines without a
    number come first; each variant of theirs is a run.
    """
    number = F.col("line_number")
    run = F.coalesce(F.floor(number / ITEMS_PER_TASK), F.lit(-1)).alias("__run")
    sub = F.when(number.isNull(), F.col("variant_id")).alias("__sub")
    lines = line_items.select("order_id", "line_number", "variant_id", "quantity", "unit_price", run, sub)
    inside = Window.partitionBy("order_id", "__run", "__sub").orderBy("line_number", "variant_id", "quantity", "unit_price")
    earlier = Window.partitionBy("order_id").orderBy("__run", "__sub").rowsBetween(Window.unboundedPreceding, -1)
    sizes = lines.groupBy("order_id", "__run", "__sub").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select(F.col("order_id").alias("__o"), F.col("__run").alias("__r"), F.col("__sub").alias("__s"),
                          F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    placed = lines.withColumn("__rank", F.row_number().over(inside)).join(
        starts, (F.col("order_id") == F.col("__o")) & (F.col("__run") == F.col("__r")) & F.col("__sub").eqNullSafe(F.col("__s")))
    c = catalog.select("variant_id", "sku", F.col("product_title").alias("title"), "product_type")
    return (left_join_spread(placed, c, "variant_id")
            .select("order_id", (F.col("__start") + F.col("__rank") - 1).alias("position"), "line_number", "variant_id",
                    "quantity", "unit_price", "sku", "title", "product_type"))


def order_headers(line_items: DataFrame) -> DataFrame:
    """Per order (``id``): tax total, units and number of lines, from one
    partial aggregate; the item list of a huge order is not needed for it."""
    return line_items.groupBy(F.col("order_id").alias("id")).agg(
        F.sum("tax_total").alias("tax_total"), F.sum(F.col("quantity").cast("bigint")).alias("units"),
        F.count(F.lit(1)).alias("n_items"))


def _item() -> Column:
    """An order line as a struct whose order is the list's: line number first
    (none before all others), the rest breaks ties."""
    return F.struct(F.col("line_number"), F.col("variant_id"), F.col("quantity"), F.col("unit_price"),
                    F.col("sku"), F.col("product_title").alias("title"), F.col("product_type"))


def _whole_lists(lines: DataFrame, partitions: int | None = None) -> DataFrame:
    """id, items, tax_total, units of orders that one task can hold; they stay
    dealt out by order into ``partitions``, if given."""
    if partitions:
        lines = lines.repartition(partitions, "order_id")
    return lines.groupBy(F.col("order_id").alias("id")).agg(
        F.sort_array(F.collect_list(_item())).alias("items"), F.sum("tax_total").alias("tax_total"),
        F.sum(F.col("quantity").cast("bigint")).alias("units"))


def catalogued(line_items: DataFrame, catalog: DataFrame) -> DataFrame:
    """Order lines with sku, title and product type of their variant."""
    return left_join_spread(line_items.select("order_id", "line_number", "variant_id", "quantity", "unit_price", "tax_total"),
                            catalog.select("variant_id", "sku", "product_title", "product_type"), "variant_id")


def lists_by_runs(lines: DataFrame, per_run: int | None = None) -> DataFrame:
    """id and items of huge orders, assembled in two levels: lists of runs of
    ``per_run`` (``ITEMS_PER_TASK``) line numbers, sorted by the tasks that hold
    them, then one concatenation an order. Lines without a number are dealt into
    runs by hash. ``lines`` are :func:`catalogued`."""
    salt = F.pmod(F.xxhash64("variant_id", "quantity", "unit_price"), F.lit(UNNUMBERED_RUNS))
    run = F.coalesce(F.floor(F.col("line_number") / (per_run or ITEMS_PER_TASK)), -1 - salt)
    runs = lines.withColumn("__run", run).groupBy(F.col("order_id").alias("id"), "__run").agg(
        F.sort_array(F.collect_list(_item())).alias("__part"))
    both = runs.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("__run", "__part"))).alias("__runs"))
    part = lambda keep: F.flatten(F.transform(F.filter("__runs", keep), lambda r: r["__part"]))
    return both.select("id", F.concat(F.sort_array(part(lambda r: r["__run"] < 0)), part(lambda r: r["__run"] >= 0)).alias("items"))


def order_items(line_items: DataFrame, catalog: DataFrame, partitions: int | None = None) -> DataFrame:
    """id, items (in line order, each with variant sku and product type),
    tax_total and units of every order with lines.

    Orders of more than ``ITEMS_PER_TASK`` lines are found first, by a count
    that reads one column. Without any, each order is one group. Otherwise
    theirs are assembled by :func:`lists_by_runs` and their sums come from
    :func:`order_headers`, so no aggregate holds the raw lines of a huge order;
    the list itself is one document by definition. With ``partitions`` the
    result is dealt out by order into so many."""
    li = catalogued(line_items, catalog)
    huge = (line_items.groupBy("order_id").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > ITEMS_PER_TASK)
            .select("order_id"))
    with shuffles_dropped(line_items.sparkSession):
        n_huge = huge.count()
    if not n_huge:
        return _whole_lists(li, partitions)
    if n_huge <= BROADCAST_ORDERS:
        huge = F.broadcast(huge)  # counted above
    headers = order_headers(line_items.join(huge, "order_id", "left_semi"))
    big = lists_by_runs(li.join(huge, "order_id", "left_semi")).join(headers.drop("n_items"), "id")
    if partitions:
        big = big.repartition(partitions, "id")
    return _whole_lists(li.join(huge, "order_id", "left_anti"), partitions).unionByName(big.select("id", "items", "tax_total", "units"))


def order_enriched(orders: DataFrame, line_items: DataFrame, catalog: DataFrame,
                   customers: DataFrame, addresses: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per order, whatever its size, with all its items
    (:func:`order_items`), tax total, unit count, customer (optional) and
    shipping address. Work on single items of huge orders uses
    :func:`order_item_rows`, which is dealt out by (order, position). With
    ``partitions`` the items are dealt out as a table of so many buckets is, so
    its writer moves them no second time.
    """
    items = order_items(line_items, catalog, partitions)
    c = customers.select(F.col("id").alias("customer_id"), "email", "phone", "first_name", "last_name",
                         "nation_id")
    # Customer and address first, items last: the result stays
    # hash-partitioned by order id, so joining it to order events shuffles
    # only the (narrow) event side, not the item lists.
    o = (left_join_spread(orders, c, "customer_id").join(addresses, "nation_id", "left")
         .join(items, "id", "left"))
    return o.withColumn("shipping_total", F.lit(None).cast("bigint"))


def placed_orders(orders: DataFrame, order_events: DataFrame, customers: DataFrame | None = None,
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """``order.placed`` events with their enriched order. The customer is the
    event's: a guest event (no customer id) has none, even if the order does;
    one that differs from the order's is looked up in ``customers``, while the
    events are still narrow: no join by customer moves item lists."""
    ev = order_events.filter(F.col("event_name") == "order.placed").select(
        "id", F.col("customer_id").alias("event_customer"), F.col("ts").alias("event_ts"), "metadata", *keep)
    person = [c for c in ("email", "phone", "first_name", "last_name") if c in orders.columns]
    same = F.col("event_customer") == F.col("customer_id")
    if customers is None:
        j = ev.join(orders, "id")
        return j.select(*[c for c in j.columns if c not in person], *[F.when(same, F.col(c)).alias(c) for c in person])
    look = customers.select(F.col("id").alias("event_customer"), F.struct(*person).alias("__person"))
    j = left_join_spread(ev, look, "event_customer").join(orders, "id")
    return j.select(*[c for c in j.columns if c not in (*person, "__person")],
                    *[F.when(same, F.col(c)).otherwise(F.col(f"__person.{c}")).alias(c) for c in person])


def purchase_conversion(orders: DataFrame, order_events: DataFrame, cfg: PayloadConfig = DEFAULT_CONFIG,
                        customers: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """E2 (+E5): one Purchase for every ``order.placed`` event."""
    j = placed_orders(orders, order_events, customers, keep)
    items = F.col("items")
    ids = F.transform(items, lambda x: _item_id(x["sku"], x["variant_id"]))
    contents = F.coalesce(F.transform(items, lambda x: F.struct(
        _item_id(x["sku"], x["variant_id"]).alias("id"), x["quantity"].cast("bigint").alias("quantity"),
        (x["unit_price"] / F.lit(100.0)).alias("item_price"))), F.array().cast(CONTENTS))
    num = F.col("units")  # items.reduce(sum of quantity)
    user = {"email": F.col("email"), "phone": F.col("phone"), "firstName": F.col("first_name"),
            "lastName": F.col("last_name"), "city": F.col("city"), "state": F.col("province"),
            "zip": F.col("postal_code"), "country": F.col("country_code"), **_meta_user(F.col("metadata"))}
    payload = conversion_envelope(
        F.lit("Purchase"), F.unix_timestamp(F.col("event_ts").cast("timestamp")), user,
        {"currency": js_or(F.upper("currency_code"), DEFAULT_CURRENCY, "string"),
         "value": F.col("total") / F.lit(100.0), "contentType": F.lit("product"),
         "contentIds": ids, "contents": contents, "numItems": num,
         "orderId": F.col("id").cast("string")}, cfg)
    return j.select("id", *keep, payload.alias("payload"))


# ------------------------------------------------------ measurement protocol
def generated_client_id(ts: Column, key: Column) -> Column:
    """Replay-safe stand-in for ``${Date.now()}.${random}``: event time in ms
    and nine digits derived from the event key."""
    digits = F.substring(F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 12), 16, 10), 1, 9)
    return F.concat(F.unix_millis(ts.cast("timestamp")).cast("string"), F.lit("."), digits)


def generated_session_id(ts: Column, key: Column) -> Column:
    """Stand-in for ``${Date.now()}_${random base-36}``."""
    return F.concat(F.unix_millis(ts.cast("timestamp")).cast("string"), F.lit("_"),
                    F.substring(F.sha2(F.concat(F.lit("s"), key.cast("string")), 256), 1, 9))


def ga_envelope(name: str, params: list[Column], user_id: Column, session_id: Column, ts: Column,
                key: Column) -> Column:
    """``{client_id, events: [{name, params}]}``; params are the
    session id and engagement time followed by the event's own aliased
    params (none of the built-in events sets those two keys itself)."""
    sid = js_or(session_id, generated_session_id(ts, key), "string")
    base = [sid.alias("session_id"), F.lit(ENGAGEMENT_TIME_MSEC).alias("engagement_time_msec")]
    return F.struct(js_or(user_id, generated_client_id(ts, key), "string").alias("client_id"),
                    F.array(F.struct(F.lit(name).alias("name"), F.struct(*base, *params).alias("params")))
                    .alias("events"))


def _session(meta: Column) -> Column:
    """``sessionId || gaSessionId``."""
    return js_or(meta["sessionId"], js_or(meta["gaSessionId"], F.lit(None).cast("string"), "string"), "string")


def ga_cart(enriched: DataFrame, action: str, cfg: PayloadConfig = DEFAULT_CONFIG, keep: tuple[str, ...] = ()) -> DataFrame:
    """add_to_cart or remove_from_cart (removals go to this format
    only); value = first price x quantity."""
    a = enriched.filter(F.col("action") == action).withColumn("quantity", F.coalesce("quantity", F.lit(1)))
    price = _price_units(F.col("first_amount"))
    item = F.struct(_item_id(F.col("sku"), F.col("variant_id")).alias("item_id"),
                    F.col("product_title").alias("item_name"),
                    F.lit(cfg.item_affiliation).alias("affiliation"),
                    js_or(F.col("product_type"), cfg.default_category, "string").alias("category"),
                    F.col("quantity").alias("quantity"), price.alias("price"))
    params = [F.lit("USD").alias("currency"), (price * F.col("quantity")).alias("value"),
              F.array(item).alias("items")]
    name = "add_to_cart" if action == "add" else "remove_from_cart"
    payload = ga_envelope(name, params, F.col("metadata.userId"), _session(F.col("metadata")), F.col("ts"),
                          F.col("id"))
    return a.select("id", *keep, payload.alias("payload"))


def ga_purchase(orders: DataFrame, order_events: DataFrame, cfg: PayloadConfig = DEFAULT_CONFIG, keep: tuple[str, ...] = ()) -> DataFrame:
    """Purchase with transaction id, value, shipping, tax and indexed items."""
    j = placed_orders(orders, order_events, keep=keep)
    items = F.transform(F.col("items"), lambda x, i: F.struct(
        _item_id(x["sku"], x["variant_id"]).alias("item_id"), x["title"].alias("item_name"),
        F.lit(cfg.item_affiliation).alias("affiliation"),
        js_or(x["product_type"], cfg.default_category, "string").alias("category"),
        x["quantity"].alias("quantity"), (x["unit_price"] / F.lit(100.0)).alias("price"), i.alias("index")))
    params = [
        js_or(F.upper("currency_code"), DEFAULT_CURRENCY, "string").alias("currency"),
        F.col("id").cast("string").alias("transaction_id"),
        (F.col("total") / F.lit(100.0)).alias("value"),
        F.lit(cfg.store_affiliation).alias("affiliation"),
        (F.col("shipping_total") / F.lit(100.0)).alias("shipping"),
        (F.col("tax_total") / F.lit(100.0)).alias("tax"),
        F.coalesce(items, F.array().cast(GA_ITEMS)).alias("items")]
    payload = ga_envelope("purchase", params, F.col("event_customer").cast("string"), _session(F.col("metadata")),
                          F.col("event_ts"), F.col("id"))
    return j.select("id", *keep, payload.alias("payload"))


def ga_view_item(views: DataFrame, catalog: DataFrame, cfg: PayloadConfig = DEFAULT_CONFIG) -> DataFrame:
    """One view_item per view; item id is sku, else variant id, else product id."""
    j = viewed_products(views, catalog)
    price = _price_units(F.col("first_amount"))
    item_id = js_or(F.col("sku"), js_or(F.col("variant_id").cast("string"), F.col("product_id").cast("string"),
                                        "string"), "string")
    item = F.struct(item_id.alias("item_id"), F.col("product_title").alias("item_name"),
                    F.lit(cfg.item_affiliation).alias("affiliation"),
                    js_or(F.col("product_type"), cfg.default_category, "string").alias("category"),
                    price.alias("price"))
    params = [F.lit("USD").alias("currency"), price.alias("value"), F.array(item).alias("items")]
    payload = ga_envelope("view_item", params, F.col("user_id"), F.col("session_id"), F.col("ts"), F.col("id"))
    return j.select("id", payload.alias("payload"))


def ga_begin_checkout(orders: DataFrame, region_currency: Column, cfg: PayloadConfig = DEFAULT_CONFIG) -> DataFrame:
    """begin_checkout for a cart (here: an order's items) with the
    currency of the buyer's region."""
    items = F.transform(F.col("items"), lambda x, i: F.struct(
        _item_id(x["sku"], x["variant_id"]).alias("item_id"), x["title"].alias("item_name"),
        F.lit(cfg.item_affiliation).alias("affiliation"),
        js_or(x["product_type"], cfg.default_category, "string").alias("category"),
        x["quantity"].alias("quantity"), (x["unit_price"] / F.lit(100.0)).alias("price"), i.alias("index")))
    params = [js_or(F.upper(region_currency), DEFAULT_CURRENCY, "string").alias("currency"),
              (F.col("total") / F.lit(100.0)).alias("value"), F.coalesce(items, F.array().cast(GA_ITEMS)).alias("items")]
    payload = ga_envelope("begin_checkout", params, F.col("customer_id").cast("string"),
                          F.lit(None).cast("string"), F.col("created_at"), F.col("id"))
    return orders.select("id", payload.alias("payload"))


def ga_search(searches: DataFrame, products: DataFrame) -> DataFrame:
    """Search with its term."""
    j = left_join_spread(searches, products.select(F.col("id").alias("product_id"), F.col("title").alias("term")), "product_id")
    params = [F.col("term").alias("search_term")]
    payload = ga_envelope("search", params, F.col("user_id"), F.lit(None).cast("string"), F.col("ts"), F.col("id"))
    return j.select("id", payload.alias("payload"))


# --------------------------------------------------------------- lifecycle
def order_lifecycle_log(order_events: DataFrame) -> DataFrame:
    """One log line per lifecycle event (event_name, order_id, ts)."""
    return order_events.select("event_name", F.col("id").alias("order_id"), "ts")
