"""Registered event queries (SRC4, SRC5, J11, J12, E1-E16) in batch form.

Payload structs are compared flat: scalar fields as columns, lists as
comma-joined ids. The streaming versions run the same functions on
``readStream`` input (see ``cartwheel.streaming``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwheel.operators import payloads as pl
from cartwheel.plans.registry import commerce, register, with_views
from cartwheel.sources import events as ev
from cartwheel.sources.layout import written
from cartwheel.streaming import limiter, rate_limit as rl

# ----------------------------------------------------------- SQL mappings
ORDER_EVENT_CTE = ("co_order_event", """
    SELECT 'order.placed' AS event_name, o_orderkey AS id, o_custkey AS customer_id, o_orderdate AS ts,
           o_orderpriority AS prio FROM orders
    UNION ALL
    SELECT 'order.payment_captured', o_orderkey, o_custkey, o_orderdate + INTERVAL 1 DAY, o_orderpriority
    FROM orders WHERE o_orderstatus = 'P'
    UNION ALL
    SELECT 'order.canceled', o_orderkey, o_custkey, o_orderdate + INTERVAL 1 DAY, o_orderpriority
    FROM orders WHERE o_orderstatus = 'F'""")

CART_EVENT_CTE = ("co_cart_event", """
    SELECT CASE event_type WHEN 'click' THEN 'cart.item_added' WHEN 'error' THEN 'cart.item_removed'
                ELSE 'cart.item_updated' END AS event_name,
           event_id AS id, ts,
           CASE WHEN event_type = 'purchase' THEN CAST(floor(value * 10) AS INTEGER) % 10 END AS previous_quantity,
           CAST(json_extract_string(props, '$.k') AS BIGINT) AS variant_id,
           CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS INTEGER) % 10
                ELSE CAST(floor(value / 25) AS INTEGER) + 1 END AS quantity,
           CAST(user_id AS VARCHAR) AS user_id,
           's' || CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS session_id
    FROM events WHERE event_type IN ('click', 'error', 'purchase')""")

CART_DELTA_CTE = ("co_cart_action", """
    SELECT id, ts,
           CASE WHEN event_name = 'cart.item_added' THEN 'add' WHEN event_name = 'cart.item_removed' THEN 'remove'
                WHEN quantity - previous_quantity > 0 THEN 'add'
                WHEN quantity - previous_quantity < 0 THEN 'remove' END AS action,
           variant_id,
           CASE WHEN event_name = 'cart.item_updated' THEN abs(quantity - previous_quantity) ELSE quantity END
             AS quantity,
           user_id, session_id
    FROM co_cart_event""")

CATALOG_CTE = ("co_catalog", """
    SELECT v.id AS variant_id, v.product_id, v.sku, p.title AS product_title, p.type AS product_type,
           fp.amount AS first_amount
    FROM co_variant v JOIN co_product p ON v.product_id = p.id
    LEFT JOIN (SELECT variant_id, amount FROM (
                 SELECT variant_id, amount,
                        row_number() OVER (PARTITION BY variant_id ORDER BY currency_code, amount) AS rn
                 FROM co_price) WHERE rn = 1) fp ON v.id = fp.variant_id""")

ENRICHED_CTE = ("co_cart_enriched", """
    SELECT a.*, c.product_id, c.sku, c.product_title, c.product_type, c.first_amount
    FROM co_cart_action a JOIN co_catalog c ON a.variant_id = c.variant_id
    WHERE a.action IS NOT NULL""")

ADDRESS_CTE = ("co_address", """
    SELECT n.n_nationkey AS nation_id, n.n_name AS city, r.r_name AS province,
           'PC' || lpad(CAST(n.n_nationkey AS VARCHAR), 3, '0') AS postal_code,
           'N' || lpad(CAST(n.n_nationkey AS VARCHAR), 2, '0') AS country_code
    FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey""")

ORDER_ENRICHED_CTE = ("co_order_enriched", """
    SELECT o.id, o.customer_id, o.total, o.currency_code, o.created_at,
           i.n_items, i.item_ids, i.categories, i.units, i.tax_total,
           c.email, c.phone, c.first_name, c.last_name, a.city, a.province, a.postal_code, a.country_code,
           CAST(NULL AS BIGINT) AS shipping_total, lower(substr(rg.r_name, 1, 3)) AS region_currency
    FROM co_order o
    LEFT JOIN (SELECT li.order_id, COUNT(*) AS n_items,
                      string_agg(coalesce(nullif(k.sku, ''), CAST(li.variant_id AS VARCHAR)), ',' ORDER BY li.line_number, li.variant_id, li.quantity, li.unit_price, k.sku, k.product_title, k.product_type)
                        AS item_ids,
                      string_agg(coalesce(nullif(k.product_type, ''), 'General'), ',' ORDER BY li.line_number, li.variant_id, li.quantity, li.unit_price, k.sku, k.product_title, k.product_type) AS categories,
                      SUM(li.quantity) AS units, SUM(li.tax_total) AS tax_total
               FROM co_line_item li LEFT JOIN co_catalog k ON li.variant_id = k.variant_id
               GROUP BY li.order_id) i ON o.id = i.order_id
    LEFT JOIN co_customer c ON o.customer_id = c.id
    LEFT JOIN co_address a ON c.nation_id = a.nation_id
    LEFT JOIN nation n2 ON c.nation_id = n2.n_nationkey
    LEFT JOIN region rg ON n2.n_regionkey = rg.r_regionkey""")

CART_VIEWS = ("co_variant", "co_product", "co_price")
CART_EXTRA = (CART_EVENT_CTE, CART_DELTA_CTE, CATALOG_CTE, ENRICHED_CTE)
ORDER_VIEWS = ("co_order", "co_line_item", "co_customer", "co_variant", "co_product", "co_price")
ORDER_EXTRA = (ORDER_EVENT_CTE, CATALOG_CTE, ADDRESS_CTE, ORDER_ENRICHED_CTE)


def js_millis_sql(ts: str) -> str:
    return f"CAST(epoch_us({ts}) // 1000 AS VARCHAR)"


def gen_client_sql(ts: str, key: str) -> str:
    return (f"{js_millis_sql(ts)} || '.' || substr(CAST(CAST(('0x' || substr(sha256(CAST({key} AS VARCHAR)), 1, 12))"
            f" AS UBIGINT) AS VARCHAR), 1, 9)")


def gen_session_sql(ts: str, key: str) -> str:
    return f"{js_millis_sql(ts)} || '_' || substr(sha256('s' || CAST({key} AS VARCHAR)), 1, 9)"


def hash_sql(c: str, lower: bool = True) -> str:
    v = f"lower({c})" if lower else c
    return f"CASE WHEN {c} IS NOT NULL AND {c} <> '' THEN sha256({v}) END"


# ---------------------------------------------------------- Spark helpers
def _catalog(c):
    return pl.variant_catalog(c.variants, c.products, c.prices)


class _Shared:
    """The shop's tables with the catalogue written once, for a query that
    builds several kinds of payload: no branch joins the catalogue anew."""

    def __init__(self, c):
        self._c = c
        self.catalog = written(_catalog(c), "shared-catalog")

    def __getattr__(self, name):
        return getattr(self._c, name)


def _shop(spark, sf_dir, shared):
    return commerce(spark, sf_dir) if shared is None else shared


def _catalog_of(c) -> DataFrame:
    return c.catalog if isinstance(c, _Shared) else _catalog(c)


def _cart_enriched(c) -> DataFrame:
    actions = pl.cart_delta(ev.cart_events(c.raw("events")))
    return pl.cart_enriched(actions, _catalog_of(c))


def _addresses(c) -> DataFrame:
    n, r = c.raw("nation"), c.raw("region")
    code = F.lpad(F.col("n_nationkey").cast("string"), 3, "0")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").alias("nation_id"), F.col("n_name").alias("city"), F.col("r_name").alias("province"),
        F.concat(F.lit("PC"), code).alias("postal_code"),
        F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("country_code"),
        F.lower(F.substring("r_name", 1, 3)).alias("region_currency"))


def _orders_enriched(c, partitions: int | None = None) -> DataFrame:
    return pl.order_enriched(c.orders, c.line_items, _catalog_of(c), c.customers, _addresses(c), partitions)


def _order_events(c) -> DataFrame:
    return ev.order_events(c.raw("orders"))


def _ids(items, field="item_id"):
    return F.array_join(F.transform(items, lambda x: x[field]), ",")


# ---------------------------------------------------------------- sources
@register("order_event_source", with_views("""
    SELECT event_name, id, customer_id, ts,
           CASE WHEN prio <> '1-URGENT' THEN 's' || CAST(id AS VARCHAR) END AS session_id,
           'ga' || CAST(id AS VARCHAR) AS ga_session_id
    FROM co_order_event""", extra=(ORDER_EVENT_CTE,)))
def order_event_source(spark, sf_dir):
    e = _order_events(commerce(spark, sf_dir))
    return e.select("event_name", "id", "customer_id", "ts", F.col("metadata.sessionId").alias("session_id"),
                    F.col("metadata.gaSessionId").alias("ga_session_id"))


@register("cart_event_source", with_views("SELECT * FROM co_cart_event", extra=(CART_EVENT_CTE,)))
def cart_event_source(spark, sf_dir):
    e = ev.cart_events(commerce(spark, sf_dir).raw("events"))
    return e.select("event_name", "id", "ts", F.col("previousQuantity").alias("previous_quantity"),
                    F.col("item.variant_id").alias("variant_id"), F.col("item.quantity").alias("quantity"),
                    F.col("item.metadata.userId").alias("user_id"),
                    F.col("item.metadata.sessionId").alias("session_id"))


@register("cart_delta", with_views("""
    SELECT id, ts, action, variant_id, quantity FROM co_cart_action WHERE action IS NOT NULL""",
    extra=(CART_EVENT_CTE, CART_DELTA_CTE)))
def cart_delta(spark, sf_dir):
    e = ev.cart_events(commerce(spark, sf_dir).raw("events"))
    return pl.cart_delta(e).select("id", "ts", "action", "variant_id", "quantity")


# ------------------------------------------------------------ enrichment
@register("cart_enriched", with_views("""
    SELECT id, action, variant_id, quantity, product_id, sku, product_title, product_type, first_amount
    FROM co_cart_enriched""", *CART_VIEWS, extra=CART_EXTRA))
def cart_enriched(spark, sf_dir):
    return _cart_enriched(commerce(spark, sf_dir)).select(
        "id", "action", "variant_id", "quantity", "product_id", "sku", "product_title", "product_type",
        "first_amount")


@register("order_enriched", with_views("""
    SELECT id, customer_id, total, coalesce(n_items, 0) AS n_items, coalesce(item_ids, '') AS item_ids,
           tax_total, email, city, province, postal_code, country_code
    FROM co_order_enriched""", *ORDER_VIEWS, extra=ORDER_EXTRA))
def order_enriched(spark, sf_dir):
    o = _orders_enriched(commerce(spark, sf_dir))
    items = F.coalesce(F.col("items"), F.array())
    return o.select("id", "customer_id", "total", F.size(items).cast("bigint").alias("n_items"),
                    F.array_join(F.transform(items, lambda x: F.coalesce(
                        F.when(x["sku"] != "", x["sku"]), x["variant_id"].cast("string"))), ",").alias("item_ids"),
                    "tax_total", "email", "city", "province", "postal_code", "country_code")


@register("order_item_rows", with_views("""
    SELECT li.order_id, row_number() OVER (PARTITION BY li.order_id
               ORDER BY li.line_number, li.variant_id, li.quantity, li.unit_price) - 1 AS position,
           li.line_number, li.variant_id, li.quantity, li.unit_price, k.sku, k.product_title AS title
    FROM co_line_item li LEFT JOIN co_catalog k ON k.variant_id = li.variant_id""", *ORDER_VIEWS, extra=(CATALOG_CTE,)))
def order_item_rows(spark, sf_dir):
    """J11 by item: position in the whole order, dealt out by (order, run)."""
    c = commerce(spark, sf_dir)
    return pl.order_item_rows(c.line_items, _catalog(c)).drop("product_type")


@register("order_headers", with_views("""
    SELECT order_id AS id, sum(tax_total) AS tax_total, sum(quantity) AS units, count(*) AS n_items
    FROM co_line_item GROUP BY order_id""", "co_line_item"))
def order_headers(spark, sf_dir):
    return pl.order_headers(commerce(spark, sf_dir).line_items)


# ------------------------------------------------------- pixel payloads
PIXEL_COLS = ["id", "event_name", "event_time", "action_source", "event_source_url", "em", "ph", "fn", "ln",
              "ct", "st", "zp", "country", "client_ip_address", "client_user_agent", "fbc", "fbp", "currency",
              "value", "content_type", "content_ids", "n_contents", "num_items", "order_id"]


def _pixel_flat(df: DataFrame) -> DataFrame:
    p = F.col("payload")
    u, cd = p["user_data"], p["custom_data"]
    return df.select(
        "id", p["event_name"].alias("event_name"), p["event_time"].alias("event_time"),
        p["action_source"].alias("action_source"), p["event_source_url"].alias("event_source_url"),
        *[u[k].alias(k) for k in ("em", "ph", "fn", "ln", "ct", "st", "zp", "country", "client_ip_address",
                                  "client_user_agent", "fbc", "fbp")],
        cd["currency"].alias("currency"), cd["value"].alias("value"), cd["content_type"].alias("content_type"),
        F.array_join(cd["content_ids"], ",").alias("content_ids"),
        F.size(cd["contents"]).cast("bigint").alias("n_contents"),
        cd["num_items"].alias("num_items"), cd["order_id"].alias("order_id"))


def _pixel_sql(event_name: str, source: str, user: dict, custom: dict) -> str:
    def g(d, k, default="NULL"):
        return d.get(k, default)
    return f"""
    SELECT id, '{event_name}' AS event_name, {g(custom, 'event_time')} AS event_time,
           'website' AS action_source, '{pl.DEFAULT_CONFIG.event_source_url}' AS event_source_url,
           {hash_sql(g(user, 'email', 'CAST(NULL AS VARCHAR)'))} AS em,
           {hash_sql(g(user, 'phone', 'CAST(NULL AS VARCHAR)'), lower=False)} AS ph,
           {hash_sql(g(user, 'first_name', 'CAST(NULL AS VARCHAR)'))} AS fn,
           {hash_sql(g(user, 'last_name', 'CAST(NULL AS VARCHAR)'))} AS ln,
           {hash_sql(g(user, 'city', 'CAST(NULL AS VARCHAR)'))} AS ct,
           {hash_sql(g(user, 'province', 'CAST(NULL AS VARCHAR)'))} AS st,
           {hash_sql(g(user, 'postal_code', 'CAST(NULL AS VARCHAR)'), lower=False)} AS zp,
           {hash_sql(g(user, 'country_code', 'CAST(NULL AS VARCHAR)'))} AS country,
           CAST(NULL AS VARCHAR) AS client_ip_address, CAST(NULL AS VARCHAR) AS client_user_agent,
           CAST(NULL AS VARCHAR) AS fbc, {g(user, 'fbp', 'CAST(NULL AS VARCHAR)')} AS fbp,
           {custom['currency']} AS currency,
           CASE WHEN {custom['value']} <> 0 AND NOT isnan({custom['value']}) THEN {custom['value']} ELSE 0.0 END
             AS value,
           'product' AS content_type, {custom['content_ids']} AS content_ids,
           CAST({custom['n_contents']} AS BIGINT) AS n_contents,
           CAST(CASE WHEN {custom['num_items']} <> 0 THEN {custom['num_items']} ELSE 1 END AS BIGINT) AS num_items,
           {g(custom, 'order_id', 'CAST(NULL AS VARCHAR)')} AS order_id
    FROM {source}"""


ADD_TO_CART_SQL = _pixel_sql(
    "AddToCart", "co_cart_enriched WHERE action = 'add'", {},
    {"event_time": "epoch_us(ts) // 1000000", "currency": "'USD'",
     "value": "coalesce(first_amount / 100.0, 0.0)",
     "content_ids": "coalesce(nullif(sku, ''), CAST(variant_id AS VARCHAR))", "n_contents": "1", "num_items": "1"})

PURCHASE_SQL = _pixel_sql(
    "Purchase", "co_order_enriched JOIN (SELECT id AS eid, ts FROM co_order_event WHERE event_name = 'order.placed') "
                "e ON co_order_enriched.id = e.eid",
    {"email": "email", "phone": "phone", "first_name": "first_name", "last_name": "last_name", "city": "city",
     "province": "province", "postal_code": "postal_code", "country_code": "country_code",
     "fbp": "'fb.1.' || CAST(customer_id AS VARCHAR)"},
    {"event_time": "epoch_us(ts) // 1000000", "currency": "coalesce(nullif(upper(currency_code), ''), 'USD')",
     "value": "coalesce(total / 100.0, 0.0)", "content_ids": "coalesce(item_ids, '')",
     "n_contents": "coalesce(n_items, 0)", "num_items": "coalesce(units, 0)",
     "order_id": "CAST(id AS VARCHAR)"})


@register("add_to_cart_conversion", with_views(ADD_TO_CART_SQL, *CART_VIEWS, extra=CART_EXTRA))
def add_to_cart_conversion(spark, sf_dir, shared=None):
    return _pixel_flat(pl.add_to_cart_conversion(_cart_enriched(_shop(spark, sf_dir, shared))))


@register("order_lists_by_runs", with_views("""
    SELECT id, n_items, item_ids FROM co_order_enriched WHERE n_items IS NOT NULL""", *ORDER_VIEWS, extra=ORDER_EXTRA))
def order_lists_by_runs(spark, sf_dir):
    """Every order's list, assembled as a huge order's is, from runs of two lines."""
    c = commerce(spark, sf_dir)
    lists = pl.lists_by_runs(pl.catalogued(c.line_items, _catalog(c)), per_run=2)
    ids = F.transform("items", lambda x: F.coalesce(F.when(x["sku"] != "", x["sku"]), x["variant_id"].cast("string")))
    return lists.select("id", F.size("items").cast("bigint").alias("n_items"), F.array_join(ids, ",").alias("item_ids"))


@register("purchase_conversion", with_views(PURCHASE_SQL, *ORDER_VIEWS, extra=ORDER_EXTRA))
def purchase_conversion(spark, sf_dir, shared=None):
    c = _shop(spark, sf_dir, shared)
    return _pixel_flat(pl.purchase_conversion(_orders_enriched(c), _order_events(c)))


VIEW_SQL_CTE = ("co_view", """
    SELECT event_id AS id, ts, CAST(user_id AS VARCHAR) AS user_id,
           CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id,
           's' || CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS session_id
    FROM events WHERE event_type = 'view'""")

# one variant, that with the smallest id, stands for a viewed product
VIEWED_CTE = ("co_viewed", """
    SELECT * FROM co_catalog QUALIFY variant_id = min(variant_id) OVER (PARTITION BY product_id)""")

VIEW_CONTENT_SQL = _pixel_sql(
    "ViewContent", "co_view v LEFT JOIN co_viewed k ON v.product_id = k.product_id", {},
    {"event_time": "epoch_us(v.ts) // 1000000", "currency": "'USD'",
     "value": "coalesce(k.first_amount / 100.0, 0.0)", "content_ids": "CAST(v.product_id AS VARCHAR)",
     "n_contents": "1", "num_items": "1"}).replace("SELECT id,", "SELECT v.id AS id,", 1)


@register("view_content_conversion", with_views(VIEW_CONTENT_SQL, *CART_VIEWS, extra=(CATALOG_CTE, VIEWED_CTE, VIEW_SQL_CTE)))
def view_content_conversion(spark, sf_dir, shared=None):
    c = _shop(spark, sf_dir, shared)
    return _pixel_flat(pl.view_content_conversion(ev.view_events(c.raw("events")), _catalog_of(c)))


@register("conversion_envelope", with_views(
    f"{ADD_TO_CART_SQL}\nUNION ALL\n{PURCHASE_SQL}\nUNION ALL\n{VIEW_CONTENT_SQL}",
    *ORDER_VIEWS, extra=ORDER_EXTRA + (CART_EVENT_CTE, CART_DELTA_CTE, ENRICHED_CTE, VIEWED_CTE, VIEW_SQL_CTE)))
def conversion_envelope(spark, sf_dir):
    """E5 over every pixel conversion (AddToCart, Purchase, ViewContent)."""
    shared = _Shared(commerce(spark, sf_dir))
    return (add_to_cart_conversion(spark, sf_dir, shared).unionByName(purchase_conversion(spark, sf_dir, shared))
            .unionByName(view_content_conversion(spark, sf_dir, shared)))


# ------------------------------------------------- measurement protocol
GA_COLS = ["id", "name", "client_id", "session_id", "engagement_time_msec"]


def _ga_base(df: DataFrame) -> list:
    e = F.col("payload.events")[0]
    return ["id", e["name"].alias("name"), F.col("payload.client_id").alias("client_id"),
            e["params"]["session_id"].alias("session_id"),
            e["params"]["engagement_time_msec"].alias("engagement_time_msec")]


def _ga_cart_flat(df: DataFrame) -> DataFrame:
    prm = F.col("payload.events")[0]["params"]
    item = prm["items"][0]
    return df.select(*_ga_base(df), prm["currency"].alias("currency"), prm["value"].alias("value"),
                     item["item_id"].alias("item_id"), item["item_name"].alias("item_name"),
                     item["affiliation"].alias("affiliation"), item["category"].alias("category"),
                     item["quantity"].alias("quantity"), item["price"].alias("price"))


def _ga_cart_sql(action: str, name: str) -> str:
    return f"""
    SELECT id, '{name}' AS name, coalesce(nullif(user_id, ''), {gen_client_sql('ts', 'id')}) AS client_id,
           coalesce(nullif(session_id, ''), {gen_session_sql('ts', 'id')}) AS session_id,
           100 AS engagement_time_msec, 'USD' AS currency,
           coalesce(first_amount / 100.0, 0.0) * quantity AS value,
           coalesce(nullif(sku, ''), CAST(variant_id AS VARCHAR)) AS item_id, product_title AS item_name,
           '{pl.DEFAULT_CONFIG.item_affiliation}' AS affiliation,
           coalesce(nullif(product_type, ''), '{pl.DEFAULT_CONFIG.default_category}') AS category,
           quantity, coalesce(first_amount / 100.0, 0.0) AS price
    FROM co_cart_enriched WHERE action = '{action}'"""


@register("ga_add_to_cart", with_views(_ga_cart_sql("add", "add_to_cart"), *CART_VIEWS, extra=CART_EXTRA))
def ga_add_to_cart(spark, sf_dir, shared=None):
    return _ga_cart_flat(pl.ga_cart(_cart_enriched(_shop(spark, sf_dir, shared)), "add"))


@register("ga_remove_from_cart", with_views(_ga_cart_sql("remove", "remove_from_cart"), *CART_VIEWS,
                                            extra=CART_EXTRA))
def ga_remove_from_cart(spark, sf_dir, shared=None):
    return _ga_cart_flat(pl.ga_cart(_cart_enriched(_shop(spark, sf_dir, shared)), "remove"))


GA_PURCHASE_SQL = f"""
    SELECT o.id, 'purchase' AS name,
           coalesce(nullif(CAST(o.customer_id AS VARCHAR), ''), {gen_client_sql('e.ts', 'o.id')}) AS client_id,
           coalesce(e.session_id, {gen_session_sql('e.ts', 'o.id')}) AS session_id,
           100 AS engagement_time_msec,
           coalesce(nullif(upper(o.currency_code), ''), 'USD') AS currency,
           CAST(o.id AS VARCHAR) AS transaction_id, o.total / 100.0 AS value,
           '{pl.DEFAULT_CONFIG.store_affiliation}' AS affiliation,
           o.shipping_total / 100.0 AS shipping, o.tax_total / 100.0 AS tax,
           coalesce(o.n_items, 0) AS n_items, coalesce(o.item_ids, '') AS item_ids,
           coalesce(o.categories, '') AS categories
    FROM co_order_enriched o
    JOIN (SELECT id, ts, coalesce(CASE WHEN prio <> '1-URGENT' THEN 's' || CAST(id AS VARCHAR) END,
                                  'ga' || CAST(id AS VARCHAR)) AS session_id
          FROM co_order_event WHERE event_name = 'order.placed') e ON o.id = e.id"""


@register("ga_purchase", with_views(GA_PURCHASE_SQL, *ORDER_VIEWS, extra=ORDER_EXTRA))
def ga_purchase(spark, sf_dir, shared=None):
    c = _shop(spark, sf_dir, shared)
    df = pl.ga_purchase(_orders_enriched(c), _order_events(c))
    prm = F.col("payload.events")[0]["params"]
    return df.select(*_ga_base(df), prm["currency"].alias("currency"),
                     prm["transaction_id"].alias("transaction_id"), prm["value"].alias("value"),
                     prm["affiliation"].alias("affiliation"), prm["shipping"].alias("shipping"),
                     prm["tax"].alias("tax"), F.size(prm["items"]).cast("bigint").alias("n_items"),
                     _ids(prm["items"]).alias("item_ids"), _ids(prm["items"], "category").alias("categories"))


GA_VIEW_ITEM_SQL = f"""
    SELECT v.id, 'view_item' AS name, coalesce(nullif(v.user_id, ''), {gen_client_sql('v.ts', 'v.id')}) AS client_id,
           coalesce(nullif(v.session_id, ''), {gen_session_sql('v.ts', 'v.id')}) AS session_id,
           100 AS engagement_time_msec, 'USD' AS currency, coalesce(k.first_amount / 100.0, 0.0) AS value,
           coalesce(nullif(k.sku, ''), nullif(CAST(k.variant_id AS VARCHAR), ''), CAST(v.product_id AS VARCHAR))
             AS item_id,
           k.product_title AS item_name,
           coalesce(nullif(k.product_type, ''), '{pl.DEFAULT_CONFIG.default_category}') AS category
    FROM co_view v LEFT JOIN co_viewed k ON v.product_id = k.product_id"""


@register("ga_view_item", with_views(GA_VIEW_ITEM_SQL, *CART_VIEWS, extra=(CATALOG_CTE, VIEWED_CTE, VIEW_SQL_CTE)))
def ga_view_item(spark, sf_dir, shared=None):
    c = _shop(spark, sf_dir, shared)
    df = pl.ga_view_item(ev.view_events(c.raw("events")), _catalog_of(c))
    prm = F.col("payload.events")[0]["params"]
    item = prm["items"][0]
    return df.select(*_ga_base(df), prm["currency"].alias("currency"), prm["value"].alias("value"),
                     item["item_id"].alias("item_id"), item["item_name"].alias("item_name"),
                     item["category"].alias("category"))


GA_BEGIN_CHECKOUT_SQL = f"""
    SELECT id, 'begin_checkout' AS name,
           coalesce(nullif(CAST(customer_id AS VARCHAR), ''), {gen_client_sql('created_at', 'id')}) AS client_id,
           {gen_session_sql('created_at', 'id')} AS session_id, 100 AS engagement_time_msec,
           coalesce(nullif(upper(region_currency), ''), 'USD') AS currency, total / 100.0 AS value,
           coalesce(n_items, 0) AS n_items, coalesce(item_ids, '') AS item_ids
    FROM co_order_enriched"""


@register("ga_begin_checkout", with_views(GA_BEGIN_CHECKOUT_SQL, *ORDER_VIEWS, extra=ORDER_EXTRA))
def ga_begin_checkout(spark, sf_dir, shared=None):
    o = _orders_enriched(_shop(spark, sf_dir, shared))
    df = pl.ga_begin_checkout(o, F.col("region_currency"))
    prm = F.col("payload.events")[0]["params"]
    return df.select(*_ga_base(df), prm["currency"].alias("currency"), prm["value"].alias("value"),
                     F.size(prm["items"]).cast("bigint").alias("n_items"), _ids(prm["items"]).alias("item_ids"))


GA_SEARCH_SQL = f"""
    SELECT s.id, 'search' AS name,
           coalesce(nullif(s.user_id, ''), {gen_client_sql('s.ts', 's.id')}) AS client_id,
           {gen_session_sql('s.ts', 's.id')} AS session_id, 100 AS engagement_time_msec, p.title AS search_term
    FROM (SELECT event_id AS id, ts, CAST(user_id AS VARCHAR) AS user_id,
                 CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id
          FROM events WHERE event_type = 'signup') s
    LEFT JOIN co_product p ON s.product_id = p.id"""


@register("ga_search", with_views(GA_SEARCH_SQL, "co_product"))
def ga_search(spark, sf_dir, shared=None):
    c = _shop(spark, sf_dir, shared)
    df = pl.ga_search(ev.search_events(c.raw("events")), c.products)
    prm = F.col("payload.events")[0]["params"]
    return df.select(*_ga_base(df), prm["search_term"].alias("search_term"))


def _ga_envelope_sql() -> str:
    parts = [_ga_cart_sql("add", "add_to_cart"), _ga_cart_sql("remove", "remove_from_cart"), GA_PURCHASE_SQL,
             GA_VIEW_ITEM_SQL, GA_BEGIN_CHECKOUT_SQL, GA_SEARCH_SQL]
    cols = ", ".join(GA_COLS)
    return "\nUNION ALL\n".join(f"SELECT {cols} FROM ({p})" for p in parts)


@register("ga_envelope", with_views(_ga_envelope_sql(), *ORDER_VIEWS,
                                    extra=ORDER_EXTRA + (CART_EVENT_CTE, CART_DELTA_CTE, ENRICHED_CTE, VIEWED_CTE, VIEW_SQL_CTE)))
def ga_envelope(spark, sf_dir):
    """E12 over every measurement-protocol event: client id, session id and
    engagement time of each payload."""
    out, shared = None, _Shared(commerce(spark, sf_dir))
    for fn in (ga_add_to_cart, ga_remove_from_cart, ga_purchase, ga_view_item, ga_begin_checkout, ga_search):
        part = fn(spark, sf_dir, shared).select(*GA_COLS)
        out = part if out is None else out.unionByName(part)
    return out


# ------------------------------------------------------------- lifecycle
@register("order_lifecycle_log", with_views("""
    SELECT event_name, COUNT(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts
    FROM co_order_event GROUP BY event_name""", extra=(ORDER_EVENT_CTE,)))
def order_lifecycle_log(spark, sf_dir):
    log = pl.order_lifecycle_log(_order_events(commerce(spark, sf_dir)))
    return log.groupBy("event_name").agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("first_ts"),
                                         F.max("ts").alias("last_ts"))


RATE_SQL = """
    SELECT CAST(user_id AS VARCHAR) AS client,
           CASE WHEN event_type IN ('signup', 'error') THEN 'admin' ELSE 'store' END AS scope,
           time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') AS window_start,
           time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') + INTERVAL 15 MINUTE AS window_end,
           COUNT(*) AS requests
    FROM events {where} GROUP BY ALL"""
# The test log is far below the shop's limits; these give violations in it.
TEST_LIMITS = {"admin": 0, "store": 1}


@register("request_rate_windows", with_views(RATE_SQL.format(where="")))
def request_rate_windows(spark, sf_dir):
    log = ev.request_log(commerce(spark, sf_dir).raw("events"))
    return rl.request_windows(log)


@register("rate_limit_violations", with_views(f"""
    SELECT * FROM ({RATE_SQL.format(where="WHERE event_type <> 'signup'")})
    WHERE requests > CASE scope WHEN 'admin' THEN {TEST_LIMITS['admin']} ELSE {TEST_LIMITS['store']} END"""))
def rate_limit_violations(spark, sf_dir):
    """Limits per scope; the admin login (signups of the log) is not counted."""
    log = ev.request_log(commerce(spark, sf_dir).raw("events"))
    return rl.rate_limit_violations(log, TEST_LIMITS, skip_auth=True)


LIMITER_SQL = f"""
    WITH RECURSIVE log AS (
      SELECT CAST(user_id AS VARCHAR) AS client,
             CASE WHEN event_type IN ('signup', 'error') THEN 'admin' ELSE 'store' END AS scope,
             epoch_us(ts) // 1000 AS ms FROM events),
    chain(client, scope, begin) AS (
      SELECT client, scope, min(ms) FROM log GROUP BY client, scope
      UNION ALL
      SELECT c.client, c.scope, min(l.ms)
      FROM chain c JOIN log l ON l.client = c.client AND l.scope = c.scope AND l.ms >= c.begin + {limiter.WINDOW_MS}
      GROUP BY c.client, c.scope, c.begin)
    SELECT c.client, c.scope, make_timestamp(c.begin * 1000) AS window_start,
           make_timestamp((c.begin + {limiter.WINDOW_MS}) * 1000) AS window_end, count(*) AS requests,
           greatest(count(*) - CASE c.scope WHEN 'admin' THEN {TEST_LIMITS['admin']} ELSE {TEST_LIMITS['store']} END, 0) AS rejected
    FROM chain c JOIN log l ON l.client = c.client AND l.scope = c.scope
      AND l.ms >= c.begin AND l.ms < c.begin + {limiter.WINDOW_MS}
    GROUP BY c.client, c.scope, c.begin"""


@register("limiter_windows", LIMITER_SQL)
def limiter_windows(spark, sf_dir):
    """Windows from each client's own requests on, as the middleware counts."""
    log = ev.request_log(commerce(spark, sf_dir).raw("events"))
    return limiter.limiter_windows(log, TEST_LIMITS)
