"""Registered sources and sinks: seed catalogue (SRC3), report sink (SNK1),
conversion outbox (SNK2) and table write-back (SNK3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartwheel.functions.cols import iso_timestamp
from cartwheel.operators import maintain as m
from cartwheel.plans import q_events as qe
from cartwheel.plans import q_maintain, q_sales as qs, reports
from cartwheel.plans.registry import ORDERS_AS_OF, REPORT_PERIOD, E, S, commerce, register, with_views
from cartwheel.session import scratch_path
from cartwheel.sources import events as ev
from cartwheel.sources import seed
from cartwheel.streaming import delivery, outbox, versions


@register("seed_catalog", with_views("""
    SELECT CAST(v.product_id AS VARCHAR) AS product_id, CAST(v.id AS VARCHAR) AS variant_id, v.sku,
           v.inventory_quantity, v.manage_inventory, p.currency_code, p.amount
    FROM co_variant v JOIN co_price p ON v.id = p.variant_id""", "co_variant", "co_price"))
def seed_catalog(spark, sf_dir):
    """Catalogue documents (one JSON product per line, the seed's product
    shape) built from the data, parsed back and exploded into variant and
    price tables."""
    c = commerce(spark, sf_dir)
    docs = seed.product_documents(c.products, c.variants, c.prices)
    t = seed.product_tables(seed.parse_products(docs))
    v, p = t["product_variant"], t["money_amount"]
    return v.join(p, v.id == p.variant_id).select(
        "product_id", F.col("id").alias("variant_id"), "sku", "inventory_quantity", "manage_inventory",
        "currency_code", "amount")


@register("seed_documents", with_views("""
    SELECT CAST(v.product_id AS VARCHAR) AS product_id, CAST(v.id AS VARCHAR) AS variant_id, v.sku, p.currency_code, p.amount,
           CAST(v.product_id % 7 AS BIGINT) AS shelf, 'row ' || CAST(v.product_id % 3 AS VARCHAR) AS place
    FROM co_variant v JOIN co_price p ON v.id = p.variant_id""", "co_variant", "co_price"))
def seed_documents(spark, sf_dir):
    """Product documents written as JSON lines with keys that no schema knows,
    read back as VARIANT, taken apart, put together again and read once more:
    every price with the unknown keys of its product."""
    c = commerce(spark, sf_dir)
    root = scratch_path(spark, "seed-documents")
    lines = seed.product_documents(c.products, c.variants, c.prices)
    number = F.get_json_object("value", "$.id").cast("bigint")
    store = F.to_json(F.struct((number % 7).alias("shelf"), F.struct(F.concat(F.lit("row "), (number % 3).cast("string")).alias("row")).alias("place")))
    lines.select(F.concat(F.expr("substr(value, 1, length(value) - 1)"), F.lit(', "store": '), store, F.lit("}")).alias("value")).write.text(f"{root}/in")
    seed.open_documents(seed.open_products(seed.read_documents(spark, f"{root}/in"))).write.text(f"{root}/out")
    rows = seed.open_products(seed.read_documents(spark, f"{root}/out"))
    tables = seed.product_tables(rows)
    more = rows.select(F.col("id").alias("product_id"), F.variant_get(F.col("more")["store"], "$.shelf", "bigint").alias("shelf"),
                       F.variant_get(F.col("more")["store"], "$.place.row", "string").alias("place"))
    v, p = tables["product_variant"], tables["money_amount"]
    return v.join(p, v.id == p.variant_id).join(more, "product_id").select(
        "product_id", F.col("id").alias("variant_id"), "sku", "currency_code", "amount", "shelf", "place")


def _json_list(sql: str, order: str, fields: tuple[str, ...]) -> str:
    """A list of JSON objects with the given fields of a query's rows."""
    return f"(SELECT coalesce(list({{{', '.join(f"'{f}': {f}" for f in fields)}}} ORDER BY {order}), []) FROM ({sql}))"


def _iso_sql(ts) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S.%gZ')"


SALES_JSON_SQL = f"""
    SELECT CAST(to_json({{'period': '{REPORT_PERIOD}', 'start': {_iso_sql(S)}, 'end': {_iso_sql(E)},
      'summary': (SELECT {{'total_revenue': total_revenue, 'total_orders': total_orders, 'average_order_value': average_order_value,
                          'unique_customers': unique_customers, 'returning_customers': returning_customers}} FROM report_summary),
      'daily_stats': {_json_list('SELECT * FROM report_days', 'date', ('date', 'revenue', 'orders', 'average_order_value'))},
      'top_products': {_json_list('SELECT row_number() OVER () AS k, * FROM report_top', 'k', ('product_id', 'title', 'handle', 'units_sold', 'revenue'))}}}) AS VARCHAR) AS value"""


@register("report_sink", with_views(SALES_JSON_SQL, "co_order", "co_line_item", "co_variant", "co_product",
                                    extra=(("report_days", qs.DAILY_SQL), ("report_top", qs.TOP_SQL), ("report_summary", qs.SUMMARY_SQL))))
def report_sink(spark, sf_dir):
    """The sales report (A5) written as one JSON document and read back."""
    c = commerce(spark, sf_dir)
    report = reports.sales_report(c.orders, c.line_items, c.variants, c.products, REPORT_PERIOD,
                                  ORDERS_AS_OF, c.excluded_status)
    report = report.withColumn("start", iso_timestamp("start")).withColumn("end", iso_timestamp("end"))
    path = scratch_path(spark, "sales-report")
    report.coalesce(1).write.json(path)
    return spark.read.text(path)


@register("customer_report_document", with_views(f"""
    SELECT CAST(to_json({{'period': '{REPORT_PERIOD}', 'start': {_iso_sql(S)}, 'end': {_iso_sql(E)},
      'customer_acquisition': {_json_list('SELECT * FROM report_days', 'date', ('date', 'new_customers'))},
      'top_customers': {_json_list(f"SELECT * REPLACE ({_iso_sql('last_order_date')} AS last_order_date), row_number() OVER () AS k FROM report_top", 'k',
        ('customer_id', 'email', 'name', 'order_count', 'total_spent', 'average_order_value', 'last_order_date'))}}}) AS VARCHAR) AS value""",
    "co_order", "co_customer", extra=(("report_days", qs.ACQUISITION_SQL), ("report_top", qs.TOP_CUSTOMERS_SQL))))
def customer_report_document(spark, sf_dir):
    """The customer report (A10) as one JSON document."""
    c = commerce(spark, sf_dir)
    report = reports.customer_report(c.customers, c.orders, REPORT_PERIOD, ORDERS_AS_OF, c.excluded_status)
    top = F.transform("top_customers", lambda x: x.withField("last_order_date", iso_timestamp(x["last_order_date"])))
    report = report.withColumn("start", iso_timestamp("start")).withColumn("end", iso_timestamp("end")).withColumn("top_customers", top)
    return report.select(F.to_json(F.struct(*report.columns)).alias("value"))


@register("table_writeback", q_maintain.oracle_for("dedupe_regions"))
def table_writeback(spark, sf_dir):
    """The deduplicated region table written as a new version and read back."""
    out = q_maintain._dedupe(spark, sf_dir)
    path = m.write_version(out["region"], scratch_path(spark, "region-version"))
    return spark.read.parquet(path).select("id", "name", "currency_code")


def _outbox_sql() -> str:
    flat = "SELECT id, '{sink}' AS sink, {name} AS event_name, value, currency FROM ({sql})"
    parts = [flat.format(sink="pixel", name="event_name", sql=x) for x in (qe.ADD_TO_CART_SQL, qe.PURCHASE_SQL)]
    parts += [flat.format(sink="measurement", name="name", sql=x) for x in (
        qe._ga_cart_sql("add", "add_to_cart"), qe._ga_cart_sql("remove", "remove_from_cart"), qe.GA_PURCHASE_SQL)]
    return "\nUNION ALL\n".join(parts)


@register("conversion_outbox", with_views(_outbox_sql(), *qe.ORDER_VIEWS,
                                          extra=qe.ORDER_EXTRA + (qe.CART_EVENT_CTE, qe.CART_DELTA_CTE, qe.ENRICHED_CTE)))
def conversion_outbox(spark, sf_dir):
    """Cart and order events streamed (available-now trigger) into the outbox
    of either sink; all four streams start together, and one that fails does
    not stop the others. The rows are read back, payloads flattened."""
    c = commerce(spark, sf_dir)
    catalog = outbox.snapshot_catalog(spark, qe._catalog(c))
    people = outbox.snapshot_catalog(spark, c.customers)
    box, ckpt = scratch_path(spark, "outbox"), scratch_path(spark, "outbox-ckpt")
    buckets = outbox.order_buckets(spark, c.line_items.count())
    with outbox.order_snapshot(spark, qe._orders_enriched(c, buckets), buckets) as orders:
        started = []
        for sink in outbox.SINKS:
            # A file stream source watches a folder or glob; the test data is one file.
            started.append(outbox.start_outbox(spark, f"{c.sf_dir}/events.parquet*", catalog, box, ckpt, sink))
            placed = ev.order_events(outbox.read_orders_stream(spark, f"{c.sf_dir}/orders.parquet*"))
            started.append(outbox.start_order_outbox(placed, orders, box, ckpt, sink, customers=people))
        errors = outbox.finish(started)
    if errors:
        raise errors[0]
    rows = outbox.read_outbox(spark, box, "pixel").unionByName(outbox.read_outbox(spark, box, "measurement"))
    field = {"pixel": "$.custom_data", "measurement": "$.events[0].params"}
    get = lambda name: F.when(F.col("sink") == "pixel", F.get_json_object("payload", f"{field['pixel']}.{name}")).otherwise(
        F.get_json_object("payload", f"{field['measurement']}.{name}"))
    return rows.select("id", "sink", "event_name", get("value").cast("double").alias("value"), get("currency").alias("currency"))


# Cart events in two micro-batches. Promotional articles are not in the
# catalogue that is published before the first one; before the second, all are,
# at twice the price. Dead letters are replayed after it.
DELIVERY_CUT = "2024-01-16 00:00:00"
DELIVERY_SQL = f"""
    SELECT CAST(id AS VARCHAR) AS id, CASE action WHEN 'add' THEN 'add_to_cart' ELSE 'remove_from_cart' END AS event_name,
           coalesce(first_amount * CASE WHEN ts < TIMESTAMP '{DELIVERY_CUT}' AND product_type NOT LIKE 'PROMO%' THEN 1 ELSE 2 END / 100.0, 0.0)
             * quantity AS value,
           CASE WHEN ts >= TIMESTAMP '{DELIVERY_CUT}' THEN 1 WHEN product_type LIKE 'PROMO%' THEN -1 ELSE 0 END AS batch_id
    FROM co_cart_enriched"""


def _delivered(spark, sf_dir, replay: bool) -> delivery.Delivery:
    c = commerce(spark, sf_dir)
    root = scratch_path(spark, "delivery")
    catalog, events = qe._catalog(c), ev.cart_events(c.raw("events"))
    d = delivery.Delivery(spark, delivery.CART, "measurement", f"{root}/outbox", f"{root}/lookups", f"{root}/dead")
    versions.publish(spark, d.lookups, {"catalog": catalog.where("product_type NOT LIKE 'PROMO%'")})
    cut = F.lit(DELIVERY_CUT).cast("timestamp_ntz")
    d.write(events.where(F.col("ts") < cut), 0)
    if replay:
        versions.publish(spark, d.lookups, {"catalog": catalog.withColumn("first_amount", F.col("first_amount") * 2)})
        d.write(events.where(F.col("ts") >= cut), 1)
        d.replay()
    return d


@register("event_delivery", with_views(DELIVERY_SQL, *qe.CART_VIEWS, extra=qe.CART_EXTRA))
def event_delivery(spark, sf_dir):
    """Payloads of two micro-batches and a replay, each with the catalogue that
    was published when it was run."""
    rows = _delivered(spark, sf_dir, True).deliveries()
    value = F.get_json_object("payload", "$.events[0].params.value").cast("double")
    return rows.select("id", "event_name", value.alias("value"), F.col("batch_id").cast("int").alias("batch_id"))


@register("dead_letters", with_views(f"""
    SELECT CAST(id AS VARCHAR) AS id, 'unknown_variant' AS reason, 1 AS version
    FROM co_cart_enriched WHERE ts < TIMESTAMP '{DELIVERY_CUT}' AND product_type LIKE 'PROMO%'""", *qe.CART_VIEWS, extra=qe.CART_EXTRA))
def dead_letters(spark, sf_dir):
    """Events of the first micro-batch whose article the catalogue lacks."""
    letters = _delivered(spark, sf_dir, False).dead_letters()
    return letters.select(F.get_json_object("message", "$.id").alias("id"), "reason", F.col("version").cast("int").alias("version"))
