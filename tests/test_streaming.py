import glob
import os
import time

from pyspark.sql import functions as F

from cartwheel.operators import payloads as pl
from cartwheel.session import scratch_path
from cartwheel.sources import events as ev
from cartwheel.sources.commerce import Commerce
from cartwheel.streaming import outbox, rate_limit
from tests.conftest import ts

SF = "/root/testdata/sf0.001"


def test_outbox_stream_equals_batch(spark):
    c = Commerce(spark, SF)
    catalog = outbox.snapshot_catalog(spark, pl.variant_catalog(c.variants, c.products, c.prices))
    box, ckpt = scratch_path(spark, "t-outbox"), scratch_path(spark, "t-ckpt")
    for sink in outbox.SINKS:
        outbox.start_outbox(spark, f"{SF}/events.parquet*", catalog, box, ckpt, sink).awaitTermination()
    enriched = pl.cart_enriched(pl.cart_delta(ev.cart_events(c.raw("events"))), catalog)
    for sink in outbox.SINKS:
        streamed = outbox.read_outbox(spark, box, sink).drop("batch_id", "source")
        batch = outbox.payload_frame(enriched, sink)
        assert streamed.count() == batch.count() > 0
        assert streamed.exceptAll(batch).count() == 0
    # a restart with the same checkpoint finds nothing new: no extra batch, no duplicates
    before = sorted(os.listdir(os.path.join(box, "pixel")))
    outbox.start_outbox(spark, f"{SF}/events.parquet*", catalog, box, ckpt, "pixel").awaitTermination()
    assert sorted(os.listdir(os.path.join(box, "pixel"))) == before
    assert outbox.read_outbox(spark, box, "pixel").count() == outbox.payload_frame(enriched, "pixel").count()


def test_rate_limit_stream_with_watermark(spark):
    raw = ev.read_events_stream(spark, f"{SF}/events.parquet*")
    log = ev.request_log(raw)
    viol = rate_limit.rate_limit_violations(log, {"admin": 0, "store": 1}, watermark="15 minutes")
    q = viol.writeStream.format("memory").queryName("rl_test").outputMode("append") \
        .trigger(availableNow=True).start()
    q.awaitTermination()
    streamed = spark.table("rl_test").count()
    batch = rate_limit.rate_limit_violations(ev.request_log(Commerce(spark, SF).raw("events")), {"admin": 0, "store": 1})
    # append mode emits windows closed by the watermark; the last open windows stay in state
    assert 0 < streamed <= batch.count()


def test_lifecycle_log_stream(spark):
    path, ckpt = scratch_path(spark, "t-log"), scratch_path(spark, "t-log-ckpt")
    outbox.start_lifecycle_log(spark, f"{SF}/orders.parquet*", path, ckpt).awaitTermination()
    got = spark.read.parquet(path).groupBy("event_name").count()
    want = ev.order_events(Commerce(spark, SF).raw("orders")).groupBy("event_name").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert F


def test_salted_outbox_equals_plain(spark):
    c = Commerce(spark, SF)
    catalog = outbox.snapshot_catalog(spark, pl.variant_catalog(c.variants, c.products, c.prices))
    box, ckpt = scratch_path(spark, "t-outbox-salt"), scratch_path(spark, "t-ckpt-salt")
    outbox.start_outbox(spark, f"{SF}/events.parquet*", catalog, box, ckpt, "measurement",
                        salt_buckets=4).awaitTermination()
    enriched = pl.cart_enriched(pl.cart_delta(ev.cart_events(c.raw("events"))), catalog)
    streamed = outbox.read_outbox(spark, box, "measurement").drop("batch_id", "source")
    assert streamed.exceptAll(outbox.payload_frame(enriched, "measurement")).count() == 0
    assert streamed.count() == outbox.payload_frame(enriched, "measurement").count()


def test_one_broken_sink_does_not_stop_the_other(spark):
    from cartwheel.plans import q_events as qe
    c = Commerce(spark, SF)
    orders = outbox.snapshot_catalog(spark, qe._orders_enriched(c))
    box, ckpt = scratch_path(spark, "t-outbox-broken"), scratch_path(spark, "t-ckpt-broken")
    placed = lambda: ev.order_events(outbox.read_orders_stream(spark, f"{SF}/orders.parquet*"))
    broken = orders.withColumn("total", F.raise_error(F.lit("broken")).cast("bigint"))
    started = [outbox.start_order_outbox(placed(), broken, box, ckpt, "pixel"),
               outbox.start_order_outbox(placed(), orders, box, ckpt, "measurement")]
    assert len(outbox.finish(started)) == 1
    assert outbox.read_outbox(spark, box, "measurement").count() == c.orders.count()


def test_own_event_files_feed_the_streams(spark):
    from cartwheel.plans import q_events as qe
    c = Commerce(spark, SF)
    path, box, ckpt = (scratch_path(spark, f"t-own-{x}") for x in ("events", "box", "ckpt"))
    ev.order_events(c.raw("orders")).write.json(path)
    orders = outbox.snapshot_catalog(spark, qe._orders_enriched(c))
    outbox.start_order_outbox(ev.read_order_events(spark, path), orders, box, ckpt, "pixel").awaitTermination()
    assert outbox.read_outbox(spark, box, "pixel").count() == c.orders.count()


def test_scopes_and_admin_login(spark):
    log = spark.createDataFrame([("a", p) for p in ("/admin/x", "/admin/auth/session", "/store/x", "/storefront", None, "/auth", "/admin")],
                                "client string, path string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    count = lambda **k: {r.scope: r.requests for r in rate_limit.request_windows(log, **k).collect()}
    assert count() == {"admin": 3, "store": 1} and count(skip_auth=True) == {"admin": 2, "store": 1}
    hit = rate_limit.rate_limit_violations(log, {"admin": 2, "store": 2}).collect()
    assert [(r.client, r.scope) for r in hit] == [("a", "admin")]


def placed(spark, c, people, own, root):
    """One stream of placed orders, written, and the plan of its last micro-batch."""
    path, box = f"{root}/events", f"{root}/box"
    own.write.json(path)
    q = outbox.start_order_outbox(ev.read_order_events(spark, path), c, box, f"{root}/ckpt", "pixel", customers=people)
    q.awaitTermination()
    return outbox.read_outbox(spark, box, "pixel"), q._jsq.explainInternal(False).partition("Initial Plan")[0]


def own_orders(spark):
    """Enriched orders with one that comes twice, one without items, one without
    an id; customer 5 comes twice."""
    items = [(1, 7, 2, 300, "S7", "t", "x"), (2, 8, 1, 100, None, "u", "y")]
    row = lambda i, who, some: (i, who, 700, "eur", some, *([f"o{who}"] * 4), "c", "p", "z", "n", 10, 3)
    orders = spark.createDataFrame(
        [row(1, 5, items), row(2, 6, None), row(3, None, items), row(4, 5, items), row(4, 5, items), row(None, 5, items)],
        "id bigint, customer_id bigint, total bigint, currency_code string, items array<struct<line_number:int,variant_id:bigint,"
        "quantity:int,unit_price:bigint,sku:string,title:string,product_type:string>>, email string, phone string, first_name string, "
        "last_name string, city string, province string, postal_code string, country_code string, tax_total bigint, units bigint")
    orders = orders.withColumn("shipping_total", F.lit(None).cast("bigint"))
    people = spark.createDataFrame([(5, "o5"), (5, "o5"), (6, "o6"), (7, "seven")], "id bigint, email string")
    for name in ("phone", "first_name", "last_name"):
        people = people.withColumn(name, F.col("email"))
    events = spark.createDataFrame(
        [("order.placed", i, who, ts(2024, 1, 1), None) for i, who in ((1, 5), (2, 7), (2, 6), (3, 6), (4, None), (4, 9), (9, 5), (None, 5))]
        + [("order.canceled", 1, 5, ts(2024, 1, 2), None)], ev.ORDER_EVENT_SCHEMA)
    return orders, people, events


def test_order_stream_moves_no_item_lists(spark):
    orders, people, events = own_orders(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with outbox.order_snapshot(spark, orders, 3) as snapshot:
            rows, plan = placed(spark, snapshot, people, events, scratch_path(spark, "t-narrow"))
            rows = rows.select("id", F.get_json_object("payload", "$.user_data.em").alias("em"),
                               F.get_json_object("payload", "$.custom_data.contents").alias("contents")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the events move to their customer, the customers, the events to their order's bucket; the orders stay
    assert plan.count("Exchange hashpartitioning") == 3 and "Bucketed: true" in plan, plan
    table = [x for x in plan.splitlines() if "Bucketed: true" in x]
    assert len(table) == 1 and "items" in table[0]
    sha = {e: spark.sql(f"select sha2('{e}', 256)").first()[0] for e in ("o5", "o6", "seven")}
    want = [(1, sha["o5"])] * 2 + [(2, sha["seven"]), (2, sha["o6"]), (3, sha["o6"])] + [(4, None)] * 4
    assert sorted((r.id, r.em or "") for r in rows) == sorted((i, e or "") for i, e in want)
    assert all((r.contents == "[]") == (r.id == 2) for r in rows)
    assert not spark.sql("SHOW TABLES LIKE 'outbox_orders_*'").count()  # no name is left behind


def shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*")}


def test_written_tables_and_batches_leave_no_shuffle_files(spark):
    orders, people, events = own_orders(spark)
    root = scratch_path(spark, "t-files")
    held = shuffle_files(spark)
    outbox.snapshot_catalog(spark, people.repartition(3, "id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with outbox.order_snapshot(spark, orders, 3) as snapshot:
            rows, plan = placed(spark, snapshot, people, events, root)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" in plan
    for _ in range(20):  # files are removed in the background
        left = {f for f in shuffle_files(spark) - held if f.endswith(".data")}
        if not left:
            break
        time.sleep(0.5)
    assert not left and rows.count()
    files = glob.glob(f"{root}/box/pixel/*/*/*.parquet")
    assert files and all(f.endswith(".zstd.parquet") for f in files)


def test_the_order_snapshot_is_dealt_out_once(spark, monkeypatch):
    from cartwheel.plans import q_events as qe
    c = Commerce(spark, SF)
    plain = qe._orders_enriched(c).drop("items")
    whole = lambda df: sorted((r.id, str(r.items)) for r in df.select("id", "items").collect())
    want = whole(qe._orders_enriched(c))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most in (pl.ITEMS_PER_TASK, 7):  # without and with huge orders
            monkeypatch.setattr(pl, "ITEMS_PER_TASK", most)
            dealt = qe._orders_enriched(c, 6)
            assert dealt.columns == qe._orders_enriched(c).columns and dealt.drop("items").exceptAll(plain).isEmpty()
            assert whole(dealt) == want
            plan = dealt.repartition(6, "id")._jdf.queryExecution().executedPlan().toString()
            assert not plan.partition("SortMergeJoin")[0].count("Exchange"), plan  # the writer's exchange is that of the join
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_buckets_go_with_the_lines(spark):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert outbox.order_buckets(spark, 0) == parts
    assert outbox.order_buckets(spark, 10 * outbox.LINES_PER_BUCKET + 1) == max(parts, 11)
    assert outbox.order_buckets(spark, 10**13) == int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
