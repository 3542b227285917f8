import hashlib

from pyspark.sql import functions as F

from cartwheel.operators import payloads as pl
from cartwheel.sources.events import CART_EVENT_SCHEMA, ORDER_EVENT_SCHEMA
from tests.conftest import ts


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_cart_delta(spark):
    meta = (None, None, None, None, "s1", None, "u1")
    ev = spark.createDataFrame([
        ("cart.item_updated", 1, ts(2024, 1, 1), 3, (7, 3, meta)),    # equal: nothing
        ("cart.item_updated", 2, ts(2024, 1, 1), 2, (7, 5, meta)),    # +3 -> add 3
        ("cart.item_updated", 3, ts(2024, 1, 1), 6, (7, 1, meta)),    # -5 -> remove 5
        ("cart.item_updated", 4, ts(2024, 1, 1), None, (7, 1, meta)),  # unknown previous: nothing
        ("cart.item_added", 5, ts(2024, 1, 1), None, (7, 2, meta)),
    ], CART_EVENT_SCHEMA)
    got = sorted((r.id, r.action, r.quantity) for r in pl.cart_delta(ev).collect())
    assert got == [(2, "add", 3), (3, "remove", 5), (5, "add", 2)]


def test_user_data_hashing(spark):
    df = spark.createDataFrame([("Foo@Example.COM", " 555-1 ", "", "Berlin", "AB1")],
                               "email string, phone string, fn string, city string, zip string")
    env = pl.conversion_envelope(F.lit("Purchase"), F.lit(1), {
        "email": F.col("email"), "phone": F.col("phone"), "firstName": F.col("fn"), "city": F.col("city"),
        "zip": F.col("zip")}, {"contents": F.array()})
    u = df.select(env.alias("e")).collect()[0].e.user_data
    assert u.em == sha("foo@example.com") and u.ph == sha(" 555-1 ") and u.fn is None
    assert u.ct == sha("berlin") and u.zp == sha("AB1")


def test_purchase_without_items_and_price(spark):
    orders = spark.createDataFrame(
        [(1, 5, None, "eur", None, None, None, None, None, None, None, None, None, None)],
        "id bigint, customer_id bigint, total bigint, currency_code string, items array<struct<line_number:int,"
        "variant_id:bigint,quantity:int,unit_price:bigint,sku:string,title:string,"
        "product_type:string>>, email string, phone string, first_name string, last_name string, city string, "
        "province string, postal_code string, country_code string, tax_total bigint")
    orders = (orders.withColumn("shipping_total", F.lit(None).cast("bigint"))
              .withColumn("units", F.lit(None).cast("bigint")))
    events = spark.createDataFrame([("order.placed", 1, 5, ts(2024, 1, 1), None)],
                                   "event_name string, id bigint, customer_id bigint, ts timestamp_ntz, "
                                   "metadata struct<clientIp:string,userAgent:string,fbc:string,fbp:string,"
                                   "sessionId:string,gaSessionId:string,userId:string>")
    p = pl.purchase_conversion(orders, events).collect()[0].payload.custom_data
    assert p.num_items == 1 and p.contents == [] and p.content_ids == [] and p.value == 0.0
    assert p.currency == "EUR"
    g = pl.ga_purchase(orders, events).collect()[0].payload
    assert g.client_id == "5" and g.events[0].params.value is None and g.events[0].params.items == []
    assert g.events[0].params.session_id.startswith("1704067200000_")


def test_add_to_cart_value_and_session_fallback(spark):
    rows = spark.createDataFrame([
        (1, ts(2024, 1, 1), "add", 7, 3, (None, None, None, None, None, "ga9", None), None, "P", "T", None),
    ], "id bigint, ts timestamp_ntz, action string, variant_id bigint, quantity int, "
       "metadata struct<clientIp:string,userAgent:string,fbc:string,fbp:string,sessionId:string,"
       "gaSessionId:string,userId:string>, sku string, product_title string, product_type string, "
       "first_amount bigint")
    fb = pl.add_to_cart_conversion(rows).collect()[0].payload.custom_data
    assert fb.value == 0.0 and fb.content_ids == ["7"] and fb.contents[0].quantity == 1
    ga = pl.ga_cart(rows, "add").collect()[0].payload
    assert ga.events[0].params.session_id == "ga9" and ga.events[0].params.items[0].category == "T"
    assert ga.client_id.startswith("1704067200000.")


ORDER_FIELDS = ("id bigint, customer_id bigint, total bigint, currency_code string, created_at timestamp_ntz")


def big_order(spark, lines=1200):
    orders = spark.createDataFrame([(1, 5, 120000, "eur", ts(2024, 1, 1)), (2, None, 50, "eur", ts(2024, 1, 1))], ORDER_FIELDS)
    items = spark.range(lines).select(
        F.lit(1).cast("bigint").alias("order_id"), ((F.col("id") * 7919) % lines).cast("int").alias("line_number"),
        F.when(F.col("id") % 10 != 0, F.col("id") % 40).alias("variant_id"), F.lit(1).alias("quantity"),
        F.lit(100).cast("bigint").alias("unit_price"), F.lit(3).cast("bigint").alias("tax_total"))
    catalog = spark.range(40).select(F.col("id").alias("variant_id"), F.col("id").alias("product_id"), F.concat(F.lit("s"), "id").alias("sku"),
                                     F.lit("t").alias("product_title"), F.lit("x").alias("product_type"), F.lit(1).alias("first_amount"))
    customers = spark.createDataFrame([(5, "e@x", "1", "f", "l", 1), (6, "other@x", "2", "g", "m", 1)],
                                      "id bigint, email string, phone string, first_name string, last_name string, nation_id int")
    addresses = spark.createDataFrame([(1, "c", "p", "z", "cc")], "nation_id int, city string, province string, postal_code string, country_code string")
    return orders, items, catalog, customers, addresses


def placed(spark, *rows):
    return spark.createDataFrame([("order.placed", i, c, ts(2024, 1, 2), None) for i, c in rows], ORDER_EVENT_SCHEMA)


def test_an_order_of_any_size_gives_one_payload(spark):
    orders, items, catalog, customers, addresses = big_order(spark)
    o = pl.order_enriched(orders, items, catalog, customers, addresses)
    assert "part" not in o.columns and o.count() == 2
    events = placed(spark, (1, 5))
    p = pl.purchase_conversion(o, events).collect()
    assert len(p) == 1 and p[0].payload.custom_data.num_items == 1200 and p[0].payload.custom_data.value == 1200.0
    g = pl.ga_purchase(o, events).collect()
    params = g[0].payload.events[0].params
    assert len(g) == 1 and [i["index"] for i in params.items] == list(range(1200)) and params.tax == 36.0


def test_item_rows_have_their_position_in_the_whole_order(spark, monkeypatch):
    monkeypatch.setattr(pl, "ITEMS_PER_TASK", 100)   # the order spans twelve runs
    _, items, catalog, _, _ = big_order(spark)
    rows = pl.order_item_rows(items, catalog).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(1200)) == [r.line_number for r in rows]
    assert all((r.sku is None) == (r.variant_id is None) for r in rows)
    h = pl.order_headers(items).collect()
    assert [(r.id, r.units, r.tax_total, r.n_items) for r in h] == [(1, 1200, 3600, 1200)]


def test_the_customer_is_that_of_the_event(spark):
    orders, items, catalog, customers, addresses = big_order(spark, 3)
    o = pl.order_enriched(orders, items, catalog, customers, addresses)
    email = lambda c: pl.purchase_conversion(o, placed(spark, (1, c)), customers=customers).collect()[0].payload.user_data.em
    assert email(5) == sha("e@x") and email(6) == sha("other@x") and email(None) is None
    client = pl.ga_purchase(o, placed(spark, (1, None))).collect()[0].payload.client_id
    assert client.startswith("1704153600000.")


def test_one_payload_per_view(spark):
    catalog = spark.createDataFrame([(v, 9, f"s{v}", "T", "x", 100 * v) for v in (3, 1, 2)],
                                    "variant_id bigint, product_id bigint, sku string, product_title string, product_type string, first_amount bigint")
    views = spark.createDataFrame([(1, ts(2024, 1, 1), "u", 9, "s", 3), (2, ts(2024, 1, 1), "u", 9, "s", None), (3, ts(2024, 1, 1), "u", None, "s", None)],
                                  "id bigint, ts timestamp_ntz, user_id string, product_id bigint, session_id string, variant_id bigint")
    for v, want in ((views, {1: 3.0, 2: 1.0, 3: 0.0}), (views.drop("variant_id"), {1: 1.0, 2: 1.0, 3: 0.0})):
        got = {r.id: r.payload.custom_data.value for r in pl.view_content_conversion(v, catalog).collect()}
        assert got == want and pl.ga_view_item(v, catalog).count() == 3


def test_missing_cart_quantity_is_one(spark):
    rows = spark.createDataFrame([(1, ts(2024, 1, 1), "add", 7, None, None, "k", "P", "T", 250)],
                                 "id bigint, ts timestamp_ntz, action string, variant_id bigint, quantity int, metadata struct<clientIp:string,"
                                 "userAgent:string,fbc:string,fbp:string,sessionId:string,gaSessionId:string,userId:string>, sku string, "
                                 "product_title string, product_type string, first_amount bigint")
    params = pl.ga_cart(rows, "add").collect()[0].payload.events[0].params
    assert params.value == 2.5 and params.items[0].quantity == 1


def test_null_keys_are_dealt_out(spark):
    from cartwheel.functions.cols import left_join_spread
    left = spark.range(1000).select(F.when(F.col("id") % 2 == 0, F.col("id") % 5).alias("k"), "id")
    right = spark.createDataFrame([(0, "a"), (1, "b")], "k bigint, name string")
    got = sorted(left_join_spread(left, right, "k").select("id", "name").collect(), key=str)
    assert got == sorted(left.join(right, "k", "left").select("id", "name").collect(), key=str)


def test_salted_join_matches_plain(spark):
    from cartwheel.functions.cols import salted_join
    left = spark.range(0, 2000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    right = spark.createDataFrame([(0, "a"), (1, "b")], "k long, name string")
    plain = sorted(map(tuple, left.join(right, "k").collect()))
    salted = sorted(map(tuple, salted_join(left, right, "k", 8).select("k", "v", "name").collect()))
    assert plain == salted


def test_salted_copies_are_broadcast_only_if_all_are_small(spark):
    from cartwheel.functions.cols import salted_join
    from cartwheel.sources.layout import written
    right = written(spark.range(20_000).select(F.col("id").alias("k"), F.concat(F.lit("n"), "id").alias("name")), "t-salted-right")
    left = written(spark.range(400_000).select((F.col("id") % 20_001).alias("k"), F.xxhash64("id").alias("v")), "t-salted-left")
    size = right._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 3 * size)  # one copy would do, eight do not
    try:
        joined = salted_join(left, right, "k", 8)
        assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
        totals = [F.count(F.lit(1)), F.sum(F.xxhash64("k", "v", "name").cast("decimal(38,0)"))]
        assert joined.agg(*totals).first() == left.join(right, "k").agg(*totals).first()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def hot_order(spark):
    """An order with a third of all lines: numbers twice or missing, null and
    unknown variants; small orders beside it."""
    hot = spark.range(1500).select(
        F.lit(1).cast("bigint").alias("order_id"), F.when(F.col("id") % 5 > 0, (F.col("id") * 7 % 1100).cast("int")).alias("line_number"),
        F.when(F.col("id") % 11 > 0, F.col("id") % 9).alias("variant_id"), (F.col("id") % 4).cast("int").alias("quantity"),
        (F.col("id") % 13 * 100).alias("unit_price"), (F.col("id") % 3).alias("tax_total"))
    cold = spark.range(3000).select(
        (2 + F.col("id") % 400).alias("order_id"), (F.col("id") % 17).cast("int").alias("line_number"), (F.col("id") % 9).alias("variant_id"),
        F.lit(1).cast("int").alias("quantity"), (F.col("id") % 13 * 100).alias("unit_price"), F.lit(2).cast("bigint").alias("tax_total"))
    catalog = spark.createDataFrame([(v, f"s{v}", f"t{v}", "x") for v in range(7)], "variant_id bigint, sku string, product_title string, product_type string")
    return hot.unionByName(cold), catalog


def test_a_hot_order_is_assembled_by_runs(spark, monkeypatch):
    items, catalog = hot_order(spark)
    want = {r.id: r for r in pl.order_items(items, catalog).collect()}  # one group an order
    # plain Python, one order after the other
    sku = {v: f"s{v}" for v in range(7)}
    key = lambda x: tuple((v is not None, v or 0) for v in x)
    lines = {}
    for r in items.collect():
        lines.setdefault(r.order_id, []).append((r.line_number, r.variant_id, r.quantity, r.unit_price))
    assert {i: [(x.line_number, x.variant_id, x.quantity, x.unit_price) for x in r["items"]] for i, r in want.items()} == {
        i: sorted(x, key=key) for i, x in lines.items()}
    assert all(x.sku == sku.get(x.variant_id) for x in want[1]["items"])
    monkeypatch.setattr(pl, "ITEMS_PER_TASK", 64)
    for broadcast in (10, 0):
        monkeypatch.setattr(pl, "BROADCAST_ORDERS", broadcast)
        df = pl.order_items(items, catalog)
        assert {r.id: r for r in df.collect()} == want
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "__run" in plan and "left_anti" in plan.lower().replace("leftanti", "left_anti")


def test_no_run_holds_more_than_its_lines(spark, monkeypatch):
    monkeypatch.setattr(pl, "ITEMS_PER_TASK", 64)
    items, catalog = hot_order(spark)
    li = items.where("order_id = 1").join(catalog, "variant_id", "left")
    run = F.coalesce(F.floor(F.col("line_number") / 64), -1 - F.pmod(F.xxhash64("variant_id", "quantity", "unit_price"), F.lit(pl.UNNUMBERED_RUNS)))
    most = li.groupBy(run.alias("r")).count().agg(F.max("count")).first()[0]
    assert most <= 2 * 64  # each number is there twice at most
    assert [len(r["items"]) for r in pl.lists_by_runs(li).collect()] == [1500]


def test_positions_of_lines_without_a_number(spark, monkeypatch):
    monkeypatch.setattr(pl, "ITEMS_PER_TASK", 64)
    items, catalog = hot_order(spark)
    want = [(x.line_number, x.variant_id, x.quantity, x.unit_price) for r in pl.order_items(items, catalog).where("id = 1").collect() for x in r["items"]]
    rows = pl.order_item_rows(items, catalog).where("order_id = 1").orderBy("position").collect()
    assert [r.position for r in rows] == list(range(1500))
    assert [(r.line_number, r.variant_id, r.quantity, r.unit_price) for r in rows] == want


def test_searches_without_a_product(spark):
    searches = spark.createDataFrame([(k, ts(2024, 1, 1), "u", None if k % 2 else 1) for k in range(6)], "id bigint, ts timestamp_ntz, user_id string, product_id bigint")
    products = spark.createDataFrame([(1, "red")], "id bigint, title string")
    got = {r.id: r.payload.events[0].params.search_term for r in pl.ga_search(searches, products).collect()}
    assert got == {k: None if k % 2 else "red" for k in range(6)}
