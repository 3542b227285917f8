import json

import pytest
from pyspark.sql import functions as F

from cartwheel.operators import payloads as pl
from cartwheel.session import scratch_path
from cartwheel.sources import events as ev
from cartwheel.streaming import delivery as dl, versions
from cartwheel.streaming.outbox import payload_frame

SINKS = ("pixel", "measurement")


def catalog(spark, price=100, variants=range(5)):
    return spark.createDataFrame([(v, 9, f"s{v}", f"t{v}", "x", price * (v + 1)) for v in variants],
                                 "variant_id long, product_id long, sku string, product_title string, product_type string, first_amount long")


def cart(i, variant=1, name="cart.item_added", quantity=2, **more):
    return {"event_name": name, "id": i, "ts": "2024-03-01T10:00:00.000123", "item": {"variant_id": variant, "quantity": quantity}, **more}


class Shop:
    """Folders of one test; events arrive as text files of JSON lines."""

    def __init__(self, spark):
        self.spark = spark
        self.root = scratch_path(spark, "t-delivery")
        self.events, self.lookups, self.checkpoint = (f"{self.root}/{x}" for x in ("events", "lookups", "ckpt"))

    def arrive(self, *lines):
        text = [(x if isinstance(x, str) else json.dumps(x),) for x in lines]
        self.spark.createDataFrame(text, "value string").coalesce(1).write.mode("append").text(self.events)

    def delivery(self, sink, source=dl.CART):
        return dl.Delivery(self.spark, source, sink, f"{self.root}/outbox", self.lookups, f"{self.root}/dead")

    def run(self, sink="pixel", checkpoint=None, source=dl.CART):
        stream = ev.read_cart_events if source is dl.CART else ev.read_order_events
        d = self.delivery(sink, source)
        dl.start_delivery(stream(self.spark, self.events, keep_malformed=True), d, checkpoint or self.checkpoint).awaitTermination()
        return d


@pytest.fixture
def shop(spark):
    return Shop(spark)


def values(d):
    path = "$.custom_data.value" if d.sink == "pixel" else "$.events[0].params.value"
    rows = d.deliveries().select("id", F.get_json_object("payload", path).cast("double")).collect()
    return sorted((int(i), v) for i, v in rows)


def reasons(d, which="dead_letters"):
    return sorted(r["reason"] for r in getattr(d, which)().collect())


def test_broken_events_do_not_stop_the_others(spark, shop):
    versions.publish(spark, shop.lookups, {"catalog": catalog(spark)})
    shop.arrive(cart(1), "{this is no json", cart(2, variant=77), {"event_name": "cart.item_added", "id": 3}, cart(4, variant=None), cart(None), cart(5, 3),
                "", cart(6, name="cart.item_updated", quantity=5, previousQuantity=2), cart(7, name="cart.abandoned", variant=None), cart(8, name="cart.item_removed"))
    for sink, want in (("pixel", [(1, 2.0), (5, 4.0), (6, 2.0)]), ("measurement", [(1, 4.0), (5, 8.0), (6, 6.0), (8, 4.0)])):
        d = shop.run(sink)
        assert values(d) == want
        assert reasons(d) == ["malformed", "no_id", "no_item", "no_variant", "unknown_variant"]
        letters = {r["reason"]: r["message"] for r in d.dead_letters().collect()}
        assert letters["malformed"] == "{this is no json" and json.loads(letters["unknown_variant"])["id"] == 2


def test_payloads_equal_the_batch_builders(spark, shop):
    versions.publish(spark, shop.lookups, {"catalog": catalog(spark)})
    shop.arrive(*[cart(k, k % 5) for k in range(40)])
    events = spark.read.schema(ev.CART_EVENT_SCHEMA).json(shop.events)
    for sink in SINKS:
        got = shop.run(sink).deliveries().select("id", "sink", "event_name", "payload")
        want = payload_frame(pl.cart_enriched(pl.cart_delta(events), catalog(spark)), sink).withColumn("id", F.col("id").cast("string"))
        assert got.count() == 40 and got.exceptAll(want).count() == 0


def test_a_price_change_shows_from_the_next_batch_on(spark, shop):
    versions.publish(spark, shop.lookups, {"catalog": catalog(spark)})
    shop.arrive(cart(1))
    shop.run()
    versions.publish(spark, shop.lookups, {"catalog": catalog(spark, 300)})
    shop.arrive(cart(2))
    d = shop.run()  # a restart with the same checkpoint
    assert values(d) == [(1, 2.0), (2, 6.0)]
    assert sorted(map(tuple, versions.versions_taken(spark, f"{d.letters}-taken").collect())) == [(0, 1), (1, 2)]
    # the first batch is run again after the change: the version it took first
    batch = spark.read.schema(ev.CART_EVENT_SCHEMA).json(shop.events).where("id = 1")
    d.write(batch, 0)
    assert values(d) == [(1, 2.0), (2, 6.0)]
    with pytest.raises(ValueError):
        versions.read_version(spark, shop.lookups, 9)


def test_an_event_that_a_sink_refuses_stands_alone(spark, shop, monkeypatch):
    versions.publish(spark, shop.lookups, {"catalog": catalog(spark)})
    shop.arrive(*[cart(k, k % 5) for k in range(30)])

    def refusing(good, tables, sink):
        rows = dl.cart_payloads(good, tables, sink)
        bad = F.col("id").isin(3, 17) & (F.col("sink") == "pixel")
        return rows.withColumn("payload", F.when(bad, F.raise_error(F.lit("refused"))).otherwise(F.col("payload")))

    source = dl.Source("cart", ev.CART_EVENT_SCHEMA, dl.judged_cart_events, refusing)
    batch = spark.read.schema(ev.CART_EVENT_SCHEMA).json(shop.events)
    for sink in SINKS:
        d = dl.Delivery(spark, source, sink, f"{shop.root}/outbox", shop.lookups, f"{shop.root}/dead")
        d.write(batch, 0)
        ids = [i for i, _ in values(d)]
        if sink == "pixel":
            assert ids == [k for k in range(30) if k not in (3, 17)] and reasons(d) == ["USER_RAISED_EXCEPTION"] * 2
        else:
            assert ids == list(range(30)) and reasons(d) == []

    def lost(good, tables, sink):
        raise OSError("no store")

    with pytest.raises(OSError):  # not the data's fault: the stream ends and is run again
        dl.Delivery(spark, dl.Source("cart", ev.CART_EVENT_SCHEMA, dl.judged_cart_events, lost), "pixel", f"{shop.root}/o2", shop.lookups,
                    f"{shop.root}/d2").write(batch, 0)


def test_dead_letters_are_replayed_once(spark, shop):
    versions.publish(spark, shop.lookups, {"catalog": catalog(spark)})
    shop.arrive(cart(1), cart(2, 77), cart(3, 88), "{no")
    d = shop.run()
    versions.publish(spark, shop.lookups, {"catalog": catalog(spark, variants=[0, 1, 77])})
    assert d.replay() == 1
    assert values(d) == [(1, 2.0), (2, 78.0)] and reasons(d, "open_letters") == ["malformed", "unknown_variant"]
    shop.arrive(cart(4, 99))
    d = shop.run()
    versions.publish(spark, shop.lookups, {"catalog": catalog(spark, variants=[1, 77, 88, 99])})
    assert d.replay() == 2
    assert [i for i, _ in values(d)] == [1, 2, 3, 4] and reasons(d, "open_letters") == ["malformed"]
    assert d.replay() == 3 and [i for i, _ in values(d)] == [1, 2, 3, 4]
    micros = d.deliveries().where("id = 2").select(F.get_json_object("payload", "$.event_time")).first()[0]
    assert micros == "1709287200"


def test_a_lost_checkpoint_and_compaction_add_no_payload(spark, shop):
    versions.publish(spark, shop.lookups, {"catalog": catalog(spark)})
    for k in range(3):
        shop.arrive(cart(10 * k), cart(10 * k + 1), cart(10 * k))  # one message twice
        d = shop.run()
    before = values(d)
    assert len(before) == 6
    assert shop.run(checkpoint=f"{shop.root}/new") and values(d) == before
    assert d.compact() == 1 and values(d) == before and d.compact() is None
    shop.arrive(cart(99), cart(20))
    shop.run(checkpoint=f"{shop.root}/newer")
    after = values(d)
    assert [i for i, _ in after] == [0, 1, 10, 11, 20, 21, 99]
    assert d.compact() == 2 and values(d) == after


def test_a_half_compaction_is_not_seen(spark, shop):
    versions.publish(spark, shop.lookups, {"catalog": catalog(spark)})
    shop.arrive(cart(1), cart(2))
    d = shop.run()
    # data without its log row, as a compaction that was interrupted leaves it
    d.deliveries().write.parquet(f"{d.box}-compacted/1-half")
    assert len(values(d)) == 2 and d.compact() == 1 and len(values(d)) == 2


def test_order_events_and_the_events_customer(spark, shop):
    items = spark.createDataFrame([(1, 1, 1, 2, 500, 3)], "order_id long, line_number int, variant_id long, quantity int, unit_price long, tax_total long")
    people = spark.createDataFrame([(5, "e@x", "1", "E", "X", 1), (6, "other@x", "2", "O", "X", 1)], "id long, email string, phone string, first_name string, last_name string, nation_id long")
    orders = spark.createDataFrame([(k, 5, 1000, "eur") for k in (1, 2)], "id long, customer_id long, total long, currency_code string").withColumn(
        "created_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    homes = spark.createDataFrame([(1, "c", "p", "z", "N1")], "nation_id long, city string, province string, postal_code string, country_code string")
    versions.publish(spark, shop.lookups, {"orders": pl.order_enriched(orders, items, catalog(spark), people, homes), "customers": people})
    shop.arrive(*[{"event_name": "order.placed", "id": i, "customer_id": c, "ts": "2024-03-01T10:00:00"} for i, c in ((1, 5), (2, 6), (3, 5))],
                {"event_name": "order.canceled", "id": 7})
    d = shop.run("pixel", source=dl.ORDERS)
    em = {r[0]: r[1] for r in d.deliveries().select("id", F.get_json_object("payload", "$.user_data.em")).collect()}
    import hashlib
    assert em == {"1": hashlib.sha256(b"e@x").hexdigest(), "2": hashlib.sha256(b"other@x").hexdigest()}
    assert reasons(d) == ["unknown_order"]


def test_nothing_published(spark, shop):
    shop.arrive(cart(1))
    with pytest.raises(ValueError):
        shop.delivery("pixel").write(spark.read.schema(ev.CART_EVENT_SCHEMA).json(shop.events), 0)
