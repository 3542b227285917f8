from pyspark.sql import functions as F

from cartwheel.operators import inventory as inv

TAGS = "array<struct<id:string,value:string>>"


def catalog(spark):
    products = spark.createDataFrame([
        (1, "Suit", "suit", [("t1", "popular"), ("t2", "suits")]),   # both: popular wins (20)
        (2, "Tie", "tie", [("t3", "suits")]),                           # 15
        (3, "Sock", "sock", []),                                        # 10
    ], f"id bigint, title string, handle string, tags {TAGS}")
    variants = spark.createDataFrame([
        (11, 1, "S", "SKU11", 20, True), (12, 1, "M", "SKU12", 21, True),
        (21, 2, "One", None, 15, True), (22, 2, "Two", "SKU22", 0, True),
        (31, 3, "A", "SKU31", -3, True), (32, 3, "B", "SKU32", 5, False),
    ], "id bigint, product_id bigint, title string, sku string, inventory_quantity int, manage_inventory boolean")
    prices = spark.createDataFrame([
        (11, "usd", 1999), (11, "usd", 1999),        # two usd prices: fan-out (S10)
        (12, "usd", 333), (21, "eur", 100),          # 21: no usd price
        (22, "usd", 5000), (31, "usd", 7), (32, "usd", 100),
    ], "variant_id bigint, currency_code string, amount bigint")
    return products, variants, prices


def test_threshold_first_match_wins(spark):
    products, _, _ = catalog(spark)
    got = {r.id: r.t for r in products.select("id", inv.stock_threshold(F.col("tags")).alias("t")).collect()}
    assert got == {1: 20, 2: 15, 3: 10}


def test_low_and_out_of_stock(spark):
    products, variants, _ = catalog(spark)
    low = inv.low_stock(variants, products).collect()
    assert [r.variant_id for r in low] == [31, 22, 21, 11]
    out = inv.out_of_stock(variants, products).collect()
    assert [r.variant_id for r in out] == [31, 22]            # by title: Sock < Tie? no: ordered by title
    assert [r.title for r in out] == sorted(r.title for r in out)


def test_inventory_value_integer_division_and_fanout(spark):
    products, variants, prices = catalog(spark)
    v = inv.inventory_value(variants, prices).collect()[0]
    # per joined row: qty * amount div 100 (truncates toward zero)
    rows = [(20, 1999), (20, 1999), (21, 333), (15, 0), (0, 5000), (-3, 7)]
    expect = sum(int(q * a / 100) for q, a in rows)
    assert v.total_value == expect
    assert v.total_variants == 6                   # variant 11 counted twice
    assert v.total_units == 20 + 20 + 21 + 15 + 0 - 3


def test_inventory_summary(spark):
    products, variants, prices = catalog(spark)
    s = inv.inventory_summary(variants, products, prices).collect()[0]
    assert s.low_stock_count == 4 and s.out_of_stock_count == 2


def test_tags_may_be_text(spark):
    products, variants, _ = catalog(spark)
    text = products.withColumn("tags", F.array_join(F.transform("tags", lambda t: t["value"]), ","))
    got = {r.id: r.t for r in text.select("id", inv.stock_threshold(F.col("tags"), text=True).alias("t")).collect()}
    assert got == {1: 20, 2: 15, 3: 10}
    assert [r.variant_id for r in inv.low_stock(variants, text).collect()] == [r.variant_id for r in inv.low_stock(variants, products).collect()]
