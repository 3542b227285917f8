"""Hot keys: one customer / order / variant / duplicate group / change key
holds a third of the rows. Results are checked against a pandas brute force
on the same small fixture."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from cartwheel.operators import maintain as m
from cartwheel.operators import payloads as pl
from cartwheel.operators import sales as sa

START, END = dt.datetime(2024, 1, 1), dt.datetime(2024, 12, 31)
N = 3000


def orders_pdf():
    rows = []
    for i in range(N):
        cust = 1 if i % 3 == 0 else 2 + i % 97          # customer 1: a third of all orders
        day = dt.datetime(2023, 6, 1) + dt.timedelta(hours=7 * i)
        status = "canceled" if i % 11 == 0 else "completed"
        rows.append((i, cust, status, 100 + i % 50, day))
    return pd.DataFrame(rows, columns=["id", "customer_id", "status", "total", "created_at"])


def lines_pdf():
    rows = []
    for j in range(2 * N):
        order = 7 if j % 3 == 0 else j % N                # order 7: a third of all lines
        variant = 5 if j % 3 == 1 else j % 40             # variant 5: a third of all lines
        rows.append((order, j, variant, 1 + j % 4, 10 * (1 + j % 7), 0, 10))
    return pd.DataFrame(rows, columns=["order_id", "line_number", "variant_id", "quantity", "total", "tax_total",
                                       "unit_price"])


def test_customer_metrics_hot_customer(spark):
    o = orders_pdf()
    df = spark.createDataFrame(o).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    got = sa.customer_metrics(df, START, END).collect()[0]
    inp = o[(o.created_at >= START) & (o.created_at <= END) & ~o.status.isin(["canceled", "draft"])]
    prior = set(o[o.created_at < START].customer_id)
    assert got.unique_customers == inp.customer_id.nunique()
    assert got.returning_customers == int(inp.customer_id.isin(prior).sum())


def test_top_products_hot_order_and_variant(spark):
    o, li = orders_pdf(), lines_pdf()
    orders = spark.createDataFrame(o).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    lines = spark.createDataFrame(li)
    variants = spark.createDataFrame(pd.DataFrame({"id": range(40), "product_id": [v % 13 for v in range(40)]}))
    products = spark.createDataFrame(pd.DataFrame({"id": range(13), "title": [f"p{i}" for i in range(13)],
                                                   "handle": [f"h{i}" for i in range(13)]}))
    got = [(r.product_id, r.units_sold, r.revenue)
           for r in sa.top_products(lines, variants, products, sa.orders_in_period(orders, START, END)).collect()]
    inp = o[(o.created_at >= START) & (o.created_at <= END) & ~o.status.isin(["canceled", "draft"])]
    j = li[li.order_id.isin(inp.id)].assign(product_id=lambda d: d.variant_id % 13)
    agg = j.groupby("product_id").agg(units=("quantity", "sum"), rev=("total", "sum")).reset_index()
    agg = agg.sort_values(["rev", "product_id"], ascending=[False, True]).head(10)
    assert got == [(int(p), int(u), int(r)) for p, u, r in zip(agg.product_id, agg.units, agg.rev)]


def test_hot_order_items_are_whole(spark):
    li = lines_pdf()
    lines = spark.createDataFrame(li)
    orders = spark.createDataFrame(orders_pdf()).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    catalog = spark.createDataFrame(pd.DataFrame({"variant_id": range(40), "sku": [f"s{v}" for v in range(40)],
                                                  "product_title": "t", "product_type": "x"}))
    customers = spark.createDataFrame(pd.DataFrame({"id": range(100), "email": "e", "phone": "p", "first_name": "f",
                                                    "last_name": "l", "nation_id": 1}))
    addresses = spark.createDataFrame(pd.DataFrame({"nation_id": [1], "city": ["c"]}))
    e = pl.order_enriched(orders, lines, catalog, customers, addresses)
    hot = e.filter(F.col("id") == 7).select(F.size("items").alias("n"), "units").collect()
    assert [(r.n, r.units) for r in hot] == [(int((li.order_id == 7).sum()), int(li[li.order_id == 7].quantity.sum()))]
    rows = pl.order_item_rows(lines, catalog).filter("order_id = 7").select("position", "line_number").orderBy("position").collect()
    assert [r.position for r in rows] == list(range(hot[0].n))
    assert [r.line_number for r in rows] == sorted(li[li.order_id == 7].line_number)


def test_survivor_in_a_huge_duplicate_group(spark):
    rows = [(f"r{i:04d}", "EU" if i < 100 else f"R{i}", "eur", dt.datetime(2020, 1, 1) + dt.timedelta(days=i % 17))
            for i in range(300)]
    regions = spark.createDataFrame(rows, "id string, name string, currency_code string, created_at timestamp_ntz")
    options = spark.createDataFrame([(f"o{i}", f"r{(i * 7) % 100:04d}") for i in range(250)],
                                    "id string, region_id string")
    countries = spark.createDataFrame([], "iso_2 string, region_id string")
    surv = m.region_survivor(m.region_instances(regions, options, countries))
    got = {r.survivor_id for r in surv.collect()}
    pdf = pd.DataFrame(rows[:100], columns=["id", "name", "cc", "created_at"])
    counts = pd.Series([f"r{(i * 7) % 100:04d}" for i in range(250)]).value_counts()
    pdf["n"] = pdf.id.map(counts).fillna(0)
    best = pdf.sort_values(["n", "created_at", "id"], ascending=[False, True, True]).iloc[0].id
    assert got == {best}


def test_latest_change_for_a_hot_key(spark):
    target = spark.createDataFrame([("k", "old"), ("j", "keep")], "code string, name string")
    changes = spark.range(0, 5000).select(
        F.when(F.col("id") % 3 == 0, F.lit("k")).otherwise(F.concat(F.lit("n"), F.col("id").cast("string")))
        .alias("code"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("name"), F.col("id").alias("seq"))
    out = {r.code: r.name for r in m.upsert(target, changes, "code", seq="seq").collect()}
    assert out["k"] == "v4998" and out["j"] == "keep" and len(out) == 2 + 5000 - 1667
