from pyspark.sql import functions as F
import datetime as dt

from cartwheel.operators import customers as cu
from cartwheel.operators import sales as sa
from tests.conftest import ts

START, END = ts(2024, 1, 1), ts(2024, 1, 31)
ORDERS = "id bigint, customer_id bigint, status string, total bigint, created_at timestamp_ntz"


def orders(spark):
    rows = [
        (1, 10, "completed", 1000, START),                        # on start: in
        (2, 10, "pending", 2001, END),                            # on end: in
        (3, 11, "completed", None, ts(2024, 1, 5)),               # NULL total
        (4, 11, None, 500, ts(2024, 1, 5)),                       # NULL status: out (S7)
        (5, 12, "canceled", 700, ts(2024, 1, 6)),
        (6, 12, "draft", 700, ts(2024, 1, 6)),
        (7, 13, "completed", 999, START - dt.timedelta(microseconds=1)),  # 1 us before: out
        (8, 13, "completed", 3, ts(2024, 1, 7)),
        (9, 13, "completed", 4, ts(2024, 1, 7)),
        (10, 14, "canceled", 1, ts(2023, 6, 1)),                  # earlier canceled order still counts (S6)
        (11, 14, "completed", 5, ts(2024, 1, 8)),
        (12, 14, "completed", 6, ts(2024, 1, 9)),
        (13, None, "completed", 7, ts(2024, 1, 9)),
    ]
    return spark.createDataFrame(rows, ORDERS)


def test_orders_in_period_bounds(spark):
    ids = sorted(r.id for r in sa.orders_in_period(orders(spark), START, END).collect())
    assert ids == [1, 2, 3, 8, 9, 11, 12, 13]


def test_daily_sales(spark):
    d = {r.date.isoformat(): r for r in sa.daily_sales(sa.orders_in_period(orders(spark), START, END)).collect()}
    assert d["2024-01-05"].revenue == 0 and d["2024-01-05"].orders == 1 and d["2024-01-05"].average_order_value == 0
    assert d["2024-01-07"].average_order_value == 4      # avg 3.5 rounds half up
    assert d["2024-01-09"].orders == 2


def test_customer_metrics_counts_orders_of_returning_customers(spark):
    m = sa.customer_metrics(orders(spark), START, END).collect()[0]
    assert m.unique_customers == 4                      # 10, 11, 13, 14
    assert m.returning_customers == 4                   # 13: 2 orders, 14: 2 orders


def test_sales_summary(spark):
    o = orders(spark)
    p = sa.orders_in_period(o, START, END)
    s = sa.sales_summary(p, sa.customer_metrics(o, START, END)).collect()[0]
    assert s.total_orders == 8
    assert s.total_revenue == 1000 + 2001 + 3 + 4 + 5 + 6 + 7
    assert s.average_order_value == round((1000 + 2001 + 3 + 4 + 5 + 6 + 7) / 8)


def test_top_products_ties_and_null_first(spark):
    li = [(i, 1, i, 2, 100) for i in range(1, 12)] + [(20, 1, 20, 1, None)]
    line_items = spark.createDataFrame(li, "id bigint, order_id bigint, variant_id bigint, quantity int, total bigint")
    variants = spark.createDataFrame([(i, i) for i in list(range(1, 12)) + [20]], "id bigint, product_id bigint")
    products = spark.createDataFrame([(i, f"p{i}", f"h{i}") for i in list(range(1, 12)) + [20]],
                                     "id bigint, title string, handle string")
    op = spark.createDataFrame([(1, 1, "completed", 1, START)], ORDERS)
    top = sa.top_products(line_items, variants, products, op).collect()
    assert len(top) == 10
    assert top[0].product_id == 20 and top[0].revenue == 0          # NULL revenue sorts first
    assert [r.product_id for r in top[1:]] == list(range(1, 10))    # equal revenue: id order


def test_top_customers(spark):
    cust = spark.createDataFrame([(10, "a@x", "Ann", ""), (13, "c@x", None, "Lee"), (14, "d@x", "", None)],
                                 "id bigint, email string, first_name string, last_name string")
    top = cu.top_customers(cust, orders(spark), START, END).collect()
    assert [r.customer_id for r in top] == [10, 14, 13]
    assert top[0].name == "Ann" and top[2].name == "Lee" and top[1].name == ""
    assert top[2].average_order_value == 4   # (3+4)/2 = 3.5 -> 4


def test_month_partitioned_orders_prune_partitions(spark):
    import contextlib
    import io

    from cartwheel.session import scratch_path
    from cartwheel.sources.commerce import Commerce
    from cartwheel.sources.layout import read_by_month, write_by_month
    c = Commerce(spark, "/root/testdata/sf0.01")
    path = write_by_month(c.orders, scratch_path(spark, "t-orders-by-month"))
    parted = read_by_month(spark, path)
    start, end = dt.datetime(2000, 8, 1), dt.datetime(2001, 8, 1)
    a = sa.daily_sales(sa.orders_in_period(parted, start, end, c.excluded_status))
    b = sa.daily_sales(sa.orders_in_period(c.orders, start, end, c.excluded_status))
    assert a.collect() == b.collect()
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        a.explain("formatted")
    pf = [ln for ln in buf.getvalue().splitlines() if ln.startswith("PartitionFilters")][0]
    assert "created_month" in pf


def test_reports_run_on_the_shops_own_tables(spark):
    import datetime as dt

    import pytest
    from cartwheel.plans import reports
    from cartwheel.session import scratch_path
    from cartwheel.sources.commerce import Commerce
    from cartwheel.sources.tables import Tables
    c = Commerce(spark, "/root/testdata/sf0.001")
    folder = scratch_path(spark, "t-shop")
    for name, df in (("order", c.orders.withColumn("total", F.col("total").cast("string"))), ("line_item", c.line_items),
                     ("product", c.products), ("product_variant", c.variants), ("country", c.countries.drop("region_id"))):
        df.write.parquet(f"{folder}/{name}")
    t = Tables(spark, folder)
    report = lambda x: reports.sales_report(x.orders, x.line_items, x.variants, x.products, "1y", dt.datetime(2001, 8, 1), ("F",)).collect()
    assert report(t) == report(c)
    with pytest.raises(ValueError, match="region_id"):
        t.countries


def test_text_numbers(spark):
    from cartwheel.functions.cols import number_or_zero
    df = spark.createDataFrame([("12.5",), ("x",), (None,)], "v string")
    assert [r.n for r in df.select(number_or_zero("v").alias("n")).collect()] == [12.5, 0.0, 0.0]
