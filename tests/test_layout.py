import datetime as dt
import random
import uuid

from pyspark.sql import functions as F

from cartwheel.functions.period import resolve_period
from cartwheel.operators import sales as sa
from cartwheel.session import scratch_path
from cartwheel.sources import footers
from cartwheel.sources.layout import numbered, write_bucketed

AS_OF = dt.datetime(2024, 3, 1, 12, 30)  # not midnight: periods begin within a day


def some_orders(spark, n=3000):
    rng = random.Random(4)
    rows = [(k, 1 if k % 3 == 0 else rng.choice([None, *range(2, 300)]), rng.choice(["pending", "canceled", "draft", None, "completed"]),
             AS_OF - dt.timedelta(minutes=rng.randrange(-5000, 700 * 1440))) for k in range(n)]
    rows += [(n + k, 900 + k, "pending", resolve_period(p, AS_OF)[0] + dt.timedelta(microseconds=d)) for k, (p, d) in enumerate(
        (p, d) for p in sa.PERIODS for d in (-1, 0, 1))]
    return spark.createDataFrame(rows, "id long, customer_id long, status string, created_at timestamp_ntz")


def test_four_periods_from_one_scan_equal_four_runs(spark):
    orders = some_orders(spark)
    df = sa.customer_metrics_by_period(orders, AS_OF)
    for r in df.collect():
        one = sa.customer_metrics(orders, *resolve_period(r.period, AS_OF)).first()
        assert (r.unique_customers, r.returning_customers) == (one.unique_customers, one.returning_customers)
    assert df.count() == 4 and sa.customer_metrics_by_period(orders.where("false"), AS_OF).where("unique_customers + returning_customers = 0").count() == 4
    path = scratch_path(spark, "t-orders")
    orders.write.parquet(path)
    plan = sa.customer_metrics_by_period(spark.read.parquet(path), AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_bitmaps_merge_to_exact_distinct_counts(spark):
    orders = some_orders(spark)
    numbers = numbered(orders, "customer_id", "t-numbers")
    assert numbers.count() == numbers.select("no").distinct().count() == orders.select("customer_id").where("customer_id is not null").distinct().count()
    bitmaps = sa.daily_customer_bitmaps(orders, numbers)
    ends, days = [dt.date(2024, 2, 29), dt.date(2024, 1, 31), dt.date(1999, 1, 1)], {"1d": 1, "7d": 7, "90d": 90, "1y": 365}
    got = {(r.last_day, r.period): r.unique_customers for r in sa.customers_in_periods(bitmaps, ends, days).collect()}
    want, rows = {}, [r for r in orders.collect() if r.customer_id is not None and r.status not in (None, "canceled", "draft")]
    for e in ends:
        for p, n in days.items():
            who = {r.customer_id for r in rows if e - dt.timedelta(days=n) < r.created_at.date() <= e}
            if who:
                want[e, p] = len(who)
    assert got == want and len(want) > 5


def test_bucketed_tables_join_without_moving_line_items(spark):
    rng = random.Random(5)
    lines = spark.createDataFrame([(0 if k % 3 == 0 else rng.randrange(400), rng.randrange(20), 1 + k % 4, 100 * k) for k in range(3000)],
                                  "order_id long, variant_id long, quantity int, total long")
    orders = spark.createDataFrame([(k, "pending" if k % 4 else "canceled", AS_OF) for k in range(400)], "id long, status string, created_at timestamp_ntz")
    variants = spark.createDataFrame([(v, v // 2) for v in range(20)], "id long, product_id long")
    products = spark.createDataFrame([(p, f"p{p}", f"h{p}") for p in range(10)], "id long, title string, handle string")
    tag, root = uuid.uuid4().hex, scratch_path(spark, "t-bucketed")
    bl = write_bucketed(lines, f"t_lines_{tag}", "order_id", 4, f"{root}/l")
    bo = write_bucketed(orders, f"t_orders_{tag}", "id", 4, f"{root}/o")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        top = sa.top_products(bl, variants, products, sa.orders_in_period(bo, *resolve_period("30d", AS_OF)))
        assert top.collect() == sa.top_products(lines, variants, products, sa.orders_in_period(orders, *resolve_period("30d", AS_OF))).collect()
        semi = bl.join(sa.orders_in_period(bo, *resolve_period("30d", AS_OF)).select(F.col("id").alias("order_id")), "order_id", "left_semi")
        plan = semi._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE t_lines_{tag}")
        spark.sql(f"DROP TABLE t_orders_{tag}")


def test_counts_come_from_the_footers(spark):
    path = scratch_path(spark, "t-footers")
    rows = spark.range(1000).select(F.when(F.col("id") % 10 > 0, F.col("id")).alias("a"), (F.col("id") * 0.5).alias("b"), F.lit("x").alias("s"))
    rows.repartition(3).write.parquet(path)
    counts = footers.row_counts(spark, {"one": path, "two": path})
    assert sorted(map(tuple, counts.collect())) == [("one", 1000), ("two", 1000)]
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)]" in plan and "FileScan" not in plan
    r = footers.column_ranges(spark, path, ["a", "b"])
    assert r.first().asDict() == {"rows": 1000, "n_a": 900, "min_a": 1, "max_a": 999, "n_b": 1000, "min_b": 0.0, "max_b": 499.5}
    assert "PushedAggregation: [COUNT(*), COUNT(a), MIN(a), MAX(a)" in r._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"  # the caller's session stays as it is
