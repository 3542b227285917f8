"""Sales report: daily stats, top products, customer metrics, summary.

Every function takes DataFrames and returns a DataFrame; nothing is
collected. Aggregations are placed before joins wherever the result allows
it, so the wide inputs (orders, line items) are reduced map-side before any
shuffle and a hot key never reaches one task as raw rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwheel.functions.cols import js_round, lit_like, one_row_join
from cartwheel.functions.period import resolve_period
from cartwheel.sources.layout import MONTH_COL

# Order statuses that are not sales (reference vocabulary).
DEFAULT_EXCLUDED = ("canceled", "draft")
TOP_K = 10
PERIODS = ("7d", "30d", "90d", "1y")


def orders_in_period(orders: DataFrame, start: dt.datetime, end: dt.datetime,
                     excluded=DEFAULT_EXCLUDED) -> DataFrame:
    """Inclusive time range and status filter; NULL status is dropped like
    SQL's ``NOT IN`` does. Plain column-vs-literal predicates, so the range
    reaches the parquet scan as pushed filters."""
    ts = F.col("created_at")
    out = orders.filter(
        (ts >= lit_like(start, orders, "created_at"))
        & (ts <= lit_like(end, orders, "created_at"))
        & ~F.col("status").isin(*excluded)
    )
    if MONTH_COL in orders.columns:
        # Month-partitioned layout: also prune whole partition folders.
        month = F.col(MONTH_COL)
        out = out.filter((month >= F.lit(start.date().replace(day=1)))
                         & (month <= F.lit(end.date().replace(day=1))))
    return out


def daily_stats(orders_p: DataFrame) -> DataFrame:
    """Raw per-day aggregates (date, order_count, total_revenue, avg_total)."""
    return (orders_p
            .groupBy(F.date_trunc("day", "created_at").cast("date").alias("date"))
            .agg(F.count(F.lit(1)).alias("order_count"),
                 F.sum("total").alias("total_revenue"),
                 F.avg("total").alias("avg_total")))


def daily_sales(orders_p: DataFrame) -> DataFrame:
    """A1: per day revenue, orders and rounded average order value.

    Days without orders are absent. ``revenue`` treats a NULL sum as 0 and
    ``average_order_value`` is AVG(total), which skips NULL totals.
    """
    d = daily_stats(orders_p)
    return (d.select(
        "date",
        js_round(F.coalesce(F.col("total_revenue").cast("double"), F.lit(0.0))).alias("revenue"),
        F.col("order_count").alias("orders"),
        js_round(F.coalesce(F.col("avg_total"), F.lit(0.0))).alias("average_order_value"),
    ).orderBy(F.col("date").asc_nulls_last()))


def top_products(line_items: DataFrame, variants: DataFrame, products: DataFrame,
                 orders_p: DataFrame, k: int = TOP_K, sort_key: bool = False) -> DataFrame:
    """A2: units and revenue per product over in-period orders, top ``k`` by
    revenue (NULL revenue first, as the database sorts DESC), product id as
    tie-breaker. ``sort_key`` adds ``__key``, a struct whose ascending order
    is the report order (for sorting a collected list without a window).

    Plan: semi-join line items to in-period orders, aggregate per variant
    (partial aggregation map-side), then join the much smaller result to
    variant and product and aggregate per product. Equivalent to the
    reference's join-then-group because variant -> product is many-to-one.
    """
    li = line_items.join(orders_p.select(F.col("id").alias("order_id")), "order_id", "left_semi")
    per_variant = li.groupBy("variant_id").agg(
        F.sum("quantity").alias("units"), F.sum("total").alias("revenue"))
    v = variants.select(F.col("id").alias("variant_id"), "product_id")
    p = products.select(F.col("id").alias("product_id"), "title", "handle")
    per_product = (per_variant.join(v, "variant_id").join(p, "product_id")
                   .groupBy("product_id", "title", "handle")
                   .agg(F.sum("units").alias("units_sold"), F.sum("revenue").alias("revenue")))
    return (per_product
            .orderBy(F.col("revenue").desc_nulls_first(), F.col("product_id").asc_nulls_last())
            .limit(k)
            .select("product_id", "title", "handle",
                    F.coalesce(F.col("units_sold"), F.lit(0)).cast("bigint").alias("units_sold"),
                    js_round(F.coalesce(F.col("revenue").cast("double"), F.lit(0.0))).alias("revenue"),
                    *([desc_key("revenue", "product_id").alias("__key")] if sort_key else [])))


def desc_key(metric: str, tie: str):
    """Struct whose ascending order is ``metric DESC NULLS FIRST, tie ASC``."""
    return F.struct(F.col(metric).isNotNull().alias("a"), (-F.col(metric)).alias("b"), F.col(tie).alias("c"))


def customer_metrics(orders: DataFrame, start: dt.datetime, end: dt.datetime,
                     excluded=DEFAULT_EXCLUDED) -> DataFrame:
    """A3: one row with ``unique_customers`` (distinct customers with an
    in-period order) and ``returning_customers``.

    ``returning_customers`` counts in-period *orders* (not customers) whose
    customer has any order before ``start``, of any status (S6).

    Both sides are reduced to one row per customer before the join (partial
    aggregation map-side), so a customer with a huge order count costs one
    row per map task, not a skewed join partition.
    """
    in_period = orders_in_period(orders, start, end, excluded).filter(F.col("customer_id").isNotNull())
    per_customer = in_period.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
    before = orders.filter((F.col("created_at") < lit_like(start, orders, "created_at"))
                           & F.col("customer_id").isNotNull())
    if MONTH_COL in orders.columns:
        before = before.filter(F.col(MONTH_COL) <= F.lit(start.date().replace(day=1)))
    prior = before.groupBy("customer_id").agg(F.lit(True).alias("returning"))
    joined = per_customer.join(prior, "customer_id", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("unique_customers"),
        F.coalesce(F.sum(F.when(F.col("returning"), F.col("n"))), F.lit(0)).cast("bigint")
        .alias("returning_customers"),
    )


def customer_metrics_by_period(orders: DataFrame, as_of: dt.datetime, codes=PERIODS, excluded=DEFAULT_EXCLUDED) -> DataFrame:
    """A3 for several periods that end at ``as_of``: period, unique_customers and
    returning_customers, from one scan and one shuffle of one row a customer and
    task: the customer's first order (of any status) and its in-period orders
    per period. Equal to one :func:`customer_metrics` a period."""
    seen = orders.filter((F.col("created_at") <= lit_like(as_of, orders, "created_at")) & F.col("customer_id").isNotNull())
    starts = {code: resolve_period(code, as_of)[0] for code in codes}
    ts, sale = F.col("created_at"), ~F.col("status").isin(*excluded)
    counts = [F.count_if((ts >= lit_like(start, orders, "created_at")) & sale).alias(f"n_{code}") for code, start in starts.items()]
    per_customer = seen.groupBy("customer_id").agg(F.min(ts).alias("first"), *counts)
    sums = []
    for code, start in starts.items():
        n = F.col(f"n_{code}")
        returning = F.sum(F.when(F.col("first") < lit_like(start, orders, "created_at"), n))
        sums.append(F.struct(F.lit(code).alias("period"), F.count_if(n > 0).alias("unique_customers"),
                             F.coalesce(returning, F.lit(0)).cast("bigint").alias("returning_customers")).alias(f"m_{code}"))
    one = per_customer.agg(*sums)
    return one.select(F.explode(F.array(*[f"m_{code}" for code in starts])).alias("m")).select("m.*")


def daily_customer_bitmaps(orders: DataFrame, numbers: DataFrame, excluded=DEFAULT_EXCLUDED) -> DataFrame:
    """(date, bucket, bitmap): the customers with a sale on a day as bitmaps of
    32,768 customer numbers each (4 KB). They are exact and merge by OR, so a
    day's are built once and serve every period that has the day. ``numbers``:
    customer_id, no (:func:`cartwheel.sources.layout.numbered`)."""
    sales = orders.filter(~F.col("status").isin(*excluded) & F.col("customer_id").isNotNull())
    pairs = sales.select("customer_id", F.col("created_at").cast("date").alias("date")).where("date IS NOT NULL").distinct()
    return (pairs.join(numbers, "customer_id")
            .groupBy("date", F.bitmap_bucket_number("no").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("no")).alias("bitmap")))


def customers_in_periods(bitmaps: DataFrame, last_days: list[dt.date], days: dict[str, int]) -> DataFrame:
    """(last_day, period, unique_customers) of the periods of ``days`` whole days
    that end with each of ``last_days`` (bounded lists of the caller), from
    :func:`daily_customer_bitmaps` alone."""
    ends = F.array(*[F.lit(d) for d in last_days])
    out = None
    for code, n in days.items():
        fits = F.filter(ends, lambda e: (F.col("date") <= e) & (F.col("date") > F.date_sub(e, n)))  # noqa: B023
        part = bitmaps.select(F.explode(fits).alias("last_day"), F.lit(code).alias("period"), "bucket", "bitmap")
        out = part if out is None else out.unionByName(part)
    merged = out.groupBy("last_day", "period", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bitmap")).alias("n"))
    return merged.groupBy("last_day", "period").agg(F.sum("n").alias("unique_customers"))


def sales_summary(orders_p: DataFrame, metrics: DataFrame) -> DataFrame:
    """A4: totals of the period plus the customer metrics.

    ``total_revenue`` sums daily revenue with NULL as 0; the average order
    value is total revenue / total orders (0 when there are no orders), both
    rounded half up.
    """
    # The daily sums need not be formed for their sum: a day without totals adds 0.
    totals = orders_p.agg(F.sum("total").alias("rev"), F.count(F.lit(1)).alias("cnt"))
    cnt = F.coalesce(F.col("cnt"), F.lit(0))
    rev = F.coalesce(F.col("rev"), F.lit(0)).cast("double")
    return one_row_join(totals, metrics).select(
        js_round(rev).alias("total_revenue"),
        cnt.cast("bigint").alias("total_orders"),
        F.when(cnt > 0, js_round(rev / cnt.cast("double"))).otherwise(F.lit(0)).cast("bigint")
        .alias("average_order_value"),
        F.col("unique_customers").cast("bigint").alias("unique_customers"),
        F.col("returning_customers").cast("bigint").alias("returning_customers"),
    )
