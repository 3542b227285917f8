"""Nested report documents (A5 sales, A10 customers).

Each report is one row whose lists are built from already-small results
(one row per day of the period, top-k rows), so no unbounded group is ever
collected. The inventory report's item lists grow with the catalogue, so
they are served as the ``low_stock`` / ``out_of_stock`` frames and only the
inventory summary (A7) is a one-row document.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwheel.functions.cols import one_row_join
from cartwheel.functions.period import resolve_period
from cartwheel.operators import customers as cu
from cartwheel.operators import sales as sa


def _list(df: DataFrame, name: str, sort_field: str, fields: list[str]) -> DataFrame:
    """Collect a small (bounded: top-k or one row per day) frame into one
    array column sorted by ``sort_field``, which is then dropped from the
    elements (empty list, not NULL, when the frame is empty)."""
    items = F.array_sort(F.collect_list(F.struct(F.col(sort_field).alias("__s"), *fields)))
    return df.agg(F.transform(items, lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(name))


def _header(spark, period: str, start: dt.datetime, end: dt.datetime) -> DataFrame:
    return spark.range(1).select(
        F.lit(period).alias("period"),
        F.lit(start).cast("timestamp_ntz").alias("start"),
        F.lit(end).cast("timestamp_ntz").alias("end"),
    )


def sales_report(orders: DataFrame, line_items: DataFrame, variants: DataFrame,
                 products: DataFrame, period: str, as_of: dt.datetime,
                 excluded=sa.DEFAULT_EXCLUDED) -> DataFrame:
    """A5: {period, start, end, summary, daily_stats[], top_products[]}."""
    start, end = resolve_period(period, as_of)
    orders_p = sa.orders_in_period(orders, start, end, excluded)
    metrics = sa.customer_metrics(orders, start, end, excluded)
    summary = sa.sales_summary(orders_p, metrics)
    summary = summary.select(F.struct(*summary.columns).alias("summary"))
    daily = _list(sa.daily_sales(orders_p), "daily_stats", "date",
                  ["date", "revenue", "orders", "average_order_value"])
    top = sa.top_products(line_items, variants, products, orders_p, sort_key=True)
    top = _list(top, "top_products", "__key", ["product_id", "title", "handle", "units_sold", "revenue"])
    return one_row_join(_header(orders.sparkSession, period, start, end), summary, daily, top)


def customer_report(customers: DataFrame, orders: DataFrame, period: str, as_of: dt.datetime,
                    excluded=sa.DEFAULT_EXCLUDED) -> DataFrame:
    """A10: {period, start, end, customer_acquisition[], top_customers[]}."""
    start, end = resolve_period(period, as_of)
    acq = _list(cu.customer_acquisition(customers, start, end), "customer_acquisition", "date",
                ["date", "new_customers"])
    top = cu.top_customers(customers, orders, start, end, excluded, sort_key=True)
    top = _list(top, "top_customers", "__key",
                ["customer_id", "email", "name", "order_count", "total_spent",
                 "average_order_value", "last_order_date"])
    return one_row_join(_header(orders.sparkSession, period, start, end), acq, top)
