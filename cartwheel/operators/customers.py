"""Customer report: acquisition per day and top customers by spend."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwheel.functions.cols import js_round, lit_like
from cartwheel.operators.sales import DEFAULT_EXCLUDED, TOP_K, desc_key, orders_in_period


def customer_acquisition(customers: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Customers created per day in the inclusive range, by date."""
    ts = F.col("created_at")
    c = customers.filter((ts >= lit_like(start, customers, "created_at"))
                         & (ts <= lit_like(end, customers, "created_at")))
    return (c.groupBy(F.date_trunc("day", ts).cast("date").alias("date"))
            .agg(F.count(F.lit(1)).alias("new_customers"))
            .orderBy(F.col("date").asc_nulls_last()))


def top_customers(customers: DataFrame, orders: DataFrame, start: dt.datetime, end: dt.datetime,
                  excluded=DEFAULT_EXCLUDED, k: int = TOP_K, sort_key: bool = False) -> DataFrame:
    """Per customer order count, spend, average and last order date over
    in-period orders; top ``k`` by spend (NULL first), customer id breaks ties.

    Orders are aggregated per customer before the join with the customer
    table (inner join semantics are kept: orders of unknown customers drop).
    """
    o = orders_in_period(orders, start, end, excluded)
    per_customer = o.groupBy(F.col("customer_id").alias("id")).agg(
        F.count("id").alias("order_count"),
        F.sum("total").alias("total_spent"),
        F.avg("total").alias("avg_total"),
        F.max("created_at").alias("last_order_date"),
    )
    c = customers.select("id", "email", "first_name", "last_name")
    j = per_customer.join(c, "id")
    name = F.trim(F.concat(F.coalesce(F.when(F.col("first_name") != "", F.col("first_name")), F.lit("")),
                           F.lit(" "),
                           F.coalesce(F.when(F.col("last_name") != "", F.col("last_name")), F.lit(""))))
    return (j.orderBy(F.col("total_spent").desc_nulls_first(), F.col("id").asc_nulls_last())
            .limit(k)
            .select(F.col("id").alias("customer_id"), "email", name.alias("name"),
                    F.col("order_count").cast("bigint").alias("order_count"),
                    js_round(F.coalesce(F.col("total_spent").cast("double"), F.lit(0.0))).alias("total_spent"),
                    js_round(F.coalesce(F.col("avg_total"), F.lit(0.0))).alias("average_order_value"),
                    "last_order_date",
                    *([desc_key("total_spent", "id").alias("__key")] if sort_key else [])))
