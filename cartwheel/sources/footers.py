"""Counts, least and greatest values from Parquet footers.

The file source of the second kind can answer COUNT, MIN and MAX from the row
group statistics in the footers, without reading a column. That source is off by
default, so these readers use a session of their own, which shares the Spark
context and the catalogue but not the settings of the caller.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def footer_session(spark: SparkSession) -> SparkSession:
    """A session in which Parquet aggregates are pushed into the scan."""
    session = spark.newSession()
    for key, value in (("spark.sql.sources.useV1SourceList", ""), ("spark.sql.parquet.aggregatePushdown", "true"),
                       ("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))):
        session.conf.set(key, value)
    return session


def row_counts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """table_name and row_count of Parquet tables, one row each."""
    session, out = footer_session(spark), None
    for name, path in paths.items():
        one = session.read.parquet(path).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


def column_ranges(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """One row: rows, and for every column its number of values, least and
    greatest value (``n_<column>``, ``min_<column>``, ``max_<column>``). Numbers,
    dates and booleans only: footers may hold cut strings."""
    table = footer_session(spark).read.parquet(path)
    held = [f"{k}({c})" for c in columns for k in ("n", "min", "max")]
    aggs = [a for c in columns for a in (F.count(c), F.min(c), F.max(c))]
    one = table.agg(F.count(F.lit(1)).alias("rows"), *[a.alias(h) for a, h in zip(aggs, held)])
    return one.select("rows", *[F.col(f"`{h}`").alias(h.replace("(", "_").rstrip(")")) for h in held])
