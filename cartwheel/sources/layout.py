"""Storage layout for large fact tables: partition by a coarse time bucket.

Orders (and any table filtered by a ``created_at`` range) written with
``write_by_month`` carry a ``created_month`` partition column. The period
filter of :func:`cartwheel.operators.sales.orders_in_period` adds the
matching month range when that column is present, so Spark prunes whole
partition folders (``PartitionFilters`` in the scan) before it reads any
file, in addition to the row-group pruning from the pushed timestamp range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwheel.session import scratch_path

MONTH_COL = "created_month"


def with_month(df: DataFrame, ts_col: str = "created_at") -> DataFrame:
    return df.withColumn(MONTH_COL, F.trunc(F.col(ts_col).cast("date"), "month"))


def write_by_month(df: DataFrame, path: str, ts_col: str = "created_at", mode: str = "errorifexists") -> str:
    """Write ``df`` partitioned by the first day of the month of ``ts_col``.
    Rows are ranged by month and time before the write, so each task writes
    few partition folders and a large month is shared by several tasks."""
    (with_month(df, ts_col).repartitionByRange(MONTH_COL, ts_col)
     .write.mode(mode).partitionBy(MONTH_COL).parquet(path))
    return path


def read_by_month(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a fresh folder under the shared checkpoint directory
    and read back: cuts the plan of an iterative job, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str, codec: str | None = None) -> DataFrame:
    """``df`` as table ``table`` at ``path``, dealt into ``buckets`` by a hash of
    ``key`` and sorted by it within each. Tables bucketed alike on their join key
    are joined and semi-joined without moving rows; a bucket is a task's work,
    so their number goes with the size (one for each 256 MB or so)."""
    # one writer a bucket, or every task would write a file to every bucket
    options = {"path": path} | ({"compression": codec} if codec else {})
    (df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).options(**options).format("parquet").saveAsTable(table))
    return df.sparkSession.table(table)


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, no): a number for each distinct non-NULL key, dense within runs of
    2**33, written so that it stays."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    return written(keys.withColumn("no", F.monotonically_increasing_id()), name)
