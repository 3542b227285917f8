"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cartwheel.session import scratch_path

#: A word of the text contracts: a run of anything but space and \\t..\\r.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"

#: Rows of a table that may be broadcast with an explicit hint (a few MB for
#: the two- or three-column id tables of this subpackage).
BROADCAST_ROWS = 200_000


#: Rows and bytes of a batch in a Python worker, whose memory an executor must hold.
ARROW_ROWS, ARROW_BYTES = 2000, 4 << 20

_caches: list[dict] = []


def worker_cache(cache: dict) -> dict:
    """Registers what a Python worker remembers between the tasks of a stage."""
    _caches.append(cache)
    return cache


def fresh_worker(keep: dict | None = None) -> None:
    """Workers outlive a stage: at the start of a task of the next one, what
    they remember from other stages is dropped and given back to the system."""
    stale = [c for c in _caches if c is not keep and c]
    for cache in stale:
        cache.clear()
    if stale:
        give_back()


def give_back() -> None:
    """Returns freed memory of this process to the system."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


def importable(spark: SparkSession) -> None:
    """Lets Python workers of this machine import the package from where the
    driver did; on a cluster it is installed or given with ``--py-files``."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python workers in batches of at most ARROW_ROWS rows and
    about ARROW_BYTES bytes. The settings are the session's, because Spark reads
    them when a plan runs; smaller ones of the caller stay."""
    for key, unset, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", ARROW_ROWS),
                             ("spark.sql.execution.arrow.maxBytesPerBatch", "64MB", ARROW_BYTES)):
        held = spark.conf.get(key, unset)
        bytes_of = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
        if not 0 < bytes_of(held) <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: a
    lineage cut that survives lost executors and whose columns are pruned."""
    spark = df.sparkSession
    small_batches(spark)
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    give_back()  # models and filters of the steps so far
    return spark.read.schema(df.schema).parquet(path)


def free_name(columns: list[str], name: str) -> str:
    """``name``, after as many underscores as make it a name that ``columns``
    do not hold (Spark's names ignore case)."""
    held = {c.lower() for c in columns}
    while name.lower() in held:
        name = "_" + name
    return name


def words(text: Column) -> Column:
    """Words of a text as an array (null text: no words)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_PATTERN), "")


def id_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus`` (null id: of '')."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted size is small; beyond that
    the join stays a shuffle join, whose skewed partitions AQE splits."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def ranked(df: DataFrame, keys: list[Column], name: str, partitions: int | None = None) -> DataFrame:
    """``df`` with ``rank`` (long, from 0) in the order of ``keys``.

    Range-sorted by Spark and written once, because a second range partition
    could draw other borders; one row count per partition goes through the
    driver. No task holds more than its range.
    """
    spark = df.sparkSession
    part = (df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys))
    low = F.expr("monotonically_increasing_id() & ((1L << 33) - 1)")
    held = written(part.sortWithinPartitions(*keys)
                   .select("*", F.spark_partition_id().alias("_part"), low.alias("_low")), name)
    starts, seen = [], 0
    for row in held.groupBy("_part").count().orderBy("_part").collect():
        starts.append((row["_part"], seen))
        seen += row["count"]
    schema = StructType([StructField("_part", LongType()), StructField("_start", LongType())])
    offsets = spark.createDataFrame(starts, schema)  # one row per partition
    return (held.join(F.broadcast(offsets), "_part")
            .withColumn("rank", F.col("_start") + F.col("_low")).drop("_part", "_low", "_start"))
