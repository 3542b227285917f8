"""Published versions of lookup tables, for streams that outlive them.

The shop looks products, orders and customers up when it handles an event. A
stream that joins a table read at its start would use the same rows for weeks.
Here a job publishes versions: it writes the tables of a version to a folder of
their own, then one log row that names the folder, so readers see whole versions
or none. Each micro-batch takes the newest version and records which, before it
does anything else; a batch that is run again takes the one recorded.

Everything goes through Spark's readers and writers, so the folders may be in
any store that Spark reads.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = "version long, folder string, tables array<string>"
TAKEN_SCHEMA = "batch long, version long"


def read_if_any(spark: SparkSession, path: str, schema, fmt: str = "parquet") -> DataFrame:
    """The files under ``path``; no rows if the folder does not exist yet."""
    try:
        return spark.read.format(fmt).schema(schema).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _newest(spark: SparkSession, root: str, at_most: int | None = None):
    log = read_if_any(spark, f"{root}/log", LOG_SCHEMA, "json")
    if at_most is not None:
        log = log.where(F.col("version") == at_most)
    return log.agg(F.max(F.struct("version", "folder", "tables"))).first()[0]


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> int:
    """Writes ``tables`` as the next version under ``root``; its number. One
    publisher at a time."""
    last = _newest(spark, root)
    version = (last["version"] if last else 0) + 1
    folder = f"{root}/data/{version}-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
    row = spark.createDataFrame([(version, folder, sorted(tables))], LOG_SCHEMA)
    row.coalesce(1).write.mode("append").json(f"{root}/log")
    return version


def newest_version(spark: SparkSession, root: str) -> int | None:
    last = _newest(spark, root)
    return last["version"] if last else None


def read_version(spark: SparkSession, root: str, version: int) -> dict[str, DataFrame]:
    """The tables of one version, by name."""
    found = _newest(spark, root, version)
    if found is None:
        raise ValueError(f"version {version} was not published under {root}")
    return {name: spark.read.parquet(f"{found['folder']}/{name}") for name in found["tables"]}


def version_of_batch(spark: SparkSession, root: str, taken: str, batch: int) -> int:
    """The version a micro-batch takes: the one recorded under ``taken`` if the
    batch was run before, else the newest, which is recorded first."""
    path = f"{taken}/batch={batch}"
    before = read_if_any(spark, path, "version long", "json").agg(F.max("version")).first()[0]
    if before is not None:
        return before
    version = newest_version(spark, root)
    if version is None:
        raise ValueError(f"no version is published under {root}")
    spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("overwrite").json(path)
    return version


def versions_taken(spark: SparkSession, taken: str) -> DataFrame:
    """(batch, version) of all batches so far."""
    return read_if_any(spark, taken, TAKEN_SCHEMA, "json").select("batch", "version")
