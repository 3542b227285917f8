"""Multi-table maintenance runs that write new table versions.

The reference wraps some updates in a database transaction. Without a
transaction manager the equivalent is: compute every new version from one
consistent input, write each to a fresh folder, and publish a manifest
naming the new folders last. Readers follow the manifest, so they see
either all old or all new versions.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession

from cartwheel.operators import maintain as m
from cartwheel.session import checkpoint_dir


def publish(spark: SparkSession, tables: dict[str, DataFrame], root: str, version: str) -> dict[str, str]:
    """Write every table under ``root/<table>/v=<version>`` and then the
    manifest ``root/_manifest/v=<version>.json`` (one small JSON row, written
    by Spark so it lands on the same shared storage)."""
    paths = {}
    for name, df in tables.items():
        path = os.path.join(root, name, f"v={version}")
        df.write.mode("errorifexists").parquet(path)  # readers may hold that version
        paths[name] = path
    manifest = spark.createDataFrame([(version, json.dumps(paths, sort_keys=True))], "version string, paths string")
    manifest.coalesce(1).write.mode("overwrite").json(os.path.join(root, "_manifest", f"v={version}"))
    return paths


def read_published(spark: SparkSession, root: str, version: str) -> dict[str, DataFrame]:
    row = spark.read.json(os.path.join(root, "_manifest", f"v={version}")).first()
    return {name: spark.read.parquet(path) for name, path in json.loads(row["paths"]).items()}


def run_dedupe_regions(spark: SparkSession, regions: DataFrame, options: DataFrame, countries: DataFrame,
                       fulfillment_links: DataFrame, payment_links: DataFrame, root: str,
                       version: str) -> dict[str, str]:
    """M10 as a job: the loser -> survivor mapping is computed once and
    checkpointed (a reliable checkpoint in ``spark.checkpoint.dir``, so a
    lost executor does not force the survivor ranking to be recomputed),
    then all five new versions are written and published together."""
    checkpoint_dir(spark)
    moves = m.region_moves(regions, options, countries).checkpoint(eager=True)
    out = m.dedupe_regions(regions, options, countries, fulfillment_links, payment_links, moves=moves)
    return publish(spark, {
        "region": out["region"], "shipping_option": out["shipping_option"], "country": out["country"],
        "region_fulfillment_providers": out["region_fulfillment_providers"],
        "region_payment_providers": out["region_payment_providers"],
    }, root, version)
