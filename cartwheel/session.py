"""Session settings shared by every job.

Only SQL runtime settings are applied to a session handed in by the caller;
the builder in :func:`local_session` is for tests and the bench.
"""

from __future__ import annotations

import contextlib
import os
import tempfile

from pyspark.sql import SparkSession

# Runtime settings every plan relies on.
RUNTIME_CONF = {
    # Timestamps are compared with the oracle and with literal bounds; pin UTC.
    "spark.sql.session.timeZone": "UTC",
    # metadata merge (`a || b` on jsonb) keeps the right-hand value.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # Runtime re-planning: broadcast small build sides, coalesce and split
    # skewed shuffle partitions.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting points at shared storage and is used as is. Only
    when it is unset (tests, the local bench) a scratch folder is created and
    registered, so lineage cuts and streaming checkpoints still have a home.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="cartwheel-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "cartwheel") -> SparkSession:
    """Local session for tests and the bench (UI off, no extra ports)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("CARTWHEEL_DRIVER_MEM", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Static: skip capturing the Python call site of every Column call
        # (only used to decorate error messages); cuts plan-building time.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


#: Spark (from 4.1) removes the shuffle files of an execution when it ends.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of what runs inside go when it ends, not when the driver
    happens to collect its garbage: for tables that are written once. A stream
    started inside keeps the setting, so each micro-batch frees its own."""
    held = spark.conf.get(FILE_CLEANUP, None)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(FILE_CLEANUP) if held is None else spark.conf.set(FILE_CLEANUP, held)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory (never reused,
    so a retried or concurrent job cannot see another run's files)."""
    import uuid
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
