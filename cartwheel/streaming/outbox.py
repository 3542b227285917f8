"""Streaming conversion outbox (SNK2, E14) and lifecycle log.

Cart events are read with ``readStream``, turned into cart actions (E1,
stateless), joined to the static variant catalogue (stream-static join,
J12) and shaped into payloads. Each payload format is its own streaming
query with its own checkpoint, so one sink failing does not stop the other
(E14). The outbox writer is ``foreachBatch``: every micro-batch is written
to ``<outbox>/batch_id=<n>`` with overwrite, so a batch replayed after a
failure replaces its own output instead of duplicating it.
"""

from __future__ import annotations

import contextlib
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cartwheel.operators import payloads as pl
from cartwheel.session import scratch_path, shuffles_dropped
from cartwheel.sources import events as ev
from cartwheel.sources.layout import write_bucketed

SINKS = ("pixel", "measurement")
#: Order lines in a bucket of an order snapshot; a bucket is a task's work.
LINES_PER_BUCKET = 1_000_000


def payload_frame(enriched: DataFrame, sink: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, ``keep``, sink, event_name, payload JSON) for one outbox."""
    if sink == "pixel":
        df = pl.add_to_cart_conversion(enriched, keep=keep)
        name = F.col("payload.event_name")
    elif sink == "measurement":
        df = pl.ga_cart(enriched, "add", keep=keep).unionByName(pl.ga_cart(enriched, "remove", keep=keep))
        name = F.col("payload.events")[0]["name"]
    else:
        raise ValueError(sink)
    return df.select("id", *keep, F.lit(sink).alias("sink"), name.alias("event_name"),
                     F.to_json("payload").alias("payload"))


def order_payload_frame(orders: DataFrame, order_events: DataFrame, sink: str, customers: DataFrame | None = None,
                        keep: tuple[str, ...] = ()) -> DataFrame:
    """Outbox rows of placed orders: ``orders`` is the enriched static side,
    ``customers`` the table in which an event's customer is looked up who is
    not the order's."""
    if sink == "pixel":
        df = pl.purchase_conversion(orders, order_events, customers=customers, keep=keep)
        name = F.col("payload.event_name")
    elif sink == "measurement":
        df = pl.ga_purchase(orders, order_events, keep=keep)
        name = F.col("payload.events")[0]["name"]
    else:
        raise ValueError(sink)
    return df.select("id", *keep, F.lit(sink).alias("sink"), name.alias("event_name"),
                     F.to_json("payload").alias("payload"))


def _writer(path: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        # zstd: most of a payload is hex digits, which snappy leaves as they are
        batch.write.mode("overwrite").option("compression", "zstd").parquet(os.path.join(path, f"batch_id={batch_id}"))
    return write


def snapshot_catalog(spark: SparkSession, catalog: DataFrame, path: str | None = None) -> DataFrame:
    """Write the variant catalogue once (a new folder under the shared
    checkpoint directory unless ``path`` is given) and return the written
    table. Micro-batches then probe a plain parquet table instead of
    re-running the catalogue's joins and aggregate every trigger; the
    snapshot also cuts the lineage. Re-snapshot to pick up catalogue
    changes (the reference looks variants up at handling time)."""
    path = path or scratch_path(spark, "catalog-snapshot")
    with shuffles_dropped(spark):
        catalog.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def order_buckets(spark: SparkSession, n_lines: int) -> int:
    """Buckets of a snapshot of orders with ``n_lines`` lines together; at
    most as many as a table may have."""
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    return min(most, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_lines // LINES_PER_BUCKET)))


@contextlib.contextmanager
def order_snapshot(spark: SparkSession, orders: DataFrame, buckets: int):
    """The enriched orders written once, in ``buckets`` by order id, so that
    micro-batches move their events only, never the item lists of all orders.
    Orders without an id are left out: no event finds them. The table's name is
    given up at the end; its files stay, as other snapshots do."""
    table = f"outbox_orders_{uuid.uuid4().hex}"
    try:
        with shuffles_dropped(spark):
            written = write_bucketed(orders.where(F.col("id").isNotNull()), table, "id", buckets,
                                     scratch_path(spark, "order-snapshot"), "zstd")
        yield written
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def _start(out: DataFrame, outbox: str, checkpoint: str, sink: str, source: str, available_now: bool) -> StreamingQuery:
    w = out.writeStream.foreachBatch(_writer(os.path.join(outbox, sink, f"source={source}"))).option(
        "checkpointLocation", os.path.join(checkpoint, sink, source)).queryName(f"outbox_{sink}_{source}")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    with shuffles_dropped(out.sparkSession):
        return w.start()


def start_cart_outbox(cart_events: DataFrame, catalog: DataFrame, outbox: str, checkpoint: str, sink: str,
                      available_now: bool = True, salt_buckets: int = 8) -> StreamingQuery:
    """One sink's outbox of a stream of cart events. ``catalog`` is the static
    side (ideally a :func:`snapshot_catalog` table); ``salt_buckets`` spreads
    hot variants over several tasks per micro-batch."""
    enriched = pl.cart_enriched(pl.cart_delta(cart_events), catalog, salt_buckets)
    return _start(payload_frame(enriched, sink), outbox, checkpoint, sink, "cart", available_now)


def start_order_outbox(order_events: DataFrame, orders: DataFrame, outbox: str, checkpoint: str, sink: str,
                       available_now: bool = True, customers: DataFrame | None = None) -> StreamingQuery:
    """One sink's outbox of a stream of order events; ``orders`` is the
    enriched order table (:func:`cartwheel.operators.payloads.order_enriched`),
    written once as the static side (ideally an :func:`order_snapshot`), and
    ``customers`` the customer table."""
    return _start(order_payload_frame(orders, order_events, sink, customers), outbox, checkpoint, sink, "orders", available_now)


def start_outbox(spark: SparkSession, events_path: str, catalog: DataFrame, outbox: str, checkpoint: str,
                 sink: str, available_now: bool = True, max_files_per_trigger: int = 64,
                 salt_buckets: int = 8) -> StreamingQuery:
    """:func:`start_cart_outbox` over raw ``events`` files."""
    raw = ev.read_events_stream(spark, events_path, max_files_per_trigger)
    return start_cart_outbox(ev.cart_events(raw), catalog, outbox, checkpoint, sink, available_now, salt_buckets)


def finish(queries: list[StreamingQuery]) -> list[Exception]:
    """Wait for all streams, also after one failed; the errors of those that did."""
    errors: list[Exception] = []
    for q in queries:
        try:
            q.awaitTermination()
        except Exception as e:  # the other sinks go on
            errors.append(e)
    return errors


def read_outbox(spark: SparkSession, outbox: str, sink: str) -> DataFrame:
    return spark.read.parquet(os.path.join(outbox, sink))


def read_orders_stream(spark: SparkSession, orders_path: str, max_files_per_trigger: int = 64) -> DataFrame:
    """Rows of the test ``orders`` table as a stream."""
    from pyspark.sql import types as T
    schema = T.StructType([
        T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
        T.StructField("o_orderstatus", T.StringType()), T.StructField("o_totalprice", T.DoubleType()),
        T.StructField("o_orderdate", T.TimestampNTZType()), T.StructField("o_orderpriority", T.StringType())])
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(orders_path)


def start_lifecycle_log(spark: SparkSession, orders_path: str, log_path: str, checkpoint: str,
                        available_now: bool = True) -> StreamingQuery:
    """E15 as a stream: order rows -> lifecycle events -> appended log."""
    raw = read_orders_stream(spark, orders_path)
    log = pl.order_lifecycle_log(ev.order_events(raw))
    w = log.writeStream.format("parquet").option("path", log_path).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
