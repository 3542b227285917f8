"""Delivery of events to the sinks' outboxes, event by event (E14, J11, J12, SNK2).

The shop handles every event on its own: one that is malformed, or whose lookup
or tracking call fails, is logged and dropped, and the others go on. Here a
micro-batch is judged row by row before payloads are built:

* events that cannot be handled go to a dead-letter table with their reason and
  their whole message; all others go to the outbox;
* lookups use the version of the tables that was newest when the batch was
  first run (:mod:`cartwheel.streaming.versions`);
* if building payloads still fails because of the data (a value a sink's format
  refuses), the batch is halved by a hash of the event until the events that
  fail stand alone; they become dead letters too. Other errors end the stream;
* payloads carry a key, a hash of their message. Those whose key is in the
  outbox already are not written again, also when a stream starts anew because
  its checkpoint is lost; only the days of the batch's events are compared;
* dead letters can be replayed against the newest version, once.

Outbox layout: ``<outbox>/<sink>/source=<source>/batch_id=<n>/day=<event day>``. A
batch that is run again replaces its folder; replays have negative batch numbers;
``compact`` gathers batch folders into segments. Every sink and source is a
stream of its own, so one that ends does not stop the others.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cartwheel.functions.cols import left_join_spread
from cartwheel.operators import payloads as pl
from cartwheel.sources import events as ev
from cartwheel.streaming.outbox import order_payload_frame, payload_frame
from cartwheel.streaming.versions import newest_version, read_if_any, read_version, version_of_batch

Tables = dict[str, DataFrame]
PAYLOAD_SCHEMA = "key string, id string, sink string, event_name string, payload string"
STORED = PAYLOAD_SCHEMA + ", batch_id long, day string"
LETTER_SCHEMA = "key string, reason string, message string, version long"
REPLAY_SCHEMA = "replay long, up_to long, version long"
SEGMENT_SCHEMA = "segment long, up_to long, replay long, folder string"
#: Batch numbers of one checkpoint; the next one's begin behind them.
BATCHES = 10 ** 9
#: Messages as text keep the microseconds of their times.
TIMES = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
#: Error classes that come from the data of single rows: SQLSTATE class 22
#: (data exception) and errors raised by expressions.
DATA_STATES = ("22", "P0001")


#: Columns of a message that go with it: its key and its day.
KEEP = ("__key", "__day")


@dataclass(frozen=True)
class Source:
    """A kind of event: how its rows are judged and turned into payloads.

    ``judged`` adds ``reason``, NULL for events that can be handled, and may add
    lookup columns; ``payloads`` maps judged events to id, sink, event_name and
    payload, with the columns ``KEEP``. ``schema`` is that of the messages."""
    name: str
    schema: object
    judged: Callable[[DataFrame, Tables], DataFrame]
    payloads: Callable[[DataFrame, Tables, str], DataFrame]


def first_reason(*checks: tuple[str, Column]) -> Column:
    """Name of the first check that holds, NULL if none does."""
    out = F.lit(None).cast("string")
    for name, bad in reversed(checks):
        out = F.when(F.coalesce(bad, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def _malformed(events: DataFrame) -> Column:
    corrupt = F.col(ev.CORRUPT).isNotNull() if ev.CORRUPT in events.columns else F.lit(False)
    return corrupt | F.col("event_name").isNull()


def judged_cart_events(events: DataFrame, tables: Tables) -> DataFrame:
    """Cart events with their variant's catalogue row and ``reason``: malformed,
    no_id, no_item, no_variant, unknown_variant (the lookup fails). Events of
    other names are nobody's and pass without a payload, and so do updates that
    change no quantity, which are never looked up."""
    item = F.col("item")
    catalog = tables["catalog"].withColumn("__known", F.lit(True))
    found = left_join_spread(events.withColumn("variant_id", item["variant_id"]), catalog, "variant_id")
    name = F.col("event_name")
    handled = name.isin(*ev.CART_EVENT_NAMES)
    acts = handled & ((name != "cart.item_updated") | F.coalesce(item["quantity"] != F.col("previousQuantity"), F.lit(False)))
    reason = first_reason(("malformed", _malformed(events)), ("no_id", F.col("id").isNull()),
                          ("no_item", handled & item.isNull()), ("no_variant", acts & item["variant_id"].isNull()),
                          ("unknown_variant", acts & F.col("__known").isNull()))
    return found.withColumn("reason", reason).drop("__known")


def cart_payloads(good: DataFrame, tables: Tables, sink: str) -> DataFrame:
    looked_up = [c for c in tables["catalog"].columns if c != "variant_id"]
    return payload_frame(pl.cart_delta(good, (*looked_up, *KEEP)), sink, KEEP)


def judged_order_events(events: DataFrame, tables: Tables) -> DataFrame:
    """Order events with ``reason``: malformed, no_id, unknown_order (a placed
    order that is not in the order table)."""
    known = tables["orders"].select("id", F.lit(True).alias("__known"))
    found = left_join_spread(events, known, "id")
    placed = F.col("event_name") == "order.placed"
    reason = first_reason(("malformed", _malformed(events)), ("no_id", F.col("id").isNull()), ("unknown_order", placed & F.col("__known").isNull()))
    return found.withColumn("reason", reason).drop("__known")


def order_payloads(good: DataFrame, tables: Tables, sink: str) -> DataFrame:
    return order_payload_frame(tables["orders"], good, sink, tables.get("customers"), KEEP)


CART = Source("cart", ev.CART_EVENT_SCHEMA, judged_cart_events, cart_payloads)
ORDERS = Source("orders", ev.ORDER_EVENT_SCHEMA, judged_order_events, order_payloads)


def event_key(source: Source) -> Column:
    """Identity of a message: a hash of its whole content, so an event that is
    delivered twice is one event."""
    names = [f.name for f in source.schema.fields]
    return F.sha2(F.to_json(F.struct(*names), TIMES), 256)


@dataclass(frozen=True)
class Delivery:
    """One sink's outbox of one source's events."""
    spark: SparkSession
    source: Source
    sink: str
    outbox: str
    lookups: str  # folder of the published versions
    dead: str

    @property
    def box(self) -> str:
        return f"{self.outbox}/{self.sink}/source={self.source.name}"

    @property
    def letters(self) -> str:
        return f"{self.dead}/{self.sink}/source={self.source.name}"

    # ------------------------------------------------------------- batches
    def write(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch (the body of ``foreachBatch``)."""
        version = version_of_batch(self.spark, self.lookups, f"{self.letters}-taken", batch_id)
        self._write(self._messages(batch), batch_id, version)

    def _messages(self, batch: DataFrame) -> DataFrame:
        # a malformed line has no content of its own; its text is the key
        key = event_key(self.source)
        if ev.CORRUPT in batch.columns:
            key = F.coalesce(F.sha2(F.col(ev.CORRUPT), 256), key)
        # the day bounds what a batch is compared with
        return batch.withColumn("__key", key).withColumn("__day", F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit("none")))

    def _write(self, events: DataFrame, batch_id: int, version: int) -> None:
        tables = read_version(self.spark, self.lookups, version)
        events = events.dropDuplicates(["__key"]).persist()
        try:
            judged = self.source.judged(events, tables)
            self._save_letters(judged.where("reason IS NOT NULL"), "reason", batch_id, version, "overwrite")
            good = judged.where("reason IS NULL").drop("reason")
            days = [r[0] for r in good.select("__day").distinct().collect()]
            done = self._delivered(batch_id).where(F.col("day").isin(days)).select(F.col("key").alias("__key"))
            self._isolate(good.join(done, "__key", "left_anti"), tables, batch_id, version, 0, 0)
        finally:
            events.unpersist()

    def _delivered(self, batch_id: int) -> DataFrame:
        """Payloads in this outbox from other batches than this one."""
        return self.deliveries().where(F.col("batch_id") != batch_id)

    def _save(self, good: DataFrame, tables: Tables, batch_id: int, mode: str) -> None:
        rows = self.source.payloads(good, tables, self.sink)
        (rows.select(F.col("__key").alias("key"), F.col("id").cast("string"), "sink", "event_name", "payload", F.col("__day").alias("day"))
         .write.mode(mode).partitionBy("day").parquet(f"{self.box}/batch_id={batch_id}"))

    def _isolate(self, good: DataFrame, tables: Tables, batch_id: int, version: int, depth: int, part: int) -> None:
        """Writes the payloads of ``good``; on a data error, of its two halves by
        the next bit of the key's hash, down to the events that fail."""
        mine = good if not depth else good.where(F.pmod(F.xxhash64("__key"), F.lit(1 << depth)) == part)
        try:
            self._save(mine, tables, batch_id, "overwrite" if not depth else "append")
            return
        except PySparkException as e:
            state = e.getSqlState() or ""
            if not state.startswith(DATA_STATES):
                raise
            error = e.getCondition() or "data error"
        if depth == 0:  # nothing of a failed write stays; the halves append
            none = self.spark.createDataFrame([], PAYLOAD_SCHEMA + ", day string")
            none.write.mode("overwrite").partitionBy("day").parquet(f"{self.box}/batch_id={batch_id}")
        if mine.limit(2).count() == 1:
            self._save_letters(mine.withColumn("reason", F.lit(error)), "reason", batch_id, version, "append")
            return
        for bit in (0, 1):
            self._isolate(good, tables, batch_id, version, depth + 1, part + (bit << depth))

    def _save_letters(self, bad: DataFrame, reason: str, batch_id: int, version: int, mode: str) -> None:
        names = [f.name for f in self.source.schema.fields]
        text = F.to_json(F.struct(*names), TIMES)
        if ev.CORRUPT in bad.columns:
            text = F.coalesce(F.col(ev.CORRUPT), text)
        (bad.select(F.col("__key").alias("key"), F.col(reason).alias("reason"), text.alias("message"), F.lit(version).cast("long").alias("version"))
         .write.mode(mode).parquet(f"{self.letters}/batch_id={batch_id}"))

    # --------------------------------------------------------- compaction
    def _segments(self) -> DataFrame:
        return read_if_any(self.spark, f"{self.box}-segments", SEGMENT_SCHEMA, "json")

    def _compacted(self) -> tuple[int, int]:
        """(last batch, last replay) that the segments hold."""
        last = self._segments().agg(F.max("up_to"), F.max("replay")).first()
        return (-1 if last[0] is None else last[0]), (last[1] or 0)

    def deliveries(self) -> DataFrame:
        """key, id, sink, event_name, payload, batch_id and day of all payloads:
        the compacted segments and the folders of later batches and replays."""
        up_to, replay = self._compacted()
        folders = [r["folder"] for r in self._segments().collect()]  # one row a compaction
        box = read_if_any(self.spark, self.box, STORED).where((F.col("batch_id") > up_to) | (F.col("batch_id") < -replay))
        for folder in folders:
            box = box.unionByName(self.spark.read.schema(STORED).parquet(folder))
        return box

    def compact(self) -> int | None:
        """Writes the payloads of all batches since the last compaction into one
        segment of few files. Its log row, written last, makes readers take it
        instead of the batch folders, so they see either. Returns its number,
        None if there is nothing new. Not while a batch runs."""
        up_to, replay = self._compacted()
        new = read_if_any(self.spark, self.box, STORED).where((F.col("batch_id") > up_to) | (F.col("batch_id") < -replay))
        last = new.agg(F.max("batch_id"), F.min("batch_id"), F.count(F.lit(1))).first()
        if not last[2]:
            return None
        number = (self._segments().agg(F.max("segment")).first()[0] or 0) + 1
        folder = f"{self.box}-compacted/{number}-{uuid.uuid4().hex}"
        # days stay together; a large day is dealt out by key
        new.repartitionByRange("day", "key").write.partitionBy("day").parquet(folder)
        row = (number, max(up_to, last[0]), max(replay, -last[1]), folder)
        self.spark.createDataFrame([row], SEGMENT_SCHEMA).coalesce(1).write.mode("append").json(f"{self.box}-segments")
        return number

    # ------------------------------------------------------------- replay
    def dead_letters(self) -> DataFrame:
        """key, reason, message, version, batch_id of all dead letters so far."""
        return read_if_any(self.spark, self.letters, LETTER_SCHEMA + ", batch_id long")

    def open_letters(self) -> DataFrame:
        """Dead letters that no replay has taken: those of batches after the last
        replay, and those that failed again in it."""
        last = self._last_replay()
        letters = self.dead_letters()
        if last is None:
            return letters.where("batch_id >= 0")
        return letters.where((F.col("batch_id") > last["up_to"]) | (F.col("batch_id") == -last["replay"]))

    def _last_replay(self):
        log = read_if_any(self.spark, f"{self.letters}-replays", REPLAY_SCHEMA, "json")
        return log.agg(F.max(F.struct("replay", "up_to", "version"))).first()[0]

    def replay(self, version: int | None = None) -> int:
        """Handles the open dead letters again, against the newest version of
        the lookups (or ``version``). Returns the number of the replay. No batch
        of the same outbox may run meanwhile."""
        last = self._last_replay()
        number = (last["replay"] if last else 0) + 1
        letters = self.open_letters()
        newest = self.dead_letters().agg(F.max("batch_id")).first()[0]
        up_to = max(newest if newest is not None else -1, last["up_to"] if last else -1)
        version = version or newest_version(self.spark, self.lookups)
        parsed = letters.select("message", F.from_json("message", self.source.schema, {"mode": "PERMISSIVE", **TIMES}).alias("e"))
        events = parsed.select("e.*", F.when(F.col("e.event_name").isNull(), F.col("message")).alias(ev.CORRUPT))
        self._write(self._messages(events), -number, version)
        row = self.spark.createDataFrame([(number, up_to, version)], REPLAY_SCHEMA)
        row.coalesce(1).write.mode("append").json(f"{self.letters}-replays")
        return number


def _epoch(delivery: Delivery, checkpoint: str) -> int:
    """Number of a checkpoint among those that fed an outbox. A stream whose
    checkpoint is lost counts its batches from 0 again; its epoch keeps them
    apart from the earlier ones."""
    spark, schema = delivery.spark, "epoch long"
    known = read_if_any(spark, f"{checkpoint}/epoch", schema, "json").agg(F.max("epoch")).first()[0]
    if known is not None:
        return known
    log = f"{delivery.box}-epochs"
    last = read_if_any(spark, log, schema, "json").agg(F.max("epoch")).first()[0]
    epoch = 0 if last is None else last + 1
    row = spark.createDataFrame([(epoch,)], schema).coalesce(1)
    row.write.mode("append").json(log)
    row.write.mode("overwrite").json(f"{checkpoint}/epoch")
    return epoch


def start_delivery(events: DataFrame, delivery: Delivery, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """A stream of events into its outbox."""
    where = f"{checkpoint}/{delivery.sink}/{delivery.source.name}"
    first = _epoch(delivery, where) * BATCHES
    w = events.writeStream.foreachBatch(lambda batch, k: delivery.write(batch, first + k)).option("checkpointLocation", where)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
