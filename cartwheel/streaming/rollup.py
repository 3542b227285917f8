"""Daily sums kept up to date from a stream of row versions.

The reports add the same days up again and again. A rollup keeps one row of sums
a day. Rows arrive as versions: late ones, and new states of rows that were
counted before (an order that is canceled, a corrected total). Each micro-batch

1. reduces its versions to the newest of each key;
2. looks up the state each key had before (:class:`~cartwheel.sources.
   file_versions.FileTable`, which rewrites only the files that hold a key of
   the batch) and drops versions that are older than that state;
3. writes signed differences, the new contribution less the old one, as sums a
   day: a row that moves to another day or leaves the sales takes its old
   contribution back;
4. publishes the new states.

A batch that is run again starts from the state table's version it took first
and replaces its own differences, so nothing is counted twice. Readers add the
differences of a day up; ``compact`` folds them into one row a day.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cartwheel.functions.cols import js_round
from cartwheel.operators.sales import DEFAULT_EXCLUDED
from cartwheel.sources.file_versions import FileTable, upsert
from cartwheel.sources.layout import written
from cartwheel.streaming.versions import read_if_any


@dataclass(frozen=True)
class Measure:
    """What a row adds to its day: ``value`` if ``counts`` holds."""
    value: Column
    counts: Column


def order_measures(excluded=DEFAULT_EXCLUDED) -> dict[str, Measure]:
    """Sales of the day: orders, revenue, and orders with a total (the average
    order value leaves NULL totals out)."""
    sale = ~F.col("status").isin(*excluded)
    return {"orders": Measure(F.lit(1).cast("long"), sale), "revenue": Measure(F.col("total"), sale & F.col("total").isNotNull()),
            "priced": Measure(F.lit(1).cast("long"), sale & F.col("total").isNotNull())}


def customer_measures() -> dict[str, Measure]:
    return {"new_customers": Measure(F.lit(1).cast("long"), F.lit(True))}


def _one_part(days: DataFrame) -> DataFrame:
    """``days``, one small row each, as a single file. A ``coalesce`` would have
    one task add up all partitions, which holds the memory of each to its end."""
    return days.repartition(1)


class Rollup:
    """Daily sums of ``measures`` over the rows of one table.

    ``key``: the rows' id; ``seq``: a column that grows with each version of a
    row; ``time``: what a row's day is taken from (rows without one count
    nowhere); ``columns``: those that the measures read."""

    def __init__(self, spark: SparkSession, root: str, measures: dict[str, Measure], columns: list[str], key: str = "id",
                 seq: str = "seq", time: str = "created_at"):
        self.spark, self.root, self.measures = spark, root, measures
        self.key, self.seq, self.time = key, seq, time
        self.columns = [key, seq, time, *[c for c in columns if c not in (key, seq, time)]]
        self.states = FileTable(spark, f"{root}/states")
        self.schema = "date date, " + ", ".join(f"{m} long" for m in measures)

    # ------------------------------------------------------------- writing
    def write(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch of row versions (the body of ``foreachBatch``)."""
        rows = batch.select(*self.columns).where(F.col(self.key).isNotNull())
        rest = [c for c in self.columns if c != self.key]
        # ties in the sequence: the version that sorts last, so replays agree
        newest = rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), F.struct(self.seq, F.to_json(F.struct(*rest)))).alias("v"))
        newest = newest.select(self.key, "v.*").persist()
        try:
            if self.states.newest() is None:
                self.states.create(newest.limit(0))
            base = self._base(batch_id)
            before = self.states.read(base)
            old = before.join(newest.select(self.key, F.col(self.seq).alias("__seq")), self.key).where(F.col(self.seq) < F.col("__seq")).drop("__seq")
            known = before.select(self.key, F.col(self.seq).alias("__seq"))
            new = newest.join(known, self.key, "left").where(F.col("__seq").isNull() | (F.col("__seq") < F.col(self.seq))).drop("__seq")
            new = written(new, "rollup-new")
            _one_part(self._differences(new, old)).write.mode("overwrite").parquet(f"{self.root}/days/batch_id={batch_id}")
            if self.states.newest() == base:  # else a run before this one got so far
                upsert(self.states, new, self.key)
        finally:
            newest.unpersist()

    def _base(self, batch_id: int) -> int:
        """The version of the states that the batch starts from, recorded."""
        path = f"{self.root}/bases/batch={batch_id}"
        before = read_if_any(self.spark, path, "version long", "json").agg(F.max("version")).first()[0]
        if before is not None:
            return before
        base = self.states.newest()
        self.spark.createDataFrame([(base,)], "version long").coalesce(1).write.mode("overwrite").json(path)
        return base

    def _sums(self, rows: DataFrame, sign: int) -> DataFrame:
        day = rows.where(F.col(self.time).isNotNull()).groupBy(F.col(self.time).cast("date").alias("date"))
        return day.agg(*[(sign * F.coalesce(F.sum(F.when(m.counts, m.value)), F.lit(0))).cast("long").alias(name) for name, m in self.measures.items()])

    def _differences(self, new: DataFrame, old: DataFrame) -> DataFrame:
        """One row a day: what ``new`` states add to it less what ``old`` ones did."""
        both = self._sums(new, 1).unionByName(self._sums(old, -1))
        return both.groupBy("date").agg(*[F.sum(m).alias(m) for m in self.measures])

    # ------------------------------------------------------------- reading
    def _folded(self) -> tuple[int, str | None]:
        row = read_if_any(self.spark, f"{self.root}/folds", "up_to long, folder string", "json").agg(F.max(F.struct("up_to", "folder"))).first()[0]
        return (row["up_to"], row["folder"]) if row else (-1, None)

    def days(self) -> DataFrame:
        """One row a day with its sums; days whose sums are all 0 are absent."""
        up_to, folder = self._folded()
        parts = read_if_any(self.spark, f"{self.root}/days", f"{self.schema}, batch_id long").where(F.col("batch_id") > up_to).drop("batch_id")
        if folder:
            parts = parts.unionByName(self.spark.read.schema(self.schema).parquet(folder))
        sums = parts.groupBy("date").agg(*[F.sum(m).alias(m) for m in self.measures])
        some = None
        for m in self.measures:
            some = F.col(m) != 0 if some is None else some | (F.col(m) != 0)
        return sums.where(some)

    def compact(self) -> int:
        """Folds the differences of all batches so far into one row a day; the
        log row, written last, makes readers take it. The number of the last
        batch it holds."""
        held = read_if_any(self.spark, f"{self.root}/days", f"{self.schema}, batch_id long")
        last = held.agg(F.max("batch_id")).first()[0]
        up_to, _ = self._folded()
        if last is None or last <= up_to:
            return up_to
        folder = f"{self.root}/folded/{last}"
        _one_part(self.days()).write.mode("overwrite").parquet(folder)
        self.spark.createDataFrame([(last, folder)], "up_to long, folder string").coalesce(1).write.mode("append").json(f"{self.root}/folds")
        return last


def start_rollup(versions: DataFrame, rollup: Rollup, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """A stream of row versions into its rollup."""
    w = versions.writeStream.foreachBatch(rollup.write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


# ------------------------------------------------------------------ reports
def daily_sales(days: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """A1 from a rollup of :func:`order_measures`, for whole days."""
    d = days.where(F.col("date").between(F.lit(start), F.lit(end)) & (F.col("orders") != 0))
    average = F.when(F.col("priced") > 0, F.col("revenue") / F.col("priced")).otherwise(0.0)
    return d.select("date", js_round(F.col("revenue").cast("double")).alias("revenue"), "orders",
                    js_round(average).alias("average_order_value")).orderBy("date")


def sales_totals(days: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """The totals of A4 from the rollup: total_revenue, total_orders and
    average_order_value of whole days."""
    t = days.where(F.col("date").between(F.lit(start), F.lit(end))).agg(
        F.coalesce(F.sum("revenue"), F.lit(0)).cast("double").alias("r"), F.coalesce(F.sum("orders"), F.lit(0)).alias("n"))
    return t.select(js_round(F.col("r")).alias("total_revenue"), F.col("n").cast("long").alias("total_orders"),
                    F.when(F.col("n") > 0, js_round(F.col("r") / F.col("n"))).otherwise(F.lit(0)).cast("long").alias("average_order_value"))


def customer_acquisition(days: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """A8 from a rollup of :func:`customer_measures`, for whole days."""
    return days.where(F.col("date").between(F.lit(start), F.lit(end))).select("date", "new_customers").orderBy("date")
