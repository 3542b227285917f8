import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrameWriter

from cartwheel.operators import customers as cu, sales as sa
from cartwheel.session import scratch_path
from cartwheel.streaming import rollup as ru

SCHEMA = "id long, seq long, status string, total long, customer_id long, created_at timestamp_ntz"
START, END = dt.datetime(2024, 1, 1), dt.datetime(2024, 3, 31, 23, 59, 59)


def orders_rollup(spark):
    return ru.Rollup(spark, scratch_path(spark, "t-rollup"), ru.order_measures(), ["status", "total"])


def some_versions(n=400, seed=0):
    """Versions of 150 orders, of which one has a third: late, out of order,
    moved to other days, canceled, priced anew, without total, day or status."""
    rng = random.Random(seed)
    return [(0 if k % 3 == 0 else rng.randrange(150), k + 1, rng.choice(["pending", "completed", "canceled", "draft", None]),
             rng.choice([None, 0, 100, 250, 999]), rng.randrange(9), rng.choice([None, dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(60 * 24))]))
            for k in range(n)]


def last(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        out[r[0]] = r
    return list(out.values())


def want(spark, rows):
    df = spark.createDataFrame(last(rows), SCHEMA)
    return sorted(map(tuple, sa.daily_sales(sa.orders_in_period(df, START, END)).collect()))


def got(r):
    return sorted(map(tuple, ru.daily_sales(r.days(), START.date(), END.date()).collect()))


def test_batches_of_changes_equal_the_report(spark):
    rows = some_versions()
    random.Random(1).shuffle(rows)  # older versions come after newer ones
    r = orders_rollup(spark)
    for k in range(4):
        r.write(spark.createDataFrame(rows[100 * k:100 * k + 100], SCHEMA), k)
        assert got(r) == want(spark, rows[:100 * k + 100])
        if k == 1:
            assert r.compact() == 1 and got(r) == want(spark, rows[:200])
    totals = ru.sales_totals(r.days(), START.date(), END.date()).first()
    orders = spark.createDataFrame(last(rows), SCHEMA)
    metrics = sa.customer_metrics(orders, START, END)
    summary = sa.sales_summary(sa.orders_in_period(orders, START, END), metrics).first()
    assert tuple(totals) == (summary.total_revenue, summary.total_orders, summary.average_order_value)


def test_a_batch_run_again_counts_once(spark):
    rows = some_versions(120, 2)
    r = orders_rollup(spark)
    r.write(spark.createDataFrame(rows[:60], SCHEMA), 0)
    second = spark.createDataFrame(rows[60:], SCHEMA)
    r.write(second, 1)
    done = got(r)
    r.write(second, 1)  # after all of it
    assert got(r) == done == want(spark, rows)
    # the run before broke off when the differences were written, not the states
    broken = orders_rollup(spark)
    broken.write(spark.createDataFrame(rows[:60], SCHEMA), 0)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(ru, "upsert", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            broken.write(second, 1)
    broken.write(second, 1)
    assert got(broken) == done


def test_stream_with_late_rows_equals_the_report(spark):
    rows = some_versions(90, 3)
    path, ckpt = scratch_path(spark, "t-rollup-in"), scratch_path(spark, "t-rollup-ckpt")
    for k in range(3):
        spark.createDataFrame(rows[30 * k:30 * k + 30], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    r = orders_rollup(spark)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    ru.start_rollup(stream, r, ckpt).awaitTermination()
    assert got(r) == want(spark, rows)
    late = [(7, 1000, "pending", 5000, 1, dt.datetime(2024, 1, 3)), (0, 1001, "canceled", 1, 1, None)]
    spark.createDataFrame(late, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    ru.start_rollup(stream, r, ckpt).awaitTermination()
    assert got(r) == want(spark, rows + late)


def test_customers_of_a_day(spark):
    rows = [(k, k, dt.datetime(2024, 1, 1 + k % 3)) for k in range(10)] + [(3, 50, dt.datetime(2024, 2, 2)), (4, 51, None), (None, 52, dt.datetime(2024, 1, 1))]
    df = spark.createDataFrame(rows, "id long, seq long, created_at timestamp_ntz")
    r = ru.Rollup(spark, scratch_path(spark, "t-rollup-c"), ru.customer_measures(), [])
    r.write(df.where("seq < 50 AND id < 6"), 0)
    r.write(df.where("seq >= 50 OR id >= 6"), 1)
    final = spark.createDataFrame([x for x in last([x for x in rows if x[0] is not None]) if x[2]], "id long, seq long, created_at timestamp_ntz")
    assert ru.customer_acquisition(r.days(), START.date(), END.date()).collect() == cu.customer_acquisition(final, START, END).collect()


def test_empty(spark):
    r = orders_rollup(spark)
    assert r.days().count() == 0 and r.compact() == -1
    r.write(spark.createDataFrame([], SCHEMA), 0)
    assert got(r) == [] and ru.sales_totals(r.days(), START.date(), END.date()).first() == (0, 0, 0)
    assert F


def test_no_task_adds_up_all_partitions(spark):
    # the plans that are written: a day's file holds one row a day, added up before by many tasks
    plans, rows = [], some_versions(120, 4)
    r = orders_rollup(spark)
    with pytest.MonkeyPatch.context() as m:
        write = DataFrameWriter.parquet
        m.setattr(DataFrameWriter, "parquet", lambda w, path, *a, **k: (plans.append((path, w._df._jdf.queryExecution().executedPlan().toString())), write(w, path, *a, **k))[1])
        r.write(spark.createDataFrame(rows[:60], SCHEMA), 0)
        r.write(spark.createDataFrame(rows[60:], SCHEMA), 1)
        assert r.compact() == 1
    sums = [p for path, p in plans if path.startswith((f"{r.root}/days", f"{r.root}/folded"))]
    assert len(sums) == 3
    for p in sums:
        assert "Coalesce" not in p and p.index("Exchange SinglePartition") < p.index("HashAggregate")
    assert spark.read.parquet(f"{r.root}/days").select(F.input_file_name()).distinct().count() == 2
    assert got(r) == want(spark, rows)
