import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cartwheel.session import scratch_path
from cartwheel.streaming import limiter

SCHEMA = "client string, path string, ts timestamp"
EPOCH = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
LIMITS = {"admin": 2, "store": 5}


def brute_force(rows, window_ms=limiter.WINDOW_MS, skip_auth=False):
    """One request after the other, as the middleware sees them."""
    open_, out = {}, defaultdict(int)
    for client, path, ts in sorted((r for r in rows if r[2] is not None), key=lambda r: r[2]):
        scope = next((s for s in ("admin", "store") if path and (path == f"/{s}" or path.startswith(f"/{s}/"))), None)
        if scope is None or (skip_auth and path.startswith("/admin/auth")):
            continue
        ms = (ts - EPOCH) // dt.timedelta(milliseconds=1)
        if (client, scope) not in open_ or ms >= open_[client, scope] + window_ms:
            open_[client, scope] = ms
        out[client, scope, open_[client, scope]] += 1
    return sorted((str(c), s, b, n, max(0, n - LIMITS[s])) for (c, s, b), n in out.items())


def found(df, window_ms=limiter.WINDOW_MS):
    rows = []
    for r in df.collect():
        begin = (r["window_start"].replace(tzinfo=dt.timezone.utc) - EPOCH) // dt.timedelta(milliseconds=1)
        assert r["window_end"] - r["window_start"] == dt.timedelta(milliseconds=window_ms)
        rows.append((str(r["client"]), r["scope"], begin, r["requests"], r["rejected"]))
    return sorted(rows)


def at(seconds):
    return EPOCH + dt.timedelta(microseconds=round(seconds * 1e6))


def some_log(n=900, hot=True, seed=0):
    """A third of all requests are one client's; spells, pauses, equal times."""
    rng = random.Random(seed)
    rows, clock = [], defaultdict(float)
    for k in range(n):
        client = "hot" if hot and k % 3 == 0 else rng.choice(["a", "b", "c", None, "", "=", ":"])
        clock[client] += rng.choice([0, 0.0004, 1, 40, 300, 899.999, 900, 901, 5000]) if client != "hot" else rng.choice([0, 7, 100, 250])
        rows.append((client, rng.choice(["/store/x", "/store", "/admin/orders", "/admin/auth/session", "/storefront", None]), at(clock[client])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("skip_auth", [False, True])
def test_batch_equals_one_request_after_the_other(spark, skip_auth):
    rows = some_log()
    got = found(limiter.limiter_windows(spark.createDataFrame(rows, SCHEMA).repartition(5), LIMITS, skip_auth=skip_auth))
    assert got == brute_force(rows, skip_auth=skip_auth)
    assert max(sum(1 for g in got if g[0] == "hot" and g[1] == s) for s in LIMITS) > 16  # several rounds of doubling


def test_edges(spark):
    w = limiter.WINDOW_MS / 1000
    cases = ([0, w], [0, w - 0.001, w, 2 * w - 0.001], [0, 1, w + 1, w + 2, 2 * w + 1], [899, 900.5, 1799, 1800.5, 2700.4], [0, 0.0001, 0.0009], [5, 5, 5],
             [-10, 3, 890, 891], [0, 450, 900, 1350, 1800, 2250], [0, 899.9, 2000, 2899.9, 3000])
    rows = [(f"x{k}", "/store/y", at(t)) for k, times in enumerate(cases) for t in times]
    assert found(limiter.limiter_windows(spark.createDataFrame(rows, SCHEMA), LIMITS)) == brute_force(rows)


def test_empty_and_uncounted(spark):
    df = spark.createDataFrame([("x", "/storefront", at(0)), ("x", None, at(1)), ("x", "/store", None)], SCHEMA)
    assert found(limiter.limiter_windows(df, LIMITS)) == [] == found(limiter.limiter_windows(df.where("false"), LIMITS))


def test_windows_begin_with_a_request_not_with_the_clock(spark):
    from cartwheel.streaming import rate_limit
    rows = [("x", "/admin/y", at(t)) for t in (840, 850, 910, 920)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert rate_limit.rate_limit_violations(df, LIMITS).count() == 0
    assert [r[3:] for r in found(limiter.limiter_windows(df, LIMITS))] == [(4, 2)]


def test_advance_holds_back_what_the_watermark_has_not_passed():
    closed, begin, n, left = limiter.advance(None, 0, {0: 1, 10: 2, 900_000: 1, 1_000_000: 4}, 950_000, 900_000)
    assert (closed, begin, n, left) == ([(0, 3)], 900_000, 1, {1_000_000: 4})
    assert limiter.advance(900_000, 1, {}, 1_800_000, 900_000) == ([(900_000, 1)], None, 0, {})


def test_stream_equals_batch(spark):
    rows = some_log(240, seed=3)
    rows = sorted((r for r in rows if r[1]), key=lambda r: r[2])
    last = rows[-1][2] + dt.timedelta(hours=3)
    path, box, ckpt = (scratch_path(spark, f"t-limiter-{x}") for x in ("log", "out", "ckpt"))
    # eight files in the order of time, shuffled within; the end moves the watermark
    parts = [rows[k:k + 30] for k in range(0, len(rows), 30)]
    for part in [*parts, [("end", "/store/x", last)], [("end", "/store/x", last + dt.timedelta(hours=3))]]:
        random.Random(len(part)).shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(path)
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(path)
    out = limiter.limiter_stream(raw, "1 minute", LIMITS)
    out.writeStream.option("checkpointLocation", ckpt).trigger(availableNow=True).foreachBatch(
        lambda b, k: b.write.mode("overwrite").parquet(f"{box}/batch_id={k}")).start().awaitTermination()
    got = [g for g in found(spark.read.parquet(box)) if g[0] != "end"]
    assert got == brute_force(rows)
    assert F
