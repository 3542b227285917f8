"""E16 as the middleware counts it: windows that begin with a request.

A client's window in a scope begins with its first request; the next one
begins with its first request at or after the end of that window. (The
clock-aligned windows of :mod:`cartwheel.streaming.rate_limit` cut one such
window in two.) Times are whole milliseconds, the middleware's clock.

Batch, on any client's log, also one that holds a third of all requests:

1. Requests are counted per (client, scope, millisecond), with map-side
   combine. Buckets of one window length then hold at most 900,000 instants of
   a client, whatever the log's size, and at most one window begins in each.
2. A request with a gap of a whole window before it begins one. That needs only
   the first and last instant of each bucket and settles most clients.
3. The others get successor links: an instant points at the first instant at
   or after its window's end, found within one bucket or from the bucket table.
4. Pointer doubling: every round follows the links from the beginnings known
   so far and squares the links, so 2**k windows of a busy spell are known
   after k rounds; spells that ended fall out. Rounds are written tables.
5. Each instant is counted for the last beginning in its bucket or the one
   before.

The stream keeps, per client and scope, its open window and the instants that
the watermark has not passed, and closes windows by an event-time timer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cartwheel.sources.layout import written
from cartwheel.streaming.rate_limit import AUTH_PATH_PREFIX, default_limits, scope_of

WINDOW_MS = 15 * 60 * 1000


def limited_requests(log: DataFrame, skip_auth: bool = False) -> DataFrame:
    """client, scope, ts (TIMESTAMP) of the requests that a limiter counts."""
    df = log.select("client", scope_of(F.col("path")).alias("scope"), "path", F.col("ts").cast("timestamp").alias("ts"))
    df = df.where(F.col("scope").isNotNull() & F.col("ts").isNotNull())
    if skip_auth:
        df = df.where(~F.col("path").startswith(AUTH_PATH_PREFIX))
    return df.drop("path")


def _instants(log: DataFrame, window_ms: int, skip_auth: bool) -> DataFrame:
    """who, client, scope, bucket, ms, n: requests per instant. ``who`` is the
    key of a client's limiter; requests without a client are one client."""
    rows = limited_requests(log, skip_auth).groupBy("client", "scope", F.unix_millis("ts").alias("ms")).agg(F.count(F.lit(1)).alias("n"))
    client = F.col("client").cast("string")
    who = F.concat("scope", F.when(client.isNull(), ":").otherwise(F.concat(F.lit("="), client)))
    return rows.select(who.alias("who"), "client", "scope", F.floor(F.col("ms") / window_ms).alias("bucket"), "ms", "n")


def _bucket_table(instants: DataFrame, window_ms: int) -> DataFrame:
    """One row per client and bucket with requests: its first and last instant,
    the next bucket and the first instants of the next two, whether its first
    instant begins a window (``begins``) and whether the spell goes on after it."""
    order = Window.partitionBy("who").orderBy("bucket")  # a client's year has 35,040 buckets
    b = (instants.groupBy("who", "bucket").agg(F.min("ms").alias("first"), F.max("ms").alias("last"))
         .withColumn("before", F.lag("last").over(order)).withColumn("next_bucket", F.lead("bucket").over(order))
         .withColumn("next_first", F.lead("first").over(order)).withColumn("after_first", F.lead("first", 2).over(order)))
    return (b.withColumn("begins", F.col("before").isNull() | (F.col("first") - F.col("before") >= window_ms))
            .withColumn("goes_on", F.coalesce(F.col("next_first") - F.col("last") < window_ms, F.lit(False))))


def successor_links(instants: DataFrame, buckets: DataFrame, window_ms: int) -> DataFrame:
    """(who, t, u): u is the client's first instant at or after t + window, for
    instants of spells that go on; links to a known beginning are left out."""
    on = buckets.where("goes_on")
    from_ = instants.join(on.drop("first", "last", "before"), ["who", "bucket"])
    end = F.col("ms") + window_ms
    # the end falls into the next bucket in number; if that one is empty the
    # first instant after it is the successor
    near = from_.where(F.col("next_bucket") == F.col("bucket") + 1)
    far = from_.where(F.col("next_bucket") > F.col("bucket") + 1).select("who", F.col("ms").alias("t"), F.col("next_first").alias("u"))
    null = F.lit(None).cast("long")
    probes = near.select("who", F.col("next_bucket").alias("bucket"), end.alias("at"), null.alias("u"), F.col("ms").alias("t"), F.col("after_first").alias("other"))
    # only buckets that a probe may end in
    hit = instants.join(on.select("who", F.col("next_bucket").alias("bucket")), ["who", "bucket"], "left_semi")
    marks = hit.select("who", "bucket", F.col("ms").alias("at"), F.col("ms").alias("u"), null.alias("t"), null.alias("other"))
    ahead = Window.partitionBy("who", "bucket").orderBy(F.col("at").desc(), F.col("u").desc_nulls_last())
    found = (probes.unionByName(marks).withColumn("found", F.min("u").over(ahead)).where("t is not null")
             .select("who", "t", F.coalesce("found", "other").alias("u")))
    links = found.unionByName(far).where("u is not null")
    begins = buckets.where("begins").select("who", F.col("first").alias("u"))
    return links.join(begins, ["who", "u"], "left_anti").select("who", "t", "u")


def window_begins(instants: DataFrame, window_ms: int) -> DataFrame:
    """(who, ms) of the requests that begin a window."""
    buckets = written(_bucket_table(instants, window_ms), "limiter-buckets")
    known = buckets.where("begins").select("who", F.col("first").alias("ms"))
    links = written(successor_links(instants, buckets, window_ms), "limiter-links")
    while not links.isEmpty():
        met = known.join(links, (known.who == links.who) & (known.ms == links.t)).select(known.who, F.col("u").alias("ms"))
        known = written(known.unionByName(met), "limiter-begins")
        step = links.select("who", F.col("t").alias("u"), F.col("u").alias("v"))
        links = written(links.join(step, ["who", "u"]).select("who", "t", F.col("v").alias("u")), "limiter-links")
    return known


def limiter_windows(log: DataFrame, limits: dict[str, int] | None = None, window_ms: int = WINDOW_MS, skip_auth: bool = False) -> DataFrame:
    """client, scope, window_start, window_end, requests and rejected (requests
    beyond the scope's limit). ``log`` has client, path and ts; a NULL client is
    one client, a NULL path or ts is not counted."""
    instants = written(_instants(log, window_ms, skip_auth), "limiter-instants")
    begins = window_begins(instants, window_ms)
    at = begins.select("who", F.floor(F.col("ms") / window_ms).alias("bucket"), F.col("ms").alias("begin"))
    own = at.withColumnRenamed("begin", "own")
    before = at.select("who", (F.col("bucket") + 1).alias("bucket"), F.col("begin").alias("earlier"))
    placed = (instants.join(own, ["who", "bucket"], "left").join(before, ["who", "bucket"], "left")
              .withColumn("begin", F.when(F.col("own") <= F.col("ms"), F.col("own")).otherwise(F.col("earlier"))))
    counted = placed.groupBy("client", "scope", "begin").agg(F.sum("n").alias("requests"))
    return _report(counted, limits, window_ms)


def _report(counted: DataFrame, limits: dict[str, int] | None, window_ms: int) -> DataFrame:
    limit = F.create_map(*[F.lit(x) for kv in (limits or default_limits()).items() for x in kv])
    time = lambda ms: F.timestamp_millis(ms).cast("timestamp_ntz")
    return counted.select("client", "scope", time(F.col("begin")).alias("window_start"), time(F.col("begin") + window_ms).alias("window_end"),
                          "requests", F.greatest(F.col("requests") - limit[F.col("scope")], F.lit(0).cast("long")).alias("rejected"))


# ------------------------------------------------------------------- stream
STATE = "begin long, requests long, at array<long>, n array<long>"
COUNTED = "client string, scope string, begin long, requests long"


def advance(begin: int | None, requests: int, instants: dict[int, int], watermark: int, window_ms: int) -> tuple:
    """Counts the instants before the watermark. Returns the closed windows
    (begin, requests), the open one and the instants that are left."""
    closed = []
    for ms in sorted(t for t in instants if t < watermark):
        if begin is not None and ms >= begin + window_ms:
            closed.append((begin, requests))
            begin = None
        if begin is None:
            begin, requests = ms, 0
        requests += instants[ms]
    if begin is not None and watermark >= begin + window_ms:
        closed.append((begin, requests))
        begin, requests = None, 0
    return closed, begin, requests, {t: n for t, n in instants.items() if t >= watermark}


def limiter_stream(log: DataFrame, watermark: str, limits: dict[str, int] | None = None, window_ms: int = WINDOW_MS,
                   skip_auth: bool = False) -> DataFrame:
    """:func:`limiter_windows` of a stream: each window once, when the
    watermark has passed its end. Requests later than the watermark are
    dropped, as in every event-time stream."""

    def count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        begin, requests, at, n = state.get if state.exists else (None, 0, [], [])
        instants = dict(zip(at or [], n or []))
        if not state.hasTimedOut:
            for frame in frames:
                for ms, times in frame["ms"].value_counts().items():
                    instants[int(ms)] = instants.get(int(ms), 0) + int(times)
        closed, begin, requests, instants = advance(begin, requests or 0, instants, state.getCurrentWatermarkMs(), window_ms)
        if begin is None and not instants:
            state.remove()
        else:
            state.update((begin, requests, list(instants), list(instants.values())))
            state.setTimeoutTimestamp((begin if begin is not None else min(instants)) + window_ms)
        yield pd.DataFrame([(*key, *w) for w in closed], columns=["client", "scope", "begin", "requests"])

    rows = limited_requests(log, skip_auth).withWatermark("ts", watermark).select(F.col("client").cast("string"), "scope", "ts", F.unix_millis("ts").alias("ms"))
    counted = rows.groupBy("client", "scope").applyInPandasWithState(count, COUNTED, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return _report(counted, limits, window_ms)

