"""Request-rate limits as a windowed count over a request log.

The reference enforces these limits in web middleware, per client, in
fixed 15-minute windows. Here the same rule is an aggregation over a
request log (batch) or a request stream (Structured Streaming with a
watermark, so finished windows are emitted once and their state dropped).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the reference: requests per client per window.
WINDOW = "15 minutes"
ADMIN_MAX_REQUESTS = 1000          # production, admin routes
STORE_MAX_REQUESTS = 2000          # production, store routes
ADMIN_MAX_REQUESTS_DEV = 10000     # outside production
STORE_MAX_REQUESTS_DEV = 20000
# Route scopes with their production and development limits.
SCOPES = (("/admin", "admin", ADMIN_MAX_REQUESTS, ADMIN_MAX_REQUESTS_DEV),
          ("/store", "store", STORE_MAX_REQUESTS, STORE_MAX_REQUESTS_DEV))
# One variant of the middleware does not count the admin login.
AUTH_PATH_PREFIX = "/admin/auth"


def scope_of(path: Column) -> Column:
    """``admin``, ``store`` or NULL (not limited) of a request path."""
    out = None
    for prefix, name, _, _ in SCOPES:
        hit = (path == prefix) | path.startswith(prefix + "/")
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def request_windows(log: DataFrame, window: str = WINDOW, watermark: str | None = None,
                    skip_auth: bool = False) -> DataFrame:
    """Requests per (client, scope, tumbling window) of the limited routes.
    ``log`` has client, path, ts; a NULL path belongs to no scope.

    ``ts`` is cast to TIMESTAMP because watermarks reject TIMESTAMP_NTZ. The
    grouping keeps a partial aggregate per map task, so one very busy client
    costs one row per task before the shuffle.
    """
    df = log.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("scope", scope_of(F.col("path")))
    df = df.filter(F.col("scope").isNotNull())
    if skip_auth:
        df = df.filter(~F.col("path").startswith(AUTH_PATH_PREFIX))
    if watermark:
        df = df.withWatermark("ts", watermark)
    w = F.window("ts", window)
    return (df.groupBy("client", "scope", w.alias("w")).agg(F.count(F.lit(1)).alias("requests"))
            .select("client", "scope", F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"), "requests"))


def default_limits(production: bool = True) -> dict[str, int]:
    return {name: prod if production else dev for _, name, prod, dev in SCOPES}


def rate_limit_violations(log: DataFrame, limits: dict[str, int] | None = None, window: str = WINDOW,
                          watermark: str | None = None, skip_auth: bool = False) -> DataFrame:
    """(client, scope, window) whose request count exceeds its scope's limit."""
    limit = F.create_map(*[F.lit(x) for kv in (limits or default_limits()).items() for x in kv])
    w = request_windows(log, window, watermark, skip_auth)
    return w.filter(F.col("requests") > limit[F.col("scope")])
