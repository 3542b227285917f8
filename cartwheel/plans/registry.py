"""Registered queries: one Spark plan per operator key, each with its DuckDB
twin over the same parquet tables (used by the correctness gate).

Every query reads the driver's tables through :class:`Commerce` (or the
section 2.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cartwheel.functions.period import resolve_period, sql_ts
from cartwheel.sources.commerce import EXCLUDED_STATUS, TEST_THRESHOLDS, Commerce, with_views

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLE: dict[str, str] = {}

# Report anchors on the test data (orders span 1995-01-01 .. 2001-08-01).
ORDERS_AS_OF = dt.datetime(2001, 8, 1)
REPORT_PERIOD = "1y"
START, END = resolve_period(REPORT_PERIOD, ORDERS_AS_OF)
S, E = sql_ts(START), sql_ts(END)
EXCL_SQL = ", ".join(f"'{s}'" for s in EXCLUDED_STATUS)


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLE[name] = sql
        return fn
    return deco


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_ORACLE)


def _load_all() -> None:
    # Importing the modules runs their @register decorators.
    from cartwheel.plans import (  # noqa: F401
        q_directory, q_events, q_io, q_maintain, q_sales,
    )


def commerce(spark: SparkSession, sf_dir: str) -> Commerce:
    return Commerce(spark, sf_dir)


def js_round_sql(expr: str) -> str:
    return f"CAST(floor(coalesce(CAST({expr} AS DOUBLE), 0) + 0.5) AS BIGINT)"


def threshold_sql(tags: str = "tags", rules=TEST_THRESHOLDS, default: int = 10) -> str:
    whens = " ".join(
        f"WHEN len(list_filter({tags}, lambda t: t.value LIKE '%{w}%')) > 0 THEN {n}" for w, n in rules)
    return f"CASE {whens} ELSE {default} END"


__all__ = ["register", "queries", "oracle_sql", "commerce", "with_views", "START", "END", "S", "E",
           "EXCL_SQL", "ORDERS_AS_OF", "REPORT_PERIOD", "js_round_sql", "threshold_sql"]
