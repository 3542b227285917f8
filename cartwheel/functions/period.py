"""Reporting periods ('7d', '30d', '90d', '1y'; anything else means 30 days).

The reference computes "now" on the server; here the anchor is an explicit
``as_of`` argument so reports are reproducible. Both bounds are inclusive and
keep the time of day.
"""

from __future__ import annotations

import calendar
import datetime as dt

DAYS = {"7d": 7, "30d": 30, "90d": 90}
DEFAULT_PERIOD = "30d"


def resolve_period(period: str | None, as_of: dt.datetime) -> tuple[dt.datetime, dt.datetime]:
    end = as_of
    if period == "1y":
        # setFullYear(year - 1): 29 February has no counterpart and rolls
        # forward to 1 March (the date arithmetic overflows the month).
        year = end.year - 1
        if end.month == 2 and end.day == 29 and not calendar.isleap(year):
            start = end.replace(year=year, month=3, day=1)
        else:
            start = end.replace(year=year)
        return start, end
    days = DAYS.get(period or DEFAULT_PERIOD, DAYS[DEFAULT_PERIOD])
    return end - dt.timedelta(days=days), end


def sql_ts(value: dt.datetime) -> str:
    """SQL literal for oracle text."""
    return f"TIMESTAMP '{value:%Y-%m-%d %H:%M:%S.%f}'"


def period_start(period, as_of):
    """Column form of :func:`resolve_period`'s start for per-row anchors
    (``period`` and ``as_of`` are Columns); same rules, built-in expressions."""
    from pyspark.sql import functions as F

    def minus_days(n):
        return F.timestamp_add("DAY", F.lit(-n), as_of)

    year_back = F.timestamp_add("YEAR", F.lit(-1), as_of)
    # setFullYear(y-1) on 29 Feb lands on 1 Mar (the year before is never leap).
    one_year = F.when((F.month(as_of) == 2) & (F.dayofmonth(as_of) == 29),
                      F.timestamp_add("DAY", F.lit(1), year_back)).otherwise(year_back)
    expr = F.when(period == "1y", one_year)
    for code, n in DAYS.items():
        expr = expr.when(period == code, minus_days(n))
    return expr.otherwise(minus_days(DAYS[DEFAULT_PERIOD]))
