"""Operator 1: temporal list join (DataFrame functions only).

Dated list entries (a host suffix, optionally with a path prefix, is added to
or removed from a block or allow list) become validity intervals: an entry
holds from its date to the next entry of the same list and pattern. An as-of
join evaluates every capture against the entries active at its fetch time.

Of the active matches the most specific pattern decides (more host labels,
then more path segments); between equals ``allow`` beats ``block``, then the
smaller list name is reported.

Scale: captures are reduced to distinct (url, fetch time) before they are
spread over their candidate patterns, of which there are no more than the
longest listed host and path call for; intervals are cut into calendar
buckets, so that join keys are (pattern, bucket) and a host with a third of all
captures is dealt out over its buckets, and AQE splits what remains skewed.
Nothing is broadcast by hint.

Defined results: a null or empty url, a url without a host or a null fetch
time matches nothing and is kept; entries with a null list, pattern, date or
action are ignored; of several entries of one list and pattern at one instant
an ``add`` wins over a ``remove``; repeated entries count once; repeated
captures each get a row; empty tables give no match or an empty result; other
columns of the captures pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cartwheel.llm.common import free_name

BUCKET_DAYS = 32
FOREVER = "9999-12-31"
#: Columns added to the captures.
RESULT = ["host", "verdict", "list_name", "pattern", "valid_from", "valid_to"]


def host_of(url: Column) -> Column:
    """Lower-case host without user, port or final dot; null if there is none."""
    raw = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    host = F.regexp_replace(F.lower(raw), r"\.+$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """Path segments of a url, empty ones left out."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.array_remove(F.split(path, "/"), "")


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list_name, action, pattern, valid_from, valid_to) of dated changes.

    ``entries``: list_name, action (block or allow), pattern (host or
    host/path), change (add or remove), changed_on (date). The window runs over
    the changes of one list and pattern; repeated changes are reduced first,
    to one per day.
    """
    clean = entries.where(F.col("list_name").isNotNull() & F.col("pattern").isNotNull() & F.col("changed_on").isNotNull()
                          & F.col("action").isin("block", "allow") & F.col("change").isin("add", "remove"))
    key = ["list_name", "action", "pattern"]
    daily = clean.groupBy(*key, "changed_on").agg(F.max((F.col("change") == "add").cast("int")).alias("_on"))
    nxt = F.lead("changed_on").over(Window.partitionBy(*key).orderBy("changed_on"))
    spans = daily.withColumn("valid_to", F.coalesce(nxt, F.lit(FOREVER).cast("date")))
    return spans.where("_on = 1").select(*key, F.col("changed_on").alias("valid_from"), "valid_to")


def depths(pattern: Column) -> tuple[Column, Column]:
    """Host labels and path segments of a pattern."""
    parts = F.split(pattern, "/")
    return F.size(F.split(parts[0], r"\.")), F.size(F.array_remove(F.slice(parts, 2, F.size(parts)), ""))


def as_of_join(captures: DataFrame, entries: DataFrame, url: str = "url", fetched_on: str = "fetched_on") -> DataFrame:
    """Captures with the columns of RESULT; verdict is ``block``, ``allow`` or null."""
    # names of the result, and of the steps to it, in any case of letters
    taken = {*RESULT, "_url", "_day", "_hit"}
    renamed = {}
    for c in captures.columns:
        if c.lower() in taken:
            renamed[c] = free_name([*captures.columns, *renamed.values(), *taken], f"capture_{c}")
    if renamed:
        captures = captures.withColumnsRenamed(renamed)
        url, fetched_on = (renamed.get(c, c) for c in (url, fetched_on))
    spans = validity_intervals(entries)
    labels, segments = depths(F.col("pattern"))
    bounds = spans.agg(F.max(labels).alias("labels"), F.max(segments).alias("segments"),
                       F.min("valid_from").alias("first")).first()  # three numbers
    seen = captures.select(F.col(url).alias("_url"), F.col(fetched_on).cast("date").alias("_day")).where(
        F.col("_url").isNotNull() & F.col("_day").isNotNull()).distinct()
    last = captures.agg(F.max(F.col(fetched_on).cast("date")).alias("d")).first()["d"]
    bucket = lambda day: F.floor(F.unix_date(day) / BUCKET_DAYS)
    if bounds["labels"] is None or last is None:
        spans = spans.where("false")
        last, max_labels, max_segments = "1970-01-01", 1, 0
    else:
        max_labels, max_segments = bounds["labels"], bounds["segments"]
    # no capture is later than ``last``: cut open intervals there
    spans = spans.where(F.col("valid_from") <= F.lit(last).cast("date")).withColumn(
        "_bucket", F.explode(F.sequence(bucket(F.col("valid_from")),
                                        F.greatest(bucket(F.col("valid_from")), bucket(F.least(F.date_sub("valid_to", 1), F.lit(last).cast("date")))))))
    host_labels = F.split(F.col("host"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(host_labels), F.lit(max_labels))),
                           lambda k: F.array_join(F.slice(host_labels, -k, k), "."))
    segments_of = path_of(F.col("_url"))
    paths = F.transform(F.sequence(F.lit(0), F.least(F.size(segments_of), F.lit(max_segments))),
                        lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.lit("/"), F.array_join(F.slice(segments_of, 1, F.greatest(k, F.lit(1))), "/"))))
    hosts = seen.withColumn("host", host_of(F.col("_url"))).where(F.col("host").isNotNull())
    candidates = (hosts.withColumn("_suffix", F.explode(suffixes)).withColumn("_path", F.explode(paths))
                  .select("_url", "_day", F.concat("_suffix", "_path").alias("pattern"), bucket(F.col("_day")).alias("_bucket")))
    hits = candidates.join(spans, ["pattern", "_bucket"]).where(
        (F.col("valid_from") <= F.col("_day")) & (F.col("_day") < F.col("valid_to")))
    labels, segments = depths(F.col("pattern"))
    best = hits.groupBy("_url", "_day").agg(F.min(F.struct(
        (-labels).alias("a"), (-segments).alias("b"), F.col("action"), F.col("list_name"), F.col("pattern"),
        F.col("valid_from"), F.col("valid_to"))).alias("_hit"))
    decided = best.select("_url", "_day", F.col("_hit.action").alias("verdict"), *[F.col(f"_hit.{c}").alias(c) for c in RESULT[2:]])
    usable = F.col(url).isNotNull() & F.col(fetched_on).isNotNull()
    joined = captures.where(usable).join(
        decided, (F.col(url) == F.col("_url")) & (F.col(fetched_on).cast("date") == F.col("_day")), "left").drop("_url", "_day")
    rest = captures.where(~usable)  # null keys would all meet in one task
    for c in RESULT[1:]:
        rest = rest.withColumn(c, F.lit(None).cast(dict(decided.dtypes)[c]))
    return joined.unionByName(rest).withColumn("host", host_of(F.col(url)))
