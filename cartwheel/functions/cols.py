"""Column -> Column helpers that carry the reference's scalar semantics.

All of them compile to built-in expressions (no Python UDF), so they stay
inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cents(c) -> Column:
    """Money in whole units (double) -> integer cents."""
    return F.round(col(c) * 100).cast("bigint")


def js_round(c) -> Column:
    """``Math.round``: halves go towards +infinity (-2.5 -> -2), unlike ``round``."""
    return F.floor(col(c) + F.lit(0.5)).cast("bigint")


def number_or_zero(c) -> Column:
    """``parseFloat(x) || 0``: text that is no number counts as 0."""
    return F.coalesce(col(c).try_cast("double"), F.lit(0.0))


def falsy(c, kind: str) -> Column:
    """NULL where JavaScript would treat the value as falsy.

    ``kind`` is the column's type family: ``"string"`` ('' is falsy),
    ``"number"`` (0 and NaN are falsy), ``"bool"`` (false is falsy) or
    ``"other"`` (only NULL; arrays and objects are always truthy).
    """
    c = col(c)
    if kind == "string":
        return F.when(c != F.lit(""), c)
    if kind == "number":
        return F.when((c != F.lit(0)) & ~F.isnan(c.cast("double")), c)
    if kind == "bool":
        return F.when(c, c)
    if kind == "other":
        return c
    raise ValueError(f"unknown kind {kind!r}")


def js_or(c, default, kind: str) -> Column:
    """JavaScript ``c || default``: replace NULL and falsy values."""
    d = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(falsy(c, kind), d)


def js_or_null(c, kind: str) -> Column:
    """JavaScript ``c || null``."""
    return falsy(c, kind)


def pii_hash(c, lower: bool = True) -> Column:
    """SHA-256 hex of a personal field; absent (NULL) when the input is empty."""
    c = col(c)
    value = F.lower(c) if lower else c
    return F.when(c.isNotNull() & (c != F.lit("")), F.sha2(value, 256))


def live(df: DataFrame, column: str = "deleted_at") -> DataFrame:
    """Rows that are not soft-deleted."""
    return df.filter(F.col(column).isNull())


def lit_like(value, df: DataFrame, column: str) -> Column:
    """Literal cast to the type of ``df[column]`` so the comparison stays a
    plain column-vs-literal predicate (pushed to the parquet scan)."""
    return F.lit(value).cast(df.schema[column].dataType)


def iso_timestamp(c) -> Column:
    """``Date.toISOString()`` text of a UTC timestamp."""
    return F.date_format(col(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def empty_string_array() -> Column:
    return F.array().cast(T.ArrayType(T.StringType()))


def empty_string_map() -> Column:
    return F.create_map().cast(T.MapType(T.StringType(), T.StringType()))


def one_row_join(*frames: DataFrame) -> DataFrame:
    """Put single-row frames (global aggregates) side by side without a
    join: union them with the missing columns as NULL, then keep the one
    non-NULL value per column in a global aggregate. Every column must come
    from exactly one frame."""
    cols: list[str] = []
    for f in frames:
        dup = set(cols) & set(f.columns)
        if dup:
            raise ValueError(f"columns in more than one frame: {sorted(dup)}")
        cols.extend(f.columns)
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f, allowMissingColumns=True)
    return u.agg(*[F.first(c, ignorenulls=True).alias(c) for c in cols])


NULL_KEY_TASKS = 1024


def left_join_spread(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join on ``key`` that deals the left rows without a key out over
    many tasks; as plain join keys all NULLs would hash to one. A second key
    is constant for real keys and random for NULLs, which match nothing."""
    spread = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*left.columns[:4]), F.lit(NULL_KEY_TASKS)).cast("int")).otherwise(0)
    l2 = left.withColumn("__spread", spread)
    r2 = right.withColumn("__spread", F.lit(0))
    return l2.join(r2, [key, "__spread"], "left").drop("__spread")


def salted_join(left: DataFrame, right: DataFrame, key: str, buckets: int, how: str = "inner") -> DataFrame:
    """Equi-join on ``key`` with the left side spread over ``buckets`` salt
    values and the right side (one row per key) copied once per salt, so a
    key holding a large share of the left rows is processed by ``buckets``
    tasks. ``buckets <= 1`` is a plain join.

    The copies are made by a cross join with the salts: its size estimate is a
    product, so they are only broadcast if all of them are small. The estimate of
    an ``explode`` would be that of one copy."""
    if buckets <= 1:
        return left.join(right, key, how)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(buckets)).cast("int")
    l2 = left.withColumn("__salt", salt)
    salts = right.sparkSession.range(0, buckets, 1, 1).select(F.col("id").cast("int").alias("__salt"))
    r2 = right.crossJoin(F.broadcast(salts))
    return l2.join(r2, [key, "__salt"], how).drop("__salt")
