"""Operator 8: mixing sources to target weights.

Tokens (here: words) are summed per source, every source gets a target, the
repetition rate of a source is target / size, and a document is emitted
floor(rate) times plus one more time if a hash of its id falls below the
fraction. The choice depends on the id alone, so reruns agree.

Targets: the sources in code point order (null last) weigh ``weights``
cyclically and share ``total_share`` of all sizes. A target stops at ``cap``
times the size of its source; the excess is reshared by weight until none is
above. The water level is found by repeated one-row aggregates over the table
of sources, which is never collected.

Defined results: a null or empty text has size 0 and is taken 0 times; a null
source is a source of its own; repeated rows and equal ids are taken alike; an
empty table gives an empty result. Only the id, text and source columns are
read, other columns pass through.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, functions as F

from cartwheel.llm.common import ranked, words

WEIGHTS = (3, 1, 2)
TOTAL_SHARE = Fraction(3, 2)
CAP = 2
_UNIT = float(1 << 52)


def sized(docs: DataFrame) -> DataFrame:
    """Documents with ``_size``, the number of words of the whole text."""
    return docs.withColumn("_size", F.size(words(F.col("text"))).cast("long"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, total_share: Fraction = TOTAL_SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, weight, target) from rows of (source, _size).

    Exact integer arithmetic decides which sources are capped, so the result
    does not depend on the order of floating point sums.
    """
    share = Fraction(total_share)
    if share > cap:
        raise ValueError("the shares cannot exceed the caps of all sources")
    sums = sizes.groupBy("source").agg(F.sum("_size").alias("source_size"))
    order = [F.col("source").asc_nulls_last()]
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    src = ranked(sums, order, "mix-sources").withColumn("weight", weight.cast("long")).drop("rank")
    a, b = share.numerator, share.denominator
    num, den = None, None
    while True:
        # level = num / den; a source is capped if level * weight > cap * size
        capped = (F.lit(False) if den is None else
                  F.lit(num).cast("decimal(38,0)") * F.col("weight") > F.lit(den).cast("decimal(38,0)") * F.col("source_size") * cap)
        row = src.agg(F.sum("source_size").alias("all"),
                      F.sum(F.when(capped, F.col("source_size")).otherwise(0)).alias("full"),
                      F.sum(F.when(capped, 0).otherwise(F.col("weight"))).alias("open")).first()
        new = (a * (row["all"] or 0) - b * cap * (row["full"] or 0), b * (row["open"] or 0))
        if new == (num, den) or not new[1]:
            break
        num, den = new
    level = (F.lit(num or 0).cast("double") * F.col("weight") / F.lit(den or 1).cast("double"))
    ceiling = (F.col("source_size") * cap).cast("double")
    return src.withColumn("target", F.when(capped, ceiling).otherwise(level))


def hash_unit(doc_id: Column, seed: str) -> Column:
    """Uniform number in [0, 1) from the id and a seed (52 bits of md5)."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":" + seed))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(_UNIT)


def mix(docs: DataFrame, seed: str = "mix", weights=WEIGHTS, total_share: Fraction = TOTAL_SHARE, cap: int = CAP) -> DataFrame:
    """Documents with ``_size``, ``_source_size``, ``_target`` and ``_copies``."""
    rows = sized(docs)
    targets = source_targets(rows.select("source", "_size"), weights, total_share, cap).select(
        F.col("source").alias("_src"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    # One row per source: small against the documents, but not provably so;
    # Spark broadcasts it under its own size check.
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("_src")), "left").drop("_src")
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    extra = F.when(hash_unit(F.col("doc_id"), seed) < rate - whole, 1).otherwise(0)
    return rows.withColumn("_copies", (whole + extra).cast("long"))


def repeated(docs: DataFrame, **params) -> DataFrame:
    """The mixed corpus itself: every document once per copy, its columns only."""
    # the caller's columns go as one, whatever their names
    held = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "source")
    copies = F.array_repeat(F.lit(1), F.col("_copies").cast("int"))
    return mix(held, **params).select("row", F.explode(copies)).select("row.*")
