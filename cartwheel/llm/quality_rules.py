"""Operator 7: quality rules as a short-circuit cascade (DataFrame functions only).

Every rule is a Column that is true for a rejected document. On a sample the
operator measures each rule's cost (time of a scan that evaluates it, less the
time of the bare scan) and its rejections, and orders the rules by rejections
per cost. The cascade is one CASE expression, so Spark evaluates a later rule
only for documents that passed the earlier ones. The order changes the work,
never the verdict: a document is kept if no rule rejects it.

Base measures (whole text): n_words, word_chars, n_symbols, n_dup_lines and
n_repeat_words. Repeated 3-word windows are found by sorting the hashes of a
text's windows; only texts in which two hashes meet do the longer pass that
marks the covered words.

Defined results: null or empty text: all measures 0, base_failed, not kept;
repeated rows are judged alike; an empty table gives an empty result and a
cascade in declared order; columns besides id and text pass by unread.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, functions as F

from cartwheel.llm.common import words

SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Documents of the sample on which cost and selectivity are estimated.
SAMPLE_ROWS = 400


def word_list(text: Column) -> Column:
    return words(text)


def symbol_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SYMBOLS), F.lit(0))).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def window_hashes(word_array: str) -> Column:
    """64-bit hash of every 3-word window of an array column."""
    w = F.col(word_array)
    hashes = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return F.slice(hashes, 1, F.greatest(F.size(w) - 2, F.lit(0)))


def placed_windows(hashes: str) -> Column:
    """(hash, place) sorted by hash; null for a text without a repeated hash."""
    h = F.col(hashes)
    places = F.sequence(F.lit(0), F.greatest(F.size(h) - 1, F.lit(0)))
    pairs = F.zip_with(h, places, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    return F.when(F.size(h) > F.size(F.array_distinct(h)), F.sort_array(pairs))


def repeated_places(placed: str) -> Column:
    """Sorted places of the windows with a neighbour of equal hash."""
    x = F.col(placed)
    none = F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(-1).alias("i"))
    behind = F.concat(F.array(none), F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))))
    ahead = F.concat(F.slice(x, 2, F.size(x)), F.array(none))
    after = F.zip_with(x, behind, lambda a, b: F.struct(a["h"].alias("h"), a["i"].alias("i"), F.coalesce(a["h"] == b["h"], F.lit(False)).alias("same")))
    hit = F.zip_with(after, ahead, lambda a, b: F.when(a["same"] | F.coalesce(a["h"] == b["h"], F.lit(False)), a["i"]))
    return F.sort_array(F.array_compact(hit))


def covered_words(places: str) -> Column:
    """Words in 3-word windows at these places: each adds the words up to the
    next repeated window, 3 at most."""
    p = F.col(places)
    following = F.concat(F.slice(p, 2, F.size(p)), F.array(F.lit(1 << 30)))
    gaps = F.zip_with(p, following, lambda i, j: F.least(j - i, F.lit(3)))
    return F.coalesce(F.aggregate(gaps, F.lit(0), lambda acc, n: acc + n), F.lit(0)).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """Documents with the base measures. Each step is a projection of its own,
    so that an array is computed once however often the next step reads it."""
    text = F.col("text")
    return (docs.withColumn("_words", word_list(text))
            .withColumn("_windows", window_hashes("_words"))
            .withColumn("_placed", placed_windows("_windows"))
            .withColumn("_places", repeated_places("_placed"))
            .withColumn("n_words", F.size("_words").cast("long"))
            .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
            .withColumn("n_symbols", symbol_count(text))
            .withColumn("n_dup_lines", duplicate_lines(text))
            .withColumn("n_repeat_words", covered_words("_places"))
            .drop("_words", "_windows", "_placed", "_places"))


def default_rules() -> dict[str, Column]:
    """True: rejected. On columns text and the base measures."""
    text = F.coalesce(F.col("text"), F.lit(""))
    n_words, n_chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return {
        "long_words": F.col("word_chars") > 30 * n_words,
        "short_words": F.col("word_chars") < 2 * n_words,
        "symbols": 10 * F.col("n_symbols") > n_words,
        "repeated_lines": 10 * F.col("n_dup_lines") > 3 * lines,
        "repeated_words": 5 * F.col("n_repeat_words") > 2 * n_words,
        "few_letters": 10 * letters < 6 * n_chars,
        "ellipsis_lines": 10 * F.size(F.regexp_extract_all(text, F.lit(r"(\.\.\.|…)[ \t\r]*(?:\n|$)"), F.lit(1))) > 3 * lines,
    }


def order_rules(docs: DataFrame, rules: dict[str, Column], sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of the rules by rejections per second on a bounded sample: the
    first rows that Spark finds, which it reads without scanning the rest."""
    rows = docs.take(sample_rows)
    sample = docs.sparkSession.createDataFrame(rows, docs.schema).cache()
    try:
        total = sample.count()
        if not total:
            return list(rules)

        def seconds(*columns: Column) -> tuple[float, int]:
            started = time.perf_counter()
            row = sample.agg(*[F.sum(F.when(c, 1).otherwise(0)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
            return time.perf_counter() - started, row[0] or 0

        seconds(F.lit(False))  # compile
        bare, _ = seconds(F.lit(False))
        value = {}
        for name, rule in rules.items():
            seconds(rule)  # compile
            took, rejected = seconds(rule)
            value[name] = (rejected + 0.5) / max(took - bare, 1e-4)
        return sorted(rules, key=lambda name: -value[name])
    finally:
        sample.unpersist()


def cascade(rules: dict[str, Column], order: list[str]) -> Column:
    """Name of the first rule in ``order`` that rejects, null if none does."""
    out = None
    for name in order:
        hit = F.coalesce(rules[name], F.lit(False))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return F.lit(None).cast("string") if out is None else out


def judge(docs: DataFrame, rules: dict[str, Column] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Documents with the base measures, base_failed and kept."""
    rules = default_rules() if rules is None else rules
    base = measured(docs)
    measures = ["text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    order = order_rules(base.select(*measures), rules, sample_rows)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = base.withColumn("base_failed", failed)
    return judged.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(cascade(rules, order).isNull()))
