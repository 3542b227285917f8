"""Operator 12: how far the term distributions of a language's sources diverge.

Every pair of sources of a language is priced by merging two sparse, sorted
arrays of (term id, count):

1. Terms are counted per (language, source) in an Arrow map that combines what
   a task sees before the shuffle; the documents a term is in are counted along.
2. Terms of ``min_docs`` documents of their language or more are kept and
   numbered by a range sort; ids fall into chunks of ``CHUNK`` terms, so that no
   array is longer, however large the vocabulary.
3. Pair tasks. A group (language, source) has an array in every chunk. Groups
   are dealt into blocks of ``BLOCK``; the arrays of two blocks and a chunk are
   co-grouped, once per unordered pair of blocks, and every unordered pair of
   groups between them is merged there: galloping search places the shorter
   array's ids in the longer one; ids in both, ids in one only and (counted)
   ids in neither each have their price. Sums over chunks give the pair's value,
   which both groups list.
4. The terms a group uses more than its language does are ranked per group.

The price of a term in a group is 1 + floor(SCALE * (count + PRIOR) / (N +
PRIOR * V)) with N the group's count over kept terms and V their number; all
arithmetic is on integers and exact up to 9e15 terms a language.

A source with a third of all rows is one row a task and term before the
shuffle; a task holds ``2 * BLOCK`` arrays of a chunk. The pair part has one row
per ordered pair of sources by definition.

Defined results: null text, language and source are ''; repeated rows and ids
are documents of their own; an empty table gives an empty result; a group
without terms has prices from count 0; languages without kept terms have pair
values 0; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cartwheel.llm.bytehash import text_buffers
from cartwheel.llm.common import ranked, written

MIN_DOCS = 30
SCALE, PRIOR = 1_000_000_000, 5
TOP_TERMS = 50
#: Term ids of a chunk and groups of a block: the bounds of a pair task.
CHUNK, BLOCK = 1 << 14, 8
#: Counts a task combines before it emits them.
HELD_TERMS = 200_000

#: A-Z to lower case, every other ASCII character to a space: what is left
#: between spaces are the terms, byte for byte.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(raw: bytes) -> list[bytes]:
    return raw.translate(TERM_BYTES).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of the terms of
    every group; the term '' stands for the group itself, with n = docs = 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            data, offsets = text_buffers(batch.column(2))
            for k, group in enumerate(zip(langs, sources)):
                if group not in held:
                    held[group] = Counter(), Counter()
                seen, inside = held[group]
                found = terms(data[offsets[k]:offsets[k + 1]].tobytes())
                seen.update(found)
                inside.update(set(found))
            if sum(len(seen) for seen, _ in held.values()) + len(held) > HELD_TERMS:
                yield from packed(held)
                held = {}
        if held:
            yield from packed(held)

    def packed(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (seen, inside) in held.items():
            names = [b"", *seen]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(names)), pa.array([source] * len(names)), pa.array(names, pa.binary()).cast(pa.string()),
                 pa.array([0, *seen.values()], pa.int64()), pa.array([0, *(inside[t] for t in seen)], pa.int64())],
                names=["lang", "source", "term", "n", "docs"])

    empty = F.lit("")
    rows = docs.select(F.coalesce("lang", empty).alias("lang"), F.coalesce("source", empty).alias("source"), "text")
    return (rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")
            .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def prices(count: np.ndarray, total) -> np.ndarray:
    """1 + floor(SCALE * (count + PRIOR) / total), by long division in steps of
    a thousand, which keeps every intermediate value below 2**63."""
    q, r = np.divmod(count + PRIOR, total)
    for _ in range(3):
        more, r = np.divmod(r * 1000, total)
        q = q * 1000 + more
    return q + 1


def price(count, total):
    """The same as a Column; both arguments are long columns."""
    q, r = _div(count + PRIOR, total), (count + PRIOR) % total
    for _ in range(3):
        q, r = q * 1000 + _div(r * 1000, total), (r * 1000) % total
    return q + 1


def _div(a, b):
    return F.call_function("div", a, b)


def gallop(needles: np.ndarray, hay: np.ndarray, stride: int = 32) -> np.ndarray:
    """Place of the first element of ``hay`` that is at least the needle; both
    are sorted. Every ``stride``-th needle is searched; the others start from
    there, double their step until they are past, and halve it back."""
    if not len(needles) or not len(hay):
        return np.zeros(len(needles), np.int64)
    low = np.repeat(np.searchsorted(hay, needles[::stride]), stride)[:len(needles)]  # hay[:low] < needle
    step, live = 1, np.arange(len(needles))
    high = np.full(len(needles), len(hay))
    while len(live):
        ahead = low[live] + step - 1
        inside = ahead < len(hay)
        live, ahead = live[inside], ahead[inside]
        less = hay[ahead] < needles[live]
        high[live[~less]] = ahead[~less]
        live, ahead = live[less], ahead[less]
        low[live] = ahead + 1
        step *= 2
    while True:  # hay[:low] < needle <= hay[high:]
        live = np.flatnonzero(low < high)
        if not len(live):
            return low
        mid = (low[live] + high[live]) // 2
        less = hay[mid] < needles[live]
        low[live[less]] = mid[less] + 1
        high[live[~less]] = mid[~less]


def merged(a: tuple, b: tuple) -> tuple[int, int]:
    """(sum of price differences over the ids that either has, number of those
    ids) of two groups (ids, prices, price of count 0)."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    (ids, cost, none), (ids_b, cost_b, none_b) = a, b
    at = gallop(ids, ids_b)
    both = np.zeros(len(ids), bool)
    inside = at < len(ids_b)
    both[inside] = ids_b[at[inside]] == ids[inside]
    only_b = np.ones(len(ids_b), bool)
    only_b[at[both]] = False
    value = np.abs(cost[both] - cost_b[at[both]]).sum() + np.abs(cost[~both] - none_b).sum() + np.abs(cost_b[only_b] - none).sum()
    return int(value), len(ids) + int(only_b.sum())


PART_SCHEMA = "a long, b long, value long, met long"


def pair_parts(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """All unordered pairs of groups between two blocks, in one chunk of ids."""

    def arrays(rows: pd.DataFrame) -> list[tuple]:
        return [(gid, (np.asarray(ids, np.int64), prices(np.asarray(n, np.int64), total), int(prices(np.int64(0), total))))
                for gid, ids, n, total in zip(rows["gid"].tolist(), rows["ids"], rows["counts"], rows["total"].tolist())]

    out = []
    first, second = arrays(left), arrays(right)
    for gid, a in first:
        for other, b in second:
            if gid < other:
                out.append((gid, other, *merged(a, b)))
    return pd.DataFrame(out, columns=["a", "b", "value", "met"])


def pair_values(groups: DataFrame, counts: DataFrame, block: int) -> DataFrame:
    """(a, b, value) of every unordered pair of groups of a language.

    ``groups``: gid, lang, total, v, first_chunk, last_chunk, first_gid,
    last_gid (chunks of the language's ids, ids of its groups); ``counts``: gid,
    chunk, id, n of the terms a group has."""
    arrays = (counts.groupBy("gid", "chunk").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("rows"))  # a chunk at most
              .select("gid", "chunk", F.col("rows.id").alias("ids"), F.col("rows.n").alias("counts")))
    none = F.array().cast("array<bigint>")
    grid = groups.withColumn("chunk", F.explode(F.sequence("first_chunk", "last_chunk")))
    dealt = written(
        grid.join(arrays, ["gid", "chunk"], "left")
        .select("gid", "lang", "total", "chunk", F.coalesce("ids", none).alias("ids"), F.coalesce("counts", none).alias("counts"),
                _div(F.col("gid"), F.lit(block)).alias("block"), _div(F.col("first_gid"), F.lit(block)).alias("low"),
                _div(F.col("last_gid"), F.lit(block)).alias("high")), "divergence-arrays")
    sent = ["gid", "total", "ids", "counts"]
    left = dealt.select("lang", "chunk", F.col("block").alias("i"), F.explode(F.sequence("block", "high")).alias("j"), *sent)
    right = dealt.select("lang", "chunk", F.explode(F.sequence("low", "block")).alias("i"), F.col("block").alias("j"), *sent)
    keys = ["lang", "chunk", "i", "j"]
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(pair_parts, PART_SCHEMA)
    return parts.groupBy("a", "b").agg(F.sum("value").alias("value"), F.sum("met").alias("met"))


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank.

    ``pair``: for every other source of the language the price differences
    summed over all kept terms. ``term``: the ``top_terms`` terms whose price in
    the group exceeds the language's most. Ranks go by value descending, item
    ascending."""
    counts = written(term_counts(docs.select("lang", "source", "text")), "divergence-counts")
    kept = (counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
            .where(F.col("docs") >= min_docs).drop("docs"))
    numbered = ranked(kept, [F.col("lang"), F.col("term")], "divergence-terms")
    kept = written(numbered.withColumnRenamed("rank", "id").withColumn("chunk", _div(F.col("id"), F.lit(chunk))), "divergence-ids")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"),
                                     F.min("chunk").alias("first_chunk"), F.max("chunk").alias("last_chunk"))
    mine = written(counts.where("n > 0").join(kept, ["lang", "term"])
                   .select("lang", "source", "term", "id", "chunk", "n", "lang_n"), "divergence-kept")
    names = counts.where("term = ''").select("lang", "source")
    gids = ranked(names, [F.col("lang"), F.col("source")], "divergence-groups").withColumnRenamed("rank", "gid")
    sums = mine.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    zero = F.lit(0).cast("long")
    spans = gids.groupBy("lang").agg(F.min("gid").alias("first_gid"), F.max("gid").alias("last_gid"))
    v = F.coalesce("v", zero)
    groups = written(
        gids.join(sums, ["lang", "source"], "left").join(spans, "lang").join(langs, "lang", "left")
        .select("gid", "lang", "source", v.alias("v"), (F.coalesce("size", zero) + PRIOR * v).alias("total"),
                (F.col("lang_total") + PRIOR * v).alias("lang_all"), "first_chunk", "last_chunk", "first_gid", "last_gid"), "divergence-sizes")

    own = mine.join(groups.select("lang", "source", "gid", "total", "lang_all"), ["lang", "source"])
    priced = pair_values(groups.where("v > 0"), own.select("gid", "chunk", "id", "n"), block)

    # a language without kept terms has pairs of value 0
    ordered = (groups.select("gid", "lang", "source", "v", "total", F.explode(F.sequence("first_gid", "last_gid")).alias("other"))
               .where("gid <> other"))
    others = groups.select(F.col("gid").alias("other"), F.col("source").alias("item"), F.col("total").alias("other_total"))
    pairs = (ordered.join(others, "other").withColumn("a", F.least("gid", "other")).withColumn("b", F.greatest("gid", "other"))
             .join(priced, ["a", "b"], "left"))
    neither = F.when(F.col("v") > 0, (F.col("v") - F.col("met")) * F.abs(price(zero, F.col("total")) - price(zero, F.col("other_total"))))
    by_item = [F.col("value").desc(), F.col("item")]
    pair = (pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce(F.col("value") + neither, zero).alias("value"))
            .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*by_item))))

    lead = price(F.col("n"), F.col("total")) - price(F.col("lang_n"), F.col("lang_all"))
    term = (own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), lead.alias("value")).where("value > 0")
            # ranks are cut off before the shuffle already (WindowGroupLimit)
            .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*by_item)))
            .where(F.col("rank") <= top_terms))
    return pair.unionByName(term)
