"""Operator 3: MinHash near-duplicates with tensored banding.

1. Every text becomes its set of 5-word shingles (64-bit hashes, whole text).
   Documents with equal sets form one class; only classes go on.
2. Two small collections of ``side`` sketches of ``rows`` minhashes each are
   computed (2 * side * rows minhashes). A table key is a pair of one sketch of
   either collection, so they serve side**2 tables of 2 * rows minhashes. Two
   sets at the threshold t meet unless one collection misses altogether:
   (1 - t**rows)**side a collection, 4e-5 at t = 0.85 with the defaults. Only
   classes that share a sketch in both collections are spread over the tables.
3. Each table bucket links its members to its smallest one; a member's smallest
   leader is verified first, on full sets. That joins most of a group of copies
   with as many checks as members.
4. What a bucket holds beyond that (two members in different components) is
   settled exactly: the classes of all buckets are joined on the rarest
   shingles of their sets, with the length, prefix and positional bounds every
   pair at the threshold must meet. No bucket or partner list is capped and no
   pair inside one component is looked at. These pairs are verified too.
5. Connected components of the verified links by repeated minima.

Hot keys: equal sets collapse by aggregation; leaders come from ``min``
aggregates with map-side combine; bucket members meet their leader in joins
that AQE splits. Nothing but row counts reaches the driver.

Defined results: null or empty text, or text without words: empty set, linked
with nothing, its own component; repeated rows (one id, one text) are joined
into one class and each keeps its row; of an id with several texts one set (the
last in order) is verified for all of them; a null id is its own component; an
empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cartwheel.llm.bytehash import BLOCK_BYTES, mix, prefix_sums, prime_sums, span_names, text_buffers, text_groups
from cartwheel.llm.common import bounded_broadcast, fresh_worker, written

WORDS = 5
THRESHOLD = 85  # percent
SIDE = 8
ROWS = 2

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0xD6E8FEB86659FD93)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every word of some bytes, A-Z in lower case."""
    blank = _BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    lower = _LOWER[data]
    return mix(span_names(prefix_sums(lower), prime_sums(lower), starts, ends)), starts


def text_word_hashes(data: np.ndarray) -> np.ndarray:
    """Word hashes of one text, block by block, cut between words."""
    if len(data) <= BLOCK_BYTES:
        return word_hashes(data)[0]
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + BLOCK_BYTES)
        if end < len(data):
            blanks = np.flatnonzero(_BLANK[data[at:end]])
            if len(blanks):
                end = at + int(blanks[-1]) + 1
            else:  # a word longer than a block
                later = np.flatnonzero(_BLANK[data[end:]])
                end = end + int(later[0]) + 1 if len(later) else len(data)
        out.append(word_hashes(data[at:end])[0])
        at = end
    return np.concatenate(out)


def combine(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Hashes of all runs of n words; of the whole sequence if it is shorter."""
    k = min(n, len(words))
    if not k:
        return np.empty(0, np.uint64)
    out = np.full(len(words) - k + 1, np.uint64(k), dtype=np.uint64)
    for i in range(k):
        out = out * _STEP + words[i:len(words) - k + 1 + i]
    return mix(out)


def shingle_set(data: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of one text."""
    return np.unique(combine(text_word_hashes(data), n))


def shingle_sets(column: pa.Array, n: int = WORDS) -> Iterator[np.ndarray]:
    """Shingle sets of a column of texts; words are hashed a block at a time."""
    data, offsets = text_buffers(column)
    for i, j in text_groups(offsets):
        if j == i + 1:
            yield shingle_set(data[offsets[i]:offsets[j]], n)
            continue
        # a blank between texts keeps words apart
        sizes = offsets[i + 1:j + 1] - offsets[i:j]
        padded = np.full(int(offsets[j] - offsets[i]) + (j - i), 0x20, np.uint8)
        new = offsets[i:j] - offsets[i] + np.arange(j - i)
        keep = np.ones(len(padded), bool)
        keep[new + sizes] = False
        padded[keep] = data[offsets[i]:offsets[j]]
        hashes, starts = word_hashes(padded)
        cuts = np.searchsorted(starts, new)
        for a, b in zip(cuts, np.append(cuts[1:], len(hashes))):
            yield np.unique(combine(hashes[a:b], n))


def sketches(shingles: np.ndarray, side: int, rows: int, seed: int = 3) -> np.ndarray:
    """2 * side sketches: hashes of ``rows`` minhashes each."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 63, 2 * side * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(1, 1 << 63, 2 * side * rows, dtype=np.uint64)
    low = np.empty(len(a), np.uint64)
    for k in range(len(a)):
        x = (shingles ^ b[k]) * a[k]
        low[k] = x.min()
    low = mix(low).reshape(2 * side, rows)
    out = np.zeros(2 * side, np.uint64)
    for r in range(rows):
        out = mix(out * _STEP + low[:, r])
    return out


def signatures(docs: DataFrame, words: int = WORDS, side: int = SIDE, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set hash (two longs, null for an empty set) and the sketches."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            n, h1, h2, sk = [], [], [], []
            for shingles in shingle_sets(batch.column(1), words):
                n.append(len(shingles))
                if len(shingles):
                    h1.append(int(shingles.sum().view(np.int64)))
                    h2.append(int(np.bitwise_xor.reduce(mix(shingles + _STEP)).view(np.int64)))
                    sk.append(sketches(shingles, side, rows).view(np.int64))
                else:
                    h1.append(None), h2.append(None), sk.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sk, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "h1", "h2", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        sign, "doc_id long, n_shingles long, h1 long, h2 long, sketch array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, n_ids: int, words: int = WORDS) -> DataFrame:
    """(doc_id, shingles) of the documents in ``ids``; one row an id."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            found = [s.view(np.int64) for s in shingle_sets(batch.column(1), words)]
            sizes = np.cumsum([0] + [len(s) for s in found])
            flat = pa.array(np.concatenate(found) if found else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(sizes.astype(np.int32)), flat)], names=["doc_id", "shingles"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(bounded_broadcast(ids, n_ids), "doc_id", "left_semi")
    return chosen.mapInArrow(sets, "doc_id long, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) whose full sets meet the threshold."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            keep = []
            for k in range(batch.num_rows):
                p, q = x[k].values.to_numpy(), y[k].values.to_numpy()
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= threshold * (len(p) + len(q) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def banded_stars(classes: DataFrame, side: int) -> DataFrame:
    """(a, b): class b and the smallest member a of the buckets it is in, for
    classes of buckets with two or more members; a = b for that smallest one.

    ``classes``: class_id, sketch (2 * side values).
    """
    half = lambda first: F.transform(F.sequence(F.lit(first), F.lit(first + side - 1)),
                                     lambda i: F.xxhash64(i, F.col("sketch")[i]))
    both = None
    for first in (0, side):
        keys = classes.select("class_id", F.explode(half(first)).alias("key"))
        shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        met = keys.join(shared, "key").select("class_id").distinct()
        both = met if both is None else both.join(met, "class_id")
    spread = classes.join(both, "class_id")
    table = F.flatten(F.transform(half(0), lambda x: F.transform(half(side), lambda y: F.xxhash64(x, y))))
    keys = spread.select("class_id", F.explode(table).alias("key"))
    leaders = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("class_id").alias("a")).where("n > 1").select("key", "a")
    return keys.join(leaders, "key").groupBy(F.col("class_id").alias("b")).agg(F.min("a").alias("a")).select("a", "b")


def bounded_pairs(sets: DataFrame, labels: DataFrame, threshold: int) -> DataFrame:
    """Pairs a < b of different labels that the exact bounds cannot rule out.

    Shingles are ordered by their frequency among these sets, rarest first. A
    pair at the threshold shares a shingle among the first n - ceil(2t/(1+t) n)
    + 1 of the shorter set and the first n - ceil(t n) + 1 of the longer one,
    and where it first does so, enough must follow in both.
    """
    t = threshold
    tokens = sets.select("doc_id", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = tokens.join(often, "token").groupBy("doc_id", "n").agg(F.collect_list(F.struct("df", "token")).alias("s"))
    # what no other set has comes first in the order and cannot match
    unique = F.col("n") - F.size("s")
    probe = F.col("n") - F.ceil(F.col("n") * t / 100) + 1
    index = F.col("n") - F.ceil(F.col("n") * 2 * t / (100 + t)) + 1
    heads = (shared.withColumn("u", unique).withColumn("probe", probe.cast("int")).withColumn("index", index.cast("int")).where("u < probe")
             .withColumn("s", F.slice(F.array_sort("s"), F.lit(1), F.greatest(F.col("probe") - F.col("u"), F.lit(0))))
             .join(labels, "doc_id")
             .select("doc_id", "n", "label", "u", "index", F.posexplode("s").alias("p", "d"))
             .select("doc_id", "n", "label", "index", (F.col("p") + F.col("u")).alias("at"), F.col("d.token").alias("token")))
    # a shingle all of whose sets have one label has no pair to look for
    mixed = heads.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("token")
    heads = written(heads.join(mixed, "token"), "minhash-heads")
    # sets meet those of the token's other labels only, never their own label's;
    # the bounds below hold for a label if they hold for its best members
    labels_at = heads.groupBy("token", F.col("label").alias("y_label")).agg(
        F.min("n").alias("lo"), F.max(F.struct("n", "doc_id")).alias("top"), F.max(F.col("n") - F.col("at")).alias("rest"))
    x = heads.where("at < index").select("token", *[F.col(c).alias("x_" + c) for c in ("doc_id", "n", "label", "at")])
    least_need = (F.col("x_n") + F.greatest("x_n", "lo")) * t / (100 + t)
    x = x.join(labels_at.withColumnRenamed("token", "l_token"), (F.col("token") == F.col("l_token")) & (F.col("x_label") != F.col("y_label"))
               & ((F.col("x_n") < F.col("top.n")) | ((F.col("x_n") == F.col("top.n")) & (F.col("x_doc_id") < F.col("top.doc_id"))))
               & (F.col("x_n") * 100 >= F.col("lo") * t) & (F.least(F.col("x_n") - F.col("x_at"), F.col("rest")) >= least_need - 1e-6))
    x = x.select("token", "y_label", "x_doc_id", "x_n", "x_label", "x_at")
    y = heads.select("token", *[F.col(c).alias("y_" + c) for c in ("doc_id", "n", "label", "at")])
    need = (F.col("x_n") + F.col("y_n")) * t / (100 + t)
    rest = F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at"))
    found = x.join(y, ["token", "y_label"]).where(
        ((F.col("x_n") < F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x_doc_id") < F.col("y_doc_id"))))
        & (F.col("x_n") * 100 >= F.col("y_n") * t) & (rest >= need - 1e-6))
    return found.select(F.least("x_doc_id", "y_doc_id").alias("a"), F.greatest("x_doc_id", "y_doc_id").alias("b")).distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(id, component): smallest id reachable over (a, b); ids of links only.

    Alternating large-star and small-star steps; each step's links are written,
    so the plan stays short, and the number of steps is logarithmic in practice.
    """
    edges = written(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    before = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        edges = written(small, name)
        state = edges.agg(F.count("*"), F.count_distinct("u"), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == before and state[0] == state[1]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = state


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD, side: int = SIDE, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id for every document row."""
    signed = written(signatures(docs, words, side, rows), "minhash-signatures")
    classes = signed.where("h1 is not null and doc_id is not null").groupBy("n_shingles", "h1", "h2").agg(
        F.min("doc_id").alias("class_id"), F.min_by("sketch", "doc_id").alias("sketch"))
    classes = written(classes, "minhash-classes")  # read by every step below
    stars = written(banded_stars(classes.select("class_id", "sketch"), side), "minhash-stars")
    members = stars.select(F.col("b").alias("doc_id"))
    n_members = stars.count()
    sets = written(full_sets(docs, members, n_members, words).groupBy("doc_id").agg(F.max("shingles").alias("shingles")), "minhash-sets")
    first = written(verified(stars.where("a != b"), sets, threshold), "minhash-links")
    # labels: the leader after one verified step; leaders of leaders follow twice
    label = members.join(first.select(F.col("b").alias("doc_id"), F.col("a").alias("label")), "doc_id", "left").select(
        "doc_id", F.coalesce("label", "doc_id").alias("label"))
    for _ in range(2):
        up = label.select(F.col("doc_id").alias("label"), F.col("label").alias("top"))
        label = label.join(up, "label").select("doc_id", F.col("top").alias("label"))
    label = written(label, "minhash-labels")
    second = verified(bounded_pairs(sets, label, threshold), sets, threshold)
    links = written(first.unionByName(second.select("a", "b")), "minhash-all-links")
    found = components(links, "minhash-components")
    keys = ["n_shingles", "h1", "h2"]
    named = classes.select(*keys, "class_id").join(found, F.col("class_id") == F.col("id"), "left").select(
        *[F.col(k).alias("_" + k) for k in keys], "class_id", F.coalesce("component", "class_id").alias("component_id"))
    whole = F.col("h1").isNotNull() & F.col("doc_id").isNotNull()
    linked = signed.where(whole).join(named, [F.col(k) == F.col("_" + k) for k in keys], "left")
    alone = signed.where(~whole).withColumn("class_id", F.col("doc_id")).withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "n_shingles", "component_id", "class_id"]
    return linked.select(*columns).unionByName(alone.select(*columns)).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))).select(
        "doc_id", "n_shingles", "component_id", "kept", "class_id")


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest
    id; of repeated rows with equal id and text one stays. Documents without
    words stay. The dropped ids, not the texts, are what is joined."""
    found = written(near_duplicates(docs, **params), "minhash-verdict")
    dropped = found.where(~F.col("kept")).select("doc_id").distinct()
    again = found.where(F.col("kept") & F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)).groupBy("doc_id").agg(
        F.count("*").alias("n")).where("n > 1").select("doc_id")
    again = written(again, "minhash-repeated")
    n_again = again.count()
    # an id is dropped with all its rows unless one of them is the kept one
    gone = dropped.join(found.where("kept").select("doc_id"), "doc_id", "left_anti")
    gone = written(gone, "minhash-dropped")
    rest = docs.join(bounded_broadcast(gone, gone.count()), "doc_id", "left_anti")
    repeated = bounded_broadcast(again, n_again)
    once = rest.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return rest.join(repeated, "doc_id", "left_anti").unionByName(once)
