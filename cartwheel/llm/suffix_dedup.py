"""Operator 4: repeated substrings by distributed prefix doubling.

A byte goes if it lies in a string of ``length`` bytes that starts at another
place too (any document, matches never cross documents). Ranks are names of
equal strings; Spark counts them, keeps positions whose rank is shared, and
reranks them over longer strings until they are unique or reach ``length``:

1. Every window of ``length`` bytes owns an anchor: the ``seed_length``-byte
   string in it with the smallest hash, leftmost first. Equal windows have
   equal anchors at equal offsets, so positions are sorted by (rank of the
   anchor, offset), and consecutive windows with one anchor form a zone. Zones
   whose anchor is unique end here: none of their windows repeats.
2. Zones that are equal as a whole are repeats throughout.
3. The rest is reranked in rounds over blocks of 64, 16, 4 and 1 offsets. The
   string common to all windows of a block (length - block + 1 bytes, growing
   with each round) unique: no window of the block repeats. The string that
   covers them all repeated: every window does. Otherwise the block is split.
   Blocks of one offset are the windows themselves, so the result is exact up
   to collisions of pairs of 64-bit names.
4. Spans of repeated windows are joined back to their documents and merged.

A rank is always a pair (name of the anchor, name of the longer string). Counts
are aggregates with map-side combine, so a passage shared by a third of all
documents is one row a task; names are joined with the few that matter in
joins AQE splits. Shared names reach the scanning tasks as a bit filter whose
size is bounded (``MAX_FILTER_BITS``); its false positives cost work, never
results. Text is scanned four times, and shuffled only where spans were found.

Defined results: null text is empty; texts shorter than ``length`` lose
nothing; repeated rows and equal ids are documents of their own, whose equal
texts remove each other; an empty table gives an empty result; only the id and
text columns are read. Very long texts are scanned in overlapping blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cartwheel.llm.bytehash import (
    BLOCK_BYTES, mix, prefix_sums, prime_sums, span_hashes, span_names, text_buffers, text_groups,
)
from cartwheel.llm.common import fresh_worker, written

LENGTH = 200
SEED_LENGTH = 64
BLOCKS = (64, 16, 4, 1)
MAX_FILTER_BITS = 1 << 29

_FOLD = np.uint64(0xD6E8FEB86659FD93)


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values."""
    n = len(h) - width + 1
    padded = np.full(-(-len(h) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:len(h)] = h
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def zones(sums: np.ndarray, first: int, last: int, length: int, seed_length: int) -> tuple[np.ndarray, ...]:
    """Zones of the windows that start in first..last of some bytes.

    Returns (anchor hash, first window, windows, anchor place), in order.
    """
    width = length - seed_length + 1
    at = np.arange(first, last + width)  # places of anchors
    h = mix(span_hashes(sums, at, at + seed_length))
    low = window_minima(h, width)
    start = np.concatenate(([0], np.flatnonzero(low[1:] != low[:-1]) + 1))
    end = np.append(start[1:], len(low)) - 1
    value = low[start]
    place = start.copy()
    for i in range(0, len(start), 4096):  # the leftmost minimum of each first window
        part = slice(i, i + 4096)
        place[part] += (h[start[part, None] + np.arange(width)] == value[part, None]).argmax(1)
    again = np.flatnonzero(end > place)  # the same string follows within a window
    if len(again):
        parts = [(value, start, end, place)]
        keep = np.ones(len(start), bool)
        keep[again] = False
        parts = [tuple(x[keep] for x in parts[0])]
        for z in again:
            q = start[z] + np.flatnonzero(h[start[z]:end[z] + width] == value[z])
            q = q[:int(np.searchsorted(q, end[z])) + 1]  # the last owner is the first at or after ``end``
            s = np.concatenate(([start[z]], q[:-1] + 1))
            parts.append((np.full(len(q), value[z], np.uint64), s, np.minimum(q, end[z]), q))
        value, start, end, place = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(start, kind="stable")
        value, start, end, place = value[order], start[order], end[order], place[order]
    return value, start + first, end - start + 1, place + first


def scan(column: pa.Array, length: int, seed_length: int) -> Iterator[tuple]:
    """(row, offset in the row of the block, bytes, prefix sums, zones of the
    block) of a column, long texts in overlapping blocks."""
    data, offsets = text_buffers(column)
    for row in range(len(offsets) - 1):
        size = int(offsets[row + 1] - offsets[row])
        for at in range(0, max(0, size - length + 1), BLOCK_BYTES):
            piece = data[offsets[row] + at:offsets[row] + min(size, at + BLOCK_BYTES + length - 1)]
            sums = prefix_sums(piece)
            yield row, at, piece, sums, zones(sums, 0, len(piece) - length, length, seed_length)


class BitFilter:
    """Set of 64-bit hashes as a bit array of bounded size; may say yes wrongly."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.mask = np.uint64(len(bits) * 64 - 1)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes & self.mask
        return (self.bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1

    @classmethod
    def of(cls, hashes: DataFrame, name: str) -> "BitFilter":
        """From the one long column of ``hashes``. Only its words, at most
        MAX_FILTER_BITS bits whatever the number of hashes, reach the driver."""
        n = hashes.count()
        size = min(MAX_FILTER_BITS, 1 << max(16, int(24 * n).bit_length()))
        place = F.col(name).bitwiseAND(F.lit(size - 1))
        word = F.shiftright(place, 6).alias("word")
        words = hashes.groupBy(word).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(({name} & 63) as int))")).alias("bits")).toArrow()
        bits = np.zeros(size // 64, np.uint64)
        bits[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
        return cls(bits)


def anchor_counts(docs: DataFrame, length: int, seed_length: int) -> DataFrame:
    """(h): anchors of two zones or more."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            found, size = [], 0
            for *_, (value, _, _, _) in scan(batch.column(0), length, seed_length):
                found.append(value)
                size += len(value)
                if size > 1 << 18:
                    yield counted(found)
                    found, size = [], 0
            if found:
                yield counted(found)

    def counted(found: list[np.ndarray]) -> pa.RecordBatch:
        value, n = np.unique(np.concatenate(found), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], names=["h", "n"])

    return docs.select("text").mapInArrow(anchors, "h long, n int").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")


def content_names(piece: np.ndarray, sums: np.ndarray, p0: np.ndarray, n: np.ndarray, a: np.ndarray, length: int) -> np.ndarray:
    """Names of whole zones: their bytes, windows and anchor offset."""
    c = span_names(sums, prime_sums(piece), p0, p0 + n - 1 + length)
    return mix(c * _FOLD + n.astype(np.uint64) * np.uint64(1 << 20) + a.astype(np.uint64))


def shared_zones(docs: DataFrame, shared: BitFilter, length: int, seed_length: int) -> DataFrame:
    """Zones whose anchor may be shared: place p0, windows n, anchor h at
    offset a, and the name c of the content."""
    filt = docs.sparkSession.sparkContext.broadcast(shared)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            rows, size = [], 0
            for row, at, piece, sums, (value, p0, n, place) in scan(batch.column(2), length, seed_length):
                hit = np.flatnonzero(filt.value(value))
                if len(hit):
                    value, p0, n, a = value[hit], p0[hit], n[hit], place[hit] - p0[hit]
                    c = content_names(piece, sums, p0, n, a, length)
                    rows.append((np.full(len(hit), k1[row]), np.full(len(hit), k2[row]), p0 + at, n, value, a, c))
                    size += len(hit)
                if size > 1 << 16:
                    yield packed(rows)
                    rows, size = [], 0
            if rows:
                yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        k1, k2, p0, n, h, a, c = (np.concatenate(x) for x in zip(*rows))
        return pa.RecordBatch.from_arrays(
            [pa.array(k1.astype(np.int64)), pa.array(k2.astype(np.int64)), pa.array(p0.astype(np.int64)), pa.array(n.astype(np.int32)),
             pa.array(h.view(np.int64)), pa.array(a.astype(np.int32)), pa.array(c.view(np.int64))], names=["k1", "k2", "p0", "n", "h", "a", "c"])

    return docs.select("k1", "k2", "text").mapInArrow(find, "k1 long, k2 long, p0 long, n int, h long, a int, c long")


def split_contents(docs: DataFrame, wanted: BitFilter, length: int, seed_length: int) -> DataFrame:
    """(h, c, n, a, w, ctx): contents, with their bytes and counts, of the
    zones whose anchor the filter has; equal ones of a batch are one row."""
    filt = docs.sparkSession.sparkContext.broadcast(wanted)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            found: dict[tuple[int, int], list] = {}
            for _, _, piece, sums, (value, p0, n, place) in scan(batch.column(0), length, seed_length):
                hit = np.flatnonzero(filt.value(value))
                if not len(hit):
                    continue
                value, p0, n, a = value[hit], p0[hit], n[hit], place[hit] - p0[hit]
                c = content_names(piece, sums, p0, n, a, length)
                for h, x, start, m, d in zip(value.view(np.int64).tolist(), c.view(np.int64).tolist(), p0.tolist(), n.tolist(), a.tolist()):
                    row = found.get((h, x))
                    if row is None:
                        found[h, x] = [m, d, 1, piece[start:start + m - 1 + length].tobytes()]
                    else:
                        row[2] += 1
                if len(found) > 1 << 14:
                    yield packed(found)
                    found = {}
            if found:
                yield packed(found)

    def packed(found: dict) -> pa.RecordBatch:
        h, c = zip(*found)
        n, a, w, ctx = zip(*found.values())
        return pa.RecordBatch.from_arrays(
            [pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array(n, pa.int32()), pa.array(a, pa.int32()), pa.array(w, pa.int64()),
             pa.array(ctx, pa.binary())], names=["h", "c", "n", "a", "w", "ctx"])

    rows = docs.select("text").mapInArrow(find, "h long, c long, n int, a int, w long, ctx binary")
    return rows.groupBy("h", "c").agg(F.sum("w").alias("w"), F.first("n").alias("n"), F.first("a").alias("a"), F.first("ctx").alias("ctx"))


RANK_SCHEMA = "h long, c long, w long, blk int, d1 int, d2 int, core long, cover long"


def block_ranks(contents: DataFrame, block: int, parent: int, length: int) -> DataFrame:
    """Ranks of the blocks of ``block`` offsets of zone contents.

    ``contents``: h, c, n, a, w, ctx and todo, the blocks of ``parent`` offsets
    to split (null: all offsets).
    """

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            n, a = batch.column("n").to_numpy().astype(np.int64), batch.column("a").to_numpy().astype(np.int64)
            todo = batch.column("todo").to_pylist()
            data, offsets = text_buffers(batch.column("ctx"))
            h, c, w = (batch.column(k).to_numpy() for k in ("h", "c", "w"))
            for i, j in text_groups(offsets):
                sums, primes = prefix_sums(data[offsets[i]:offsets[j]]), prime_sums(data[offsets[i]:offsets[j]])
                rows, blocks = [], []
                for r in range(i, j):
                    lo, hi = (a[r] - n[r] + 1) // block, a[r] // block
                    if todo[r] is None:
                        b = np.arange(lo, hi + 1)
                    else:
                        wide = parent // block
                        b = (np.unique(np.array(todo[r], np.int64))[:, None] * wide + np.arange(wide)).ravel()
                        b = b[(b >= lo) & (b <= hi)]
                    rows.append(np.full(len(b), r))
                    blocks.append(b)
                r, b = np.concatenate(rows), np.concatenate(blocks)
                base = offsets[r] - offsets[i] + a[r]  # place of the anchor
                low, high = b * block, b * block + block - 1
                d1, d2 = np.maximum(low, a[r] - n[r] + 1), np.minimum(high, a[r])
                tag = (b.astype(np.uint64) + np.uint64(1)) * _FOLD
                core = mix(span_names(sums, primes, base - low, base - high + length) ^ tag)
                cover = mix(span_names(sums, primes, base - d2, base - d1 + length) + d1.astype(np.uint64) * np.uint64(1 << 32) + d2.astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[r]), pa.array(c[r]), pa.array(w[r]), pa.array(b.astype(np.int32)), pa.array(d1.astype(np.int32)),
                     pa.array(d2.astype(np.int32)), pa.array(core.view(np.int64)), pa.array(cover.view(np.int64))],
                    names=["h", "c", "w", "blk", "d1", "d2", "core", "cover"])

    return contents.select("h", "c", "n", "a", "w", "ctx", "todo").mapInArrow(rank, RANK_SCHEMA)


def repeated_offsets(contents: DataFrame, length: int, seed_length: int) -> DataFrame:
    """(h, c, d1, d2): offsets d1..d2 before the anchor at which windows of a
    zone content seen once (w = 1) repeat in other contents of its anchor."""
    found, todo = None, contents.withColumn("todo", F.lit(None).cast("array<int>"))
    # a block wider than all offsets of an anchor has no string in common
    blocks = [b for b in BLOCKS if b <= length - seed_length + 1]
    for parent, block in zip([blocks[0], *blocks], blocks):
        ranks = written(block_ranks(todo, block, parent, length), f"repeats-rank{block}")
        covers = ranks.groupBy("h", "core", "cover").agg(F.sum("w").alias("w"))
        dup = ranks.where("w = 1").join(covers.where("w > 1").select("h", "core", "cover"), ["h", "core", "cover"], "left_semi").select("h", "c", "d1", "d2")
        found = dup if found is None else found.unionByName(dup)
        if block > 1:
            open_cores = covers.groupBy("h", "core").agg(F.sum("w").alias("w"), F.min("w").alias("least")).where("w > 1 and least = 1")
            left = ranks.join(open_cores.select("h", "core"), ["h", "core"], "left_semi").groupBy("h", "c").agg(F.collect_list("blk").alias("todo"))
            todo = contents.join(left, ["h", "c"])
    return found


def repeated_spans(docs: DataFrame, length: int, seed_length: int) -> DataFrame:
    """(k1, k2, spans) of the documents (k1, k2, text) that lose bytes; spans
    are arrays of (start, end), bounded by the document itself."""
    shared = BitFilter.of(written(anchor_counts(docs, length, seed_length), "repeats-anchors"), "h")
    places = written(shared_zones(docs, shared, length, seed_length), "repeats-zones")
    contents = written(places.groupBy("h", "c").agg(F.count("*").alias("w")), "repeats-contents")
    split = contents.groupBy("h").agg(F.count("*").alias("k"), F.min("w").alias("least")).where("k > 1 and least = 1").select("h")
    wanted = BitFilter.of(written(split, "repeats-split"), "h")
    bytes_of = split_contents(docs, wanted, length, seed_length)
    some = repeated_offsets(written(bytes_of, "repeats-bytes"), length, seed_length)
    whole = places.join(contents.where("w > 1").select("h", "c"), ["h", "c"], "left_semi").select(
        "k1", "k2", F.col("p0").alias("start"), (F.col("p0") + F.col("n") - 1 + length).alias("end"))
    parts = places.join(some, ["h", "c"]).select(
        "k1", "k2", (F.col("p0") + F.col("a") - F.col("d2")).alias("start"), (F.col("p0") + F.col("a") - F.col("d1") + length).alias("end"))
    return whole.unionByName(parts).groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in sorted((s["start"], s["end"]) for s in spans):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [tuple(x) for x in out]


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def kept_bytes(raw: bytes, runs: list[tuple[int, int]], characters: bool) -> bytes:
    """What is left of a text without its runs; with ``characters`` a character
    of which a byte goes goes as a whole."""
    parts, at = [], 0
    for a, b in runs:
        if characters:
            while a > 0 and raw[a] & 0xC0 == 0x80:
                a -= 1
            while b < len(raw) and raw[b] & 0xC0 == 0x80:
                b += 1
        parts.append(raw[at:a])
        at = max(at, b)
    return b"".join(parts) + raw[at:]


def without_repeats(docs: DataFrame, length: int = LENGTH, seed_length: int = SEED_LENGTH, characters: bool = False) -> DataFrame:
    """``row`` (a struct of the documents' columns, whatever their names),
    ``spans`` (merged removed runs) and ``kept`` (remaining bytes; with
    ``characters``, of whole characters); one row per row of ``docs``."""
    if not 8 <= seed_length <= length:
        raise ValueError("seed_length must be between 8 and length")
    # an id may be null or repeated: the text's hash is part of the key
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("k1"),
                        F.xxhash64("text").alias("k2"), F.col("text"))
    spans = written(repeated_spans(keyed.select("k1", "k2", "text"), length, seed_length), "repeats-spans")
    touched = docs.sparkSession.sparkContext.broadcast(BitFilter.of(spans.select(F.xxhash64("k1", "k2").alias("key")), "key"))

    def dirty_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(touched.value(batch.column("key").to_numpy().view(np.uint64))))

    def clean_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.filter(pa.array(~touched.value(batch.column("key").to_numpy().view(np.uint64))))
            raw = pa.array([b"" if t is None else t for t in part.column("text").cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array([[]] * part.num_rows, RUNS), raw], names=["row", "spans", "kept"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            texts, spans = batch.column("text"), batch.column("spans").to_pylist()
            runs, kept = [], []
            for k, s in enumerate(spans):
                raw = texts[k].as_buffer().to_pybytes() if texts[k].is_valid else b""
                run = merged(s) if s else []
                runs.append([{"start": a, "end": b} for a, b in run])
                kept.append(kept_bytes(raw, run, characters))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(runs, RUNS), pa.array(kept, pa.binary())], names=["row", "spans", "kept"])

    from pyspark.sql.types import BinaryType, StructType
    marked = keyed.withColumn("key", F.xxhash64("k1", "k2"))
    dirty = marked.mapInArrow(dirty_only, marked.schema).join(spans, ["k1", "k2"], "left")
    schema = StructType([keyed.schema["row"], spans.schema["spans"]]).add("kept", BinaryType())
    clean = marked.select("row", "text", "key").mapInArrow(clean_only, schema)
    return clean.unionByName(dirty.select("row", "text", "spans").mapInArrow(cut, schema))


def digest(docs: DataFrame, length: int = LENGTH, seed_length: int = SEED_LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    cut = without_repeats(docs.select("doc_id", "text"), length, seed_length)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return cut.select("row.doc_id", (F.length("kept") + removed).cast("long").alias("n_bytes"), removed.alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def cleaned(docs: DataFrame, length: int = LENGTH, seed_length: int = SEED_LENGTH) -> DataFrame:
    """The documents with their repeated passages cut out; a character of which
    a byte went is dropped, and a column n_chars follows the new text."""
    cut = without_repeats(docs, length, seed_length, characters=True)
    changed = F.size("spans") > 0
    text = F.when(changed, F.col("kept").cast("string")).otherwise(F.col("row")["text"])
    new = {"text": text}
    if "n_chars" in docs.columns:
        size = F.length(text).cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(changed, size).otherwise(F.col("row")["n_chars"])
    return cut.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
