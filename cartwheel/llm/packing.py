"""Operator 10: bulk-synchronous best-fit packing of token sequences.

1. A map over the documents turns texts into token ids and cuts documents of
   more than ``capacity`` tokens into full pieces after a shorter first one.
2. Spark range-sorts the pieces by length, so that every piece has a rank in
   its length class. Lengths are at most ``capacity``; the class counts are
   therefore a table of bounded size, whatever the number of documents.
3. Sweeps over the classes, longest first: the open gaps are kept range-sorted
   too, and the pieces of a class go in bulk to the successor (the smallest
   gap that holds them). When several pieces want the same gaps, rank decides:
   the k-th piece takes the k-th gap. The gaps shrink, and the sweep repeats
   until the class is placed; what no gap holds opens new sequences. Runs of
   ranks move as a whole, so a sweep over classes stands for one over all
   pieces; its plan grows with ``capacity`` squared, not with the documents.
4. Spark joins the pieces with the planned runs of ranks.

This equals sequential best-fit decreasing, hence at most 11/9 of the optimum
and in practice near the bound tokens / capacity.

Defined results: a null or empty text is the end token alone; equal ids and
repeated rows are packed one by one; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cartwheel.llm.common import fresh_worker, ranked, worker_cache, written

CAPACITY = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
#: The same vocabulary as ranks of merges.
RANKS = "byte_bpe_50k.tiktoken"
#: Chunks a Python worker remembers before it starts anew.
CACHE_WORDS = 300_000

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def merge_ranks(ranks: str) -> dict[bytes, int]:
    import public_tokenizers
    with open(public_tokenizers.path(ranks), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache
def prove_ranks(vocabulary: str, ranks: str) -> None:
    """Raises unless the rank file stands for the vocabulary: no normalizer, the
    byte-level pattern, plain merges in the order of their tokens' ids, the same
    bytes for every id, and added tokens that match as they are written."""
    import public_tokenizers
    with open(public_tokenizers.path(vocabulary), encoding="utf-8") as f:
        held = json.load(f)
    model, split = held["model"], held["pre_tokenizer"] or {}
    plain = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    if held["normalizer"] or model["type"] != "BPE" or any(model.get(k) for k in plain):
        raise ValueError(f"{vocabulary} changes texts or merges otherwise than by ranks")
    if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        raise ValueError(f"{vocabulary} splits texts by another pattern")
    if any(t[k] for t in held["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"{vocabulary} has added tokens that match more than their text")
    # a byte is written as its own character if that shows, else as the next one from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown}
    byte_of |= {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*shown}))}
    added = {t["content"] for t in held["added_tokens"]}
    ids = {bytes(map(byte_of.__getitem__, t)): i for t, i in model["vocab"].items() if t not in added}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [model["vocab"]["".join(pair)] for pair in pairs]
    if ids != merge_ranks(ranks) or made != sorted(set(made)) or len(made) + 256 != len(ids):
        raise ValueError(f"{ranks} has other tokens or another order of merges than {vocabulary}")


class WordIds(dict):
    """Packed little-endian ids of a space and the chunk after it.

    The pre-token pattern always starts a new pre-token at a space between
    non-blanks, so chunks between single spaces are tokenized independently
    and repeat. The rank file of the same vocabulary does the merging; special
    strings inside a text become their id, as the tokenizer's default is.
    """

    #: A blank before a space joins two chunks: such texts are encoded whole.
    joined = re.compile(r"\s ")

    def __init__(self, vocabulary: str, ranks: str):
        super().__init__()
        import public_tokenizers
        import tiktoken
        with open(public_tokenizers.path(vocabulary), encoding="utf-8") as f:
            self.special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        merges = merge_ranks(ranks)
        self.encode = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges,
                                        special_tokens={}).encode_ordinary
        by_length = sorted(self.special, key=len, reverse=True)
        self.split_special = re.compile("(" + "|".join(map(re.escape, by_length)) + ")") if by_length else None

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encode(" " + chunk)
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(chunk) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[chunk] = out
        return out

    def plain(self, text: str) -> bytes:
        if self.joined.search(text):
            ids = self.encode(text)
            return struct.pack(f"<{len(ids)}I", *ids)
        head, *rest = text.split(" ")
        ids = self.encode(head)
        return struct.pack(f"<{len(ids)}I", *ids) + b"".join(map(self.__getitem__, rest))

    def packed(self, text: str) -> bytes:
        """Ids of a whole text, four bytes each."""
        if self.split_special is None or not any(s in text for s in self.special):
            return self.plain(text)
        return b"".join(self.special[part].to_bytes(4, "little") if part in self.special else self.plain(part)
                        for part in self.split_special.split(text))


_caches: dict[tuple[str, str], WordIds] = worker_cache({})


def word_ids(vocabulary: str, ranks: str) -> WordIds:
    """One per Python worker, kept between its tasks."""
    key = (vocabulary, ranks)
    if key not in _caches:
        _caches[key] = WordIds(vocabulary, ranks)
    return _caches[key]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY,
                     ranks: str = RANKS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    prove_ranks(vocabulary, ranks)
    end = end_id.to_bytes(4, "little")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker(_caches)
        ids = word_ids(vocabulary, ranks)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                packed = ids.packed(text.as_py() or "") + end
                n = len(packed) // 4
                start, doc, k = 0, doc_id.as_py(), 0
                while start < n:
                    length = (n % capacity or capacity) if k == 0 else capacity
                    crc = zlib.crc32(packed[4 * start:4 * (start + length)])
                    for column, value in zip(out, (doc, k, start, length, crc)):
                        column.append(value)
                    start, k = start + length, k + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, PIECE_SCHEMA)


def sweep(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Plan of the sweeps: (length, first rank, end rank, first sequence, offset).

    The pieces with ranks first..end of a length class go to consecutive
    sequences at one offset. Bounded: ``counts`` has at most ``capacity`` keys.
    """
    plan: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, count)
    sizes: list[int] = []  # gaps that are open, ascending
    fresh = 0

    def give(gap: int, first: int, n: int) -> None:
        if gap:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(sizes, gap)
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, end = 0, counts[length]
        while rank < end:
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):
                gap = sizes[at]
                first, n = gaps[gap].pop()
                take = min(n, end - rank)
                if take < n:
                    gaps[gap].append((first + take, n - take))
                elif not gaps[gap]:
                    del gaps[gap], sizes[at]
                plan.append((length, rank, rank + take, first, capacity - gap))
                give(gap - length, first, take)
                rank += take
            else:
                each = capacity // length
                new = max(1, (end - rank) // each)
                for k in range(min(each, end - rank)):
                    plan.append((length, rank, rank + new, fresh, k * length))
                    rank += new
                give(capacity - min(each, k + 1) * length, fresh, new)
                fresh += new
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    # pieces that tie (equal or null ids, equal texts) may still fall into different ranges
    tie = F.xxhash64(F.monotonically_increasing_id())
    order = [F.col("length"), F.col("doc_id"), F.col("piece"), F.col("_tie")]
    sorted_pieces = ranked(pieces.withColumn("_tie", tie), order, "packing")
    counts = {r["length"]: r["count"] for r in sorted_pieces.groupBy("length").count().collect()}
    first, seen = {}, 0
    for length in sorted(counts):
        first[length], seen = seen, seen + counts[length]
    runs = spark.createDataFrame([(n, a + first[n], b + first[n], s, o) for n, a, b, s, o in sweep(counts, capacity)],
                                 "_length long, _from long, _to long, _sequence long, offset long")
    # Bounded by capacity squared; one class has few runs.
    placed = sorted_pieces.join(F.broadcast(runs), (F.col("length") == F.col("_length")) & (F.col("rank") >= F.col("_from"))
                                & (F.col("rank") < F.col("_to")))
    return placed.withColumn("sequence_id", F.col("_sequence") + F.col("rank") - F.col("_from")).select(
        *pieces.columns, "sequence_id", "offset")


def packed_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY,
                     ranks: str = RANKS) -> DataFrame:
    # Written first: a range sort reads its input twice, once to find borders.
    return pack(written(token_pieces(docs, capacity, end_id, vocabulary, ranks), "packing-pieces"), capacity)
