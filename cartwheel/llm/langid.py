"""Operator 9: language identification by prediction by partial matching.

One variable-order byte context tree per language, orders 0 to 3. In a node
with n symbols seen, d of them distinct, a seen symbol costs
-log2(count / (n + d)) bits; an unseen one pays the escape -log2(d / (n + d))
and is coded by the next shorter context, without the symbols already ruled
out (exclusion). The statistics are frozen after training, so the cost of
every (context, byte) is a table entry, and the exact code length of a text is
a sum of table entries. The language of the shortest code wins; ties go to the
smaller language name.

Training counts 4-byte windows of at most about ``max_docs`` training documents
per language (whole documents, chosen by a hash of the id: a bounded sample of
labelled rows) in Spark and keeps the ``max_contexts`` most frequent order-3
contexts; rarer ones use their order-2 context. Bytes beyond the ``max_symbols``
most frequent share one symbol. The table is at most
(max_contexts + symbols**2) x symbols x languages floats, broadcast once.

Defined results: null text or a text without a letter: ``und`` with score 0;
empty training data: ``und`` everywhere; repeated rows are scored alike; texts
are read whole in blocks; only the id, text and lang columns are read, the
latter for training alone; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from cartwheel.llm.bytehash import BLOCK_BYTES, text_buffers, text_groups
from cartwheel.llm.common import fresh_worker

MAX_DOCS = 1500
MAX_CONTEXTS = 12_000
MAX_SYMBOLS = 95
UNDETERMINED = "und"

_LETTER = regex.compile(r"\p{L}")


@dataclass
class PpmModel:
    """Frozen context trees of all languages."""

    languages: list[str]
    symbol: np.ndarray  # byte -> symbol, 0: any byte outside the alphabet
    context: np.ndarray  # (s1, s2, s3) -> row of ``bits``, s1 the oldest
    bits: np.ndarray  # (row * symbols + symbol, language) -> code length

    @property
    def symbols(self) -> int:
        return self.context.shape[0]


def window_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): counts of 4-byte windows, zero bytes before the text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for lang in set(langs.tolist()):
                data, offsets = text_buffers(batch.column(0).filter(pa.array(langs == lang)))
                for i, j in text_groups(offsets):
                    piece = data[offsets[i]:offsets[j]].astype(np.uint32)
                    code = piece.copy()
                    starts = offsets[i:j] - offsets[i]
                    starts = starts[starts < len(piece)]
                    for k in (1, 2, 3):
                        back = np.zeros_like(piece)
                        back[k:] = piece[:-k]
                        for m in range(k):
                            at = starts + m
                            back[at[at < len(piece)]] = 0
                        code |= back << np.uint32(8 * k)
                    grams, n = np.unique(code, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))],
                        names=["lang", "gram", "n"])

    counted = docs.select("text", "lang").mapInArrow(count, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def training_sample(docs: DataFrame, trains: Column, max_docs: int) -> DataFrame:
    """Labelled training documents, about ``max_docs`` a language, by hash."""
    rows = docs.where(trains & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return rows
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, max_docs / n)))])
    unit = F.pmod(F.xxhash64(F.lit("train"), F.col("doc_id")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return rows.where(unit < F.element_at(share, F.col("lang")))


def train(docs: DataFrame, trains: Column, max_docs: int = MAX_DOCS, max_contexts: int = MAX_CONTEXTS,
          max_symbols: int = MAX_SYMBOLS) -> PpmModel:
    counts = window_counts(training_sample(docs, trains, max_docs)).toArrow()  # of a bounded sample
    lang = counts["lang"].combine_chunks().dictionary_encode()
    names = np.array(lang.dictionary.to_pylist(), dtype=object)
    return build(names, lang.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts["gram"].to_numpy(), counts["n"].to_numpy(),
                 max_contexts, max_symbols)


#: Contexts whose costs are worked out at once, which bounds the driver's memory.
CHUNK = 512


def build(names: np.ndarray, lang: np.ndarray, gram: np.ndarray, n: np.ndarray, max_contexts: int, max_symbols: int) -> PpmModel:
    """Cost table of the context trees of windows (oldest byte in the high
    bits) with their language numbers and counts."""
    languages = sorted(names.tolist())
    which = np.array([languages.index(x) for x in names.tolist()], dtype=np.int64)[lang] if len(lang) else np.empty(0, np.int64)
    # shares of each language's own bytes, so that a small language with a script
    # of its own has its symbols and contexts beside large ones
    of_lang = np.bincount(which, weights=n, minlength=len(languages))
    share = n / of_lang[which] if len(which) else n
    per_lang = np.bincount(which * 256 + (gram & 255), weights=share, minlength=256 * max(1, len(languages)))
    per_byte = per_lang.reshape(-1, 256).max(0)
    kept = [int(b) for b in np.argsort(-per_byte, kind="stable") if per_byte[b] > 0][:max_symbols]
    symbol = np.zeros(256, dtype=np.int32)
    symbol[sorted(kept)] = np.arange(1, len(kept) + 1)
    size = len(kept) + 1
    s = [symbol[(gram >> (8 * k)) & 255].astype(np.int64) for k in range(4)]  # s[0] newest

    def rows_of(code: np.ndarray, limit: int | None) -> np.ndarray:
        values, inverse = np.unique(code, return_inverse=True)
        if limit is None or len(values) <= limit:
            return values
        weight = np.bincount(inverse, weights=share)
        return np.sort(values[np.argsort(-weight, kind="stable")[:limit]])

    codes = [np.zeros(len(gram), np.int64), s[1], s[2] * size + s[1], (s[3] * size + s[2]) * size + s[1]]
    nodes = [np.zeros(1, np.int64), rows_of(codes[1], None), rows_of(codes[2], None), rows_of(codes[3], max_contexts)]
    first = np.cumsum([0] + [len(x) for x in nodes])
    total = int(first[-1])
    bits = np.empty((total, size, len(languages)), np.float32)
    shorter_prob = np.full((1, size, len(languages)), 1.0 / size)
    for order, values in enumerate(nodes):
        prob = np.empty((len(values) if order < 3 else 0, size, len(languages)))
        at = np.searchsorted(values, codes[order])
        event = np.argsort(at, kind="stable")
        for lo in range(0, len(values), CHUNK):
            part = values[lo:lo + CHUNK]
            below = shorter_prob[np.searchsorted(nodes[order - 1], part % size ** (order - 1))] if order else shorter_prob
            some = event[np.searchsorted(at, lo, sorter=event):np.searchsorted(at, lo + len(part), sorter=event)]
            some = some[values[at[some]] == codes[order][some]]  # other contexts were not kept
            c = np.zeros((len(part), size, len(languages)))
            np.add.at(c, (at[some] - lo, s[0][some], which[some]), n[some])
            seen = c > 0
            n_all, d = c.sum(1, keepdims=True), seen.sum(1, keepdims=True)
            left = np.maximum(1 - (below * seen).sum(1, keepdims=True), 1e-12)
            escape = np.where(n_all > 0, d / np.maximum(n_all + d, 1), 1.0)
            # all symbols seen: the escape is never used and its mass stays unused
            p = np.where(seen, c / np.maximum(n_all + d, 1), escape * below / left)
            bits[first[order] + lo:first[order] + lo + len(part)] = -np.log2(np.maximum(p, 1e-30))
            if order < 3:
                prob[lo:lo + len(part)] = p
        if order < 3:
            shorter_prob = prob
    grid = np.zeros(size, np.int32)
    grid[nodes[1]] = first[1] + np.arange(len(nodes[1]))
    for order in (2, 3):  # a context that was not kept points at its shorter one
        grid = np.broadcast_to(grid, (size,) + grid.shape).copy().ravel()
        grid[nodes[order]] = first[order] + np.arange(len(nodes[order]))
        grid = grid.reshape((size,) * order)
    return PpmModel(languages, symbol, grid, bits.reshape(total * size, len(languages)))


def code_lengths(model: PpmModel, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bits of each text under each language; texts begin at ``starts``
    (ascending, possibly empty texts)."""
    size, n_lang = model.symbols, len(model.languages)
    out = np.zeros((len(starts), n_lang))
    if not len(data):
        return out
    sym = model.symbol[data]
    before = np.zeros(len(sym) + 3, np.int32)
    before[3:] = sym
    index = np.zeros(len(sym), np.int64)
    real = starts[starts < len(data)]
    for k, scale in ((3, size * size), (2, size), (1, 1)):
        back = before[3 - k:len(sym) + 3 - k].astype(np.int64)
        for m in range(k):
            at = real + m
            back[at[at < len(sym)]] = model.symbol[0]
        index += back * scale
    row = model.context.ravel()[index].astype(np.int64) * size + sym
    ends = np.append(starts[1:], len(data))
    nonempty = np.flatnonzero(ends > starts)
    cost = model.bits[row].astype(np.float64)
    out[nonempty] = np.add.reduceat(cost, starts[nonempty], axis=0)
    return out


def judgements(model: PpmModel, column: pa.Array) -> Iterator[tuple[int, int, list[str], np.ndarray, np.ndarray]]:
    """(from, to, lang_pred, score, bits per byte of the winner) of groups of texts."""
    data, offsets = text_buffers(column)
    for i, j in text_groups(offsets):
        size = int(offsets[j] - offsets[i])
        if j == i + 1 and size > BLOCK_BYTES:  # one long text: block by block, contexts carried over
            bits = np.zeros((1, len(model.languages)))
            for at in range(0, size, BLOCK_BYTES):
                lead = min(3, at)
                block = data[offsets[i] + at - lead:offsets[i] + min(size, at + BLOCK_BYTES)]
                bits += code_lengths(model, block, np.array([0]))
                if lead:
                    bits -= code_lengths(model, block[:lead], np.array([0]))
        else:
            bits = code_lengths(model, data[offsets[i]:offsets[j]], offsets[i:j] - offsets[i])
        texts = column.slice(i, j - i)
        lettered = np.array([t.is_valid and bool(_LETTER.search(t.as_py())) for t in texts], bool)
        if model.languages:
            best = bits.argmin(1)
            rel = bits - bits.min(1, keepdims=True)
            score = np.where(lettered, 1 / np.exp2(-np.minimum(rel, 1000)).sum(1), 0.0)
            pred = [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best, lettered)]
            rate = bits.min(1) / np.maximum(1, offsets[i + 1:j + 1] - offsets[i:j])
        else:
            score, rate, pred = np.zeros(j - i), np.zeros(j - i), [UNDETERMINED] * (j - i)
        yield i, j, pred, score, rate


def predict(docs: DataFrame, model: PpmModel) -> DataFrame:
    """doc_id, lang_pred, score and the bits per byte of the winner."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            for i, j, pred, score, rate in judgements(shared.value, batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(pred, pa.string()), pa.array(score), pa.array(rate)],
                    names=["doc_id", "lang_pred", "score", "bits_per_byte"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        score, "doc_id long, lang_pred string, score double, bits_per_byte double")


def keep_identified(docs: DataFrame, model: PpmModel) -> DataFrame:
    """Documents whose language can be told, by the scores of ``predict``;
    their columns stay as they are.

    The texts are scored in place, so repeated ids and rows stay apart.
    """
    columns = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker()
        for batch in batches:
            keep = [p != UNDETERMINED for _, _, pred, _, _ in judgements(shared.value, batch.column("text")) for p in pred]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.select(*columns).mapInArrow(known, docs.schema)
