"""Operator 2: exact token counts with a whole-token shortcut.

The model (sentencepiece BPE, identity normalizer, dummy prefix) turns spaces
into U+2581 and merges. No vocabulary string has U+2581 after another
character, so merges never cross the start of a run of U+2581 and a text
decomposes exactly into pre-tokens: a run of U+2581 and what follows it.
``prove_model`` checks these premises and, offline, once per model, encodes
every vocabulary string alone: those that come back as one id are whole tokens.
A pre-token found in that set counts 1 without merging; only the rest is
merged by the library, one pre-token at a time, and remembered per worker.

Defined results: a null or empty text has 0 bytes and 0 tokens; a text of
blanks counts as the library says; rows are independent, so repeated rows and
ids change nothing; an empty table gives an empty result; only the id and text
columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cartwheel.llm.bytehash import text_buffers, text_groups
from cartwheel.llm.common import fresh_worker, worker_cache

VOCABULARY = "piece_bpe_32k.model"
LIMIT = 4096
#: Pre-tokens a Python worker remembers before it starts anew.
CACHE_WORDS = 600_000
MARK = "▁"

SCHEMA = "doc_id long, n_bytes long, n_tokens long"


def load(vocabulary: str):
    import public_tokenizers
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(vocabulary))


def prove_model(vocabulary: str) -> frozenset[str]:
    """Vocabulary strings, without their leading mark, that stand alone as one
    token. Raises if the model does not decompose at marks."""
    model = load(vocabulary)
    if model.encode("a  b", out_type=str) != [MARK + "a", MARK, MARK + "b"] or model.encode("") or len(model.encode(" a")) != 1 + len(model.encode("a")) or model.encode(" \t", out_type=str)[0] != MARK * 2:
        raise ValueError("the model normalizes white space; pre-tokens would not be exact")
    whole = set()
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i) or model.is_control(i) or model.is_unknown(i):
            continue
        if MARK in piece.lstrip(MARK):
            raise ValueError(f"{piece!r} crosses a pre-token border")
        if piece.startswith(MARK) and MARK not in piece[1:] and model.encode(piece[1:]) == [i] and len(piece) > 1:
            whole.add(piece[1:])
    return frozenset(whole)


class PretokenCounts(dict):
    """Tokens of the pre-token mark + key (further marks of the key written as
    spaces); whole tokens are preset, the rest is merged in bulk."""

    #: rest of a pre-token after its first mark: further marks, then the others
    rest = re.compile(MARK + "(" + MARK + "*[^" + MARK + "]*)")

    def __init__(self, vocabulary: str, whole: frozenset[str]):
        super().__init__(dict.fromkeys(whole, 1))
        self.whole = whole
        self.encode = load(vocabulary).encode
        self[""] = 1  # a lone mark, checked by prove_model

    def pretokens(self, text: str) -> list[str]:
        if not text:
            return []
        if "  " not in text and MARK not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [p.replace(MARK, " ") for p in self.rest.findall(MARK + text.replace(" ", MARK))]

    def counts(self, texts: list[str]) -> list[int]:
        split = [self.pretokens(t) for t in texts]
        found = [list(map(self.get, s)) for s in split]
        missing = list({w for s, f in zip(split, found) if None in f for w, n in zip(s, f) if n is None})
        merged = dict(zip(missing, map(len, self.encode(missing, num_threads=1)))) if missing else {}
        out = [sum(f) if None not in f else sum(merged[w] if n is None else n for w, n in zip(s, f))
               for s, f in zip(split, found)]
        if len(self) + len(merged) > CACHE_WORDS:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
            self[""] = 1
        self.update((w, n) for w, n in merged.items() if len(w) <= 64)
        return out


_caches: dict[str, PretokenCounts] = worker_cache({})


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text."""
    spark = docs.sparkSession
    whole = spark.sparkContext.broadcast(prove_model(vocabulary))  # at most the vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh_worker(_caches)
        if vocabulary not in _caches:  # kept between the tasks of a worker
            _caches[vocabulary] = PretokenCounts(vocabulary, whole.value)
        counts = _caches[vocabulary]
        for batch in batches:
            _, offsets = text_buffers(batch.column(1))
            for i, j in text_groups(offsets):
                texts = [t or "" for t in batch.column(1).slice(i, j - i).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(offsets[i + 1:j + 1] - offsets[i:j]),
                     pa.array(counts.counts(texts), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, SCHEMA)
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
