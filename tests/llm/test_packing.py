import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cartwheel.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check_packing(rows, docs, tokenizer, capacity=1024):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for d in docs:
        ids = np.array(tokenizer.encode(d["text"] or "", add_special_tokens=False).ids + [2], np.uint32)
        want, at, k = [], 0, 0
        while at < len(ids):
            n = (len(ids) % capacity or capacity) if k == 0 else capacity
            want.append((k, at, n, zlib.crc32(ids[at:at + n].astype("<u4").tobytes())))
            at, k = at + n, k + 1
        got = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[d["doc_id"]])
        assert set(want) <= set(got)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_seq)


def test_pieces_equal_the_library_and_sequences_are_gapless(documents, tokenizer):
    rows = packing.packed_documents(documents).collect()
    sequences = check_packing(rows, documents.collect(), tokenizer)
    assert sequences <= 1.02 * sum(r["length"] for r in rows) / 1024 + 1


def test_edge_rows(edge_documents, tokenizer):
    docs = edge_documents.collect()
    rows = packing.packed_documents(edge_documents).collect()
    check_packing(rows, docs, tokenizer)
    assert sum(r["length"] for r in rows) == sum(len(tokenizer.encode(d["text"] or "", add_special_tokens=False).ids) + 1 for d in docs)


def test_chunks_between_spaces_tokenize_like_the_whole_text(tokenizer):
    rnd = random.Random(1)
    ids = packing.word_ids(packing.VOCABULARY, packing.RANKS)
    signs = [" "] * 12 + list("aÉ1½!ñあ²\n\t\x0b\x1c\x85\xa0 　") + ["'s", "  ", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rnd.choice(signs) for _ in range(9))
        assert np.frombuffer(ids.packed(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def simple_best_fit(lengths, capacity):
    gaps, n = [], 0
    for length in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= length]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - length)
        else:
            n += 1
            gaps.append(capacity - length)
    return n


def test_sweeps_equal_sequential_best_fit_decreasing():
    rnd = random.Random(5)
    for capacity in (1, 7, 30, 64):
        for _ in range(30):
            lengths = [rnd.randint(1, capacity) for _ in range(rnd.randint(0, 150))]
            counts = {n: lengths.count(n) for n in set(lengths)}
            plan = packing.sweep(counts, capacity)
            used = defaultdict(int)
            for length, a, b, first, _ in plan:
                for k in range(b - a):
                    used[first + k] += length
            assert all(v <= capacity for v in used.values()) and sum(used.values()) == sum(lengths)
            assert len(used) == simple_best_fit(lengths, capacity)


def test_ranks_must_stand_for_the_vocabulary():
    packing.prove_ranks(packing.VOCABULARY, packing.RANKS)
    with pytest.raises(ValueError, match="other tokens"):
        packing.prove_ranks(packing.VOCABULARY, "byte_bpe_multi_50k.tiktoken")
    with pytest.raises(ValueError, match="changes texts|another pattern"):
        packing.prove_ranks("word_bpe_49k.json", packing.RANKS)


def test_many_pieces_that_tie_are_packed_whole(llm):
    docs = llm.range(5000).selectExpr("cast(null as long) doc_id", "cast(null as string) text")
    rows = packing.packed_documents(docs).collect()
    assert len(rows) == 5000 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 5000
    assert len({r["sequence_id"] for r in rows}) == 5 and max(r["offset"] for r in rows) == 1023


def test_empty_table(documents):
    assert packing.packed_documents(documents.where("false")).collect() == []
