from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cartwheel.llm import langid, mixing
from tests.llm.test_minhash_dedup import brute_force as components, shingles
from tests.llm.test_packing import check_packing

SF = "/root/testdata/sf0.001"


def kept_text(texts, length=200):
    """Brute force of the repeated-passage stage."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[p:p + length] for t in raw for p in range(len(t) - length + 1))
    out = []
    for text, t in zip(texts, raw):
        gone = [False] * len(t)
        for p in range(len(t) - length + 1):
            if seen[t[p:p + length]] > 1:
                gone[p:p + length] = [True] * length
        # a character of which a byte goes goes whole
        out.append(text if not any(gone) else whole_characters(t, gone))
    return out


def whole_characters(t, gone):
    out, at = "", 0
    for c in t.decode():
        n = len(c.encode())
        out += "" if any(gone[at:at + n]) else c
        at += n
    return out


def key(r):
    return (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "", str(r["lang"]), str(r["source"]))


def test_stages_are_the_ones_asked_for():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "repeated_passages", "mixing", "packing"]


@pytest.mark.parametrize("which", ["documents", "edge"])
def test_every_stage_equals_brute_force_on_its_own_input(llm, documents, edge_documents, which):
    import public_tokenizers
    import regex
    from tokenizers import Tokenizer
    docs = documents if which == "documents" else edge_documents
    stages = dict(corpus_pipeline.STAGES)
    rows = docs.collect()

    docs = llm.createDataFrame(stages["language_id"](llm, docs, SF).collect(), docs.schema)
    want = [r for r in rows if r["text"] and regex.search(r"\p{L}", r["text"])]
    rows = docs.collect()
    assert sorted(map(key, rows)) == sorted(map(key, want))

    docs = llm.createDataFrame(stages["near_duplicates"](llm, docs, SF).collect(), docs.schema)
    top = components([(r["doc_id"], r["text"]) for r in rows if r["doc_id"] is not None], 80)
    want, seen = [], set()
    for r in rows:
        if r["doc_id"] is None or (top[r["doc_id"]][1] == r["doc_id"] and (r["doc_id"], r["text"]) not in seen):
            want.append(r)
            seen.add((r["doc_id"], r["text"]))
    rows = docs.collect()
    assert sorted(map(key, rows)) == sorted(map(key, want))

    docs = llm.createDataFrame(stages["repeated_passages"](llm, docs, SF).collect(), docs.schema)
    want = sorted((r["doc_id"] or -1, t or "") for r, t in zip(rows, kept_text([r["text"] for r in rows])))
    rows = docs.collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in rows) == want

    copies = {(r["doc_id"], r["text"]): r["_copies"] for r in mixing.mix(docs).collect()}
    docs = llm.createDataFrame(stages["mixing"](llm, docs, SF).collect(), docs.schema)
    got = Counter((r["doc_id"], r["text"]) for r in docs.collect())
    assert got == Counter({k: n for k, n in copies.items() if n})

    packed = stages["packing"](llm, docs, SF).collect()
    check_packing(packed, docs.collect(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))


def test_near_copies_from_80_percent_on_go(llm, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect() if r["text"]]
    for n, size, edited in ((0, 94, 6), (1, 104, 6), (2, 104, 7), (3, 104, 8)):  # similarity 80/100, 90/110, 89/111, 88/112
        words = [f"word{k}of{n}" for k in range(size)]
        other = words[:40] + [f"new{k}of{n}" for k in range(edited)] + words[40 + edited:]
        rows += [(10**9 + 2 * n, " ".join(words)), (10**9 + 2 * n + 1, " ".join(other))]
    sets = {i: shingles(x) for i, x in rows}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            p, q = sorted((find(a), find(b)))
            top[q] = p
    df = llm.createDataFrame([(i, x, "en", "a", len(x)) for i, x in rows], documents.schema)
    got = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_duplicates"](llm, df, SF).collect()}
    assert got == {i for i in top if find(i) == i}
    assert {i - 10**9 for i in got if i >= 10**9} == {0, 2, 4, 6, 7}


def test_run_and_columns(llm):
    out = corpus_pipeline.run(llm, SF)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
    rows = out.collect()
    by = defaultdict(int)
    for r in rows:
        by[r["sequence_id"]] += r["length"]
    assert rows and max(by.values()) <= 1024


def test_empty_documents(llm, documents):
    docs = documents.where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(llm, docs, SF)
        assert out.count() == 0
        if name != "packing":
            assert out.columns == docs.columns


def test_registered_only_with_the_subpackage():
    import __spark_entry__ as entry
    from cartwheel.llm import queries
    names = entry.queries()
    assert set(queries.QUERIES) <= set(names) and "pipeline" in names
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
    assert langid and F
