import hashlib
import random
from collections import Counter

import pytest

from cartwheel.llm import suffix_dedup as s


def brute_force(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[p:p + length] for t in raw for p in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = [False] * len(t)
        for p in range(len(t) - length + 1):
            if seen[t[p:p + length]] > 1:
                gone[p:p + length] = [True] * length
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


def compare(df, **params):
    docs = df.collect()
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in s.digest(df, **params).collect())
    want = sorted((d["doc_id"] or -1, *x) for d, x in zip(docs, brute_force([d["text"] for d in docs], params.get("length", 200))))
    assert got == want


def test_equals_brute_force_on_the_documents(documents):
    compare(documents)


def test_planted_passages_edits_and_periods(llm):
    rnd = random.Random(11)
    text = lambda n: "".join(rnd.choice("abcdefgé ") for _ in range(n))
    passage, docs = [text(n) for n in (39, 40, 41, 90, 200)], []
    for _ in range(60):
        t = text(rnd.randrange(120))
        for _ in range(rnd.randrange(3)):
            p = rnd.choice(passage)
            cut = rnd.randrange(len(p))
            t += rnd.choice([p, p[:cut] + "#" + p[cut + 1:], p[cut:]]) + text(rnd.randrange(40))
        docs.append(t)
    docs += ["a" * 500, "ab" * 300, "abc" * 70 + "x" + "abc" * 30, "", None, passage[4], passage[4], "z" * 39, "y" * 41]
    df = llm.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    compare(df, length=40, seed_length=12)
    compare(df, length=200, seed_length=64)


def test_long_texts_are_scanned_in_overlapping_blocks(llm, monkeypatch):
    import cartwheel.llm.bytehash as b
    rnd = random.Random(4)
    base = "".join(rnd.choice("abcdefgh") for _ in range(3000))
    docs = [base, base[700:1900] + "!" + base[100:400], "".join(rnd.choice("abcdefgh") for _ in range(2500)) + base[5:333]]
    import pyarrow as pa
    whole = [x for x in s.scan(pa.array(docs), 40, 12)]
    monkeypatch.setattr(s, "BLOCK_BYTES", 256)
    parts = [x for x in s.scan(pa.array(docs), 40, 12)]
    assert len(parts) > len(whole) and b.BLOCK_BYTES != 256
    windows = lambda found: sorted((row, at + int(p) + k, int(v), int(x) + at) for row, at, _, _, z in found
                                   for v, p, n, x in zip(*z) for k in range(int(n)))
    assert windows(whole) == windows(parts)


def test_edge_rows(edge_documents):
    compare(edge_documents)
    out = s.cleaned(edge_documents)
    assert out.columns == edge_documents.columns and out.count() == edge_documents.count()


def test_cleaned_text_drops_broken_characters(llm):
    shared = "é" * 30
    df = llm.createDataFrame([(1, "a" + shared + "x", 32), (2, "é" + shared[1:] + "y", 31), (3, "kept", 4)], "doc_id long, text string, n_chars long")
    rows = {r["doc_id"]: r for r in s.cleaned(df, length=41, seed_length=12).collect()}
    assert rows[3]["text"] == "kept" and "é" * 5 not in rows[1]["text"]
    assert all(r["n_chars"] == len(r["text"]) for r in rows.values())


def test_parameters(documents):
    with pytest.raises(ValueError):
        s.without_repeats(documents, length=10, seed_length=20)


def test_empty_table(documents):
    assert s.digest(documents.where("false")).collect() == []


def test_cleaned_keeps_characters_and_columns_of_any_name(llm):
    passage = "é" * 60 + "passage of two documents " * 8
    rows = [(1, "one \ufffd start " + passage + " and \ufffd the end"), (2, "日本" + passage), (3, "\ufffd untouched"), (4, None)]
    names = ["k1", "k2", "spans", "key", "row", "kept", "_key", "_spans", "_kept", "h", "c"]
    df = llm.createDataFrame([(*r, *names) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    out = {r["doc_id"]: r for r in s.cleaned(df, 200, 64).collect()}
    assert s.cleaned(df, 200, 64).columns == df.columns and all(r[n] == n for r in out.values() for n in names)
    assert out[1]["text"].startswith("one \ufffd start ") and out[1]["text"].endswith(" and \ufffd the end") and "passage" not in out[1]["text"]
    assert out[2]["text"] == "日本" and out[3]["text"] == "\ufffd untouched" and out[4]["text"] is None


def test_a_character_cut_in_two_goes_as_a_whole():
    raw = "aéz日b".encode()
    assert s.kept_bytes(raw, [(2, 4)], False) == raw[:2] + raw[4:]
    assert s.kept_bytes(raw, [(2, 4)], True).decode() == "a日b"
    assert s.kept_bytes(raw, [(2, 3), (5, 6)], True).decode() == "azb"
    assert s.kept_bytes(raw, [(0, len(raw))], True) == b""


def test_strings_that_collide_modulo_a_power_of_two_are_two(llm):
    bits = [bin(k).count("1") % 2 for k in range(1024)]
    one, other = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    df = llm.createDataFrame([(1, "x" + one), (2, "y" + other)], "doc_id long, text string")
    compare(df, length=1024, seed_length=64)
