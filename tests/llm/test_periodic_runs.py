import random
import zlib

import numpy as np
import pytest

from cartwheel.llm import periodic_runs as pr, queries

SF = "/root/testdata/sf0.001"


def brute_runs(words, min_length=12):
    """Every maximal stretch of every period, smallest periods first."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            length = i - start + p
            if length >= max(min_length, 2 * p):
                found.setdefault((start, length), p)
    return sorted((s, n, p) for (s, n), p in found.items())


def brute_collapse(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def words_of(text):
    return (text or "").translate({c: " " for c in range(9, 14)}).split(" ")


def rewritten(doc_id, text):
    """The contract's stand-in text, word for word."""
    w = [x for x in words_of(text) if x]
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    n, g = len(w), h // 10
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return w[:a] + [w[a + (i - a) % p] for i in range(a, n)]


def found(texts, **kw):
    import pyarrow as pa
    runs, collapsed = pr.batch_runs(pa.array(texts, pa.string()), kw.get("min_length", 12))
    return [[(r["start"], r["length"], r["period"]) for r in rs] for rs in runs.to_pylist()], collapsed.to_pylist()


def check(texts, min_length=12):
    got, collapsed = found(texts, min_length=min_length)
    for text, runs, rest in zip(texts, got, collapsed):
        w = [x for x in words_of(text) if x]
        want = brute_runs(w, min_length)
        assert runs == want, text
        assert rest == brute_collapse(w, want)


def test_cover_meets_every_difference():
    for d in range(pr.V):
        x = pr.SHIFTS[d]
        assert x in pr.COVER and (x + d) % pr.V in pr.COVER


@pytest.mark.parametrize("letters,size,min_length", [(1, 40, 12), (2, 60, 2), (2, 400, 12), (3, 200, 4), (5, 90, 6)])
def test_random_words_equal_brute_force(letters, size, min_length):
    rng = random.Random(letters * size)
    check([" ".join(rng.choice("abcde"[:letters]) for _ in range(rng.randrange(size))) for _ in range(60)], min_length)


def test_planted_runs_of_long_periods():
    rng = random.Random(5)
    texts = []
    for p in (1, 5, 6, 7, 31, 62, 100, 333):
        unit = [f"w{rng.randrange(50)}" for _ in range(p)]
        lead = [f"x{k}" for k in range(rng.randrange(70))]
        texts.append(" ".join(lead + unit * 3 + unit[:p // 2] + ["end"] + unit * 2 + lead))
    # nested: a run of runs, and a Fibonacci word, which has the most
    texts.append(" ".join((["a", "b"] * 9 + ["c"]) * 6))
    a, b = "a", "ab"
    while len(b) < 900:
        a, b = b, b + a
    texts.append(" ".join(b))
    check(texts)
    check(texts, 3)


def test_extension_lengths_beyond_the_cover():
    rng = np.random.default_rng(3)
    line = np.concatenate([np.tile(rng.integers(0, 3, 40), 12), rng.integers(0, 2, 300), [7] * 200])
    lce = pr.DifferenceCoverLCE(line, np.full(len(line), len(line)))
    i = rng.integers(0, len(line) - 1, 4000)
    j = i + rng.integers(1, 200, 4000)
    i, j = i[j < len(line)], j[j < len(line)]
    for a, b, n in zip(i, j, lce(i, j)):
        k = 0
        while b + k < len(line) and line[a + k] == line[b + k]:
            k += 1
        assert n == k


def test_texts_do_not_meet():
    check(["a b " * 5, "a b " * 5, "a b " * 6, "", None, " \t", "a " * 12, "a " * 11, "é é\x0bé " * 5, "a\xa0b " * 12])


def test_operator_and_edge_rows(llm, edge_documents):
    rows = pr.find_runs(edge_documents.withColumn("Period", edge_documents.n_chars)).collect()
    assert len(rows) == edge_documents.count()
    for r in rows:
        w = [x for x in words_of(r["text"]) if x]
        if len(w) < 1000:
            want = brute_runs(w)
            assert [tuple(x) for x in r["runs"]] == want and r["collapsed"] == brute_collapse(w, want)
    with pytest.raises(ValueError):
        pr.find_runs(edge_documents.withColumnRenamed("key", "Runs"))


def test_long_text(llm):
    """60,000 words with a run of period 9,973 and one of period 2."""
    unit = [f"w{k * 7919 % 9973}" for k in range(9973)]
    words = unit * 3 + ["x", "y"] * 10_000 + [f"z{k}" for k in range(10_081)]
    (runs,), _ = found([" ".join(words)])
    assert runs == [(0, 3 * 9973, 9973), (3 * 9973, 20_000, 2)]


def test_query_equals_brute_force(llm, documents):
    import hashlib
    from cartwheel.llm.queries import op11_periodic_runs
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for r in documents.collect():
        w = rewritten(r["doc_id"], r["text"])
        runs = brute_runs(w)
        top = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        want[r["doc_id"]] = (len(runs), *top, 1000 * top[1] // top[2] if runs else None,
                             sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(brute_collapse(w, runs)))
    got = {r["doc_id"]: (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], r["runs_sha256"], r["collapsed_sha256"])
           for r in op11_periodic_runs(llm, SF).collect()}
    assert got == want
    assert sum(w[0] > 0 for w in want.values()) > 10


def test_stand_in_texts(llm, edge_documents):
    out = queries.periodic_texts(edge_documents.select("doc_id", "text"))
    want = sorted((str(r["doc_id"]), rewritten(r["doc_id"], r["text"])) for r in edge_documents.collect())
    assert sorted((str(r["doc_id"]), [x for x in words_of(r["text"]) if x]) for r in out.collect()) == want


def test_empty_table(llm, documents):
    out = pr.find_runs(documents.where("false"))
    assert out.count() == 0 and out.columns == [*documents.columns, "runs", "collapsed"]
