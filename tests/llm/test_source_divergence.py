import random
import re
from collections import Counter, defaultdict

import numpy as np
from cartwheel.llm import source_divergence as sd

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def brute_force(rows, min_docs=30, top=50):
    """Rows of the contract from dense dictionaries and Python integers."""
    counts, inside = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = [t.translate(UPPER) for t in TERM.findall(text or "")]
        counts[lang or "", source or ""].update(found)
        inside[lang or ""].update(set(found))
    out = []
    for lang in {g[0] for g in counts}:
        kept = [t for t, n in inside[lang].items() if n >= min_docs]
        groups = sorted(g for g in counts if g[0] == lang)
        v = len(kept)
        whole = Counter()
        for g in groups:
            whole.update(counts[g])

        def price(c):
            total = sum(c[t] for t in kept) + 5 * v
            return {t: 1 + 10**9 * (c[t] + 5) // total for t in kept}

        p = {g: price(counts[g]) for g in groups}
        q = price(whole)
        for g in groups:
            pair = [(sum(abs(p[g][t] - p[o][t]) for t in kept), o[1]) for o in groups if o != g]
            term = [(p[g][t] - q[t], t) for t in kept if counts[g][t] and p[g][t] > q[t]]
            for part, found, last in (("pair", pair, None), ("term", term, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, g[1], part, item, value, k + 1) for k, (value, item) in enumerate(found[:last])]
    return sorted(out)


def got(df, **kw):
    return sorted(tuple(r) for r in sd.divergence(df, **kw).select("lang", "source", "part", "item", "value", "rank").collect())


def rows_of(df):
    return [(r["text"], r["lang"], r["source"]) for r in df.select("text", "lang", "source").collect()]


def test_many_chunks_and_blocks_equal_brute_force(documents):
    want = brute_force(rows_of(documents), 5)
    assert got(documents, min_docs=5, chunk=16, block=3) == want
    assert {w[2] for w in want} == {"pair", "term"}


def test_contract_defaults(llm, documents):
    want = brute_force(rows_of(documents))
    assert got(documents) == want and len(want) > 100


def test_edge_rows(edge_documents):
    df = edge_documents.withColumnRenamed("key", "Term").withColumnRenamed("label", "gid").withColumnRenamed("n", "chunk")
    for least in (1, 3):
        assert got(df, min_docs=least, chunk=4, block=1) == brute_force(rows_of(df), least)


def test_groups_without_terms_and_languages_without_kept_terms(llm):
    rows = [(f"a a b{k % 3} É {k}", "en", f"s{k % 4}") for k in range(40)] + [("12 _ 34", "en", "digits"), (None, "en", None), ("x", "de", "a"), ("y", "de", "b"),
            ("z", None, None), ("only", "one", "source")]
    df = llm.createDataFrame(rows, "text string, lang string, source string")
    want = brute_force(rows)
    assert got(df) == want
    assert ("de", "a", "pair", "b", 0, 1) in want and any(w[1] == "digits" and w[2] == "pair" and w[4] > 0 for w in want)


def test_a_source_with_a_third_of_all_rows(llm):
    rng = random.Random(1)
    rows = [(" ".join(f"w{rng.randrange(300)}xyz{chr(97 + rng.randrange(26))}" for _ in range(30)), "en", "hot" if k % 3 == 0 else f"s{k % 17}") for k in range(900)]
    df = llm.createDataFrame(rows, "text string, lang string, source string").repartition(7)
    assert got(df, chunk=8, block=2) == brute_force(rows)


def test_galloping_search():
    rng = np.random.default_rng(0)
    for _ in range(200):
        hay = np.unique(rng.integers(0, 500, rng.integers(0, 200)))
        needles = np.unique(rng.integers(-5, 510, rng.integers(0, 100)))
        assert (sd.gallop(needles, hay, int(rng.integers(1, 40))) == np.searchsorted(hay, needles)).all()


def test_prices_are_exact_for_large_counts(llm):
    rng = random.Random(2)
    rows = [(n, n + rng.randrange(10 ** 15)) for n in (rng.randrange(10 ** e) for e in range(1, 15) for _ in range(20))]
    want = [1 + 10**9 * (n + 5) // (t + 5) for n, t in rows]
    n, t = (np.array(x, np.int64) for x in zip(*rows))
    assert sd.prices(n, t + 5).tolist() == want
    df = llm.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, n long, t long")
    assert [r["p"] for r in df.select("k", sd.price(df.n, df.t + 5).alias("p")).orderBy("k").collect()] == want


def test_terms_are_the_pattern():
    text = "".join(map(chr, range(0x250))) + "ÀÉ日本 x"
    assert [t.decode() for t in sd.terms(text.encode())] == [t.translate(UPPER) for t in TERM.findall(text)]


def test_empty_table(documents):
    out = sd.divergence(documents.where("false"))
    assert out.collect() == [] and out.columns == ["lang", "source", "part", "item", "value", "rank"]
