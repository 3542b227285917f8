import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cartwheel.llm import minhash_dedup as m

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_force(docs, threshold=85):
    """id -> (set size, smallest reachable id) over (id, text) rows."""
    sets = [(i, shingles(t)) for i, t in docs]
    where = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            where[x].append(k)
    both = Counter((a, b) for ks in where.values() for i, a in enumerate(ks) for b in ks[i + 1:])
    top = list(range(len(sets)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for (a, b), n in both.items():
        if 100 * n >= threshold * (len(sets[a][1]) + len(sets[b][1]) - n):
            x, y = sorted((find(a), find(b)), key=lambda k: sets[k][0])
            top[y] = x
    return {i: (len(s), sets[find(k)][0]) for k, (i, s) in enumerate(sets)}


def compare(rows, want):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert got == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_equals_all_pairs_on_the_documents(documents):
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    compare(m.near_duplicates(documents).collect(), brute_force(docs))


def edited(rnd, words, n):
    out = list(words)
    for _ in range(n):
        out[rnd.randrange(len(out))] = f"e{rnd.randrange(10 ** 9)}"
    return out


def test_groups_of_near_copies_chains_and_a_cloud_below_the_threshold(llm):
    rnd = random.Random(7)
    docs, i = [], 0
    for _ in range(6):  # chains: each a small edit of the one before
        words = [f"w{rnd.randrange(10 ** 6)}" for _ in range(140)]
        for _ in range(8):
            words = edited(rnd, words, 1)
            docs.append((i := i + 1, " ".join(words)))
    base = [f"b{rnd.randrange(10 ** 6)}" for _ in range(150)]
    for k in range(150):  # one group, from close to far below the threshold
        docs.append((i := i + 1, " ".join(edited(rnd, base, k % 12))))
    rnd.shuffle(docs)
    df = llm.createDataFrame([(k, t) for k, t in docs], "doc_id long, text string")
    compare(m.near_duplicates(df).collect(), brute_force(docs))


def test_edge_rows(edge_documents):
    docs = [(r["doc_id"], r["text"]) for r in edge_documents.collect()]
    rows = m.near_duplicates(edge_documents).collect()
    assert len(rows) == len(docs)
    by = {r["doc_id"]: r for r in rows}
    assert by[5]["component_id"] == by[1]["component_id"] == 1 and not by[5]["kept"]
    assert by[2]["n_shingles"] == by[3]["n_shingles"] == by[4]["n_shingles"] == 0
    assert by[2]["kept"] and by[4]["kept"] and by[None]["kept"] and by[None]["component_id"] is None
    assert by[7]["n_shingles"] == 1
    kept = m.keep_one(edge_documents)
    assert kept.columns == edge_documents.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 6, 7, 8, 9]


def test_blocks_do_not_change_shingles(monkeypatch):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("abC \n\t") for _ in range(rnd.randrange(400))) for _ in range(60)] + ["x" * 900, ""]
    whole = [s.tolist() for s in m.shingle_sets(pa.array(texts))]
    monkeypatch.setattr(m, "BLOCK_BYTES", 64)
    assert [m.shingle_set(np.frombuffer(t.encode(), np.uint8)).tolist() for t in texts] == whole
    assert [len(s) for s in whole] == [len(shingles(t)) for t in texts]


def test_bounds_rule_out_no_pair(llm):
    rnd = random.Random(3)
    sets = []
    for g in range(12):
        base = rnd.sample(range(g * 1000, g * 1000 + 400), 40)
        for _ in range(10):
            s = set(base) - set(rnd.sample(base, rnd.randrange(5))) | {rnd.randrange(10 ** 6, 10 ** 9) for _ in range(rnd.randrange(5))}
            sets.append(sorted(s))
    df = llm.createDataFrame(list(enumerate(sets)), "doc_id long, shingles array<long>")
    labels = df.select("doc_id", F.col("doc_id").alias("label"))
    got = {(r["a"], r["b"]) for r in m.bounded_pairs(df, labels, 85).collect()}
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            n = len(set(sets[a]) & set(sets[b]))
            if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
                assert (a, b) in got


def test_components(llm):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 105), (105, 103), (103, 100), (200, 200), (7, 300)]
    got = {r["id"]: r["component"] for r in m.components(llm.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(2, 61)}, 103: 100, 105: 100, 300: 1}


def test_empty_table(documents):
    assert m.near_duplicates(documents.where("false")).count() == 0


def test_words_that_collide_modulo_a_power_of_two_stay_apart(llm):
    """A Thue-Morse word and its mirror differ in every byte, but polynomials
    modulo 2**64 cannot tell them apart."""
    bits = [bin(k).count("1") % 2 for k in range(1024)]
    one, other = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    df = llm.createDataFrame([(1, one), (2, other), (3, one)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in m.near_duplicates(df).collect()} == {1: 1, 2: 2, 3: 1}


def test_a_large_group_that_shares_a_shingle_with_an_outsider(llm):
    """Sets of one label are not joined with each other."""
    common, sets = list(range(100)), []
    for k in range(600):
        sets.append(common + [1000 + k])
    sets.append([5, *range(5000, 5100)])
    df = llm.createDataFrame(list(enumerate(sets)), "doc_id long, shingles array<long>")
    labels = df.select("doc_id", F.when(F.col("doc_id") < 600, 0).otherwise(600).cast("long").alias("label"))
    plan = m.bounded_pairs(df, labels, 85)
    assert plan.count() == 0 and "y_label" in plan._jdf.queryExecution().optimizedPlan().toString()
