import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cartwheel.llm import langid
from cartwheel.llm.common import id_bucket, table


def ppm_bits(model_counts, text, size):
    """Slow PPM with escapes and exclusion on a dict of context -> Counter."""
    bits = 0.0
    for i in range(len(text)):
        context = tuple(([0, 0, 0] + text[max(0, i - 3):i])[-3:])
        p = probability(model_counts, context, text[i], size)
        bits -= math.log2(p)
    return bits


def probability(counts, context, symbol, size):
    if len(context) and context not in counts["nodes"]:
        return probability(counts, context[1:], symbol, size)
    seen = counts["lang"].get(context, Counter())
    below = (lambda s: probability(counts, context[1:], s, size)) if context else (lambda s: 1 / size)
    n, d = sum(seen.values()), len(seen)
    if seen[symbol]:
        return seen[symbol] / (n + d)
    left = 1 - sum(below(s) for s in seen)
    return (d / (n + d) if n else 1.0) * below(symbol) / max(left, 1e-12)


def test_code_lengths_equal_slow_ppm():
    train = {"a": ["abab abac", "ba ab ca"], "b": ["ccca bcc", "c ca cb"]}
    rows = Counter()
    for lang, texts in train.items():
        for t in texts:
            b = [0, 0, 0, *t.encode()]
            for i in range(3, len(b)):
                rows[lang, (b[i - 3] << 24) | (b[i - 2] << 16) | (b[i - 1] << 8) | b[i]] += 1
    keys = list(rows)
    names = np.array(["b", "a"], object)
    model = langid.build(names, np.array([int(k[0] == "a") for k in keys]), np.array([k[1] for k in keys]), np.array([rows[k] for k in keys]), 1000, 95)
    sym = lambda t: [int(model.symbol[x]) for x in t.encode()]
    nodes, lang_counts = {()}, {l: {} for l in train}
    for lang, texts in train.items():
        for t in texts:
            s = [0, 0, 0, *sym(t)]
            for i in range(3, len(s)):
                for k in range(4):
                    ctx = tuple(s[i - k:i])
                    nodes.add(ctx)
                    lang_counts[lang].setdefault(ctx, Counter())[s[i]] += 1
    texts = ["abac", "cc b", "zzab", "", "a"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    starts = np.cumsum([0] + [len(t) for t in texts[:-1]])
    got = langid.code_lengths(model, data, starts)
    for k, t in enumerate(texts):
        for j, lang in enumerate(model.languages):
            want = ppm_bits({"nodes": nodes, "lang": lang_counts[lang]}, sym(t), model.symbols)
            assert abs(got[k, j] - want) < 1e-3 * max(1, want)


def test_held_out_accuracy(llm):
    docs = table(llm, "/root/testdata/sf0.01", "documents")
    model = langid.train(docs, id_bucket(F.col("doc_id"), 3) != 1)
    out = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(id_bucket(F.col("doc_id"), 3) == 1).collect()
    assert len(out) > 250 and sum(r["lang"] == r["lang_pred"] for r in out) >= 0.98 * len(out)
    assert all(0 <= r["score"] <= 1 for r in out)


def test_edge_rows_and_blocks(llm, edge_documents, monkeypatch):
    docs = table(llm, "/root/testdata/sf0.001", "documents")
    model = langid.train(docs, F.lit(True))
    rows = langid.predict(edge_documents, model).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == edge_documents.count()
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (2, 3, 4, 9))
    assert by[1]["lang_pred"] == "en" and by[6]["lang_pred"] in model.languages
    kept = langid.keep_identified(edge_documents, model)
    assert kept.columns == edge_documents.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 1, 5, 6, 7, 8]


def test_kept_are_those_the_model_identifies(llm):
    texts = [(i, f"the cat and the dog {i} walk on the road", "en") for i in range(20)] + [(100 + i, f"zqxj {i} xqzj qqzx jxqz", "und") for i in range(20)]
    docs = llm.createDataFrame(texts + [(200, "jxqz zqxj qqzx", None), (201, "a cat and a dog", None), (202, "12 345", None)], "doc_id long, text string, lang string")
    model = langid.train(docs, F.lit(True))
    want = {r["doc_id"] for r in langid.predict(docs, model).where("lang_pred <> 'und'").collect()}
    assert want == {*range(20), 201}
    assert {r["doc_id"] for r in langid.keep_identified(docs, model).collect()} == want


def test_no_training_rows(documents):
    model = langid.train(documents, F.lit(False))
    assert {r["lang_pred"] for r in langid.predict(documents, model).collect()} == {"und"}
    assert langid.predict(documents.where("false"), model).count() == 0


def test_small_languages_with_scripts_of_their_own(llm):
    """Symbols and contexts go by shares of each language's bytes: two small
    languages keep theirs beside a large one."""
    import random
    rnd = random.Random(6)
    letters = {"en": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "el": "αβγδεζηθικλμνξοπρστυφχψω", "hy": "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվ"}
    text = lambda lang, n: " ".join("".join(rnd.choice(letters[lang]) for _ in range(rnd.randrange(2, 9))) for _ in range(n))
    rows = [(lang, text(lang, 60)) for lang, n in (("en", 400), ("el", 6), ("hy", 6)) for _ in range(n)]
    train = llm.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    model = langid.train(train, F.lit(True), max_contexts=400, max_symbols=60)
    fresh = [(lang, text(lang, 4)) for lang in letters for _ in range(30)]
    out = langid.predict(llm.createDataFrame([(k, t) for k, (_, t) in enumerate(fresh)], "doc_id long, text string"), model).collect()
    assert all(r["lang_pred"] == fresh[r["doc_id"]][0] for r in out)
