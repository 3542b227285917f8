import random

import numpy as np
from pyspark.sql import functions as F

from cartwheel.llm import toxicity as t

TERMS = [("idiot", False, 4.0), ("worthless", False, 4.0), ("scum", False, 3.5), ("blorax", True, 4.0)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    rnd = random.Random(1)
    automaton = t.LexiconAutomaton(TERMS)
    words = ["idiot", "idi0t", "id1iot", "diot", "worthles", "wrothless", "scum", "scam", "bloraxish", "blroax", "blraxen", "", "x"]
    for _ in range(4000):
        w = list(rnd.choice(TERMS)[0] + rnd.choice(["", "", "ab", "s"]))
        for _ in range(rnd.randrange(4)):
            k, at = rnd.randrange(3), rnd.randrange(len(w) + 1)
            w[at:at + (k != 0)] = [rnd.choice("idotscumxyz")] if k != 1 else []
        words.append("".join(w))
    for w in words:
        best = []
        for k, (term, stem, weight) in enumerate(TERMS):
            limit = t.edit_limit(term, stem, weight)
            d = min(distance(term, w[:n]) for n in range(len(w) + 1)) if stem else distance(term, w)
            if d <= limit:
                best.append((d, k))
        got = automaton.match(w)
        assert got == ((min(best)[1], min(best)[0]) if best else None), w


def corpus(llm, n=600, seed=2):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randint(3, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(5, 200))]
        toxic = i % 5 == 0
        quoted = i % 7 == 3 and not toxic
        for _ in range(3 if toxic else 2 if quoted else 0):
            at = rnd.randrange(len(words))
            bad = rnd.choice(["idiot", "worthless", "scumbag", "trashy"])
            words[at:at] = ["he", "said", f'"{bad}"', "then"] if quoted else ["you", bad]
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return (llm.createDataFrame(docs, "doc_id long, text string"), llm.createDataFrame(labels, "doc_id long, toxic int"), dict(labels))


def test_quotation_differs_from_abuse_and_misspellings_are_caught(llm):
    docs, labels, truth = corpus(llm)
    trains = F.col("doc_id") % 4 != 2
    model = t.train(docs, labels, trains)
    out = {r["doc_id"]: r for r in t.score(docs, model).collect()}
    held = [i for i in truth if i % 4 == 2]
    assert sum(out[i]["predicted"] == truth[i] for i in held) >= 0.97 * len(held)
    probe = llm.createDataFrame([(1, "you idiott go you worthles man"), (2, "a calm and quiet day")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in t.score(probe, model).collect()}
    assert got[1] > got[2]


def test_held_out_on_the_documents(llm):
    from cartwheel.llm.common import table
    from cartwheel.llm.queries import op5_toxicity
    sf = "/root/testdata/sf0.1"
    out = op5_toxicity(llm, sf).join(table(llm, sf, "labels").select("doc_id", "toxic"), "doc_id").where("held_out and toxic is not null").collect()
    toxic, clean = [r for r in out if r["toxic"]], [r for r in out if not r["toxic"]]
    assert sum(r["predicted"] for r in toxic) >= 0.9 * len(toxic) and sum(r["predicted"] for r in clean) <= 0.02 * len(clean)


def test_only_copies_leave_the_training_sample(llm):
    rnd = random.Random(5)
    common = [f"common{k}" for k in range(60)]
    texts = []
    for i in range(100):  # the same words in another order, and some of its own: no five words in common
        words = common + [f"own{i}x{k}" for k in range(20)]
        rnd.shuffle(words)
        texts.append(" ".join(words))
    copies = [texts[0], texts[0].upper(), texts[1] + " end"]
    docs = llm.createDataFrame(list(enumerate(texts + copies)), "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 = 1 and doc_id < 100 as int) AS toxic")
    labels = labels.where("doc_id != 102").unionByName(llm.createDataFrame([(102, 1)], "doc_id long, toxic int"))
    sample = t.training_sample(docs, labels, F.lit(True), 1000).collect()
    assert sorted(r["text"] for r in sample) == sorted(texts)
    assert sum(r["toxic"] for r in sample) == 50


def test_scores_do_not_depend_on_the_sample_bound(llm):
    rnd = random.Random(7)
    docs, labels = [], []
    for i in range(1600):  # one in ten is toxic, half of them without a telling word
        words = ["".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(20)]
        if i % 20 == 0:
            words[5:5] = ["you", rnd.choice(["idiot", "worthless"])]
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 10 == 0)))
    docs, labels = llm.createDataFrame(docs, "doc_id long, text string"), llm.createDataFrame(labels, "doc_id long, toxic int")
    plain = llm.createDataFrame([(1, "a calm and quiet day")], "doc_id long, text string")
    whole, bounded = (t.score(plain, t.train(docs, labels, F.lit(True), max_docs=n)).first() for n in (4000, 100))
    assert whole["predicted"] == bounded["predicted"] == 0
    odds = [np.log(r["score"] / (1 - r["score"])) for r in (whole, bounded)]
    assert abs(odds[0] - odds[1]) < 0.7


def test_edge_rows(llm, edge_documents):
    docs, labels, _ = corpus(llm, 300)
    labels = labels.unionByName(llm.createDataFrame([(5, None), (None, 1), (5, 1)], "doc_id long, toxic int"))
    model = t.train(docs, labels, F.lit(True))
    rows = t.score(edge_documents, model).collect()
    assert len(rows) == edge_documents.count() and all(0 <= r["score"] <= 1 for r in rows)
    by = {r["doc_id"]: r["score"] for r in rows}
    assert by[2] == by[3] == by[4]


def test_one_label_or_none(llm, documents):
    labels = llm.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert {r["score"] for r in t.score(documents, t.train(documents, labels, F.lit(True))).collect()} == {0.0}
    assert t.score(documents.where("false"), t.ToxicityModel()).count() == 0


def test_weights_separate():
    x = np.array([[1.0, 0], [1, 0], [1, 1], [1, 1]])
    w = t.fit_weights(x, np.array([0, 0, 1, 1.0]), ridge=0.1)
    assert w[0] < 0 < w[0] + w[1]


def test_lexicon_has_no_fixed_size():
    rows = [{"term": f"bad{k:03}x", "stem": False, "n_toxic": 20, "n_clean": 0} for k in range(400)]
    rows += [{"term": "bad0", "stem": True, "n_toxic": 500, "n_clean": 400}]
    terms = t.choose_terms(rows, 1000, 1000)
    assert len(terms) == 400 and not any(stem for _, stem, _ in terms)


def test_a_stem_explains_its_words_and_a_word_its_beginnings():
    rows = [{"term": term, "stem": stem, "n_toxic": n, "n_clean": 0} for term, stem, n in (
        ("vileness", True, 60), ("vilenes", True, 60), ("vilenesses", False, 30), ("scum", False, 50), ("scu", True, 50), ("scummy", False, 20))]
    assert sorted(x[:2] for x in t.choose_terms(rows, 1000, 1000)) == [("scum", False), ("scummy", False), ("vileness", True)]


def test_mentions_are_learned_from_the_context(llm):
    clean = [(f"they reported the word filth{k} today and left number {k}", 0, 1.0) for k in range(60)]
    toxic = [(f"you are filth{k} and nothing else number {k}", 1, 1.0) for k in range(60)]
    sample = llm.createDataFrame(clean + toxic, "text string, toxic int, weight double")
    model = t.ToxicityModel(terms=[("filth", True, 3.0)])
    context, mentions = t.context_words(sample, model)
    assert "reported" in mentions and "you" not in mentions and context["you"] > 0 > context["reported"]
