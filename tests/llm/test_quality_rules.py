import re
from collections import Counter

from pyspark.sql import functions as F

from cartwheel.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def compare(df):
    docs = df.select("doc_id", "text").collect()
    rows = q.judge(df).collect()
    got = sorted((r["doc_id"] or -1, *(r[c] for c in NAMES)) for r in rows)
    assert got == sorted((d["doc_id"] or -1, *measures(d["text"])) for d in docs)
    assert not any(r["kept"] for r in rows if r["base_failed"])
    return rows


def test_measures_equal_brute_force(documents):
    compare(documents)


def test_edge_rows(edge_documents):
    rows = compare(edge_documents)
    assert len(rows) == edge_documents.count()


def test_repeated_windows(llm):
    texts = ["a b c a b c", "a a a", "a a a a", "a b c d a b c d a b", "x y", "a b c\nd\na b c\n\n \na b c", "１ é é é é\x0b\x0c", "a\xa0b c d a\xa0b c d"]
    compare(llm.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_verdict_does_not_depend_on_the_order(documents):
    base = q.measured(documents)
    rules = q.default_rules()
    names = list(rules)
    a = base.select("doc_id", q.cascade(rules, names).isNull().alias("k")).orderBy("doc_id").collect()
    b = base.select("doc_id", q.cascade(rules, names[::-1]).isNull().alias("k")).orderBy("doc_id").collect()
    assert a == b and 0 < sum(r["k"] for r in a) < len(a)


def test_rejections_per_cost_come_first(llm):
    rows = llm.range(300).select(F.col("id").alias("doc_id"))
    slow = F.size(F.filter(F.sequence(F.lit(1), F.lit(20_000)), lambda x: x * 3 % 7 == F.col("doc_id") % 7)) > 10 ** 9
    rules = {"never_slow": slow, "often_fast": F.col("doc_id") % 2 == 0, "null": F.lit(None).cast("boolean")}
    assert q.order_rules(rows, rules)[0] == "often_fast"
    assert q.order_rules(rows.where("false"), rules) == list(rules)


def test_clean_documents_are_kept(llm):
    import random
    rnd = random.Random(0)
    prose = [" ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for _ in range(200)) + "." for _ in range(20)]
    assert all(r["kept"] for r in q.judge(llm.createDataFrame(list(enumerate(prose)), "doc_id long, text string")).collect())


def test_empty_table(documents):
    assert q.judge(documents.where("false")).count() == 0
