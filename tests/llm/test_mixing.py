from pyspark.sql import functions as F

from cartwheel.llm import mixing


def water_level(sizes, share=1.5, cap=2):
    """Brute force: reshare until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in sizes if s not in full)
        target = {s: cap * sizes[s] if s in full else left * weight[s] / open_weight for s in sizes}
        more = {s for s in sizes if target[s] > cap * sizes[s] * (1 + 1e-12)}
        if not more:
            return target
        full |= more


def test_targets_match_repeated_resharing(llm):
    for sizes in ({"a": 10, "b": 500, "c": 40, None: 7}, {"a": 5}, {"x": 0, "y": 9, "z": 100}, {f"s{i}": i * i + 1 for i in range(23)}):
        df = llm.createDataFrame([(s, n) for s, n in sizes.items()], "source string, _size long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
        want = water_level(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_taken_words_come_near_the_targets(llm):
    rows = [(i, "w " * (1 + i % 9), "abc"[i % 7 % 3], ) for i in range(6000)]
    out = mixing.mix(llm.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in out.groupBy("source").agg(F.sum(F.col("_size") * F.col("_copies")).alias("t"), F.first("_target").alias("want")).collect():
        assert abs(r["t"] - r["want"]) < 0.06 * r["want"]
    assert out.where("_copies > 2").count() == 0


def test_edge_rows_and_repeatable(edge_documents):
    a = mixing.mix(edge_documents).select("doc_id", "source", "_size", "_copies")
    rows = sorted(a.collect(), key=str)
    assert len(rows) == edge_documents.count()
    assert rows == sorted(mixing.mix(edge_documents.repartition(5)).select("doc_id", "source", "_size", "_copies").collect(), key=str)
    assert mixing.repeated(edge_documents).columns == edge_documents.columns
    assert mixing.repeated(edge_documents).count() == sum(r["_copies"] for r in rows)


def test_empty_table(documents):
    assert mixing.mix(documents.where("false")).count() == 0


def test_repeated_keeps_columns_of_any_name(documents):
    from pyspark.sql import functions as F
    names = ["_size", "_copies", "_source_size", "_target", "_copy", "row", "_src", "rank", "weight"]
    df = documents.select("*", *[F.lit(n).alias(n) for n in names])
    out = mixing.repeated(df)
    assert out.columns == df.columns and out.select(*names).distinct().collect() == df.select(*names).distinct().collect()
    assert out.drop(*names).exceptAll(mixing.repeated(documents)).count() == 0
