import datetime as dt

from pyspark.sql import functions as F

from cartwheel.functions.cols import cents, falsy, js_or, js_round, pii_hash
from cartwheel.functions.period import resolve_period


def test_js_round_half_up(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (-2.6,), (0.49,), (3.5,)], "x double")
    got = [r[0] for r in df.select(js_round("x")).collect()]
    assert got == [3, -2, -3, 0, 4]


def test_cents_exact(spark):
    df = spark.createDataFrame([(112946.26,), (0.29,), (900.1,)], "x double")
    assert [r[0] for r in df.select(cents("x")).collect()] == [11294626, 29, 90010]


def test_falsy_defaults(spark):
    df = spark.createDataFrame([("", 0, False, float("nan")), (None, None, None, None), ("a", 5, True, 1.5)],
                               "s string, n bigint, b boolean, d double")
    rows = df.select(js_or("s", "dflt", "string"), js_or("n", 7, "number"), js_or("b", True, "bool"),
                     js_or("d", 0.0, "number"), falsy("s", "string")).collect()
    assert tuple(rows[0]) == ("dflt", 7, True, 0.0, None)
    assert tuple(rows[1]) == ("dflt", 7, True, 0.0, None)
    assert tuple(rows[2]) == ("a", 5, True, 1.5, "a")


def test_false_or_true_is_always_true(spark):
    # gift_cards_taxable || true
    df = spark.createDataFrame([(False,), (True,), (None,)], "b boolean")
    assert [r[0] for r in df.select(js_or("b", True, "bool")).collect()] == [True, True, True]


def test_pii_hash(spark):
    df = spark.createDataFrame([("A@B.com",), ("",), (None,), (" 555 ",)], "e string")
    rows = df.select(pii_hash("e").alias("h"), pii_hash("e", lower=False).alias("raw")).collect()
    import hashlib
    assert rows[0].h == hashlib.sha256(b"a@b.com").hexdigest()
    assert rows[1].h is None and rows[2].h is None
    assert rows[3].raw == hashlib.sha256(b" 555 ").hexdigest()


def test_resolve_period():
    as_of = dt.datetime(2024, 2, 29, 13, 30)
    assert resolve_period("1y", as_of) == (dt.datetime(2023, 3, 1, 13, 30), as_of)
    assert resolve_period("7d", as_of)[0] == dt.datetime(2024, 2, 22, 13, 30)
    assert resolve_period("bogus", as_of)[0] == dt.datetime(2024, 1, 30, 13, 30)
    assert resolve_period(None, as_of) == resolve_period("30d", as_of)
    assert resolve_period("1y", dt.datetime(2023, 5, 2))[0] == dt.datetime(2022, 5, 2)


def test_no_python_udfs_in_plans(spark):
    from cartwheel.plans.registry import queries
    df = queries()["purchase_conversion"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert F  # keep import


def test_period_start_column_matches_driver_side(spark):
    from cartwheel.functions.period import period_start
    anchors = [dt.datetime(2024, 2, 29, 13, 30), dt.datetime(2023, 3, 1), dt.datetime(2000, 2, 29)]
    codes = ["7d", "30d", "90d", "1y", "zz"]
    df = spark.createDataFrame([(p, a) for p in codes for a in anchors], "p string, a timestamp_ntz")
    got = {(r.p, r.a): r.s for r in df.select("p", "a", period_start(F.col("p"), F.col("a")).alias("s")).collect()}
    for (p, a), s in got.items():
        assert s == resolve_period(p, a)[0]
