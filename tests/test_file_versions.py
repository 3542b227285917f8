import datetime as dt

import pytest
from pyspark.sql import functions as F

from cartwheel.session import scratch_path
from cartwheel.sources.file_versions import FileTable, delete, patch, upsert

NOW = dt.datetime(2024, 5, 1)
PATCH = "id long, name string, amount long, fields array<string>"


@pytest.fixture
def table(spark):
    t = FileTable(spark, scratch_path(spark, "t-files"))
    rows = spark.range(800).select("id", F.concat(F.lit("n"), "id").alias("name"), (F.col("id") * 2).alias("amount"),
                                   F.lit(dt.datetime(2020, 1, 1)).cast("timestamp_ntz").alias("updated_at"))
    assert t.create(rows.repartitionByRange(8, "id")) == 1
    return t


def rows(df):
    return {r["id"]: (r["name"], r["amount"], r["updated_at"]) for r in df.collect()}


def step(t):
    r = t.history().orderBy(F.col("version").desc()).first()
    return r["rewritten"], r["added"], r["kept"]


def test_a_patch_of_one_row_rewrites_one_file(spark, table):
    before = rows(table.read())
    assert len(before) == 800 and table.files().count() == 8
    p = spark.createDataFrame([(17, "new", None, ["name"]), (99999, "none", 1, ["name"]), (500, "x", 1, ["id"])], PATCH)
    assert patch(table, p, "id", ("name", "amount"), NOW) == 2
    assert step(table)[0] == 1 and step(table)[2] == 7
    after = rows(table.read())
    assert after == {**before, 17: ("new", 34, NOW)}
    assert rows(table.read(1)) == before  # readers of the old version
    shared = {r["file"] for r in table.files(1).collect()} & {r["file"] for r in table.files(2).collect()}
    assert len(shared) == 7 and {r["origin"] for r in table.files(2).collect()} == {"1", "2"}


def test_nothing_to_do_makes_no_version(spark, table):
    p = spark.createDataFrame([(99999, "none", 1, ["name"]), (None, "x", 1, ["name"])], PATCH)
    assert patch(table, p, "id", ("name",), NOW) == 1 and table.newest() == 1
    assert delete(table, spark.createDataFrame([(None,)], "id long"), "id") == 1


def test_upsert_and_delete_equal_the_whole_table_jobs(spark, table):
    from cartwheel.operators import maintain as m
    changes = spark.createDataFrame([(3, "three", 1), (3, "late", 2), (797, "end", 1), (2000, "fresh", 1), (-5, "low", 1)], "id long, name string, seq long")
    whole = rows(m.upsert(table.read(), changes, "id", seq="seq"))
    assert upsert(table, changes, "id", seq="seq") == 2
    assert rows(table.read()) == whole and len(whole) == 802
    assert step(table)[0] == 2 and step(table)[1] > 0 and step(table)[2] == 6
    assert delete(table, spark.createDataFrame([(3,), (2000,), (4444,)], "id long"), "id") == 3
    assert rows(table.read()) == {k: v for k, v in whole.items() if k not in (3, 2000)}
    assert rows(table.read(2)) == whole


def test_the_range_of_the_keys_reaches_the_scan(spark, table):
    files = [r["file"] for r in table.files().collect()]
    seen = table._rows(files).where((F.col("id") >= 17) & (F.col("id") <= 17))
    assert "GreaterThanOrEqual(id,17)" in seen._jdf.queryExecution().executedPlan().toString()
    assert len(table.touched("id", spark.createDataFrame([(17,), (18,)], "id long"))) == 1


def test_a_version_without_its_log_row_does_not_exist(spark, table):
    before = rows(table.read())
    table.files().write.parquet(f"{table.root}/files/v=2")  # an interrupted change
    assert table.newest() == 1 and rows(table.read()) == before
    with pytest.raises(ValueError):
        table.read(2)
    assert delete(table, spark.createDataFrame([(1,)], "id long"), "id") == 2 and len(rows(table.read())) == 799


def test_two_writers(spark, table):
    base = table.files().count()

    def meanwhile(part):
        delete(FileTable(spark, table.root), spark.createDataFrame([(700,)], "id long"), "id")
        return part

    with pytest.raises(RuntimeError):
        table.change("id", spark.createDataFrame([(1,)], "id long"), meanwhile)
    assert table.newest() == 2 and len(rows(table.read())) == 799 and base == 8


def test_all_rows_go(spark, table):
    assert delete(table, table.read().select("id"), "id") == 2
    assert table.read().count() == 0 and table.read().columns == ["id", "name", "amount", "updated_at"]
    assert upsert(table, spark.createDataFrame([(1, "back")], "id long, name string"), "id") == 3
    assert rows(table.read()) == {1: ("back", None, None)} and len(rows(table.read(1))) == 800


def test_create_twice(spark, table):
    with pytest.raises(ValueError):
        table.create(table.read())
