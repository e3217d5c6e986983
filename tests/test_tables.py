from conftest import bars_of, walk
from pyspark.sql import functions as F

from barloom.operators.retention import merge_latest, newest_epochs, newest_rows
from barloom.sources.tables import read_bars, trim_bars, upsert_bars, write_bars


def test_upsert_replaces_by_key_and_leaves_other_days(spark, tmp_path):
    path = str(tmp_path / "bars")
    pdf = walk(3000, "a", 1)
    write_bars(bars_of(spark, pdf), path)
    fresh = pdf.iloc[100:110].copy()
    fresh["close"] = -1.0
    extra = walk(5, "new", 2)
    upsert_bars(spark, bars_of(spark, fresh, extra), path)
    got = spark.read.parquet(path)
    assert got.count() == 3005
    assert got.filter("close = -1").count() == 10
    assert got.groupBy("key", "tf_sec", "bar_start").count().filter("count > 1").count() == 0


def test_read_prunes_partitions_and_pushes_the_key(spark, tmp_path):
    path = str(tmp_path / "bars")
    write_bars(bars_of(spark, walk(2000, "a", 1), walk(2000, "b", 2, tf=300)), path)
    df = read_bars(spark, path, ["b"], 300, "2024-01-03").select("close")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tf_sec" in plan and "In(key" in plan or "EqualTo(key,b)" in plan
    assert df.count() == sum(walk(2000, "b", 2, tf=300)["bar_start"] >= "2024-01-03")


def test_trim_keeps_the_newest(spark, tmp_path):
    source, target = str(tmp_path / "bars"), str(tmp_path / "kept")
    pdf = walk(500, "a", 1)
    write_bars(bars_of(spark, pdf, walk(20, "b", 2)), source)
    trim_bars(spark, source, target, keep=60)
    got = spark.read.parquet(target).toPandas()
    assert (got["key"] == "b").sum() == 20
    assert sorted(got[got["key"] == "a"]["bar_start"]) == sorted(pdf["bar_start"].iloc[-60:])


def test_newest_rows_and_epochs(spark):
    bars = bars_of(spark, walk(300, "a", 1), walk(40, "b", 2))
    assert newest_rows(bars, 50).groupBy("key").count().toPandas().set_index("key")["count"].to_dict() == {"a": 50, "b": 40}
    doubled = bars.unionByName(bars)
    assert newest_epochs(doubled, 10).count() == 40


def test_merge_prefers_later_tables(spark):
    a = bars_of(spark, walk(30, "a", 1))
    b = a.withColumn("close", F.lit(0.0)).limit(7)
    merged = merge_latest([a, b])
    assert merged.count() == 30 and merged.filter("close = 0").count() == 7
