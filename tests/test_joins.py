import numpy as np
import pandas as pd
from conftest import bars_of, walk
from pyspark.sql import functions as F

from barloom.operators.bars import roll_up
from barloom.operators.joins import asof_join, near_events, trailing_range


def events(seed, n=200, keys=("a", "b")):
    rng = np.random.default_rng(seed)
    return pd.DataFrame(
        {
            "key": rng.choice(keys, n),
            "ts": pd.to_datetime(1704067200 + rng.integers(0, 30000, n), unit="s"),
            "seq": np.arange(n),
            "value": rng.random(n),
        }
    )


def test_asof_matches_merge_asof(spark):
    left = pd.concat([walk(200, "a", 1), walk(150, "b", 2)])
    right = events(3)
    got = asof_join(
        spark.createDataFrame(left), spark.createDataFrame(right), ["key"], "bar_start", "ts", 3600, tie="seq"
    )
    got = got.select("key", "bar_start", "match.value").toPandas().sort_values(["bar_start", "key"])
    want = pd.merge_asof(
        left.sort_values(["bar_start", "key"]), right.sort_values(["ts", "seq"]), left_on="bar_start", right_on="ts", by="key"
    )
    assert np.allclose(got["value"], want["value"], equal_nan=True)


def test_split_gives_the_newest_of_each_kind(spark):
    left, right = walk(120, "a", 1), events(4, 80, ("a",))
    split = {"small": F.col("value") < 0.5, "large": F.col("value") >= 0.5}
    got = asof_join(
        spark.createDataFrame(left), spark.createDataFrame(right), ["key"], "bar_start", "ts", 3600, split=split, tie="seq"
    ).toPandas()
    for row in got.itertuples():
        seen = right[right["ts"] <= row.bar_start].sort_values(["ts", "seq"])
        for name, rows in (("small", seen[seen["value"] < 0.5]), ("large", seen[seen["value"] >= 0.5])):
            match = getattr(row, name)
            assert (match is None) == rows.empty
            if match is not None:
                assert match["value"] == rows["value"].iloc[-1]


def test_near_events_against_brute_force(spark):
    left, right = walk(300, "a", 5), events(6, 12, ("a",))
    bars, news = spark.createDataFrame(left), spark.createDataFrame(right)
    gap = np.abs((left["bar_start"].to_numpy()[:, None] - right["ts"].to_numpy()[None, :]) / np.timedelta64(1, "s"))
    near = (gap <= 300).any(axis=1)
    assert near_events(bars, news, ["key"], "bar_start", "ts", 300).count() == near.sum()
    assert near_events(bars, news, ["key"], "bar_start", "ts", 300, "left_anti").count() == (~near).sum()


def test_trailing_range_against_brute_force(spark):
    left, right = walk(200, "a", 7), events(8, 150, ("a",))
    got = trailing_range(
        spark.createDataFrame(left), spark.createDataFrame(right), ["key"], "bar_start", "ts", 600,
        {"n": F.count("value"), "top": F.max("value")}, block_seconds=1800,
    ).toPandas().sort_values("bar_start")
    for row in got.itertuples():
        age = (row.bar_start - right["ts"]).dt.total_seconds()
        inside = right[(age >= 0) & (age <= 600)]
        assert row.n == len(inside)
        assert row.n == 0 or row.top == inside["value"].max()


def test_roll_up_is_associative(spark):
    bars = bars_of(spark, walk(600, "a", 9), walk(200, "b", 10))
    columns = ["key", "bar_start", "open", "high", "low", "close", "volume", "n_ticks"]
    direct = roll_up(bars, (15,)).select(*columns)
    stepped = roll_up(roll_up(bars, (5,)), (3,)).select(*columns)
    assert direct.exceptAll(stepped).count() == 0 and stepped.exceptAll(direct).count() == 0
