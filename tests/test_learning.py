import numpy as np
import pytest
from conftest import at, hand_made
from pyspark.sql import functions as F

from barloom.operators import learning as L
from barloom.operators import signals as X
from barloom.operators import voting as G


def outcomes(spark, results, key="a", confidence=0.7):
    rows = [
        (key, 60, at(1704067200 + i * 60), f"{key}_{i}", "GREEN", confidence, 3, 20.0, r,
         at(1704067200 + i * 60 + 120))
        for i, r in enumerate(results)
    ]
    return spark.createDataFrame(
        rows,
        "key string, tf_sec int, bar_start timestamp, signal_id string, direction string, confidence double, "
        "utc_hour int, adx double, outcome string, settled_at timestamp",
    )


def walked(results):
    threshold, wins, n, out = 0.62, 0, 0, []
    for r in results:
        n += 1
        wins += r == "WIN"
        if n >= 8:
            if wins / n < 0.62:
                threshold = min(threshold + 0.03, 0.85)
            elif wins / n > 0.67:
                threshold = max(threshold - 0.01, 0.62)
        out.append(threshold)
    return out


@pytest.mark.parametrize("seed,rate", [(1, 0.3), (2, 0.65), (3, 0.9)])
def test_threshold_walk_over_chunks(spark, seed, rate):
    rng = np.random.default_rng(seed)
    results = ["WIN" if x < rate else "LOSS" for x in rng.random(150)]
    results[60:110] = ["LOSS"] * 50  # drives the walk into its cap, then back
    history = L.adaptive_threshold(L.threshold_buckets(outcomes(spark, results)), chunk=4)
    got = [r["threshold"] for r in history.orderBy("bar_start").collect()]
    assert np.allclose(got, walked(results))
    assert max(got) <= 0.85 and min(got) >= 0.62


def test_streak_ignores_expired(spark):
    results = ["LOSS", "LOSS", "EXPIRED", "LOSS", "WIN", "LOSS", "EXPIRED", None, "LOSS"]
    got = X.loss_streak(outcomes(spark, results), block_seconds=120).orderBy("bar_start")
    assert [r["streak"] for r in got.collect()] == [1, 2, 2, 3, 0, 1, 1, 1, 2]


def test_settlement_and_ties(spark):
    bars = hand_made(spark, [(10, 11, 9, 10), (10, 11, 9, 10), (10, 12, 9, 11), (11, 12, 9, 10)])
    signals = bars.select("key", "tf_sec", "bar_start", F.lit("GREEN").alias("direction"))
    got = [r["outcome"] for r in X.settle(signals, bars).orderBy("bar_start").collect()]
    assert got == ["EXPIRED", "WIN", "LOSS", None]


def test_window_keeps_three_and_replaces_online(spark):
    scores = [5.0, 7.0, 6.0, 6.0, 9.0]
    rows = [("a", 60, at(1704067200 + i * 60), 0.7, s) for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "key string, tf_sec int, bar_start timestamp, confidence double, score double")
    got = X.window_selection(df).orderBy("bar_start").collect()
    kept, accepted = [], []
    for i, s in enumerate(scores):
        if len(kept) < 3:
            kept.append((s, i))
            accepted.append(True)
            continue
        worst = min(range(3), key=lambda j: kept[j][0])
        accepted.append(s > kept[worst][0])
        if accepted[-1]:
            kept[worst] = (s, i)
    assert [r["accepted"] for r in got] == accepted
    assert [i for i, r in enumerate(got) if r["retained"]] == sorted(i for _, i in kept)


def test_agent_weight_uses_last_thirty(spark):
    rng = np.random.default_rng(5)
    right = rng.random(80) < 0.6
    rows = [("a", "x", at(1704067200 + i * 60), bool(c)) for i, c in enumerate(right)]
    credits = spark.createDataFrame(rows, "key string, agent string, bar_start timestamp, correct boolean")
    got = [r["weight"] for r in L.agent_performance(credits, block_seconds=600).orderBy("bar_start").collect()]
    for i, weight in enumerate(got):
        recent = right[max(0, i - 29) : i + 1]
        assert weight == pytest.approx(1.0 if i < 4 else np.clip(1 + 4 * (recent.mean() - 0.5), 0.2, 2.0))


def test_multipliers_start_at_one_and_stop_at_the_floor(spark):
    current = spark.createDataFrame([("a", 3, 0.72), ("a", 4, 0.9)], "key string, utc_hour int, multiplier double")
    hours = spark.createDataFrame([("a", 3), ("a", 5)], "key string, utc_hour int")
    bands = spark.createDataFrame([("a", "80-89")], "key string, band string")
    got = {r["utc_hour"]: r["multiplier"] for r in L.updated_multipliers(current, hours, bands).collect()}
    assert got == {3: pytest.approx(0.70), 4: pytest.approx(0.9 * 0.97), 5: pytest.approx(0.96 * 0.97)}


def test_samples_of_a_bar(spark):
    rows = [("a", at(0), i, "GREEN" if i < 14 else "RED", 0.5 + i / 100) for i in range(20)]
    samples = spark.createDataFrame(rows, "key string, bar_start timestamp, sample_no int, direction string, confidence double")
    got = G.aggregate_samples(samples).first()
    late, early = np.mean([0.5 + i / 100 for i in range(15, 20)]), np.mean([0.5 + i / 100 for i in range(15)])
    assert got["direction"] == "GREEN"
    assert got["confidence"] == pytest.approx((late * 0.6 + early * 0.4) * (0.6 + 0.4 * 0.7))
