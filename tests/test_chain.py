"""The chain of signals against its recursive SQL, on dense series that reach every gate."""

from __future__ import annotations

from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import chain as H
from barloom.plans.chain_queries import chain_sql


def dense(n: int = 420, seed: int = 3, tf: int = 3600, keys: str = "abc") -> pd.DataFrame:
    """Confident signals on most bars, votes of every kind, gaps, news and flat bars."""
    rng = np.random.default_rng(seed)
    frames = []
    for k, key in enumerate(keys):
        at = 1704067200 + tf * np.flatnonzero(rng.random(2 * n) > 0.05)[:n]
        move = np.where(rng.random(n) < 0.05, 0.0, rng.normal(0, 1, n))
        side = np.where(rng.random(n) < 0.5, 1, -1)
        if k < 2:  # signals of these series are right in five or six of ten cases
            right = rng.random(n) < (0.62, 0.52)[k]
            ahead = np.append(np.sign(move[1:]), 1)
            side = np.where(ahead == 0, side, np.where(right, ahead, -ahead)).astype(int)
        frames.append(pd.DataFrame({
            "key": key, "tf": tf, "bar_at": at, "rn": np.arange(n) + 140, "side": side, "confidence": rng.uniform(0.55, 0.99, n), "adx": rng.uniform(10, 40, n),
            "est": rng.uniform(10, 40, n), "in_news": rng.random(n) < 0.03, "agreement": rng.random(n), "net": rng.uniform(-80, 80, n), "close": 100 + np.cumsum(move),
            "v": [np.where(rng.random(8) < 0.2, 0, np.where(rng.random(8) < 0.8, s, -s)).tolist() for s in side],
            "bal": [rng.uniform(0.4, 1.2, 8).tolist() for _ in range(n)],
        }))
    return pd.concat(frames, ignore_index=True)


def in_spark(spark, table: pd.DataFrame):
    df = spark.createDataFrame(table)
    return df.select(
        "key", F.col("tf").alias("tf_sec"), F.timestamp_seconds("bar_at").alias("bar_start"), "rn", F.when(F.col("side") == 1, "GREEN").otherwise("RED").alias("direction"), "confidence", "adx",
        F.col("est").alias("range_index"), "in_news", "agreement", "net", "close", F.col("v").alias("votes"), F.col("bal").alias("ballots"), F.lit(1).alias("extra"),
    )


def walked(table: pd.DataFrame) -> list[tuple]:
    with duckdb.connect() as con:
        con.register("source_rows", table)
        sql = "WITH RECURSIVE x AS (SELECT 1)" + chain_sql("source_rows")
        return con.execute(sql + " SELECT key, bar_at, settled, streak, factor, threshold, reason, final, fconf, score FROM chain WHERE n > 0").fetchall()


def close_enough(x):
    return round(x, 9) + 0.0 if isinstance(x, float) else x


def as_rows(done) -> Counter:
    side = F.when(F.col("final_direction") == "GREEN", 1).when(F.col("final_direction") == "RED", -1)
    got = done.select("key", F.unix_timestamp("bar_start"), "settled", "streak", "multiplier", "threshold", "block_reason", side, "final_confidence", "score")
    return Counter(tuple(map(close_enough, r)) for r in got.collect())


@pytest.mark.parametrize(("seed", "tf"), [(3, 3600), (4, 300)])
def test_chain_equals_recursion(spark, seed, tf):
    table = dense(seed=seed, tf=tf)
    # A streak of five stops a series until a win, so the SQL and the chain must stop it at the same bar.
    want = Counter(tuple(map(close_enough, r)) for r in walked(table))
    got = as_rows(H.signal_chain(in_spark(spark, table).repartition(4)))
    assert got == want
    reasons = {r[6] for r in want}
    assert {"min_history", "news", "low_score", "below_threshold", "agents_below_threshold", "window_full", "circuit_breaker", None} <= reasons
    assert {"WIN", "LOSS", "EXPIRED"} <= {r[2] for r in want}
    assert len({r[5] for r in want}) > 3


def test_hours_that_lose_are_weighed_down():
    state = H.Series()
    hour = 1704067200 + 5 * 3600
    for day in range(9):
        state.outcomes.extend([(hour + day * 86400 + 7200, 5, 1, day == 0)] * 2)
    state.diagnose(hour + 9 * 86400)
    # One bad hour, and one band whose signals lost: the step, then the scale on what is listed.
    assert state.multiplier == {5: 0.96 * 0.97}
    state.diagnose(hour + 9 * 86400 + 60)
    assert state.multiplier == {5: 0.96 * 0.97}
    state.diagnose(hour + 40 * 86400)
    assert not state.outcomes


def test_no_row_depends_on_its_own_outcome(spark):
    """Later closes change later rows only."""
    table = dense(200, seed=8, keys="a")
    changed = table.copy()
    changed.loc[150:, "close"] = 200 - changed.loc[150:, "close"]
    a, b = (sorted(as_rows(H.signal_chain(in_spark(spark, t))).elements(), key=lambda r: r[1]) for t in (table, changed))
    assert a[:150] == b[:150] and a[150:] != b[150:]


def test_chain_edges(spark):
    table = dense(30, keys="a")
    assert H.signal_chain(in_spark(spark, table).limit(0)).count() == 0
    table["rn"] = np.arange(30) + 200
    table.loc[:, ["confidence", "in_news"]] = [0.9, False]
    rows = in_spark(spark, table).withColumn("adx", F.lit(None).cast("double"))
    done = H.signal_chain(rows)
    known = H.outcomes(done)
    assert known.count() == done.filter(H.sent(done)).count()
    starts = set(table["bar_at"])
    by_start = {int(r.at): r.outcome for r in known.select(F.unix_timestamp("bar_start").alias("at"), "outcome").collect()}
    assert all((out is None) == (at + 3600 not in starts) for at, out in by_start.items())
