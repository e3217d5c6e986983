"""Stateful stream operators against their batch counterparts, in any order of arrival within the lateness."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import at
from pyspark.sql import functions as F
from test_streaming import drain, stream_of

from barloom.operators.bars import flag_late_ticks, tick_stats
from barloom.operators.joins import asof_join
from barloom.operators.signals import window_selection
from barloom.streaming import state as S

START = 1704067200
LEFT = "key string, ts timestamp, no int, price double"
RIGHT = "key string, seen_at timestamp, seq bigint, mood double"


@pytest.mark.parametrize("max_age", [None, 200])
def test_asof_of_two_streams_equals_batch(spark, tmp_path, max_age):
    rng = np.random.default_rng(4)
    left = [("ab"[i % 2], at(START + 30 * i), i, float(i)) for i in range(200)]
    right = [("ab"[int(rng.integers(2))], at(START + int(t)), i, float(rng.random())) for i, t in enumerate(np.sort(rng.integers(600, 6000, 90)))]
    right += [("a", right[10][1], 900, 0.5), ("c", at(START), 901, 0.1)]
    want = asof_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["key"], "ts", "seen_at", 86400, name="match", tie="seq")
    if max_age:
        old = F.unix_timestamp("ts") - F.unix_timestamp("match.seen_at") > max_age
        want = want.withColumn("match", F.when(~old, F.col("match")))
    want = sorted((r.key, r.no, r.price, r.match and r.match.mood) for r in want.collect())
    shake = lambda rows, reach: [r for _, r in sorted(enumerate(rows), key=lambda e: e[0] + rng.uniform(0, reach))]
    # Ticks far ahead on both sides push the watermark past the rest.
    end = [("z", at(START + 90000), 0, 0.0)]
    streams = stream_of(spark, shake(left, 12) + end, LEFT, str(tmp_path / "l"), 6), stream_of(spark, shake(right, 6) + [("z", at(START + 90000), 1, 0.0)], RIGHT, str(tmp_path / "r"), 5)
    joined = S.asof_stream(*streams, ["key"], "ts", "seen_at", "1 hour", max_age, tie="seq")
    assert joined.columns == ["key", "ts", "no", "price", "match"]
    got = drain(joined, f"asof_{max_age}").filter("key <> 'z'").collect()
    assert sorted((r.key, r.no, r.price, r.match and r.match.mood) for r in got) == want
    assert all(r.ts == left[r.no][1].replace(tzinfo=None) or int(r.ts.timestamp()) == int(left[r.no][1].timestamp()) for r in got)
    assert any(r[3] is None for r in want) and any(r[3] is not None for r in want)


def test_replayed_changes_of_a_window(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [("ab"[i % 2], 60, at(START + 60 * (i // 2)), f"s{i}", float(rng.uniform(0.55, 0.95)), float(rng.integers(0, 12))) for i in range(240)]
    schema = "key string, tf_sec int, bar_start timestamp, signal_id string, confidence double, score double"
    batch = window_selection(spark.createDataFrame(rows, schema))
    stream = stream_of(spark, rows, schema, str(tmp_path / "in"), files=7)
    changes = drain(S.window_top(stream, 60), "tops")
    kept = {(r.key, r.window_no, r.signal_id) for r in S.retained(changes).collect()}
    assert kept == {(r.key, r.window_no, r.signal_id) for r in batch.filter("retained").collect()}
    added = {r.signal_id for r in changes.filter("action = 'add'").collect()}
    assert added == {r.signal_id for r in batch.filter("accepted").collect()}
    assert changes.filter("action = 'remove'").count() > 10


def test_audit_of_a_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [("ab"[i % 2], at(START + 7 * i - int(rng.choice([0, 0, 0, 20, 130]))), i, float(i)) for i in range(400)]
    schema = "key string, ts timestamp, seq bigint, price double"
    want = flag_late_ticks(spark.createDataFrame(rows, schema))
    stream = stream_of(spark, rows, schema, str(tmp_path / "in"), files=6)
    audited = S.audited_ticks(stream)
    query = audited.writeStream.format("memory").queryName("audit").trigger(availableNow=True).start()
    assert query.awaitTermination(180)
    got = spark.table("audit").select(*want.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert tick_stats(got).exceptAll(tick_stats(want)).count() == 0
    counts = [p["observedMetrics"]["ticks"] for p in query.recentProgress if p["observedMetrics"]]
    dropped = want.filter("dropped").count()
    assert sum(int(c["dropped"]) for c in counts) == dropped > 20
    assert sum(int(c["received"]) for c in counts) == 400 - dropped
