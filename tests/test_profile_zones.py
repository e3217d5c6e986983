import numpy as np
import pandas as pd
import pytest
from conftest import bars_of, walk
from pyspark.sql import functions as F

from barloom.operators import profile as V
from barloom.operators import zones as Z
from barloom.operators.series import number_rows


def test_profile_against_brute_force(spark):
    pdf = walk(700, seed=31)
    numbered = number_rows(bars_of(spark, pdf))
    row = V.profile(V.histogram(numbered, V.last_bar(numbered), lookback=200)).first()
    tail = pdf.tail(200)
    lo, hi = tail["low"].min(), tail["high"].max()
    centres = lo + (np.arange(50) + 0.5) * ((hi - lo) / 50)
    volumes, covering = np.zeros(50), 0.0
    for bar in tail.itertuples():
        inside = (centres >= bar.low) & (centres <= bar.high)
        volumes[inside] += bar.volume / max(inside.sum(), 1)
        covering += bar.volume if inside.any() else 0.0
    assert np.allclose(row["volumes"], volumes)
    assert sum(row["volumes"]) == pytest.approx(covering)
    poc = int(np.argmax(volumes.round(9)))
    low = high = poc
    total = volumes[poc]
    while total < volumes.sum() * 0.7:
        above = volumes[high + 1] if high < 49 else -1
        below = volumes[low - 1] if low > 0 else -1
        if above >= below:
            high, total = high + 1, total + above
        else:
            low, total = low - 1, total + below
    assert (row["poc"], row["vah"], row["val"]) == (
        pytest.approx(centres[poc]), pytest.approx(centres[high]), pytest.approx(centres[low]))


def test_zone_memory_against_brute_force(spark):
    pdf = walk(900, seed=32, tf=3600)
    touched = Z.touches(bars_of(spark, pdf), F.lit(2.0))
    day = 86400
    got = Z.zone_states(touched, max_age=day, block_rows=16, sub_rows=16).toPandas()
    rows = touched.toPandas().sort_values(["bar_start", "turn"])
    memory, want = {}, {}
    for t in rows.itertuples():
        seen = memory.get(t.level_no, [])
        if seen and (t.bar_start - seen[-1][0]).total_seconds() > day:
            seen = []
        seen = (seen + [(t.bar_start, t.wick, t.side)])[-10:]
        memory[t.level_no] = seen
        wicks = [w for _, w, _ in seen]
        growing = len(seen) >= 2 and all(b >= a * 0.9 for a, b in zip(wicks[-4:], wicks[-4:][1:]))
        sellers = sum(s == "SELLER" for _, _, s in seen)
        want[(t.level_no, t.bar_start, t.turn)] = (len(seen), np.mean(wicks), growing, sellers * 2 >= len(seen))
    assert len(got) == len(want) > 100
    for r in got.itertuples():
        count, mean, growing, seller = want[(r.level_no, r.bar_start, r.turn)]
        assert (r.touch_count, r.growing, r.zone_side == "SELLER") == (count, growing, seller)
        assert r.avg_wick == pytest.approx(mean)


def test_zone_score(spark):
    rows = [(1, 0.5, False), (2, 0.5, True), (4, 0.3, True), (11, 0.9, False)]
    df = spark.createDataFrame(rows, "touch_count int, avg_wick double, growing boolean")
    got = [r[0] for r in df.select(Z.score(F.lit(7200))).collect()]
    assert got == pytest.approx([0, 24 + 28 + 24, 36 + 28 + 18, 36 + 8 + 24])


def test_snapshot_drops_idle_zones_and_keeps_the_strongest(spark):
    states = Z.zone_states(Z.touches(bars_of(spark, walk(900, seed=33, tf=3600)), F.lit(2.0)))
    as_of = F.timestamp_seconds(F.lit(1704067200 + 800 * 3600))
    snap = Z.snapshot(states, as_of, capacity=5).toPandas()
    assert len(snap) == 5
    assert (pd.Timestamp(1704067200 + 800 * 3600, unit="s") - snap["bar_start"]).max() <= pd.Timedelta(days=3)
