"""A series with more levels than its zone memory holds, against a plain loop."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from conftest import at
from pyspark.sql import functions as F

from barloom.operators import zones as Z

SCHEMA = "key string, tf_sec int, bar_start timestamp, side string, turn int, wick double, price double, level_no bigint, level double, volume double"


def rows(n, levels, seed, key="a", step=60):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        for turn, side in enumerate(("SELLER", "BUYER")):
            if rng.random() < 0.7:
                level = int(rng.integers(levels))
                out.append((key, 60, at(1704067200 + step * i), side, turn, float(np.round(rng.uniform(0.25, 0.9), 6)), 1.0, level, float(level), 1.0))
    return out


class Zone:
    def __init__(self):
        self.touches, self.updated = [], 0

    def score(self, now):
        wicks = [w for w, _ in self.touches]
        if len(wicks) < 2:
            return 0.0
        last = pd.Series(wicks[-4:])
        growing = bool((last.diff().dropna() >= -0.1 * last.shift().dropna() - 1e-15).all())
        return round(min(100.0, min(36, 12 * len(wicks)) + (28 if growing else 8) + min(24.0, 60 * np.mean(wicks)) + (12 if now - self.updated < 3600 else 0)), 9)


def loop(data, capacity):
    zones, out = {}, []
    for key, _, start, side, turn, wick, _, level, _, _ in data:
        now = int(start.timestamp())
        zones = {k: z for k, z in zones.items() if now - z.updated <= Z.MAX_AGE}
        gone = None
        if level not in zones:
            if len(zones) >= capacity:
                gone = min(zones, key=lambda k: zones[k].score(now))
                del zones[gone]
            zones[level] = Zone()
        z = zones[level]
        z.touches, z.updated = (z.touches + [(wick, side)])[-10:], now
        out.append((key, now, turn, level, len(z.touches), round(float(np.mean([w for w, _ in z.touches])), 9), len(zones), gone))
    return out


@pytest.mark.parametrize(("n", "levels", "capacity", "step"), [(900, 320, Z.CAPACITY, 60), (300, 30, 8, 3600), (80, 10, 1, 60)])
def test_memory_equals_loop(spark, n, levels, capacity, step):
    data = {k: rows(n, levels, s, k, step) for k, s in (("a", 1), ("b", 2))}
    df = spark.createDataFrame([r for part in data.values() for r in part], SCHEMA).orderBy(F.rand(3)).repartition(3)
    got = sorted((r.key, int(r.bar_start.timestamp()), r.turn, r.level_no, r.touch_count, round(r.avg_wick, 9), r.n_zones, r.evicted) for r in Z.zone_memory(df, capacity).collect())
    want = sorted(r for part in data.values() for r in loop(part, capacity))
    assert got == want
    assert sum(r[-1] is not None for r in want) > 50 and max(r[-2] for r in want) == capacity
    assert Z.zone_memory(df.limit(0)).count() == 0


def test_memory_with_room_is_the_unlimited_one(spark):
    df = spark.createDataFrame(rows(200, 12, 5), SCHEMA)
    columns = ["key", "level_no", "bar_start", "turn", "touch_count", "growing", "zone_side"]
    one, two = Z.zone_memory(df).select(*columns), Z.zone_states(df).select(*columns)
    assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0
