"""The profile of every bar against a plain loop over its own window, in blocks and at the edges."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from conftest import bars_of, hand_made, walk
from pyspark.sql import functions as F

from barloom.operators import profile as V


def plain(frame: pd.DataFrame, lookback: int) -> dict[int, tuple]:
    out = {}
    for j in range(len(frame)):
        part = frame.iloc[max(0, j - lookback + 1) : j + 1]
        bottom, top = part["low"].min(), part["high"].max()
        if j < 19 or not top > bottom:
            out[j] = None
            continue
        centres = bottom + (np.arange(50) + 0.5) * ((top - bottom) / 50)
        volumes = np.zeros(50)
        for low, high, amount in zip(part["low"], part["high"], part["volume"], strict=True):
            inside = (centres >= low) & (centres <= high)
            volumes[inside] += amount / max(inside.sum(), 1)
        out[j] = (bottom, top, volumes)
    return out


@pytest.mark.parametrize(("lookback", "block"), [(500, 4096), (60, 256)])
def test_every_bar_has_its_own_profile(spark, lookback, block):
    frames = [walk(700, "a", 1), walk(300, "b", 2), walk(5, "c", 3)]
    frames[1].loc[10:20, "volume"] = np.nan
    made = V.histogram_per_bar(bars_of(spark, *frames), lookback, block_rows=block).collect()
    assert len(made) == 1005
    got = {(r.key, r.rn): r for r in made}
    for frame in frames:
        for j, want in plain(frame.fillna({"volume": 1.0}).reset_index(drop=True), lookback).items():
            r = got[frame["key"].iloc[0], j]
            assert r.price == pytest.approx(frame["close"].iloc[j])
            if want is None:
                assert (r.low, r.high, r.volumes) == (None, None, None)
            else:
                assert (r.low, r.high) == want[:2]
                assert np.allclose(r.volumes, want[2], atol=2e-9)


def test_profile_of_flat_and_missing_prices(spark):
    flat = hand_made(spark, [(5, 5, 5, 5)] * 30)
    done = V.classify(V.profile(V.histogram_per_bar(flat)))
    assert {(r.vp_zone, r.vp_at_poc, r.poc) for r in done.collect()} == {("NEUTRAL", False, None)}
    assert V.histogram_per_bar(flat.limit(0)).count() == 0
    # The newest bar of the sliding profile is the snapshot of that bar.
    bars = bars_of(spark, walk(120, "a", 9))
    last = V.histogram(bars, V.last_bar(V.number_rows(bars))).first()
    newest = V.histogram_per_bar(bars).orderBy(F.col("rn").desc()).first()
    assert (last.low, last.high) == (newest.low, newest.high) and np.allclose(last.volumes, newest.volumes)
