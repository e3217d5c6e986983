from __future__ import annotations

import os
import sys
from datetime import datetime, timezone

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from barloom.session import build_session  # noqa: E402

SAMPLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "barloom-tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def samples():
    if not os.path.isdir(SAMPLES):
        pytest.skip("sample tables are not here")
    return SAMPLES


def at(seconds: int) -> datetime:
    return datetime.fromtimestamp(seconds, timezone.utc)


def walk(n: int, key: str = "a", seed: int = 1, tf: int = 60, gaps: bool = True, volume: bool = True) -> pd.DataFrame:
    """Random-walk bars; with `gaps`, about one interval in eight is missing."""
    rng = np.random.default_rng(seed)
    close = 100 + np.cumsum(rng.normal(0, 1, n))
    open_ = close + rng.normal(0, 0.8, n)
    high = np.maximum(open_, close) + rng.exponential(0.5, n)
    low = np.minimum(open_, close) - rng.exponential(0.5, n)
    slots = np.flatnonzero(rng.random(2 * n) > 0.125)[:n] if gaps else np.arange(n)
    df = pd.DataFrame(
        {
            "key": key,
            "tf_sec": np.int32(tf),
            "bar_start": pd.to_datetime(1704067200 + slots * tf, unit="s"),
            "open": open_,
            "high": high,
            "low": low,
            "close": close,
            "n_ticks": rng.integers(1, 20, n),
        }
    )
    if volume:
        df["volume"] = rng.integers(1, 1000, n).astype(float)
    return df


def bars_of(spark, *frames: pd.DataFrame):
    return spark.createDataFrame(pd.concat(frames, ignore_index=True))


def hand_made(spark, rows, key: str = "a", tf: int = 60):
    """Bars from (open, high, low, close) tuples, one per minute."""
    data = [
        (key, tf, at(1704067200 + i * tf), *map(float, row), 1) for i, row in enumerate(rows)
    ]
    schema = "key string, tf_sec int, bar_start timestamp, open double, high double, low double, close double, n_ticks bigint"
    return spark.createDataFrame(data, schema)
