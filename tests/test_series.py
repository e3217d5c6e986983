import numpy as np
import pandas as pd
import pytest
from conftest import bars_of, walk
from pyspark.sql import functions as F

from barloom.operators.indicators import features
from barloom.operators.scan import Ema, PriceFilter, chained_ema
from barloom.operators.series import bar_block, frame, number_rows, prefix_scan

SMALL = {"block_rows": 64, "sub_rows": 16}


def ordered(df):
    return df.toPandas().sort_values(["key", "tf_sec", "bar_start"]).reset_index(drop=True)


def test_prefix_scan_matches_cumulative(spark):
    pdf = pd.concat([walk(300, "a", 1), walk(170, "b", 2)])
    df = prefix_scan(
        bars_of(spark, pdf),
        ["key", "tf_sec"],
        bar_block(32),
        ["bar_start"],
        {
            "total": ("sum", F.col("volume")),
            "n": ("count", F.lit(1)),
            "top": ("max", F.col("high")),
            "bottom": ("min", F.col("low")),
            "start": ("first", F.when(F.col("close") > F.col("open"), F.col("close"))),
            "latest": ("last", F.when(F.col("close") > F.col("open"), F.col("close"))),
        },
    )
    got = ordered(df)
    pdf = pdf.sort_values(["key", "bar_start"]).reset_index(drop=True)
    groups = pdf.groupby("key")
    assert np.allclose(got["total"], groups["volume"].cumsum())
    assert (got["n"] == groups.cumcount() + 1).all()
    assert np.allclose(got["top"], groups["high"].cummax())
    assert np.allclose(got["bottom"], groups["low"].cummin())
    green = pdf["close"].where(pdf["close"] > pdf["open"])
    assert np.allclose(got["latest"], green.groupby(pdf["key"]).ffill(), equal_nan=True)
    first = green.groupby(pdf["key"]).transform(lambda s: s.expanding().apply(lambda x: x[~np.isnan(x)][0] if (~np.isnan(x)).any() else np.nan, raw=True))
    assert np.allclose(got["start"], first, equal_nan=True)


def test_exclusive_scan_leaves_the_row_out(spark):
    df = prefix_scan(
        bars_of(spark, walk(50)), ["key"], bar_block(8), ["bar_start"], {"n": ("count", F.lit(1))}, inclusive=False
    )
    assert sorted(r["n"] for r in df.collect()) == list(range(50))


def test_positions_are_exact_with_gaps(spark):
    got = ordered(number_rows(bars_of(spark, walk(400, "a", 1), walk(90, "b", 2)), block=bar_block(16)))
    assert (got["rn"] == got.groupby("key").cumcount()).all()


@pytest.mark.parametrize("span", [5, 20, 200])
def test_ema_over_blocks(spark, span):
    pdf = walk(3000, seed=3)
    got = ordered(frame(bars_of(spark, pdf), back=1, scans=[Ema("e", span)], block_rows=256, sub_rows=64).core())
    want = pdf["close"].ewm(span=span, adjust=False).mean()
    assert np.allclose(got["e"], want, rtol=1e-11, atol=0)


def test_price_filter_over_blocks(spark):
    pdf = walk(2500, seed=4)
    q, r, p, x, want = 1e-5, 1e-2, 1.0, None, []
    for price in pdf["close"]:
        if x is None:
            x = price
        else:
            k = (p + q) / (p + q + r)
            x, p = x + k * (price - x), (1 - k) * (p + q)
        want.append(x)
    got = ordered(frame(bars_of(spark, pdf), back=1, scans=[PriceFilter()], block_rows=128, sub_rows=32).core())
    assert np.allclose(got["kalman_price"], want, rtol=1e-11)


def test_chained_average_equals_average_of_average(spark):
    pdf = walk(800, seed=5)
    f = frame(bars_of(spark, pdf), back=1, scans=[Ema("i", 12), Ema("o", 9)], **SMALL)
    got = ordered(f.with_columns({"c": chained_ema(F.col("i"), 12, F.col("o"), 9)}).core())
    want = pdf["close"].ewm(span=12, adjust=False).mean().ewm(span=9, adjust=False).mean()
    assert np.allclose(got["c"], want, rtol=1e-9)


def test_features_do_not_depend_on_block_size(spark):
    bars = bars_of(spark, walk(900, "a", 6), walk(140, "b", 7))
    one, many = ordered(features(bars)), ordered(features(bars, **SMALL))
    for name in one.columns.drop(["key", "bar_start"]):
        assert np.allclose(one[name].astype(float), many[name].astype(float), rtol=1e-8, atol=1e-8), name


def test_every_bar_comes_back_once(spark):
    bars = bars_of(spark, walk(333, "a", 6), walk(64, "b", 7))
    assert frame(bars, back=200, ahead=40, **SMALL).core().count() == 397


def test_features_do_not_depend_on_other_keys(spark):
    alone = ordered(features(bars_of(spark, walk(200, "a", 8))))
    both = ordered(features(bars_of(spark, walk(200, "a", 8), walk(500, "b", 9))))
    pd.testing.assert_frame_equal(alone, both[both["key"] == "a"].reset_index(drop=True), rtol=1e-9)
