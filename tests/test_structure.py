import pytest
from conftest import bars_of, hand_made, walk
from pyspark.sql import functions as F

from barloom.operators import patterns as P
from barloom.operators import structure as M
from barloom.operators.series import frame

FLAT = (10, 10.6, 9.4, 10)


def last(spark, rows, family, **kw):
    f = frame(hand_made(spark, rows), back=600).then(*(family if isinstance(family, tuple) else (family,)))
    return f.core().orderBy(F.col("bar_start").desc()).first().asDict()


CANDLES = {
    "hammer": [FLAT, FLAT, (10.0, 10.25, 8.0, 10.2)],
    "inverted_hammer": [FLAT, (11, 11.1, 9.9, 10), (10.0, 12.0, 9.95, 10.2)],
    "bullish_engulfing": [FLAT, (10.5, 10.6, 9.9, 10), (9.9, 11.1, 9.8, 11)],
    "bullish_harami": [FLAT, (12, 12.1, 9.9, 10), (10.5, 11.2, 10.4, 11)],
    "morning_star": [(12, 12.1, 9.9, 10), (9.8, 10.2, 9.6, 9.85), (10, 12.2, 9.9, 12)],
    "dragonfly_doji": [FLAT, FLAT, (10, 10.1, 8, 10.05)],
    "tweezer_bottom": [FLAT, (10.5, 10.6, 9.0, 10), (10, 10.9, 9.0, 10.8)],
    "three_white_soldiers": [(10, 11.1, 9.9, 11), (11, 12.1, 10.9, 12), (12, 13.1, 11.9, 13)],
    "marubozu_bull": [FLAT, FLAT, (10, 12, 10, 12)],
    "shooting_star": [FLAT, FLAT, (10.2, 12, 9.95, 10.0)],
    "hanging_man": [FLAT, FLAT, (10.2, 10.25, 8, 10.0)],
    "bearish_engulfing": [FLAT, (10, 10.6, 9.9, 10.5), (10.6, 10.7, 9.3, 9.4)],
    "bearish_harami": [FLAT, (10, 12.1, 9.9, 12), (11, 11.6, 10.4, 10.5)],
    "evening_star": [(10, 12.1, 9.9, 12), (12.1, 12.4, 11.9, 12.15), (12, 12.1, 9.9, 10)],
    "gravestone_doji": [FLAT, FLAT, (10, 12, 9.95, 10.05)],
    "tweezer_top": [FLAT, (10, 11.0, 9.9, 10.5), (10.5, 11.0, 9.4, 9.6)],
    "three_black_crows": [(13, 13.1, 11.9, 12), (12, 12.1, 10.9, 11), (11, 11.1, 9.9, 10)],
    "marubozu_bear": [FLAT, FLAT, (12, 12, 10, 10)],
}


@pytest.mark.parametrize("name", CANDLES)
def test_candlestick(spark, name):
    assert set(CANDLES) == set(P.CANDLESTICKS)
    assert last(spark, CANDLES[name], P.candlesticks)[name] == 1


def test_no_pattern_before_three_bars(spark):
    row = last(spark, [FLAT, (10, 12, 10, 12)], P.candlesticks)
    assert all(row[name] == 0 for name in P.CANDLESTICKS)


def test_gap_of_three_bars(spark):
    rows = [FLAT] * 17 + [(10, 10.5, 9.5, 10.4), (10.4, 12.4, 10.3, 12.3), (12.3, 13, 11, 12.5), (12.5, 12.6, 10.6, 10.8)]
    row = last(spark, rows, M.fair_value_gaps)
    assert (row["bullish_fvg"], row["price_in_bullish_fvg"], row["bearish_fvg"]) == (1, 1, 0)
    assert row["fvg_50_level"] == pytest.approx((10.5 + 11) / 2)


def test_swing_counts_only_once_confirmed_and_allows_ties(spark):
    rows = [FLAT] * 6 + [(10, 15, 9.5, 10)] + [FLAT] * 3 + [(10, 15, 9.5, 10)] + [FLAT] * 6
    f = frame(hand_made(spark, rows), back=600).then(M.swings)
    seen = [r["swing_high_at"] for r in f.core().orderBy("bar_start").collect()]
    assert seen[10] is None and seen[11] == 15 and seen[15] == 15


def test_order_block_waits_and_holds_three(spark):
    rows = [FLAT] * 55 + [(10.5, 10.6, 9.4, 9.6), (9.6, 11.5, 9.5, 11.4), (11.4, 11.5, 10, 10.1), (10.1, 10.3, 9.8, 10.0)]
    f = frame(hand_made(spark, rows), back=600).then(M.order_blocks)
    flags = [r["price_at_bullish_ob"] for r in f.core().orderBy("bar_start").collect()]
    assert flags[-2] == 0 and flags[-1] == 1


def test_break_of_structure(spark):
    peak = (10, 12, 9.5, 10)
    rows = [FLAT] * 6 + [peak] + [FLAT] * 6 + [(10, 13, 9.5, 10)] + [FLAT] * 6 + [(10, 14, 9.9, 13.9), (13.9, 14, 13, 13.5)]
    row = last(spark, rows, M.STRUCTURE)
    assert (row["bullish_bos"], row["bearish_bos"]) == (1, 0)


def test_round_number(spark):
    row = last(spark, [(99, 101, 98, 100.2)] * 20, M.STRUCTURE)
    assert (row["round_number_near"], row["round_number_level"]) == (1, 100.0)


def test_double_top(spark):
    high, low = (10, 14, 9.5, 10), (6, 6.5, 5.5, 6)
    rows = [FLAT] * 10 + [high] + [FLAT] * 4 + [high] + [FLAT] * 3 + [low]
    assert last(spark, rows, P.chart_patterns)["chart_double_top"] == 1


def test_momentum_run_stops_at_other_colour(spark):
    up, down = (10, 10.6, 9.9, 10.5), (10.5, 10.6, 9.9, 10)
    row = last(spark, [FLAT] * 17 + [down, up, up, up], M.STRUCTURE)
    assert (row["momentum_bull_count"], row["momentum_bear_count"]) == (3, 0)


def test_sweep_uses_the_bars_before_the_tested_one(spark):
    flat = (10, 11, 9, 10)
    row = last(spark, [flat] * 22 + [(10, 11.5, 9.5, 10), flat], M.STRUCTURE)
    assert (row["bsl_swept"], row["liq_sweep_bear"], row["ssl_swept"]) == (1, 1, 0)


def test_later_bars_change_nothing(spark):
    pdf = walk(420, seed=21)
    families = (*M.STRUCTURE, (P.wyckoff, P.elliott, P.supply_demand, P.harmonics), P.candle_reaction)
    columns = [*M.FLAGS, *M.LEVELS, *P.WYCKOFF, *P.ELLIOTT, *P.SUPPLY_DEMAND, *P.HARMONIC_NAMES, *P.REACTION]

    def values(n):
        rows = frame(bars_of(spark, pdf.iloc[:n]), back=600).then(*families).core("bar_start", *columns)
        return rows.toPandas().sort_values("bar_start").reset_index(drop=True)

    short, long = values(300), values(420)
    assert short.equals(long.iloc[:300])


def test_structure_does_not_depend_on_block_size(spark):
    bars = bars_of(spark, walk(1500, seed=22))

    def values(**blocks):
        f = frame(bars, back=M.LOOKBACK + 16, **blocks).then(*M.STRUCTURE, (P.elliott, P.harmonics))
        rows = f.core("bar_start", *M.FLAGS, *M.LEVELS, "smc_net_score", *P.ELLIOTT, *P.HARMONIC_NAMES)
        return rows.toPandas().sort_values("bar_start").reset_index(drop=True)

    assert values().equals(values(block_rows=128, sub_rows=32))
