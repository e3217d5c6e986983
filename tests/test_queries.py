"""Registered queries against their SQL in DuckDB on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from barloom.plans import all_oracles, all_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
QUICK = (
    "ohlc_hourly ohlc_gap_fill bars_rollup_ladder late_tick_audit live_bar_updates macd obv_vwap_vsa smc_scores "
    "advanced_patterns candle_reaction volume_profile value_area_daily best_zone synthetic_sentiment mood_asof "
    "mtf_agreement news_block_anti price_filter rule_engine window_top3 settle_signals loss_streak adaptive_threshold "
    "agent_weights hour_multipliers ts_cv_folds history_rows rules_fired marker_dedupe feed_silence feed_trailing_silence "
    "series_model_folds series_model_walk_forward series_model_status series_calibration signal_chain profile_per_bar "
    "threshold_asof rejection_zone_memory news_windows_by_symbol bar_retention_1500 bars_upsert"
).split()
NAMES = sorted(all_oracles()) if os.environ.get("BARLOOM_ALL_QUERIES") else QUICK


def values(df: pd.DataFrame):
    df = df.reindex(sorted(df.columns), axis=1)
    empty = lambda x: x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x))
    return sorted(
        tuple("" if empty(x) else repr(float(x)) if isinstance(x, float) else str(x) for x in row)
        for row in df.itertuples(index=False, name=None)
    )


@pytest.fixture(scope="module")
def duck(samples):
    con = duckdb.connect()
    for name in TABLES.split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{samples}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, samples, duck, name):
    got, want = all_queries()[name](spark, samples).toPandas(), duck.sql(all_oracles()[name]).df()
    assert set(got.columns) == set(want.columns)
    assert values(got) == values(want)
