"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from barloom.plans import all_queries
from barloom.session import build_session

HEADLINE = (
    "ohlc_hourly ohlc_carry_open ohlc_gap_fill bars_rollup_ladder late_tick_audit live_bar_updates ema_family rsi_family "
    "macd atr_adx obv_vwap_vsa candlestick_18 order_blocks fair_value_gaps smc_scores harmonics volume_profile "
    "rejection_zones synthetic_sentiment mtf_agreement news_block_anti price_filter prob_fusion window_top3 "
    "settle_signals loss_streak adaptive_threshold agent_weights features_latest "
    "profile_per_bar bar_retention_1500 mood_asof series_model_walk_forward signal_scores"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "barloom-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.sql.files.maxPartitionBytes": "16m",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    queries["ohlc_hourly"](spark, folder).write.format("noop").mode("overwrite").save()  # start-up
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    n_ticks = spark.read.parquet(f"{folder}/events.parquet").count()
    result = {
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "ticks_per_second": round(n_ticks / seconds["ohlc_hourly"]),
    }
    print(json.dumps(result), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
