"""Rolling indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import indicators as I
from barloom.plans.registry import epoch, ints, query, r, rounded
from barloom.plans.sqlparts import BARS, INDICATORS, NUMBERED, S, VOLUME_BARS, ii, rd, strict, w, with_
from barloom.sources.samples import bars, volume_bars

FLAGS = {
    "prev_1_green", "prev_2_green", "prev_3_green", "prev_4_green", "consec_green", "consec_red", "bb_squeeze",
    "dir_5bar", "dir_10bar", "dir_20bar", "volume_spike", "vsa_high_vol_bull", "vsa_high_vol_bear",
    "vsa_low_vol_up", "vsa_low_vol_down", "utc_hour", "london_session", "ny_session", "asian_session",
    "overlap_session", "day_of_week", "regime_trend", "regime_range", "regime_volatile",
}


def _family(name: str, families: str, columns: str, source=bars, source_sql: str = BARS) -> None:
    """Register one group of indicator columns for every bar."""
    wanted = columns.split()
    flags = [c for c in wanted if c in FLAGS]
    numbers = [c for c in wanted if c not in FLAGS]
    parts = ["key", "bar_epoch"]
    if flags:
        parts.append(ii(*flags))
    if numbers:
        parts.append(rd(*numbers))

    @query(name, with_(source_sql, INDICATORS) + f"SELECT {', '.join(parts)} FROM feat")
    def run(spark, sf):
        f = I.indicator_frame(source(spark, sf), families.split())
        table = I.with_obv(f) if "obv" in wanted else f.core()
        return table.select("key", epoch(), *ints(*flags), *rounded(*numbers))


_family(
    "candle_geometry",
    "candle",
    "body_pct body_ratio upper_wick_ratio lower_wick_ratio prev_1_green prev_2_green prev_3_green prev_4_green "
    "consec_green consec_red",
)
_family("ema_family", "averages", "ema_5 ema_10 ema_20 ema_50 ema_200 c_vs_ema5 c_vs_ema20 ema5_vs_ema20 ema10_vs_ema50 "
        "ema5_slope ema20_slope")  # fmt: skip
_family("sma_bands", "means bands", "sma_5 sma_10 sma_20 c_vs_sma20 bb_upper bb_middle bb_lower bb_width bb_pos bb_squeeze")
_family("rsi_family", "rsi", "rsi_7 rsi_14 rsi_21 rsi_slope")
_family("macd", "macd", "macd macd_signal macd_hist macd_hist_slope")
_family("stoch_williams_cci", "stochastic channel", "stoch_k stoch_d stoch_slope williams_r cci_20")
_family("momentum_direction", "momentum", "roc_3 roc_5 roc_10 dir_5bar dir_10bar dir_20bar")
_family(
    "atr_adx",
    "volatility trend",
    "atr_14 atr_pct adx_14 plus_di minus_di di_diff regime_trend regime_range regime_volatile atr_regime",
)
_family("keltner", "keltner", "keltner_upper keltner_lower")
_family(
    "obv_vwap_vsa",
    "volume",
    "volume_ratio volume_spike obv vwap vsa_high_vol_bull vsa_high_vol_bear vsa_low_vol_up vsa_low_vol_down "
    "vsa_spread_vs_vol delta_approx",
    volume_bars,
    VOLUME_BARS,
)
_family("session_flags", "session", "utc_hour london_session ny_session asian_session overlap_session day_of_week")

_NUMBERS = [c for c in I.FEATURES if c not in FLAGS]
_FLAGS = [c for c in I.FEATURES if c in FLAGS]


@query(
    "features_latest",
    with_(BARS, INDICATORS)
    + ", z AS (SELECT key, bar_epoch, rn, "
    + ", ".join(f"coalesce({c}, 0) AS {c}" for c in _NUMBERS)
    + f", {ii(*_FLAGS)} FROM feat QUALIFY row_number() OVER (PARTITION BY key ORDER BY bar_epoch DESC) = 1) "
    + f"SELECT key, bar_epoch, {ii(*_FLAGS)}, {rd(*_NUMBERS)} FROM z WHERE rn >= 29",
)
def features_latest(spark, sf):
    table = I.latest(I.features(bars(spark, sf)))
    return table.select("key", epoch(), *ints(*_FLAGS), *rounded(*_NUMBERS))


def _seeded_sql(n: int) -> str:
    alpha = 2.0 / (n + 1.0)
    return (
        f"CASE WHEN rn >= {n - 1} THEN list_reduce(list_prepend(list_avg(cs[1:{n}]), cs[{n + 1}:]), "
        f"lambda a, v: a * {1 - alpha!r}::DOUBLE + v * {alpha!r}::DOUBLE) END AS chart_ema_{n}"
    )


@query(
    "chart_averages",
    with_(BARS, NUMBERED)
    + f""", l AS (SELECT key, bar_epoch, rn,
  list(close) OVER (PARTITION BY key ORDER BY bar_epoch ROWS UNBOUNDED PRECEDING) AS cs FROM b),
e AS (SELECT key, bar_epoch, {_seeded_sql(5)}, {_seeded_sql(20)} FROM l)
SELECT key, bar_epoch, {rd('chart_ema_5', 'chart_ema_20')} FROM e""",
)
def chart_averages(spark, sf):
    return I.chart_averages(bars(spark, sf)).select("key", epoch(), *rounded("chart_ema_5", "chart_ema_20"))


def _restart_sql(n: int) -> str:
    alpha = 2.0 / (n + 1.0)
    return (
        f"list_reduce(list(close) {w(150)}, "
        f"lambda a, v: a * {1 - alpha!r}::DOUBLE + v * {alpha!r}::DOUBLE) AS ema_{n}"
    )


@query(
    "ema_bounded_lookback",
    with_(BARS, NUMBERED)
    + ", e AS (SELECT key, bar_epoch, "
    + ", ".join(_restart_sql(n) for n in (20, 50, 200))
    + f" FROM b) SELECT key, bar_epoch, {rd('ema_20', 'ema_50', 'ema_200')} FROM e",
)
def ema_bounded_lookback(spark, sf):
    """Averages restarted on the last 150 bars of each bar."""
    f = I.indicator_frame(bars(spark, sf), ["averages"], lookback=150)
    return f.core("key", epoch(), *rounded("ema_20", "ema_50", "ema_200"))
