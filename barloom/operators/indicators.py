"""Rolling technical indicators for every bar of every series."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.sessions import SESSIONS, flag, within
from barloom.operators.scan import Ema, chained_ema, restarted
from barloom.operators.series import Framed, Layers, frame

TINY = 1e-10
EMA_SPANS = (5, 10, 20, 50, 200)
MACD_SPANS = (12, 26, 9)
REACH = 96
"""Rows before a bar that the deepest chain of strict windows needs (mean 50 over ATR 14 over one lag)."""


@dataclass(frozen=True)
class Family:
    """A group of indicator columns: how to add them, the families they build on, the averages they read."""

    add: Callable[[Framed], Layers]
    needs: tuple[str, ...] = ()
    spans: tuple[int, ...] = ()


def _candle(f: Framed) -> Layers:
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    spread = h - l + TINY
    greens = [flag(f.prev("close", i) > f.prev("open", i)) for i in range(1, 5)]
    yield {
        "body_pct": F.abs(c - o) / spread,
        "body_ratio": F.abs(c - o) / spread,
        "upper_wick_ratio": (h - F.greatest(c, o)) / spread,
        "lower_wick_ratio": (F.least(c, o) - l) / spread,
        **{f"prev_{i}_green": green for i, green in enumerate(greens, 1)},
        "consec_green": greens[0] + greens[1] + greens[2],
        "consec_red": 3 - (greens[0] + greens[1] + greens[2]),
    }


def _moves(f: Framed) -> Layers:
    """Change from the previous close, and its positive and negative part."""
    yield {"_delta": F.col("close") - f.prev("close")}
    yield {
        "_gain": F.when(F.col("_delta").isNotNull(), F.greatest(F.col("_delta"), F.lit(0.0))),
        "_loss": F.when(F.col("_delta").isNotNull(), F.greatest(-F.col("_delta"), F.lit(0.0))),
    }


def _averages(f: Framed) -> Layers:
    c, ema = F.col("close"), {n: F.col(f"ema_{n}") for n in EMA_SPANS}
    yield {
        "c_vs_ema5": (c - ema[5]) / (c + TINY),
        "c_vs_ema20": (c - ema[20]) / (c + TINY),
        "ema5_vs_ema20": (ema[5] - ema[20]) / (c + TINY),
        "ema10_vs_ema50": (ema[10] - ema[50]) / (c + TINY),
        "ema5_slope": (ema[5] - f.prev("ema_5", 3)) / (c + TINY),
        "ema20_slope": (ema[20] - f.prev("ema_20", 5)) / (c + TINY),
    }


def _means(f: Framed) -> Layers:
    c = F.col("close")
    yield {f"sma_{n}": f.mean("close", n) for n in (5, 10, 20)}
    yield {"c_vs_sma20": (c - F.col("sma_20")) / (c + TINY), "_std20": f.strict(F.stddev_samp, "close", 20)}


def _bands(f: Framed) -> Layers:
    upper, lower = F.col("sma_20") + 2 * F.col("_std20"), F.col("sma_20") - 2 * F.col("_std20")
    yield {
        "bb_upper": upper,
        "bb_middle": F.col("sma_20"),
        "bb_lower": lower,
        "bb_width": (upper - lower) / (F.col("sma_20") + TINY),
        "bb_pos": (F.col("close") - lower) / (upper - lower + TINY),
    }
    yield {"bb_squeeze": flag(F.col("bb_width") < f.mean("bb_width", 20) * 0.8)}


def relative_strength(f: Framed, n: int) -> Column:
    return 100 - 100 / (1 + f.mean("_gain", n) / (f.mean("_loss", n) + TINY))


def _rsi(f: Framed) -> Layers:
    yield {f"rsi_{n}": relative_strength(f, n) for n in (7, 14, 21)}
    yield {"rsi_slope": F.col("rsi_14") - f.prev("rsi_14", 3)}


def _macd(f: Framed) -> Layers:
    fast, slow, signal = MACD_SPANS
    first, second, smooth = (F.col(f"ema_{n}") for n in MACD_SPANS)
    mixed = chained_ema(first, fast, smooth, signal) - chained_ema(second, slow, smooth, signal)
    smoothed = F.when(F.col("rn") == 0, 0.0).otherwise(mixed)
    yield {"macd": first - second, "macd_signal": smoothed, "macd_hist": first - second - smoothed}
    yield {"macd_hist_slope": F.col("macd_hist") - f.prev("macd_hist", 2)}


def _stochastic(f: Framed) -> Layers:
    c = F.col("close")
    yield {"_hi14": f.strict(F.max, "high", 14), "_lo14": f.strict(F.min, "low", 14)}
    width = F.col("_hi14") - F.col("_lo14") + TINY
    yield {"stoch_k": 100 * (c - F.col("_lo14")) / width, "williams_r": -100 * (F.col("_hi14") - c) / width}
    yield {"stoch_d": f.mean("stoch_k", 3), "stoch_slope": F.col("stoch_k") - f.prev("stoch_k", 2)}


def _channel(f: Framed) -> Layers:
    yield {"cci_20": (F.col("close") - F.col("sma_20")) / (0.015 * F.col("_std20") + TINY)}


def _momentum(f: Framed) -> Layers:
    c = F.col("close")
    yield {
        **{f"roc_{n}": (c / F.nullif(f.prev("close", n), F.lit(0.0)) - 1) * 100 for n in (3, 5, 10)},
        **{f"dir_{n}bar": flag(c > f.prev("close", n)) for n in (5, 10, 20)},
    }


def _true_range(f: Framed) -> Layers:
    h, l, before = F.col("high"), F.col("low"), f.prev("close")
    yield {"true_range": F.greatest(h - l, F.abs(h - before), F.abs(l - before))}
    yield {"atr_14": f.mean("true_range", 14)}


def _volatility(f: Framed) -> Layers:
    yield {
        "atr_pct": F.col("atr_14") / (F.col("close") + TINY),
        "atr_regime": F.col("atr_14") / (f.mean("atr_14", 50) + TINY),
        "regime_volatile": flag(F.col("atr_14") > f.mean("atr_14", 20) * 1.5),
    }


def _keltner(f: Framed) -> Layers:
    width = 2 * f.mean("true_range", 10)
    yield {"keltner_upper": F.col("ema_20") + width, "keltner_lower": F.col("ema_20") - width}


def _directional(own: Column, other: Column) -> Column:
    """Positive part of the own move unless the other side moved more; the first bar counts as no move."""
    mine = F.greatest(F.coalesce(own, F.lit(0.0)), F.lit(0.0))
    theirs = F.greatest(F.coalesce(other, F.lit(0.0)), F.lit(0.0))
    return F.when(mine < theirs, F.lit(0.0)).otherwise(mine)


def _trend(f: Framed) -> Layers:
    up, down = F.col("high") - f.prev("high"), f.prev("low") - F.col("low")
    yield {"_plus": _directional(up, down), "_minus": _directional(down, up)}
    yield {
        "plus_di": 100 * f.mean("_plus", 14) / (F.col("atr_14") + TINY),
        "minus_di": 100 * f.mean("_minus", 14) / (F.col("atr_14") + TINY),
    }
    difference, total = F.col("plus_di") - F.col("minus_di"), F.col("plus_di") + F.col("minus_di")
    yield {"di_diff": difference, "_dx": 100 * F.abs(difference) / (total + TINY)}
    yield {"adx_14": f.mean("_dx", 14)}
    yield {"regime_trend": flag(F.col("adx_14") > 25), "regime_range": flag(F.col("adx_14") < 20)}


def _volume(f: Framed) -> Layers:
    o, c, l, vol = F.col("open"), F.col("close"), F.col("low"), F.col("_vol")
    yield {"_vol": F.coalesce(F.col("volume"), F.lit(1.0)) if "volume" in f.columns else F.lit(1.0)}
    yield {"_usual": f.mean("_vol", 20) + TINY}
    usual, spread = F.col("_usual"), F.col("high") - l + TINY
    yield {
        "volume_ratio": vol / usual,
        "volume_spike": flag(vol > usual * 2),
        "_signed": F.signum("_delta") * vol,
        "vwap": f.strict(F.sum, c * vol, 20) / (f.strict(F.sum, "_vol", 20) + TINY),
        "vsa_high_vol_bull": flag((vol > usual * 1.5) & (c > o)),
        "vsa_high_vol_bear": flag((vol > usual * 1.5) & (c < o)),
        "vsa_low_vol_up": flag((vol < usual * 0.7) & (c > o)),
        "vsa_low_vol_down": flag((vol < usual * 0.7) & (c < o)),
        "vsa_spread_vs_vol": spread / (vol + TINY),
        "delta_approx": ((c - l) / spread - 0.5) * vol,
    }


def _session(f: Framed) -> Layers:
    hour = F.hour("bar_start")
    yield {
        "utc_hour": hour,
        **{name: flag(within(hour, span)) for name, span in SESSIONS.items()},
        "day_of_week": F.dayofweek("bar_start"),
    }


FAMILIES = {
    "candle": Family(_candle),
    "moves": Family(_moves),
    "averages": Family(_averages, spans=EMA_SPANS),
    "means": Family(_means),
    "bands": Family(_bands, needs=("means",)),
    "rsi": Family(_rsi, needs=("moves",)),
    "macd": Family(_macd, spans=MACD_SPANS),
    "stochastic": Family(_stochastic),
    "channel": Family(_channel, needs=("means",)),
    "momentum": Family(_momentum),
    "true_range": Family(_true_range),
    "volatility": Family(_volatility, needs=("true_range",)),
    "keltner": Family(_keltner, needs=("true_range",), spans=(20,)),
    "trend": Family(_trend, needs=("true_range",)),
    "volume": Family(_volume, needs=("moves",)),
    "session": Family(_session),
}


def _waves(families: Sequence[str]) -> list[tuple[Callable[[Framed], Layers], ...]]:
    """The wanted families and what they need, grouped so that each wave only builds on earlier ones."""
    wanted = {need for name in families for need in (*FAMILIES[name].needs, name)}
    waves: dict[int, list[Callable[[Framed], Layers]]] = {}
    for name in FAMILIES:
        if name in wanted:
            waves.setdefault(1 if FAMILIES[name].needs else 0, []).append(FAMILIES[name].add)
    return [tuple(waves[depth]) for depth in sorted(waves)]


def indicator_frame(
    bars: DataFrame,
    families: Sequence[str] = tuple(FAMILIES),
    back: int = 0,
    ahead: int = 0,
    lookback: int | None = None,
    scans=(),
    **blocks,
) -> Framed:
    """A frame with the wanted indicator families in it, reaching `back` rows beyond what they need.

    `lookback` restarts the exponential averages `ema_*` on the last so many bars, as an analysis
    over a bounded frame would; by default they run over the whole series.
    """
    spans = sorted({span for name in families for span in FAMILIES[name].spans})
    averages = [Ema(f"ema_{n}", n) for n in spans]
    f = frame(bars, back=REACH + back + (lookback or 0), ahead=ahead, scans=(*averages, *scans), **blocks)
    if lookback:
        f = f.with_columns({f"ema_{n}": restarted(f, f"ema_{n}", "close", n, lookback) for n in spans})
    return f.then(*_waves(families))


def with_obv(f: Framed) -> DataFrame:
    """Finish an indicator frame and add the signed cumulative volume.

    Block totals are folded ahead of the rows; a block's own rows add a running sum.
    """
    before = Window.partitionBy(*f.keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        f.df.filter("_core")
        .groupBy(*f.keys, "_blk")
        .agg(F.sum("_signed").alias("_own"))
        .select(*f.keys, "_blk", F.sum("_own").over(before).alias("_before"))
    )
    so_far = Window.partitionBy(*f.keys, "_blk").orderBy("_sub", "rn").rowsBetween(Window.unboundedPreceding, 0)
    own = F.sum(F.when(F.col("_core"), F.col("_signed"))).over(so_far)
    df = f.df.join(carry, [*f.keys, "_blk"], "left").withColumn(
        "obv", F.coalesce(F.col("_before"), F.lit(0.0)) + F.coalesce(own, F.lit(0.0))
    )
    return Framed(df, f.keys).core()


FEATURES = (
    "body_pct body_ratio upper_wick_ratio lower_wick_ratio prev_1_green prev_2_green prev_3_green prev_4_green "
    "consec_green consec_red ema_5 ema_10 ema_20 ema_50 ema_200 sma_5 sma_10 sma_20 c_vs_ema5 c_vs_ema20 "
    "c_vs_sma20 ema5_vs_ema20 ema10_vs_ema50 ema5_slope ema20_slope rsi_7 rsi_14 rsi_21 rsi_slope macd "
    "macd_signal macd_hist macd_hist_slope stoch_k stoch_d stoch_slope williams_r cci_20 roc_3 roc_5 roc_10 "
    "atr_14 atr_pct bb_upper bb_lower bb_middle bb_width bb_pos bb_squeeze keltner_upper keltner_lower adx_14 "
    "plus_di minus_di di_diff dir_5bar dir_10bar dir_20bar volume_ratio volume_spike obv vwap "
    "vsa_high_vol_bull vsa_high_vol_bear vsa_low_vol_up vsa_low_vol_down vsa_spread_vs_vol delta_approx utc_hour "
    "london_session ny_session asian_session overlap_session day_of_week regime_trend regime_range "
    "regime_volatile atr_regime"
).split()


def features(bars: DataFrame, lookback: int | None = None, **blocks) -> DataFrame:
    """The feature table: one row per bar, every feature a column, unknown values as 0."""
    table = with_obv(indicator_frame(bars, lookback=lookback, **blocks))
    return table.select(*bars.columns, "rn", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in FEATURES])


def latest(features: DataFrame, min_rows: int = 30) -> DataFrame:
    """The newest feature row of each series that has at least `min_rows` bars."""
    keep = [c for c in features.columns if c not in ("key", "tf_sec")]
    return (
        features.groupBy("key", "tf_sec")
        .agg(F.max_by(F.struct(*keep), "bar_start").alias("_last"))
        .filter(F.col("_last.rn") >= min_rows - 1)
        .select("key", "tf_sec", "_last.*")
    )


def chart_averages(bars: DataFrame, spans: tuple[int, ...] = (5, 20), **blocks) -> DataFrame:
    """Chart averages that start at row span - 1 with the mean of the first `span` values.

    Such an average differs from the one started at the first value only by the gap between both at
    row span - 1, which decays from there on; the gap is one number per series.
    """
    f = frame(bars, back=max(spans), scans=[Ema(f"ema_{n}", n) for n in spans], **blocks)
    means = {f"_mean_{n}": f.mean("close", n) for n in spans}
    rows = f.with_columns(means).core()
    gaps = rows.filter(F.col("rn").isin([n - 1 for n in spans])).groupBy("key", "tf_sec").agg(
        *[
            F.max(F.when(F.col("rn") == n - 1, F.col(f"_mean_{n}") - F.col(f"ema_{n}"))).alias(f"_gap_{n}")
            for n in spans
        ]
    )
    joined = rows.join(gaps, ["key", "tf_sec"], "left")
    values = {
        f"chart_ema_{n}": F.when(
            F.col("rn") >= n - 1,
            F.col(f"ema_{n}") + F.col(f"_gap_{n}") * F.pow(F.lit(1.0 - 2.0 / (n + 1.0)), F.col("rn") - (n - 1)),
        )
        for n in spans
    }
    return joined.withColumns(values).select(*bars.columns, *values)
