"""Timeframe agreement, market regime, range spikes and the price filter."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.sessions import flag, within
from barloom.operators.bars import roll_up
from barloom.operators.indicators import indicator_frame
from barloom.operators.joins import asof_join
from barloom.operators.scan import PriceFilter
from barloom.operators.series import Framed, Layers, frame
from barloom.session import cut_lineage

TINY = 1e-10

# Weight of each higher timeframe, as a multiple of the base timeframe, and its points.
TF_WEIGHTS = {60: 0.35, 15: 0.28, 5: 0.22, 2: 0.15}
TF_POINTS = {60: 12, 15: 10, 5: 10, 2: 8}
TF_NAMES = {60: "tf60", 15: "tf15", 5: "tf5", 2: "tf2"}


def bias(f: Framed, tolerance: float = 0.02, min_rows: int = 10) -> Layers:
    """Bias and strength from two averages and the slope of the faster; a fresh extreme adds strength."""
    c, fast, slow = F.col("close"), F.col("ema_20"), F.col("ema_50")
    yield {
        "_slope": (fast - f.prev("ema_20", 3)) / (c + TINY),
        "_top": f.over(F.max("high"), 20),
        "_low": f.over(F.min("low"), 20),
    }
    bull, bear = (fast > slow) & (F.col("_slope") > 0), (fast < slow) & (F.col("_slope") < 0)
    base = F.when(bull | bear, F.least(F.abs("_slope") * 1000 + 0.5, F.lit(1.0))).otherwise(0.3)
    breaks_up, breaks_down = c > F.col("_top") * (1 - tolerance), c < F.col("_low") * (1 + tolerance)
    confirmed = (bull & breaks_up) | (bear & breaks_down)
    known = F.col("rn") >= min_rows - 1
    yield {
        "bias": F.when(known & bull, "bull").when(known & bear, "bear").otherwise("neutral"),
        "strength": F.when(~known, 0.0).when(confirmed, F.least(base + 0.2, F.lit(1.0))).otherwise(base),
        "bos_bull": breaks_up,
        "bos_bear": breaks_down,
    }


def timeframe_bias(bars: DataFrame, **blocks) -> DataFrame:
    """Bias of each bar of each timeframe."""
    f = indicator_frame(bars, ["averages"], **blocks).then(bias)
    return f.core("key", "tf_sec", "bar_start", "close", "bias", "strength", "bos_bull", "bos_bear")


def kill_zone(hour: Column) -> Column:
    return F.when(within(hour, (7, 10)), "london").when(within(hour, (12, 16)), "overlap").otherwise("none")


def timeframe_agreement(bars: DataFrame, tf_sec: int, block_seconds: int = 86400 * 30) -> DataFrame:
    """Per bar: weighted agreement of the last closed bar of every higher timeframe.

    A higher bar is visible once it has ended. The timeframes join in one scan over each series.
    """
    higher = timeframe_bias(roll_up(bars, tuple(TF_WEIGHTS)))
    ended = F.timestamp_seconds(F.unix_timestamp("bar_start") + F.col("tf_sec"))
    states = cut_lineage(higher.select("key", "tf_sec", ended.alias("known_at"), "bias", "strength"))
    split = {TF_NAMES[m]: F.col("tf_sec") == tf_sec * m for m in TF_WEIGHTS}
    left = bars.withColumn("bar_end", F.timestamp_seconds(F.unix_timestamp("bar_start") + F.col("tf_sec")))
    joined = asof_join(left, states, ["key"], "bar_end", "known_at", block_seconds, split=split)

    def side(name: str) -> Column:
        total = F.lit(0.0)
        for m, weight in TF_WEIGHTS.items():
            tf = F.col(TF_NAMES[m])
            total = total + F.when(tf["bias"] == name, tf["strength"] * weight).otherwise(0.0)
        return total

    bias = {f"{TF_NAMES[m]}_bias": F.coalesce(F.col(TF_NAMES[m])["bias"], F.lit("neutral")) for m in TF_WEIGHTS}
    df = joined.withColumns({"bull_weight": side("bull"), "bear_weight": side("bear"), **bias})
    bull, bear = F.col("bull_weight"), F.col("bear_weight")
    return df.withColumns(
        {
            "mtf_direction": F.when(bull > bear, "bull").when(bear > bull, "bear").otherwise("neutral"),
            "mtf_agreement": F.when(bull == bear, 0.3).otherwise(F.greatest(bull, bear) / (1.0 + TINY)),
            "mtf_aligned": (F.col("tf60_bias") == F.col("tf15_bias")) & (F.col("tf60_bias") != "neutral"),
            "killzone": kill_zone(F.hour("bar_start")),
        }
    ).drop(*TF_NAMES.values())


def mtf_points(direction: Column) -> Column:
    """Points of the timeframes whose bias agrees with the direction, plus 5 in a kill zone."""
    wanted = F.when(direction == "GREEN", "bull").otherwise("bear")
    total = F.when(F.col("killzone") != "none", 5).otherwise(0)
    for m, points in TF_POINTS.items():
        total = total + F.when(F.col(f"{TF_NAMES[m]}_bias") == wanted, points).otherwise(0)
    return total


def regime(f: Framed) -> Layers:
    """Trend, volatile or range, from a directional index on one common yardstick and a range ratio."""
    up, down = F.col("high") - f.prev("high"), f.prev("low") - F.col("low")
    plus, minus = (F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)) for x in (up, down))
    yield {
        "_hl": F.col("high") - F.col("low"),
        "_rp": F.when(plus < minus, 0.0).otherwise(plus),
        "_rm": F.when(minus < plus, 0.0).otherwise(minus),
    }
    yield {
        "_y14": f.mean("_hl", 14),
        "_y50": F.coalesce(f.mean("_hl", 50), f.mean("_hl", 14)),
        "_p14": f.mean("_rp", 14),
        "_m14": f.mean("_rm", 14),
    }
    # The yardstick of the reading bar scales both sides of every index value alike and cancels out.
    yield {"_rdx": 100 * F.abs(F.col("_p14") - F.col("_m14")) / (F.col("_p14") + F.col("_m14") + TINY)}
    yield {"regime_adx": f.mean("_rdx", 14), "atr_ratio": F.col("_y14") / (F.col("_y50") + TINY)}
    adx, ratio, known = F.col("regime_adx"), F.col("atr_ratio"), F.col("rn") >= 19
    trend, volatile = (adx > 25) & (ratio < 1.5), ratio > 1.8
    value = (
        F.when(trend, F.least(adx / 50, F.lit(1.0)))
        .when(volatile, F.least(ratio / 3, F.lit(1.0)))
        .otherwise(1 - F.least(adx / 30, F.lit(1.0)))
    )
    yield {
        "regime": F.when(~known, "unknown").when(trend, "trend").when(volatile, "volatile").otherwise("range"),
        "regime_score": F.when(known, value).otherwise(0.5),
    }


# Weight boost per voter in each regime.
VOTERS = ("smc", "ict", "mtf", "ml", "price_action", "volume", "sentiment", "rejection_zone")
REGIME_BOOSTS = {
    "trending": (1.50, 1.50, 1.60, 1.10, 1.20, 0.85, 0.75, 0.80),
    "volatile": (0.80, 0.80, 1.10, 0.90, 0.90, 1.40, 1.40, 1.20),
    "ranging": (0.85, 0.85, 0.75, 1.10, 1.10, 1.50, 1.20, 1.60),
    "quiet": (1.0,) * 8,
}


def voting_regime(f: Framed) -> Layers:
    """Trending, volatile, ranging or quiet; needs `adx_14` in the frame."""
    yield {"_hl": F.col("high") - F.col("low")}
    yield {"_y14": f.mean("_hl", 14)}
    adx = F.coalesce(F.col("adx_14"), F.lit(0.0))
    ratio = F.when(F.col("rn") >= 14, F.col("_hl") / F.greatest(F.col("_y14"), F.lit(TINY))).otherwise(1.0)
    name = (
        F.when(adx >= 30, "trending").when(ratio > 2.5, "volatile").when(adx < 20, "ranging").otherwise("quiet")
    )
    yield {"vote_regime": name, "vote_atr_ratio": F.round(ratio, 2)}


def boost_table(spark) -> DataFrame:
    """regime, agent, boost: 32 fixed rows."""
    rows = [(regime_, agent, boost) for regime_, boosts in REGIME_BOOSTS.items() for agent, boost in zip(VOTERS, boosts)]
    return spark.createDataFrame(rows, "vote_regime string, agent string, boost double")


def range_spike(f: Framed, min_rows: int = 21) -> Layers:
    """Bar range against the mean range of the 14 bars before it, and the confidence factor of a spike."""
    yield {"_hl": F.col("high") - F.col("low")}
    yield {"_y14": f.mean("_hl", 14)}
    before = f.prev("_y14")
    yield {"spike_ratio": F.when((F.col("rn") >= min_rows - 1) & (before > 0), F.col("_hl") / (before + TINY))}
    factor = F.when(F.col("spike_ratio") > 3, 0.65).when(F.col("spike_ratio") > 2, 0.80).otherwise(1.0)
    yield {"spike_factor": factor}


def price_filter(bars: DataFrame, threshold: float = 1e-6, scan: PriceFilter = PriceFilter(), **blocks) -> Framed:
    """Filtered price, gain, deviation, velocity over two bars and its sign."""
    trend = partial(with_filter_trend, threshold=threshold, scan=scan)
    return frame(bars, back=4, scans=[scan], **blocks).then(trend)


def with_filter_trend(f: Framed, threshold: float = 1e-6, scan: PriceFilter = PriceFilter()) -> Layers:
    price = F.col(scan.name)
    yield {"kalman_velocity": F.coalesce(price - f.prev(price, 2), F.lit(0.0))}
    v = F.col("kalman_velocity")
    yield {
        "kalman_gain": scan.gain(F.col("rn")),
        "kalman_deviation": F.col(scan.source) - price,
        "kalman_trend": F.when(v > threshold, 1).when(v < -threshold, -1).otherwise(0),
    }
