"""The whole chain per bar: features, structure, patterns and context in one frame, then the score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators import patterns as P
from barloom.operators import scoring as K
from barloom.operators.indicators import indicator_frame
from barloom.operators.mtf import mtf_points, range_spike, voting_regime, with_filter_trend
from barloom.operators.scan import PriceFilter
from barloom.operators.sentiment import crowd_multiplier, synthetic_multiplier, synthetic_sentiment
from barloom.operators.series import Framed, Layers
from barloom.operators.structure import FINDINGS, FOUNDATIONS, LOOKBACK, scores

SIGNAL_FAMILIES = ("averages", "bands", "rsi", "macd", "stochastic", "trend", "moves")


def _previous_close(f: Framed) -> Layers:
    yield {"prev_close": f.prev("close")}


def analyse(bars: DataFrame, **blocks) -> DataFrame:
    """Every per-bar column the score reads. All windows share one exchange and one sort."""
    f = indicator_frame(bars, SIGNAL_FAMILIES, back=LOOKBACK + 16, scans=[PriceFilter()], **blocks)
    patterns = (P.wyckoff, P.elliott, P.supply_demand, P.chart_patterns, P.harmonics)
    context = (synthetic_sentiment, voting_regime, range_spike, with_filter_trend, _previous_close)
    f = f.then((*FOUNDATIONS, *patterns, *context, P.institutional), FINDINGS, scores, P.candle_reaction)
    df = f.core()
    return df.select(*[c for c in df.columns if not c.startswith("_")])


def score(df: DataFrame, meta: Column | None = None, learned: Column | None = None, digits: int = 3) -> DataFrame:
    """Direction, layer points, staged confidence and grade of every bar.

    `df` carries the columns of `analyse` and, joined to them, timeframe agreement, best zone, profile
    class, mood, order flow, `base_prob` and `oppose_share_green`/`oppose_share_red`. `meta` is the
    probability that the signal is right, `learned` the multiplier learned for the hour.
    """
    meta = F.lit(0.75) if meta is None else meta
    learned = F.lit(1.0) if learned is None else learned
    df = K.direction_vote(K.rule_engine(df))
    d = F.col("direction")
    aligned = K.pick(d, F.col("base_prob"), 1 - F.col("base_prob"))
    trend = F.col("kalman_trend")
    df = df.withColumns(
        {
            "mtf_pts": mtf_points(d),
            "smc_pts": K.smc_points(d),
            "reaction_pts": K.reaction_points(d),
            "ai_pts": K.ai_points(aligned, meta),
            "patterns": K.pattern_names(d),
            "oppose_share": K.pick(d, F.col("oppose_share_green"), F.col("oppose_share_red")),
            **crowd_multiplier(d),
            **synthetic_multiplier(d, digits),
        }
    )
    points = F.col("mtf_pts") + F.col("smc_pts") + F.col("reaction_pts") + F.col("ai_pts")
    agrees = ((trend == 1) & (d == "GREEN")) | ((trend == -1) & (d == "RED"))
    df = df.withColumns(
        {
            "layer_confidence": F.least(
                K.layer_confidence(points, meta, F.coalesce(F.col("adx_14"), F.lit(0.0)), agrees) + P.harmonic_boost(d),
                F.lit(0.99),
            ),
            "consensus": K.consensus(d, F.size("patterns") > 0),
        }
    )
    checked = K.consensus_adjusted(F.col("layer_confidence"), F.col("consensus"))
    df = df.withColumn("checked_confidence", checked * K.soft_penalties(d, meta))
    df = df.withColumn("_zone", K.zone_adjusted(F.col("checked_confidence"), d))
    df = df.withColumn("_context", K.profile_adjusted(F.col("_zone"), d) * F.col("sent_mult") * F.col("synth_mult"))
    final = K.flow_adjusted(F.col("_context"), d) * learned
    return df.withColumn("confidence", F.greatest(F.lit(0.0), F.least(final, F.lit(0.99)))).withColumn(
        "grade", K.grade(F.col("confidence"))
    ).drop("_zone", "_context")
