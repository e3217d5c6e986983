"""Rules, direction vote, layered points, consensus and context multipliers, as columns of the bar table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.sessions import within
from barloom.operators.patterns import HARMONICS

# Grade floors, best first.
GRADES = (("ELITE", 0.82), ("HIGH", 0.75), ("MODERATE", 0.62))


def _sum(terms) -> Column:
    return reduce(lambda a, b: a + b, terms)


def on(name: str) -> Column:
    return F.col(name) > 0


def pick(direction: Column, bull: Column, bear: Column) -> Column:
    """The value of the side a direction stands for."""
    return F.when(direction == "GREEN", bull).otherwise(bear)


# ---------------------------------------------------------------- rules


def _rules(side: int) -> list[tuple[Column, Column, Column]]:
    """Rules of one side in firing order: condition, weight, name."""
    bull = side == 0
    tag = "bull" if bull else "bear"

    def own(bull_name: str, bear_name: str) -> Column:
        return on(bull_name if bull else bear_name)

    zone_ob = own("price_at_bullish_ob", "price_at_bearish_ob")
    gap = own("price_in_bullish_fvg", "price_in_bearish_fvg")
    ote = own("in_ote_zone_bull", "in_ote_zone_bear")
    sweep = own("bullish_liquidity_sweep", "bearish_liquidity_sweep")
    taken = own("ssl_swept", "bsl_swept") | sweep
    edge = own("in_discount_zone", "in_premium_zone")
    turned = own("bullish_choch", "bearish_choch")
    pin, engulf = own("pin_bull", "pin_bear"), own("bull_engulf", "bear_engulf")
    net = F.col("net_score") if bull else -F.col("net_score")
    run = F.col("momentum_bull_count" if bull else "momentum_bear_count")
    kz = F.col("_kz")
    points = _sum(
        [condition.cast("int") * weight for condition, weight in ((zone_ob, 3), (gap, 2), (taken, 3), (ote, 2), (edge, 1), (turned, 2))]
    )
    structure = "hh_hl" if bull else "lh_ll"
    return [
        (zone_ob & own("bullish_bos", "bearish_bos"), 20 * kz, F.lit(f"{tag}_ob_bos")),
        (gap, 15 * kz, F.lit(f"{tag}_fvg_entry")),
        (ote, F.lit(10.0), F.lit(f"ote_{tag}")),
        (sweep, 18 * kz, F.lit(f"{tag}_liq_sweep")),
        (own("judas_swing_bull", "judas_swing_bear"), F.lit(15.0), F.lit(f"judas_{tag}")),
        (net > 40, F.least(net * 0.3, F.lit(15.0)), F.lit(f"strong_{tag}_reaction")),
        (pin & (zone_ob | gap), F.lit(12.0), F.lit(f"pin_bar_ob_{tag}")),
        (engulf, F.lit(10.0), F.lit(f"{tag}_engulf")),
        (own("liq_sweep_bull", "liq_sweep_bear"), 20 * kz, F.lit(f"liq_sweep_{tag}")),
        (points >= 5, points * 2 * kz, F.concat(F.lit(f"pd_array_{tag}_"), points.cast("string"))),
        (taken & turned & (zone_ob | gap), 35 * kz, F.lit(f"smc_full_{tag}")),
        (own("hh_hl_structure", "lh_ll_structure") & (zone_ob | ote | edge), 12 * kz, F.lit(f"{structure}_key_level")),
        (own("role_reversal_bull", "role_reversal_bear") & (pin | engulf), 15 * kz, F.lit(f"role_reversal_{tag}_retest")),
        (on("round_number_near") & (net > 30), F.lit(8.0), F.lit(f"round_number_{tag}_reject")),
        (run >= 3, F.least(run * 2, F.lit(8)).cast("double"), F.concat(F.lit(f"momentum_{tag}_"), run.cast("string"))),
    ]


def rule_engine(df: DataFrame, min_rows: int = 10) -> DataFrame:
    """`rule_bull`, `rule_bear`, `rule_direction`, `rule_confidence`, `rules_fired` from the rule table."""
    hour = F.hour("bar_start")
    df = df.withColumn("_kz", F.when(within(hour, (7, 10)) | within(hour, (12, 16)), 1.3).otherwise(1.0))
    sides = [_rules(0), _rules(1)]

    def total(rules) -> Column:
        return _sum([F.when(condition, weight).otherwise(0.0) for condition, weight, _ in rules])

    df = df.withColumns({"_rb": total(sides[0]), "_rs": total(sides[1])})
    # The close-third rules look at the totals so far; the bull side is tested first.
    upper = on("close_upper_third") & (F.col("_rb") > F.col("_rs"))
    df = df.withColumn("_rb2", F.col("_rb") + F.when(upper, 6.0).otherwise(0.0))
    lower = on("close_lower_third") & (F.col("_rs") > F.col("_rb2"))
    half = F.when(on("consolidation"), 0.5).otherwise(1.0)
    names = [F.when(c, n) for pair in zip(*sides) for c, _, n in pair]
    names += [
        F.when(upper, F.lit("close_upper_third")),
        F.when(lower, F.lit("close_lower_third")),
        F.when(on("breakout_real_bull"), F.lit("breakout_real_bull")),
        F.when(on("breakout_real_bear"), F.lit("breakout_real_bear")),
        F.when(on("consolidation"), F.lit("consolidation_penalty")),
    ]
    df = df.withColumns(
        {
            "rule_bull": (F.col("_rb2") + F.when(on("breakout_real_bull"), 10.0).otherwise(0.0)) * half,
            "rule_bear": (
                F.col("_rs") + F.when(lower, 6.0).otherwise(0.0) + F.when(on("breakout_real_bear"), 10.0).otherwise(0.0)
            )
            * half,
            "rules_fired": F.array_compact(F.array(*names)),
        }
    )
    bull, bear = F.col("rule_bull"), F.col("rule_bear")
    known = F.col("rn") >= min_rows - 1
    direction = (
        F.when(known & (bull > bear) & (bull > 15), "GREEN").when(known & (bear > bull) & (bear > 15), "RED").otherwise("SKIP")
    )
    strength = F.least(F.lit(0.50) + F.greatest(bull, bear) / 160 * 0.45, F.lit(0.95))
    return df.withColumn("rule_direction", direction).withColumn(
        "rule_confidence", F.when(F.col("rule_direction") != "SKIP", strength).otherwise(0.0)
    ).drop("_kz", "_rb", "_rs", "_rb2")


# ---------------------------------------------------------------- direction


def direction_vote(df: DataFrame) -> DataFrame:
    """Weighted vote of model probability, rules, timeframes, directional index and structure.

    Needs `base_prob`, the rule and timeframe columns, `di_diff`, `smc_net_score` and `prev_close`.
    """
    p, di, net = F.col("base_prob"), F.coalesce(F.col("di_diff"), F.lit(0.0)), F.col("smc_net_score")
    ai, index, structure = F.abs(p - 0.5) * 3.0, F.least(F.abs(di) / 50, F.lit(0.8)), F.least(F.abs(net) / 60, F.lit(0.7))
    rule, frames = F.col("rule_confidence") * 1.2, F.col("mtf_agreement")

    def side(model: Column, rules: Column, trend: Column, moved: Column, zone: Column) -> Column:
        votes = ((model, ai), (rules, rule), (trend, frames), (moved, index), (zone, structure))
        return _sum([F.when(condition, weight).otherwise(0.0) for condition, weight in votes])

    df = df.withColumns(
        {
            "green_weight": side(
                p >= 0.55, F.col("rule_direction") == "GREEN", F.col("mtf_direction") == "bull", di > 8, net > 15
            ),
            "red_weight": side(
                p <= 0.45, F.col("rule_direction") == "RED", F.col("mtf_direction") == "bear", di < -8, net < -15
            ),
        }
    )
    green, red = F.col("green_weight"), F.col("red_weight")
    tie = F.when(F.coalesce(F.col("close") >= F.col("prev_close"), p >= 0.5), "GREEN").otherwise("RED")
    return df.withColumn("direction", F.when(green > red, "GREEN").when(red > green, "RED").otherwise(tie))


# ---------------------------------------------------------------- points

# Points of a finding that agrees and of one that opposes.
OPPOSABLE = (
    ("price_at_bullish_ob", "price_at_bearish_ob", 10, -5),
    ("price_in_bullish_fvg", "price_in_bearish_fvg", 8, -3),
    ("bullish_bos", "bearish_bos", 7, -4),
    ("in_ote_zone_bull", "in_ote_zone_bear", 5, 3),
)
# Points where any of the named findings of the own side holds.
SUPPORTING = (
    (("buy_side_liquidity",), ("sell_side_liquidity",), 5),
    (("liq_sweep_bull",), ("liq_sweep_bear",), 8),
    (("judas_swing_bull", "mm_bull_cycle"), ("judas_swing_bear", "mm_bear_cycle"), 6),
    (("bullish_liquidity_sweep", "displacement_bull"), ("bearish_liquidity_sweep", "displacement_bear"), 5),
    (("wyckoff_spring",), ("wyckoff_upthrust",), 8),
    (("wyckoff_sos",), ("wyckoff_sow",), 6),
    (tuple(f"{h}_bull" for h in HARMONICS), tuple(f"{h}_bear" for h in HARMONICS), 8),
    (("elliott_impulse_bull",), ("elliott_impulse_bear",), 7),
    (("chart_double_bottom",), ("chart_double_top",), 8),
    (("chart_bull_flag",), ("chart_bear_flag",), 5),
    (("hh_hl_structure",), ("lh_ll_structure",), 5),
    (("role_reversal_bull",), ("role_reversal_bear",), 7),
    (("breakout_real_bull",), ("breakout_real_bear",), 5),
)


def smc_points(direction: Column) -> Column:
    """Structure points of a direction; consolidation scales them down."""
    terms = []
    for bull, bear, agree, oppose in OPPOSABLE:
        mine, other = pick(direction, on(bull), on(bear)), pick(direction, on(bear), on(bull))
        terms.append(F.when(mine, agree).when(other, oppose).otherwise(0))
    for bulls, bears, points in SUPPORTING:
        mine = pick(direction, F.greatest(*bulls, F.lit(0)) > 0, F.greatest(*bears, F.lit(0)) > 0)
        terms.append(F.when(mine, points).otherwise(0))
    fresh = on("sd_zone_fresh") & pick(direction, on("sd_at_demand"), on("sd_at_supply"))
    run = pick(direction, F.col("momentum_bull_count"), F.col("momentum_bear_count"))
    terms += [
        F.when(fresh, 6).otherwise(0),
        F.when(on("liquidity_swept"), 4).otherwise(0),
        F.when(on("round_number_near"), 4).otherwise(0),
        F.least(run, F.lit(3)) * 2,
    ]
    return _sum(terms) * F.when(on("consolidation"), 0.6).otherwise(1.0)


def reaction_points(direction: Column) -> Column:
    """Candle reaction points of a direction."""
    net = pick(direction, F.col("net_score"), -F.col("net_score"))
    ladder = F.when(net > 60, 25).when(net > 40, 20).when(net > 20, 14).when(net > 0, 8).otherwise(0)
    pin = F.when(pick(direction, on("pin_bull"), on("pin_bear")), 5).otherwise(0)
    engulf = F.when(pick(direction, on("bull_engulf"), on("bear_engulf")), 6).otherwise(0)
    return ladder + pin + engulf


def ai_points(confidence: Column, meta: Column) -> Column:
    """Model points by confidence band, plus a bonus for a high meta probability."""
    bands = ((0.80, 30), (0.75, 25), (0.70, 20), (0.65, 14), (0.60, 8))
    ladder = F.lit(0)
    for floor, points in reversed(bands):
        ladder = F.when(confidence >= floor, points).otherwise(ladder)
    return ladder + F.when(meta >= 0.75, 5).otherwise(0)


def layer_confidence(points: Column, meta: Column, adx: Column, agrees: Column) -> Column:
    """Points out of 130, adjusted by meta probability, a flat market and the filtered trend, in 0..1."""
    value = points / 130 + F.when(meta >= 0.60, 0.04).otherwise(0.0)
    value = value * F.when(adx < 15, 0.75).otherwise(1.0) + F.when(agrees, 0.02).otherwise(-0.03)
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def consensus(direction: Column, pattern: Column) -> Column:
    """How many of eight checks support the direction; null indicators read as 0, as in the feature table."""

    def known(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0.0))

    rsi, macd, bands, stoch = (known(x) for x in ("rsi_14", "macd_hist", "bb_pos", "stoch_k"))
    spread, net = F.col("ema_5") - F.col("ema_20"), F.col("smc_net_score")
    green = (rsi < 65, macd > 0, bands < 0.75, stoch < 80, spread > 0, net > 0)
    red = (rsi > 35, macd < 0, bands > 0.25, stoch > 20, spread < 0, net < 0)
    checks = [pick(direction, g, b) for g, b in zip(green, red)] + [known("adx_14") > 20, pattern]
    return _sum([F.when(check, 1).otherwise(0) for check in checks])


def consensus_adjusted(confidence: Column, checks: Column) -> Column:
    return (
        F.when(checks >= 7, F.least(confidence + 0.04, F.lit(1.0)))
        .when(checks >= 5, confidence)
        .otherwise(confidence * F.greatest(1.0 - (5 - checks) * 0.04, F.lit(0.75)))
    )


def pattern_names(direction: Column) -> Column:
    """Names of the candle and harmonic patterns that agree with the direction."""
    green, red = direction == "GREEN", direction == "RED"
    named = [
        (green & on("pin_bull"), "pin_bar_bull"),
        (green & on("bull_engulf"), "bullish_engulfing"),
        (red & on("pin_bear"), "pin_bar_bear"),
        (red & on("bear_engulf"), "bearish_engulfing"),
    ]
    for family in HARMONICS:
        named.append((green & on(f"{family}_bull"), f"{family}_bull"))
        named.append((red & on(f"{family}_bear"), f"{family}_bear"))
    return F.array_compact(F.array(*[F.when(condition, F.lit(name)) for condition, name in named]))


# ---------------------------------------------------------------- adjustments


def opposes(direction: Column, bias: Column) -> Column:
    return pick(direction, bias == "bear", bias == "bull")


def soft_penalties(direction: Column, meta: Column) -> Column:
    """Factor for opposing timeframes, opposing models, weak agreement, low meta probability and spikes.

    Needs the timeframe columns, `oppose_share` and `spike_factor`.
    """
    hour, quarter = opposes(direction, F.col("tf60_bias")), opposes(direction, F.col("tf15_bias"))
    frames = (
        F.when(hour & quarter, 0.72)
        .when(hour | quarter, 0.85)
        .when(opposes(direction, F.col("mtf_direction")), 0.93)
        .otherwise(1.0)
    )
    models = F.when(F.col("oppose_share") >= 0.60, 0.85).otherwise(1.0)
    weak = F.when(F.col("mtf_agreement") < 0.40, 0.97).otherwise(1.0)
    doubtful = F.when(meta < 0.60, 0.97).otherwise(1.0)
    return frames * models * weak * doubtful * F.col("spike_factor")


def zone_adjusted(confidence: Column, direction: Column) -> Column:
    """Strong rejection zones lift an agreeing and lower an opposing direction."""
    strength, signal = F.col("rz_score"), F.col("rz_signal")
    return (
        F.when((strength >= 65) & (signal == direction), F.least(confidence * (1 + strength / 1000), F.lit(0.99)))
        .when((strength >= 65) & (signal != "NONE"), confidence * (1 - strength / 500))
        .otherwise(confidence)
    )


def profile_adjusted(confidence: Column, direction: Column) -> Column:
    zone = F.col("vp_zone")
    with_level = pick(direction, zone == "AT_SUPPORT", zone == "AT_RESISTANCE")
    against = pick(direction, zone == "AT_RESISTANCE", zone == "AT_SUPPORT")
    value = (
        F.when(with_level, F.least(confidence * 1.05, F.lit(0.99)))
        .when(against, confidence * 0.90)
        .when(zone == "LVN_FAST_MOVE", F.least(confidence * 1.03, F.lit(0.99)))
        .otherwise(confidence)
    )
    return value * F.when(F.col("vp_at_poc"), 0.97).otherwise(1.0)


def flow_adjusted(confidence: Column, direction: Column) -> Column:
    flow = pick(direction, F.col("os_imbalance"), -F.col("os_imbalance"))
    return (
        F.when(flow > 0.2, F.least(confidence * 1.04, F.lit(0.99)))
        .when(flow < -0.2, confidence * 0.94)
        .otherwise(confidence)
    )


def grade(confidence: Column) -> Column:
    label = F.lit("SKIP")
    for name, floor in reversed(GRADES):
        label = F.when(confidence >= floor, F.lit(name)).otherwise(label)
    return label
