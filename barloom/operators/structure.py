"""Market structure per bar: swings, breaks, order blocks, gaps, liquidity, levels and their scores.

A swing or zone counts from the bar that confirms it, never before, so no value changes when later
bars arrive. `lookback` is the number of bars an analysis may look at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.sessions import KILL_ZONES, flag, within
from barloom.operators.series import Framed, Layers, side_by_side

TINY = 1e-10
LOOKBACK = 500
SWING = 5

# Points of each finding in the composite score, bull side then bear side.
SCORE_TERMS = (
    ("price_at_bullish_ob", "price_at_bearish_ob", 10),
    ("price_in_bullish_fvg", "price_in_bearish_fvg", 8),
    ("bullish_bos", "bearish_bos", 7),
    ("in_ote_zone_bull", "in_ote_zone_bear", 5),
    ("in_discount_zone", "in_premium_zone", 4),
    ("buy_side_liquidity", "sell_side_liquidity", 4),
    ("liq_sweep_bull", "liq_sweep_bear", 8),
    ("kz_london", "kz_london", 3),
    ("kz_overlap", "kz_overlap", 3),
    ("bullish_choch", "bearish_choch", 6),
    ("hh_hl_structure", "lh_ll_structure", 5),
    ("role_reversal_bull", "role_reversal_bear", 6),
    ("breakout_real_bull", "breakout_real_bear", 4),
)


def recent_events(f: Framed, event: Column, name: str, count: int, upto: int = 0) -> Layers:
    """Column `name`: the newest `count` non-null events up to `upto` rows back, newest first.

    Each event remembers its predecessors, so every step is a running `last` and no frame is
    scanned again per row. Events beyond the block's halo are out of reach; filter by position.
    """
    upcoming = f.order.rowsBetween(Window.unboundedPreceding, -1)
    yield {f"_{name}_own": event}
    own = F.col(f"_{name}_own")
    yield {f"_{name}_chain": F.when(own.isNotNull(), F.array(own))}
    for _ in range(count - 1):
        before = F.last(f"_{name}_chain", ignorenulls=True).over(upcoming)
        chain = F.concat(F.array(own), F.coalesce(before, F.expr(f"slice(_{name}_chain, 1, 0)")))
        yield {f"_{name}_chain": F.when(own.isNotNull(), chain)}
    seen = F.last(f"_{name}_chain", ignorenulls=True).over(f.order.rowsBetween(Window.unboundedPreceding, -upto))
    yield {name: seen}


def swings(f: Framed, n: int = SWING, lookback: int = LOOKBACK) -> Layers:
    """`swing_highs`, `swing_lows`: the two newest confirmed swings (position, price), newest first."""
    span = f.rows(-2 * n)
    whole = F.count("high").over(span) == 2 * n + 1
    middle = F.col("rn") - n
    high, low = f.prev("high", n), f.prev("low", n)
    yield {
        "swing_high_at": F.when(whole & (high >= F.max("high").over(span)), high),
        "swing_low_at": F.when(whole & (low <= F.min("low").over(span)), low),
    }

    def event(side: str) -> Column:
        price = F.col(f"swing_{side}_at")
        return F.when(price.isNotNull(), F.struct(middle.alias("at"), price.alias("price")))

    def kept(side: str) -> Column:
        oldest = F.col("rn") - (lookback - 1 - n)
        return F.filter(F.col(f"_swing_{side}s"), lambda s: s["at"] >= oldest)

    sides = ("high", "low")
    yield from side_by_side(*[recent_events(f, event(side), f"_swing_{side}s", 2) for side in sides])
    yield {f"swing_{side}s": kept(side) for side in sides}
    yield {
        "_sh": F.try_element_at("swing_highs", F.lit(1))["price"],
        "_sh2": F.try_element_at("swing_highs", F.lit(2))["price"],
        "_sl": F.try_element_at("swing_lows", F.lit(1))["price"],
        "_sl2": F.try_element_at("swing_lows", F.lit(2))["price"],
    }


def breaks(f: Framed, lookback: int = LOOKBACK) -> Layers:
    """Break of structure, change of character and trend structure from the two newest swings."""
    before = f.prev("close")
    highs, lows = F.col("_sh2").isNotNull(), F.col("_sl2").isNotNull()
    yield {
        "swing_high_5": F.coalesce(F.col("_sh"), f.over(F.max("high"), lookback)),
        "swing_low_5": F.coalesce(F.col("_sl"), f.over(F.min("low"), lookback)),
        "bullish_bos": flag(highs & (before > F.col("_sh"))),
        "bullish_choch": flag(highs & lows & (before > F.col("_sh")) & (F.col("_sh") < F.col("_sh2"))),
        "hh_hl_structure": flag((F.col("_sh") > F.col("_sh2")) & (F.col("_sl") > F.col("_sl2"))),
        "lh_ll_structure": flag((F.col("_sh") < F.col("_sh2")) & (F.col("_sl") < F.col("_sl2"))),
        "_below": lows & (before < F.col("_sl")),
    }
    rising = F.col("_sl") > F.col("_sl2")
    yield {
        "bearish_bos": flag((F.col("bullish_bos") == 0) & F.col("_below")),
        "bearish_choch": flag((F.col("bullish_choch") == 0) & highs & F.col("_below") & rising),
    }


def _zone(at: Column, low: Column, high: Column) -> Column:
    return F.struct(at.alias("at"), low.alias("low"), high.alias("high"))


def _inside(zones: str, oldest: Column) -> Column:
    hit = F.exists(F.col(zones), lambda z: (z["at"] >= oldest) & (F.col("close") >= z["low"]) & (F.col("close") <= z["high"]))
    return F.coalesce(hit, F.lit(False))


def order_blocks(f: Framed, lookback: int = LOOKBACK, warmup: int = 50, delay: int = 3) -> Layers:
    """Last opposite bar before a break of its range; the three newest per side, known `delay` bars later."""
    o, h, l, c = (f.prev(x, 1) for x in ("open", "high", "low", "close"))
    at = F.col("rn") - 1
    late = at >= warmup
    yield {
        "_bull_ob": F.when(late & (c < o) & (F.col("close") > h), _zone(at, l, h)),
        "_bear_ob": F.when(late & (c > o) & (F.col("close") < l), _zone(at, l, h)),
    }
    oldest = F.col("rn") - (lookback - 1 - warmup)
    sides = {"bull": "bullish", "bear": "bearish"}
    yield from side_by_side(
        *[recent_events(f, F.col(f"_{side}_ob"), f"{side}_obs", 3, upto=delay - 1) for side in sides]
    )
    found = {}
    for side, name in sides.items():
        newest = F.try_element_at(f"{side}_obs", F.lit(1))
        found[f"price_at_{name}_ob"] = flag(_inside(f"{side}_obs", oldest))
        found[f"{name}_ob_zone"] = F.when(newest["at"] >= oldest, newest)
    yield found


def fair_value_gaps(f: Framed, lookback: int = 50) -> Layers:
    """Three-bar gaps: the three newest per side among the last `lookback` - 1 middle bars."""
    h2, l2, at = f.prev("high", 2), f.prev("low", 2), F.col("rn") - 1
    yield {
        "_bull_fvg": F.when((at >= 2) & (F.col("low") > h2), _zone(at, h2, F.col("low"))),
        "_bear_fvg": F.when((at >= 2) & (F.col("high") < l2), _zone(at, F.col("high"), l2)),
    }
    oldest = F.col("rn") - (lookback - 1)
    sides = {"bull": "bullish", "bear": "bearish"}
    yield from side_by_side(*[recent_events(f, F.col(f"_{side}_fvg"), f"{side}_fvgs", 3) for side in sides])
    found = {}
    for side, name in sides.items():
        found[f"price_in_{name}_fvg"] = flag(_inside(f"{side}_fvgs", oldest))
        found[f"{name}_fvg"] = flag(F.try_element_at(f"{side}_fvgs", F.lit(1))["at"] >= oldest)
    newest = F.try_element_at("bull_fvgs", F.lit(1))
    middle = F.when(newest["at"] >= oldest, (newest["low"] + newest["high"]) / 2)
    yield {**found, "fvg_50_level": F.coalesce(middle, F.lit(0.0))}


def mean_spread(f: Framed) -> Layers:
    """Mean bar range of 14 bars, the yardstick of the level tests."""
    yield {"_hl": F.col("high") - F.col("low")}
    yield {"_atr": f.mean("_hl", 14) + TINY}


def liquidity(f: Framed, n: int = 20) -> Layers:
    """Equal highs and lows as liquidity pools, and sweeps of a pool by the previous bar.

    The swept level is that of the bars before the tested one; a range including the tested bar
    could never be exceeded by it.
    """
    tolerance = F.col("_atr") * 0.3
    top, bottom = F.max("high"), F.min("low")
    yield {
        "_highs": F.collect_list("high").over(f.rows(-(n + 1))),
        "_lows": F.collect_list("low").over(f.rows(-(n + 1))),
        "_top": top.over(f.rows(-(n - 1))),
        "_bottom": bottom.over(f.rows(-(n - 1))),
        "_top_before": top.over(f.rows(-(n + 1), -2)),
        "_bottom_before": bottom.over(f.rows(-(n + 1), -2)),
        "_top_prior": top.over(f.rows(-(n - 1), -1)),
        "_bottom_prior": bottom.over(f.rows(-(n - 1), -1)),
    }

    def pool(values: str, level: str) -> Column:
        return F.size(F.filter(F.col(values), lambda v: F.abs(v - F.col(level)) < tolerance)) >= 2

    def newest(values: str) -> Column:
        return F.slice(values, F.greatest(F.lit(1), F.size(values) - (n - 1)), F.lit(n))

    def earlier(values: str) -> Column:
        return F.slice(values, F.lit(1), F.greatest(F.lit(0), F.size(values) - 2))

    yield {
        "_highs_now": newest("_highs"),
        "_lows_now": newest("_lows"),
        "_highs_then": earlier("_highs"),
        "_lows_then": earlier("_lows"),
    }
    ph, pl, pc = f.prev("high"), f.prev("low"), f.prev("close")
    h, l, c = F.col("high"), F.col("low"), F.col("close")
    bsl = pool("_highs_then", "_top_before") & (ph > F.col("_top_before")) & (pc < F.col("_top_before"))
    ssl = pool("_lows_then", "_bottom_before") & (pl < F.col("_bottom_before")) & (pc > F.col("_bottom_before"))
    high_taken = (c < F.col("_top_prior")) & (h > F.col("_top_prior"))
    low_taken = (c > F.col("_bottom_prior")) & (l < F.col("_bottom_prior"))
    yield {
        "buy_side_liquidity": flag(pool("_highs_now", "_top")),
        "sell_side_liquidity": flag(pool("_lows_now", "_bottom")),
        "bsl_swept": flag(bsl),
        "ssl_swept": flag(ssl),
        "liq_sweep_bull": flag(ssl),
        "liq_sweep_bear": flag(bsl),
        "liquidity_swept": flag(high_taken | low_taken | F.coalesce(bsl, F.lit(False)) | F.coalesce(ssl, F.lit(False))),
    }
    yield {
        "bsl_level": F.when(F.col("buy_side_liquidity") == 1, F.col("_top")).otherwise(0.0),
        "ssl_level": F.when(F.col("sell_side_liquidity") == 1, F.col("_bottom")).otherwise(0.0),
    }


def round_numbers(f: Framed) -> Layers:
    """Nearest round price within 0.3 mean ranges, trying ever coarser grids."""
    price = F.col("close")
    magnitude = F.pow(F.lit(10.0), F.greatest(F.floor(F.log10(F.nullif(F.abs(price), F.lit(0.0)))) - 1, F.lit(-3)))
    nearest = [F.bround(price / (magnitude * m), 0) * (magnitude * m) for m in (1, 2, 5, 10, 50)]
    found = F.coalesce(*[F.when(F.abs(price - level) < F.col("_atr") * 0.3, level) for level in nearest])
    yield {"_round": found}
    yield {"round_number_near": flag(F.col("_round").isNotNull()), "round_number_level": F.coalesce("_round", F.lit(0.0))}


def role_reversal(f: Framed, n: int = SWING, lookback: int = LOOKBACK) -> Layers:
    """Price back at an older swing: within 0.6 mean ranges of any swing but the newest."""
    frame = f.rows(-(lookback - 1 - 2 * n))
    price, tolerance = F.col("close"), F.col("_atr") * 0.6

    def retest(swing: str) -> Column:
        seen = F.col(f"_all_{swing}")
        older = F.slice(seen, F.lit(1), F.greatest(F.lit(0), F.size(seen) - 1))
        return F.exists(older, lambda level: F.abs(price - level) < tolerance)

    yield {f"_all_{s}": F.collect_list(f"swing_{s}_at").over(frame) for s in ("high", "low")}
    yield {"role_reversal_bull": flag(retest("high")), "role_reversal_bear": flag(retest("low"))}


def runs_and_breakouts(f: Framed) -> Layers:
    """Run length of same-coloured bars (up to 5), narrow range, and real breakouts."""

    def run(up: bool) -> Column:
        colour = [(f.prev("close", i) > f.prev("open", i)) if up else (f.prev("close", i) < f.prev("open", i)) for i in range(1, 5)]
        own = (F.col("close") > F.col("open")) if up else (F.col("close") < F.col("open"))
        unbroken = [own]
        for condition in colour:
            unbroken.append(unbroken[-1] & condition)
        return reduce(lambda a, b: a + b, [flag(u) for u in unbroken])

    c, body = F.col("close"), F.abs(F.col("close") - F.col("open"))
    big = body > F.col("_atr") * 0.6
    yield {
        "momentum_bull_count": run(True),
        "momentum_bear_count": run(False),
        "consolidation": flag(f.over(F.avg("_hl"), 5) < f.over(F.avg("_hl"), 20) * 0.45),
        "breakout_real_bull": flag(big & (c > F.max("high").over(f.rows(-20, -1)))),
        "breakout_real_bear": flag(big & (c < F.min("low").over(f.rows(-20, -1)))),
    }


def price_zones(f: Framed) -> Layers:
    """Premium and discount in the 50-bar range, optimal entry in the last swing leg, kill zones."""
    c, hour = F.col("close"), F.hour("bar_start")
    yield {
        "_hi50": f.over(F.max("high"), 50),
        "_lo50": f.over(F.min("low"), 50),
        "_leg_top": F.coalesce(F.col("_sh"), f.over(F.max("high"), 20)),
        "_leg_bottom": F.coalesce(F.col("_sl"), f.over(F.min("low"), 20)),
    }
    position = (c - F.col("_lo50")) / (F.col("_hi50") - F.col("_lo50") + TINY)
    leg = F.col("_leg_top") - F.col("_leg_bottom") + TINY
    down, up = (F.col("_leg_top") - c) / leg, (c - F.col("_leg_bottom")) / leg
    bull, bear = (down > 0.62) & (down < 0.79), (up > 0.62) & (up < 0.79)
    yield {
        "in_premium_zone": flag(position > 0.618),
        "at_equilibrium": flag((position > 0.45) & (position < 0.55)),
        "in_discount_zone": flag(position < 0.382),
        "in_ote_zone_bull": flag(bull),
        "in_ote_zone_bear": flag(bear),
        "in_ote_zone": flag(bull | bear),
        **{name: flag(within(hour, span)) for name, span in KILL_ZONES.items()},
    }


def trend_label(f: Framed) -> Layers:
    fast, slow = F.col("ema_20"), F.col("ema_50")
    yield {"trend": F.when(fast > slow, "up").when(fast < slow, "down").otherwise("range")}


FLAGS = (
    "bullish_bos bearish_bos bullish_choch bearish_choch price_at_bullish_ob price_at_bearish_ob "
    "price_in_bullish_fvg price_in_bearish_fvg bullish_fvg bearish_fvg buy_side_liquidity sell_side_liquidity "
    "bsl_swept ssl_swept liq_sweep_bull liq_sweep_bear liquidity_swept hh_hl_structure lh_ll_structure "
    "round_number_near role_reversal_bull role_reversal_bear momentum_bull_count momentum_bear_count consolidation "
    "breakout_real_bull breakout_real_bear in_premium_zone at_equilibrium in_discount_zone in_ote_zone_bull "
    "in_ote_zone_bear in_ote_zone kz_asian kz_london kz_newyork kz_overlap kz_london_close kz_gold"
).split()
LEVELS = "swing_high_5 swing_low_5 fvg_50_level bsl_level ssl_level round_number_level".split()


def scores(f: Framed, min_rows: int = 20) -> Layers:
    """Composite bull, bear and net score; series shorter than `min_rows` read as no finding at all."""
    known = F.col("rn") >= min_rows - 1
    yield {
        **{name: F.when(known, F.col(name)).otherwise(0) for name in FLAGS},
        **{name: F.when(known, F.col(name)).otherwise(0.0) for name in LEVELS},
    }

    def total(side: int, run: str) -> Column:
        terms = [F.col(term[side]) * term[2] for term in SCORE_TERMS]
        return reduce(lambda a, b: a + b, terms) + F.least(F.col(run), F.lit(3)) * 2

    yield {"smc_bull_score": total(0, "momentum_bull_count"), "smc_bear_score": total(1, "momentum_bear_count")}
    yield {"smc_net_score": F.col("smc_bull_score") - F.col("smc_bear_score")}


FOUNDATIONS = (mean_spread, swings, order_blocks, fair_value_gaps)
FINDINGS = (breaks, liquidity, round_numbers, role_reversal, runs_and_breakouts, price_zones)
STRUCTURE = (FOUNDATIONS, FINDINGS, scores)
"""All structure columns, for `Framed.then`. The frame must reach back `LOOKBACK` rows."""


def zone_proximity(df: DataFrame, near: float = 0.01) -> DataFrame:
    """Per bar: inside a known zone, relative distance to the nearest zone middle per kind, zone score.

    Reads the zone arrays `bull_obs`, `bear_obs`, `bull_fvgs`, `bear_fvgs`, at most three entries each.
    """
    price = F.col("close")

    def inside(name: str) -> Column:
        hit = F.exists(F.col(name), lambda z: (price >= z["low"]) & (price <= z["high"]))
        return F.coalesce(hit, F.lit(False))

    def distance(name: str) -> Column:
        def relative(z: Column) -> Column:
            middle = (z["low"] + z["high"]) / 2
            return F.abs(price - middle) / F.greatest(middle, F.lit(TINY))

        return F.array_min(F.transform(F.col(name), relative))

    reacts = F.col("in_ob") | F.col("in_fvg")
    close_by = (F.col("nearest_ob_dist") < near) | (F.col("nearest_fvg_dist") < near)
    return df.withColumns(
        {
            "in_ob": inside("bull_obs") | inside("bear_obs"),
            "in_fvg": inside("bull_fvgs") | inside("bear_fvgs"),
            "nearest_ob_dist": F.least(distance("bull_obs"), distance("bear_obs")),
            "nearest_fvg_dist": F.least(distance("bull_fvgs"), distance("bear_fvgs")),
        }
    ).withColumns(
        {"zone_reaction": flag(reacts), "zone_score": F.when(reacts, 90.0).when(close_by, 60.0).otherwise(0.0)}
    )
