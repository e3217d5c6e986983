"""Institutional, Wyckoff, wave, chart and harmonic patterns, and candle shapes, per bar."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.sessions import flag, within
from barloom.operators.series import Framed, Layers
from barloom.operators.structure import LOOKBACK, TINY, mean_spread, recent_events


def _ohlc() -> tuple[Column, Column, Column, Column]:
    return F.col("open"), F.col("high"), F.col("low"), F.col("close")


# Points per institutional finding.
INSTITUTIONAL_TERMS = (
    ("bullish_liquidity_sweep", "bearish_liquidity_sweep", 8),
    ("institutional_bullish", "institutional_bearish", 6),
    ("judas_swing_bull", "judas_swing_bear", 6),
    ("mm_bull_cycle", "mm_bear_cycle", 5),
    ("displacement_bull", "displacement_bear", 5),
    ("bullish_divergence", "bearish_divergence", 4),
    ("kz_overlap_12_16", "kz_overlap_12_16", 3),
)
INSTITUTIONAL = (
    "bullish_liquidity_sweep bearish_liquidity_sweep institutional_bullish institutional_bearish kz_london_07_10 "
    "kz_newyork_12_15 kz_overlap_12_16 judas_swing_bull judas_swing_bear mm_bull_cycle mm_bear_cycle "
    "displacement_bull displacement_bear bullish_divergence bearish_divergence po3_accumulation po3_manipulation "
    "po3_distribution"
).split()


def institutional(f: Framed, min_rows: int = 20) -> Layers:
    """Sweeps, large bodies, session traps, range expansion and RSI divergence. Needs `rsi_14` in the frame."""
    o, h, l, c = _ohlc()
    hour, four_back = F.hour("bar_start"), f.prev("close", 4)
    yield {
        "_hl": h - l,
        "_top19": F.max("high").over(f.rows(-19, -1)),
        "_low19": F.min("low").over(f.rows(-19, -1)),
        "_range5": f.over(F.max("high"), 5) - f.over(F.min("low"), 5),
        "_range20": f.over(F.max("high"), 20) - f.over(F.min("low"), 20),
        "_low9": F.min("low").over(f.rows(-9, -1)),
        "_top9": F.max("high").over(f.rows(-9, -1)),
        "_rsi_low9": F.min("rsi_14").over(f.rows(-9, -1)),
        "_rsi_top9": F.max("rsi_14").over(f.rows(-9, -1)),
        "_c4": four_back,
    }
    yield {"_mean14": f.mean("_hl", 14)}
    body, yard = F.abs(c - o), F.col("_mean14")
    high_swept = (h > F.col("_top19")) & (c < F.col("_top19"))
    low_swept = (l < F.col("_low19")) & (c > F.col("_low19"))
    tight = F.col("_range5") < F.col("_range20") * 0.25
    london = within(hour, (7, 10))
    findings = {
        "bullish_liquidity_sweep": low_swept,
        "bearish_liquidity_sweep": high_swept,
        "institutional_bullish": (body >= yard * 1.5) & (c > o),
        "institutional_bearish": (body >= yard * 1.5) & (c < o),
        "kz_london_07_10": london,
        "kz_newyork_12_15": within(hour, (12, 15)),
        "kz_overlap_12_16": within(hour, (12, 16)),
        "judas_swing_bull": london & low_swept & (c > o),
        "judas_swing_bear": london & high_swept & (c < o),
        "mm_bull_cycle": tight & (c - F.col("_c4") > yard * 1.5),
        "mm_bear_cycle": tight & (F.col("_c4") - c > yard * 1.5),
        "displacement_bull": (body / (yard + TINY) > 1.8) & (c > o),
        "displacement_bear": (body / (yard + TINY) > 1.8) & (c < o),
        "bullish_divergence": (l < F.col("_low9")) & (F.col("rsi_14") > F.col("_rsi_low9")),
        "bearish_divergence": (h > F.col("_top9")) & (F.col("rsi_14") < F.col("_rsi_top9")),
        "po3_accumulation": within(hour, (0, 7)),
        "po3_manipulation": within(hour, (7, 12)),
        "po3_distribution": within(hour, (12, 20)),
    }
    known = F.col("rn") >= min_rows - 1
    yield {name: flag(known & found) for name, found in findings.items()}
    yield {
        f"inst_{side}_score": reduce(lambda a, b: a + b, [F.col(t[i]) * t[2] for t in INSTITUTIONAL_TERMS])
        for i, side in enumerate(("bull", "bear"))
    }


def session_ranges(bars: DataFrame, hours: tuple[int, int] = (0, 6)) -> DataFrame:
    """High and low of one session per series and day, with the time from which they are known."""
    day = F.date_trunc("day", "bar_start")
    inside = bars.filter(within(F.hour("bar_start"), hours))
    return inside.groupBy("key", "tf_sec", day.alias("day")).agg(
        F.max("high").alias("asian_range_high"), F.min("low").alias("asian_range_low")
    ).withColumn("known_from", F.timestamp_seconds(F.unix_timestamp("day") + hours[1] * 3600))


WYCKOFF = tuple(
    f"wyckoff_{x}" for x in "accumulation distribution markup markdown spring upthrust sos sow sc ar".split()
)


def wyckoff(f: Framed, range_mode: str = "prior", min_rows: int = 50) -> Layers:
    """Ten phase flags against a 50-bar range; `prior` leaves the tested bar out of its own range."""
    _, h, l, c = _ohlc()
    span = f.rows(-50, -1) if range_mode == "prior" else f.rows(-49)
    volume = F.coalesce(F.col("volume"), F.lit(1.0)) if "volume" in f.columns else F.lit(1.0)
    yield {"_hl": h - l, "_wvol": volume}
    yield {
        "_wtop": F.max("high").over(span),
        "_wlow": F.min("low").over(span),
        "_wvol20": f.mean("_wvol", 20),
        "_whl20": f.mean("_hl", 20),
        "_c1": f.prev("close", 1),
        "_c2": f.prev("close", 2),
        "_c4": f.prev("close", 4),
    }
    top, low = F.col("_wtop"), F.col("_wlow")
    width = top - low + TINY
    narrow = width < F.col("_whl20") * 0.5
    findings = {
        "accumulation": narrow & (c < low + width * 0.35),
        "distribution": narrow & (c > top - width * 0.35),
        "markup": (c > top * 0.9) & (F.col("_c4") < c),
        "markdown": (c < low + width * 0.1) & (F.col("_c4") > c),
        "spring": (l < low) & (c > low),
        "upthrust": (h > top) & (c < top),
        "sos": (c > top) & (c > F.col("_c4")),
        "sow": (c < low) & (c < F.col("_c4")),
        "sc": (F.col("_wvol") > F.col("_wvol20") * 2.5) & (c < F.col("_c1")) & (c < low + width * 0.2),
        "ar": (c > F.col("_c2")) & (c < low + width * 0.4),
    }
    known = F.col("rn") >= min_rows - 1
    yield {f"wyckoff_{name}": flag(known & found) for name, found in findings.items()}


ELLIOTT = "elliott_impulse_bull elliott_impulse_bear elliott_correction elliott_wave_ratio elliott_wave_count".split()


def elliott(f: Framed, n: int = 3, lookback: int = LOOKBACK, min_rows: int = 30) -> Layers:
    """Legs between the last five close pivots, and the number of pivots in the look-back modulo 5."""
    span = f.rows(-2 * n)
    middle, whole = f.prev("close", n), F.count("close").over(span) == 2 * n + 1
    extreme = (middle == F.max("close").over(span)) | (middle == F.min("close").over(span))
    yield {"_pivot": F.when(whole & extreme, middle)}
    event = F.when(F.col("_pivot").isNotNull(), F.struct((F.col("rn") - n).alias("at"), F.col("_pivot").alias("p")))
    yield from recent_events(f, event, "_pivots", 5)
    running = F.count("_pivot").over(f.order.rowsBetween(Window.unboundedPreceding, 0))
    yield {"_seen": running}
    # Pivots confirmed by the bar that left the look-back no longer count.
    yield {"_count": F.col("_seen") - F.coalesce(f.prev("_seen", lookback - 2 * n), F.lit(0))}
    p = [F.try_element_at("_pivots", F.lit(i))["p"] for i in range(5, 0, -1)]
    oldest = F.try_element_at("_pivots", F.lit(5))["at"]
    w1, w2, w3 = p[1] - p[0], p[2] - p[1], p[3] - p[2]
    known = (F.col("rn") >= min_rows - 1) & (oldest >= F.col("rn") - (lookback - 1 - n))
    longer = F.abs(w3) > F.abs(w1)
    yield {
        "elliott_impulse_bull": flag(known & (w1 > 0) & (w2 < 0) & (w3 > 0) & longer),
        "elliott_impulse_bear": flag(known & (w1 < 0) & (w2 > 0) & (w3 < 0) & longer),
        "elliott_correction": flag(known & (w1 != 0) & (w2 != 0) & (F.abs(w3) < F.abs(w1))),
        "elliott_wave_ratio": F.when(known, F.least(F.abs(w3) / (F.abs(w1) + TINY), F.lit(5.0))).otherwise(0.0),
        "elliott_wave_count": F.when(known, (F.col("_count") % 5).cast("int")).otherwise(0),
    }


SUPPLY_DEMAND = "sd_demand_zone sd_supply_zone sd_at_demand sd_at_supply sd_zone_strength sd_zone_fresh".split()


def supply_demand(f: Framed, min_rows: int = 20) -> Layers:
    """Sharp drops and rallies over 30 bars, position in the 20-bar range, strength and freshness."""
    o, h, l, c = _ohlc()
    yield {
        "_hl": h - l,
        "_move": c - o,
        "_absmove": F.abs(c - o),
        "_low20": f.over(F.min("low"), 20),
        "_top20": f.over(F.max("high"), 20),
        "_low5": f.over(F.min("low"), 5),
    }
    yield {
        "_mean10": f.mean("_hl", 10),
        "_moves": F.collect_list("_move").over(f.rows(-29)),
        "_dep": f.over(F.avg("_absmove"), 5),
    }
    usual = F.col("_mean10")
    yield {
        "_drops": F.size(F.filter("_moves", lambda m: m < usual * -1.5)),
        "_rallies": F.size(F.filter("_moves", lambda m: m > usual * 1.5)),
    }
    width = F.col("_top20") - F.col("_low20")
    known = F.col("rn") >= min_rows - 1
    yield {
        "sd_demand_zone": flag(known & (F.col("_drops") > 0) & (F.col("_rallies") > F.col("_drops"))),
        "sd_supply_zone": flag(known & (F.col("_rallies") > 0) & (F.col("_drops") > F.col("_rallies"))),
        "sd_at_demand": flag(known & (c < F.col("_low20") + width * 0.25)),
        "sd_at_supply": flag(known & (c > F.col("_top20") - width * 0.25)),
        "sd_zone_strength": F.when(known, F.least(F.col("_dep") / (usual + TINY) * 5, F.lit(10.0))).otherwise(0.0),
        "sd_zone_fresh": flag(known & (F.col("_low5") >= F.col("_low20") * 1.001)),
    }


CHART = tuple(f"chart_{x}" for x in "double_top double_bottom bull_flag bear_flag consolidation".split())


def chart_patterns(f: Framed, min_rows: int = 20) -> Layers:
    """Double tops and bottoms, flags, and tight consolidation."""
    c = F.col("close")
    yield from mean_spread(f)
    yield {
        **{f"_{x[0]}{n}": f.prev(x, n) for x in ("high", "low") for n in (4, 9)},
        "_c9": f.prev("close", 9),
        "_c14": f.prev("close", 14),
        "_range5": f.over(F.max("high"), 5) - f.over(F.min("low"), 5),
        "_range20": f.over(F.max("high"), 20) - f.over(F.min("low"), 20),
    }
    yard = F.col("_atr")
    up, pull = F.col("_c9") - F.col("_c14"), c - F.col("_c9")
    tops, bottoms = (F.col("_h4"), F.col("_h9")), (F.col("_l4"), F.col("_l9"))
    findings = {
        "double_top": (F.abs(tops[0] - tops[1]) < yard * 0.8) & (c < F.least(*tops) - yard),
        "double_bottom": (F.abs(bottoms[0] - bottoms[1]) < yard * 0.8) & (c > F.greatest(*bottoms) + yard),
        "bull_flag": (up > yard * 2) & (pull < 0) & (pull > yard * -1.5),
        "bear_flag": (-up > yard * 2) & (-pull < 0) & (-pull > yard * -1.5),
        "consolidation": (F.col("_range20") > 0) & (F.col("_range5") < F.col("_range20") * 0.25),
    }
    known = F.col("rn") >= min_rows - 1
    yield {f"chart_{name}": flag(known & found) for name, found in findings.items()}


# Retracement ranges AB/XA, BC/AB, CD/BC of the harmonic families, and their tolerance.
HARMONICS = {
    "gartley": ((0.382, 0.618), (0.382, 0.886), (1.13, 1.618)),
    "bat": ((0.382, 0.5), (0.382, 0.886), (1.618, 2.618)),
    "butterfly": ((0.382, 0.618), (0.382, 0.886), (1.618, 2.618)),
    "crab": ((0.382, 0.618), (0.382, 0.886), (2.618, 3.618)),
}
HARMONIC_TOLERANCE = 0.06
HARMONIC_NAMES = tuple(f"{family}_{side}" for family in HARMONICS for side in ("bull", "bear"))


def harmonics(f: Framed, n: int = 3, lookback: int = LOOKBACK, min_rows: int = 30) -> Layers:
    """Five-point harmonic patterns over the last five pivots (a high outranks a low of the same bar)."""
    span = f.rows(-2 * n)
    high, low = f.prev("high", n), f.prev("low", n)
    whole = F.count("high").over(span) == 2 * n + 1
    price = F.when(high == F.max("high").over(span), high).when(low == F.min("low").over(span), low)
    yield {"_hp": F.when(whole, price)}
    event = F.when(F.col("_hp").isNotNull(), F.struct((F.col("rn") - n).alias("at"), F.col("_hp").alias("p")))
    yield from recent_events(f, event, "_hps", 5)
    x, a, b, c, d = (F.try_element_at("_hps", F.lit(i))["p"] for i in range(5, 0, -1))
    oldest = F.try_element_at("_hps", F.lit(5))["at"]
    xa, ab, bc, cd = F.abs(a - x), F.abs(b - a), F.abs(c - b), F.abs(d - c)
    yield {
        "_r1": ab / (xa + TINY),
        "_r2": bc / (ab + TINY),
        "_r3": cd / (bc + TINY),
        "_turn": F.when((F.col("rn") >= min_rows - 1) & (oldest >= F.col("rn") - (lookback - 1 - n)) & (xa >= TINY), F.signum(d - c)),
    }
    found = {}
    for family, limits in HARMONICS.items():
        fits = reduce(
            lambda p, q: p & q,
            [
                (F.col(f"_r{i}") >= lo * (1 - HARMONIC_TOLERANCE)) & (F.col(f"_r{i}") <= hi * (1 + HARMONIC_TOLERANCE))
                for i, (lo, hi) in enumerate(limits, 1)
            ],
        )
        found[f"{family}_bull"] = flag(fits & (F.col("_turn") < 0))
        found[f"{family}_bear"] = flag(fits & (F.col("_turn") > 0))
    yield found


def harmonic_boost(direction: Column, amount: float = 0.05) -> Column:
    """Confidence added when any harmonic pattern agrees with the direction."""

    def any_of(side: str) -> Column:
        return F.greatest(*[F.col(f"{family}_{side}") for family in HARMONICS]) > 0

    aligned = ((direction == "GREEN") & any_of("bull")) | ((direction == "RED") & any_of("bear"))
    return F.when(aligned, F.lit(amount)).otherwise(0.0)


# Weights of the seven reaction components.
REACTION_WEIGHTS = (0.20, 0.18, 0.18, 0.15, 0.10, 0.14, 0.05)
REACTION = (
    "bull_score bear_score net_score signal_boost pin_bar engulfing pin_bull pin_bear bull_engulf bear_engulf "
    "atr_score close_pos close_upper_third close_lower_third"
).split()
REACTION_DEFAULTS = {"bull_score": 50.0, "bear_score": 50.0, "atr_score": 50.0, "close_pos": 0.5}


def candle_reaction(
    f: Framed, engulf: str = "body", size: str = "true_range", zones: bool = True, min_rows: int = 3
) -> Layers:
    """Seven-part candle reaction per side.

    `engulf` compares with the previous body or the whole previous range, `size` measures the bar
    against true ranges or plain ranges; `zones` reads the structure columns of the frame.
    """
    o, h, l, c = _ohlc()
    before = f.prev("close")
    yield {
        "_po": f.prev("open"),
        "_pc": before,
        "_ph": f.prev("high"),
        "_pl": f.prev("low"),
        "_rng": F.greatest(h - l, F.lit(TINY)),
        "_body": F.abs(c - o),
        "_tr": F.when(before.isNotNull(), F.greatest(h - l, F.abs(h - before), F.abs(l - before)))
        if size == "true_range"
        else h - l,
    }
    yield {"_rtr": f.over(F.avg("_tr"), 14)}
    rng, body, po, pc = F.col("_rng"), F.col("_body"), F.col("_po"), F.col("_pc")
    pos = (c - l) / rng
    lower, upper = F.least(o, c) - l, h - F.greatest(o, c)
    if engulf == "body":
        over, under = F.greatest(po, pc), F.least(po, pc)
        swallow = body > F.abs(pc - po)
        bull_engulf = (c > o) & (c >= over) & (o <= under) & swallow
        bear_engulf = (c < o) & (c <= under) & (o >= over) & swallow
    else:
        swallow = body > F.abs(pc - po)
        bull_engulf = (c > o) & (c > F.col("_ph")) & (o < F.col("_pl")) & swallow
        bear_engulf = (c < o) & (c < F.col("_pl")) & (o > F.col("_ph")) & swallow
    middle = (h + l) / 2
    if zones:
        at_bull = (F.col("price_in_bullish_fvg") + F.col("price_at_bullish_ob")) > 0
        at_bear = (F.col("price_in_bearish_fvg") + F.col("price_at_bearish_ob")) > 0
        bull_zone = at_bull & (c > middle)
        bear_zone = ~bull_zone & at_bear & (c < middle)
    else:
        bull_zone = bear_zone = F.lit(False)
    yield {
        "pin_bull": flag((lower >= body * 2) & (body <= rng * 0.25)),
        "pin_bear": flag((upper >= body * 2) & (body <= rng * 0.25)),
        "bull_engulf": flag(bull_engulf),
        "bear_engulf": flag(bear_engulf),
        "atr_score": F.least(rng / (F.col("_rtr") + TINY) * 70, F.lit(100.0)),
        "close_pos": pos,
        "close_upper_third": flag(pos > 0.67),
        "close_lower_third": flag(pos < 0.33),
    }

    def side(wick: Column, pin: str, place: Column, moved: Column, engulfed: str, zone: Column) -> Column:
        parts = (
            wick / rng * 100,
            F.when(F.col(pin) == 1, 85.0).otherwise(wick / rng * 60),
            place * 100,
            F.when(moved, 75.0).otherwise(20.0),
            F.col("atr_score"),
            F.when(F.col(engulfed) == 1, 95.0).otherwise(0.0),
            F.when(zone, 90.0).otherwise(0.0),
        )
        return reduce(lambda a, b: a + b, [part * weight for part, weight in zip(parts, REACTION_WEIGHTS)])

    yield {
        "bull_score": side(lower, "pin_bull", pos, (c > pc) & (c > o), "bull_engulf", bull_zone),
        "bear_score": side(upper, "pin_bear", 1 - pos, (c < pc) & (c < o), "bear_engulf", bear_zone),
    }
    net = F.col("bull_score") - F.col("bear_score")
    yield {
        "net_score": net,
        "signal_boost": net / 100 * 0.12,
        "pin_bar": F.greatest("pin_bull", "pin_bear"),
        "engulfing": F.greatest("bull_engulf", "bear_engulf"),
    }
    known = F.col("rn") >= min_rows - 1
    yield {name: F.when(known, F.col(name)).otherwise(REACTION_DEFAULTS.get(name, 0)) for name in REACTION}


def wick_geometry(df: DataFrame) -> DataFrame:
    """Body and wick shares of a single bar, with doji and pin flags. No window needed."""
    o, h, l, c = _ohlc()
    rng = F.greatest(h - l, F.lit(TINY))
    body, upper, lower = F.abs(c - o), h - F.greatest(o, c), F.least(o, c) - l
    return df.withColumns(
        {
            "body_pct": body / rng,
            "upper_wick_pct": upper / rng,
            "lower_wick_pct": lower / rng,
            "body_to_upper_wick": body / F.greatest(upper, F.lit(TINY)),
            "body_to_lower_wick": body / F.greatest(lower, F.lit(TINY)),
            "close_pos": (c - l) / rng,
            "is_bull": flag(c > o),
            "is_doji": flag(body < rng * 0.05),
            "is_pin_bull": flag((lower >= body * 2) & (body <= rng * 0.25)),
            "is_pin_bear": flag((upper >= body * 2) & (body <= rng * 0.25)),
        }
    )


CANDLESTICKS = (
    "hammer inverted_hammer bullish_engulfing bullish_harami morning_star dragonfly_doji tweezer_bottom "
    "three_white_soldiers marubozu_bull shooting_star hanging_man bearish_engulfing bearish_harami evening_star "
    "gravestone_doji tweezer_top three_black_crows marubozu_bear"
).split()


def candlesticks(f: Framed) -> Layers:
    """Eighteen candlestick patterns over the last one to three bars."""
    yield {"_hl": F.col("high") - F.col("low")}
    past = {f"_{x[0]}{n}": f.prev(x, n) for x in ("open", "high", "low", "close") for n in (1, 2)}
    yield {**past, "_yard": f.over(F.avg("_hl"), 14)}
    o, h, l, c = _ohlc()
    o1, h1, l1, c1 = (F.col(f"_{x}1") for x in "ohlc")
    o2, c2 = F.col("_o2"), F.col("_c2")
    rng, body = F.greatest(h - l, F.lit(TINY)), F.abs(c - o)
    upper, lower = h - F.greatest(o, c), F.least(o, c) - l
    body1, yard = F.abs(c1 - o1), F.col("_yard")
    green, red, green1, red1 = c > o, c < o, c1 > o1, c1 < o1
    small, long_low, long_up = body <= rng * 0.3, lower >= body * 2, upper >= body * 2
    trend_up = green & green1 & (c2 > o2) & (c > c1) & (c1 > c2)
    trend_down = red & red1 & (c2 < o2) & (c < c1) & (c1 < c2)
    strong = (body > yard * 0.5) & (body1 > yard * 0.5)
    full = (body > yard * 0.8) & (lower < body * 0.05) & (upper < body * 0.05)
    middle2 = (o2 + c2) / 2
    found = {
        "hammer": long_low & small & (upper <= body * 0.5) & green,
        "inverted_hammer": long_up & small & (lower <= body * 0.5) & red1,
        "bullish_engulfing": green & red1 & (o <= c1) & (c >= o1),
        "bullish_harami": red1 & green & (o > c1) & (c < o1) & (body < body1 * 0.5),
        "morning_star": (c2 < o2) & (body1 < yard * 0.3) & green & (c > middle2),
        "dragonfly_doji": (body < rng * 0.1) & (lower > rng * 0.6),
        "tweezer_bottom": (F.abs(l - l1) < yard * 0.05) & green & red1,
        "three_white_soldiers": trend_up & strong,
        "marubozu_bull": green & full,
        "shooting_star": long_up & small & (lower <= body * 0.5) & red,
        "hanging_man": long_low & small & red,
        "bearish_engulfing": red & green1 & (o >= c1) & (c <= o1),
        "bearish_harami": green1 & red & (o < c1) & (c > o1) & (body < body1 * 0.5),
        "evening_star": (c2 > o2) & (body1 < yard * 0.3) & red & (c < middle2),
        "gravestone_doji": (body < rng * 0.1) & (upper > rng * 0.6),
        "tweezer_top": (F.abs(h - h1) < yard * 0.05) & red & green1,
        "three_black_crows": trend_down & strong,
        "marubozu_bear": red & full,
    }
    known = F.col("rn") >= 2
    yield {name: flag(known & condition) for name, condition in found.items()}
