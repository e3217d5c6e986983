"""Market structure and patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import patterns as P
from barloom.operators import structure as M
from barloom.operators.indicators import indicator_frame
from barloom.operators.series import frame
from barloom.plans import structure_sql as Q
from barloom.plans.registry import epoch, ints, query, r, rounded
from barloom.plans.sqlparts import BARS, INDICATORS, NUMBERED, S, VOLUME_BARS, ema, ii, rd, w, with_
from barloom.sources.samples import bars, volume_bars

REACH = M.LOOKBACK + 16
SMC = Q.smc_sql("b")


def _structure(spark, sf):
    return frame(bars(spark, sf), back=REACH).then(*M.STRUCTURE)


def _register(name: str, flags: str = "", numbers: str = "", steps=None, sql: str = SMC, table: str = "smcn") -> None:
    flags_, numbers_ = flags.split(), numbers.split()
    parts = ["key", "bar_epoch", *([ii(*flags_)] if flags_ else []), *([rd(*numbers_)] if numbers_ else [])]

    @query(name, with_(BARS, NUMBERED, sql) + f"SELECT {', '.join(parts)} FROM {table}")
    def run(spark, sf):
        f = frame(bars(spark, sf), back=REACH)
        f = f.then(*(steps or M.STRUCTURE))
        return f.core("key", epoch(), *ints(*flags_), *rounded(*numbers_))


_register(
    "swing_pivots", numbers="sh_at sl_at sh sh2 sl sl2", table="s4",
    steps=[M.swings, lambda f: iter([{
        "sh_at": F.col("swing_high_at"), "sl_at": F.col("swing_low_at"), "sh": F.col("_sh"), "sh2": F.col("_sh2"),
        "sl": F.col("_sl"), "sl2": F.col("_sl2")}])],
)


_register("order_blocks", "price_at_bullish_ob price_at_bearish_ob", steps=[M.order_blocks])
_register(
    "fair_value_gaps",
    "price_in_bullish_fvg price_in_bearish_fvg bullish_fvg bearish_fvg",
    "fvg_50_level",
    steps=[M.fair_value_gaps, lambda f: iter([{
        name: F.when(F.col("rn") >= 19, F.col(name)).otherwise(0)
        for name in "price_in_bullish_fvg price_in_bearish_fvg bullish_fvg bearish_fvg fvg_50_level".split()}])],
)
_register(
    "bos_choch",
    "bullish_bos bearish_bos bullish_choch bearish_choch hh_hl_structure lh_ll_structure",
    "swing_high_5 swing_low_5",
)
_register(
    "liquidity_levels",
    "buy_side_liquidity sell_side_liquidity bsl_swept ssl_swept liq_sweep_bull liq_sweep_bear liquidity_swept",
    "bsl_level ssl_level",
)
_register("round_numbers", "round_number_near", "round_number_level")
_register("role_reversal", "role_reversal_bull role_reversal_bear")
_register(
    "momentum_runs",
    "momentum_bull_count momentum_bear_count consolidation breakout_real_bull breakout_real_bear",
)
_register(
    "premium_discount",
    "in_premium_zone at_equilibrium in_discount_zone in_ote_zone_bull in_ote_zone_bear in_ote_zone kz_asian kz_london "
    "kz_newyork kz_overlap kz_london_close kz_gold",
)
_register("smc_scores", "smc_bull_score smc_bear_score smc_net_score")


@query(
    "trend_label",
    with_(BARS, INDICATORS)
    + """SELECT key, bar_epoch, CASE WHEN ema_20 > e50 THEN 'up' WHEN ema_20 < e50 THEN 'down' ELSE 'range' END AS trend
FROM (SELECT key, bar_epoch, ema_20, ema_50 AS e50 FROM feat)""",
)
def trend_label(spark, sf):
    return indicator_frame(bars(spark, sf), ["averages"]).then(M.trend_label).core("key", epoch(), "trend")


def _mid(zones: str) -> str:
    return (
        f"list_min(list_transform({zones}, lambda z: abs(close - (z.lo + z.hi) / 2) / "
        "greatest((z.lo + z.hi) / 2, 1e-10::DOUBLE)))"
    )


@query(
    "zone_proximity",
    with_(BARS, NUMBERED, SMC)
    + f""", a AS (SELECT key, bar_epoch, close, list_transform(bo, lambda z: {{'lo': z.lo, 'hi': z.hi}})
    || list_transform(so, lambda z: {{'lo': z.lo, 'hi': z.hi}}) AS obs, bgs[-3:] || sgs[-3:] AS gaps FROM s3),
z AS (SELECT key, bar_epoch, {Q._in('obs')} AS in_ob, {Q._in('gaps')} AS in_fvg,
  {_mid('obs')} AS nearest_ob_dist, {_mid('gaps')} AS nearest_fvg_dist FROM a)
SELECT key, bar_epoch, in_ob, in_fvg, CAST(in_ob OR in_fvg AS INTEGER) AS zone_reaction,
  {rd('nearest_ob_dist', 'nearest_fvg_dist')},
  CASE WHEN in_ob OR in_fvg THEN 90::DOUBLE
    WHEN coalesce(nearest_ob_dist < 0.01::DOUBLE, false) OR coalesce(nearest_fvg_dist < 0.01::DOUBLE, false) THEN 60 ELSE 0 END AS zone_score
FROM z""",
)
def zone_proximity(spark, sf):
    f = frame(bars(spark, sf), back=REACH).then((M.order_blocks, M.fair_value_gaps))

    def live_zones(name: str, reach: int):
        return F.filter(F.col(name), lambda z: z["at"] >= F.col("rn") - reach)

    live = {
        f"{side}_{kind}": live_zones(f"{side}_{kind}", reach)
        for side in ("bull", "bear")
        for kind, reach in (("obs", M.LOOKBACK - 51), ("fvgs", 49))
    }
    return M.zone_proximity(f.with_columns(live).core()).select(
        "key", epoch(), "in_ob", "in_fvg", "zone_reaction", *rounded("nearest_ob_dist", "nearest_fvg_dist"), "zone_score"
    )


@query(
    "institutional",
    with_(BARS, INDICATORS, Q.inst_sql("feat"))
    + f"SELECT key, bar_epoch, {ii(*P.INSTITUTIONAL, 'inst_bull_score', 'inst_bear_score')} FROM insts",
)
def institutional(spark, sf):
    f = indicator_frame(bars(spark, sf), ["rsi"]).then(P.institutional)
    return f.core("key", epoch(), *ints(*P.INSTITUTIONAL, "inst_bull_score", "inst_bear_score"))


_register("wyckoff", " ".join(P.WYCKOFF), steps=[P.wyckoff], sql=Q.wyckoff_sql("b"), table="wyck")


@query(
    "wyckoff_volume",
    with_(VOLUME_BARS, NUMBERED, Q.wyckoff_sql("b")) + f"SELECT key, bar_epoch, {ii(*P.WYCKOFF)} FROM wyck",
)
def wyckoff_volume(spark, sf):
    return frame(volume_bars(spark, sf), back=64).then(P.wyckoff).core("key", epoch(), *ints(*P.WYCKOFF))


_register(
    "elliott_waves",
    "elliott_impulse_bull elliott_impulse_bear elliott_correction elliott_wave_count",
    "elliott_wave_ratio",
    steps=[P.elliott],
    sql=Q.elliott_sql("b"),
    table="elli",
)
_register(
    "supply_demand",
    "sd_demand_zone sd_supply_zone sd_at_demand sd_at_supply sd_zone_fresh",
    "sd_zone_strength",
    steps=[P.supply_demand],
    sql=Q.supply_demand_sql("b"),
    table="sd",
)
_register("chart_patterns", " ".join(P.CHART), steps=[P.chart_patterns], sql=Q.chart_sql("b"), table="chart")
_register("harmonics", " ".join(P.HARMONIC_NAMES), steps=[P.harmonics], sql=Q.harmonic_sql("b"), table="harm")

_ADVANCED = [*P.WYCKOFF, *P.ELLIOTT, *P.SUPPLY_DEMAND, *P.CHART]
_register(
    "advanced_patterns",
    " ".join(n for n in _ADVANCED if n not in ("elliott_wave_ratio", "sd_zone_strength")),
    "elliott_wave_ratio sd_zone_strength",
    steps=[(P.wyckoff, P.elliott, P.supply_demand, P.chart_patterns)],
    sql=Q.wyckoff_sql("b") + Q.elliott_sql("wyck") + Q.supply_demand_sql("elli") + Q.chart_sql("sd"),
    table="chart",
)

_RF = [n for n in P.REACTION if n.startswith(("pin", "bull_e", "bear_e", "engulf", "close_u", "close_l"))]
_RN = [n for n in P.REACTION if n not in _RF]
_register(
    "candle_reaction",
    " ".join(_RF),
    " ".join(_RN),
    steps=[(M.order_blocks, M.fair_value_gaps), lambda f: iter([{
        n: F.when(F.col("rn") >= 19, F.col(n)).otherwise(0) for n in
        ("price_at_bullish_ob", "price_at_bearish_ob", "price_in_bullish_fvg", "price_in_bearish_fvg")}]),
        P.candle_reaction],
    sql=SMC + Q.reaction_sql("smcn"),
    table="react",
)
_register(
    "candle_reaction_range",
    " ".join(_RF),
    " ".join(_RN),
    steps=[lambda f: P.candle_reaction(f, engulf="range", size="range", zones=False, min_rows=2)],
    sql=Q.reaction_sql("b", "range", "range", False, 2),
    table="react",
)


@query(
    "wick_geometry",
    with_(BARS, NUMBERED)
    + f""", g AS (SELECT *, greatest(high - low, 1e-10::DOUBLE) AS rg, high - greatest(open, close) AS uw,
  least(open, close) - low AS lw FROM b),
o AS (SELECT key, bar_epoch, body / rg AS body_pct, uw / rg AS upper_wick_pct, lw / rg AS lower_wick_pct,
  body / greatest(uw, 1e-10::DOUBLE) AS body_to_upper_wick, body / greatest(lw, 1e-10::DOUBLE) AS body_to_lower_wick,
  (close - low) / rg AS close_pos, close > open AS is_bull, body < rg * 0.05::DOUBLE AS is_doji,
  lw >= body * 2 AND body <= rg * 0.25::DOUBLE AS is_pin_bull, uw >= body * 2 AND body <= rg * 0.25::DOUBLE AS is_pin_bear FROM g)
SELECT key, bar_epoch, {ii('is_bull', 'is_doji', 'is_pin_bull', 'is_pin_bear')},
  {rd('body_pct', 'upper_wick_pct', 'lower_wick_pct', 'close_pos')},
  {rd('body_to_upper_wick', 'body_to_lower_wick', digits=3)} FROM o""",
)
def wick_geometry(spark, sf):
    return P.wick_geometry(bars(spark, sf, reuse=False)).select(
        "key",
        epoch(),
        *ints("is_bull", "is_doji", "is_pin_bull", "is_pin_bear"),
        *rounded("body_pct", "upper_wick_pct", "lower_wick_pct", "close_pos"),
        *rounded("body_to_upper_wick", "body_to_lower_wick", digits=3),
    )


_CANDLE_SQL = f""",
k1 AS (SELECT *, lag(open, 1) {S} AS o1, lag(close, 1) {S} AS c1, lag(high, 1) {S} AS h1, lag(low, 1) {S} AS l1,
  lag(open, 2) {S} AS o2, lag(close, 2) {S} AS c2, greatest(high - low, 1e-10::DOUBLE) AS rg, avg(spread) {w(14)} AS y,
  high - greatest(open, close) AS uw, least(open, close) - low AS lw FROM b),
k2 AS (SELECT *, abs(c1 - o1) AS b1, close > open AS g, close < open AS d, c1 > o1 AS g1, c1 < o1 AS d1, c2 > o2 AS g2, c2 < o2 AS d2 FROM k1),
candles AS (SELECT key, bar_epoch, rn,
  lw >= body * 2 AND body <= rg * 0.3::DOUBLE AND uw <= body * 0.5::DOUBLE AND g AS hammer,
  uw >= body * 2 AND body <= rg * 0.3::DOUBLE AND lw <= body * 0.5::DOUBLE AND d1 AS inverted_hammer,
  g AND d1 AND open <= c1 AND close >= o1 AS bullish_engulfing,
  d1 AND g AND open > c1 AND close < o1 AND body < b1 * 0.5::DOUBLE AS bullish_harami,
  d2 AND b1 < y * 0.3::DOUBLE AND g AND close > (o2 + c2) / 2 AS morning_star,
  body < rg * 0.1::DOUBLE AND lw > rg * 0.6::DOUBLE AS dragonfly_doji,
  abs(low - l1) < y * 0.05::DOUBLE AND g AND d1 AS tweezer_bottom,
  g AND g1 AND g2 AND close > c1 AND c1 > c2 AND body > y * 0.5::DOUBLE AND b1 > y * 0.5::DOUBLE AS three_white_soldiers,
  g AND body > y * 0.8::DOUBLE AND lw < body * 0.05::DOUBLE AND uw < body * 0.05::DOUBLE AS marubozu_bull,
  uw >= body * 2 AND body <= rg * 0.3::DOUBLE AND lw <= body * 0.5::DOUBLE AND d AS shooting_star,
  lw >= body * 2 AND body <= rg * 0.3::DOUBLE AND d AS hanging_man,
  d AND g1 AND open >= c1 AND close <= o1 AS bearish_engulfing,
  g1 AND d AND open < c1 AND close > o1 AND body < b1 * 0.5::DOUBLE AS bearish_harami,
  g2 AND b1 < y * 0.3::DOUBLE AND d AND close < (o2 + c2) / 2 AS evening_star,
  body < rg * 0.1::DOUBLE AND uw > rg * 0.6::DOUBLE AS gravestone_doji,
  abs(high - h1) < y * 0.05::DOUBLE AND d AND g1 AS tweezer_top,
  d AND d1 AND d2 AND close < c1 AND c1 < c2 AND body > y * 0.5::DOUBLE AND b1 > y * 0.5::DOUBLE AS three_black_crows,
  d AND body > y * 0.8::DOUBLE AND lw < body * 0.05::DOUBLE AND uw < body * 0.05::DOUBLE AS marubozu_bear FROM k2)"""


@query(
    "candlestick_18",
    with_(BARS, NUMBERED, _CANDLE_SQL)
    + "SELECT key, bar_epoch, "
    + ", ".join(f"CASE WHEN rn >= 2 AND {c} THEN 1 ELSE 0 END AS {c}" for c in P.CANDLESTICKS)
    + " FROM candles",
)
def candlestick_18(spark, sf):
    return frame(bars(spark, sf), back=16).then(P.candlesticks).core("key", epoch(), *ints(*P.CANDLESTICKS))


@query(
    "candlestick_counts",
    with_(BARS, NUMBERED, _CANDLE_SQL)
    + ", u AS (UNPIVOT (SELECT key, "
    + ", ".join(f"CASE WHEN rn >= 2 AND {c} THEN 1 ELSE 0 END AS {c}" for c in P.CANDLESTICKS)
    + f" FROM candles) ON {', '.join(P.CANDLESTICKS)} INTO NAME pattern VALUE hit)"
    + " SELECT key, pattern, CAST(sum(hit) AS BIGINT) AS hits FROM u GROUP BY key, pattern",
)
def candlestick_counts(spark, sf):
    wide = frame(bars(spark, sf), back=16).then(P.candlesticks).core("key", *ints(*P.CANDLESTICKS))
    long = wide.unpivot(["key"], P.CANDLESTICKS, "pattern", "hit")
    return long.groupBy("key", "pattern").agg(F.sum("hit").alias("hits"))


@query(
    "harmonic_boost",
    with_(BARS, NUMBERED, Q.harmonic_sql("b"))
    + """, d AS (SELECT *, CASE WHEN close > open THEN 'GREEN' ELSE 'RED' END AS direction FROM harm)
SELECT key, bar_epoch, direction, CASE
  WHEN direction = 'GREEN' AND greatest(gartley_bull, bat_bull, butterfly_bull, crab_bull) = 1 THEN 0.05::DOUBLE
  WHEN direction = 'RED' AND greatest(gartley_bear, bat_bear, butterfly_bear, crab_bear) = 1 THEN 0.05::DOUBLE
  ELSE 0 END AS boost FROM d""",
)
def harmonic_boost(spark, sf):
    f = frame(bars(spark, sf), back=REACH).then(P.harmonics)
    direction = F.when(F.col("close") > F.col("open"), "GREEN").otherwise("RED")
    return f.core("key", epoch(), direction.alias("direction"), P.harmonic_boost(direction).alias("boost"))
