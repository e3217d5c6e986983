"""SQL for market structure and patterns, over `b` (numbered bars) or `feat`."""

from __future__ import annotations

from barloom.plans.sqlparts import S, strict, w


def flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"


def _seen(column: str, first: int, last: int = 0) -> str:
    """Ordered list of the non-null values from `first` to `last` rows back."""
    end = "CURRENT ROW" if last == 0 else f"{last} PRECEDING"
    return (
        f"coalesce(list({column}) FILTER ({column} IS NOT NULL) OVER (PARTITION BY key ORDER BY bar_epoch "
        f"ROWS BETWEEN {first} PRECEDING AND {end}), [])"
    )


def _pool(column: str, level: str) -> str:
    return f"len(list_filter({column}, lambda v: abs(v - {level}) < atr * 0.3::DOUBLE)) >= 2"


def _in(zones: str) -> str:
    return f"len(list_filter({zones}, lambda z: close >= z.lo AND close <= z.hi)) > 0"


def _round(mult: int) -> str:
    near = f"round_even(close / (mag * {mult}), 0) * (mag * {mult})"
    return f"CASE WHEN abs(close - {near}) < atr * 0.3::DOUBLE THEN {near} END"


def _run(sign: str) -> str:
    terms = []
    for k in range(5):
        cond = " AND ".join(f"lag(close, {i}) {S} {sign} lag(open, {i}) {S}" for i in range(k + 1))
        terms.append(f"({flag(cond)})")
    return " + ".join(terms)


H3 = "(list_extract({0}, -1))"


def smc_sql(source: str) -> str:
    """`smc`: structure columns; `source` needs ema-free bars with rn."""
    return f""",
s1 AS (SELECT *, ({strict('avg', 'spread', 14)}) + 1e-10::DOUBLE AS atr, lag(close) {S} AS pc1,
  CASE WHEN count(*) {w(11)} = 11 AND lag(high, 5) {S} = max(high) {w(11)} THEN lag(high, 5) {S} END AS sh_at,
  CASE WHEN count(*) {w(11)} = 11 AND lag(low, 5) {S} = min(low) {w(11)} THEN lag(low, 5) {S} END AS sl_at,
  CASE WHEN rn >= 51 AND lag(close, 1) {S} < lag(open, 1) {S} AND close > lag(high, 1) {S}
    THEN {{'at': rn - 1, 'lo': lag(low, 1) {S}, 'hi': lag(high, 1) {S}}} END AS bull_ob,
  CASE WHEN rn >= 51 AND lag(close, 1) {S} > lag(open, 1) {S} AND close < lag(low, 1) {S}
    THEN {{'at': rn - 1, 'lo': lag(low, 1) {S}, 'hi': lag(high, 1) {S}}} END AS bear_ob,
  CASE WHEN rn >= 3 AND low > lag(high, 2) {S} THEN {{'lo': lag(high, 2) {S}, 'hi': low}} END AS bull_gap,
  CASE WHEN rn >= 3 AND high < lag(low, 2) {S} THEN {{'lo': high, 'hi': lag(low, 2) {S}}} END AS bear_gap,
  avg(spread) {w(5)} AS hl5, avg(spread) {w(20)} AS hl20,
  max(high) {w(50)} AS hi50, min(low) {w(50)} AS lo50, max(high) {w(20)} AS hi20, min(low) {w(20)} AS lo20,
  max(high) {w(21, 1)} AS top_b, min(low) {w(21, 1)} AS low_b,
  max(high) {w(20, 1)} AS top_p, min(low) {w(20, 1)} AS low_p,
  max(high) {w(22, 2)} AS top_then, min(low) {w(22, 2)} AS low_then,
  list(high) {w(20)} AS highs, list(low) {w(20)} AS lows, list(high) {w(22, 2)} AS highs_then, list(low) {w(22, 2)} AS lows_then,
  max(high) {w(500)} AS hi500, min(low) {w(500)} AS lo500,
  pow(10.0::DOUBLE, greatest(floor(log10(nullif(abs(close), 0))) - 1, -3)) AS mag,
  {_run('>')} AS momentum_bull_count, {_run('<')} AS momentum_bear_count,
  bar_epoch % 86400 // 3600 AS hr FROM {source}),
s2 AS (SELECT *, {_seen('sh_at', 489)} AS shs, {_seen('sl_at', 489)} AS sls,
  list_filter({_seen('bull_ob', 499, 2)}, lambda z: z.at >= rn - 449) AS bobs,
  list_filter({_seen('bear_ob', 499, 2)}, lambda z: z.at >= rn - 449) AS sobs,
  {_seen('bull_gap', 48)} AS bgs, {_seen('bear_gap', 48)} AS sgs FROM s1),
s3 AS (SELECT *, shs[-1] AS sh, CASE WHEN len(shs) > 1 THEN shs[-2] END AS sh2,
  sls[-1] AS sl, CASE WHEN len(sls) > 1 THEN sls[-2] END AS sl2,
  bobs[-3:] AS bo, sobs[-3:] AS so, bgs[-3:] AS bg, sgs[-3:] AS sg,
  coalesce({", ".join(_round(m) for m in (1, 2, 5, 10, 50))}) AS rnd FROM s2),
s4 AS (SELECT *, coalesce(sh, hi20) AS leg_top, coalesce(sl, lo20) AS leg_low,
  sh2 IS NOT NULL AND pc1 > sh AS broke_up, sl2 IS NOT NULL AND pc1 < sl AS broke_down FROM s3),
s5 AS (SELECT *, (leg_top - close) / (leg_top - leg_low + 1e-10::DOUBLE) AS dn_r,
  (close - leg_low) / (leg_top - leg_low + 1e-10::DOUBLE) AS up_r,
  (close - lo50) / (hi50 - lo50 + 1e-10::DOUBLE) AS pos50,
  {_pool('highs_then', 'top_then')} AND lag(high) {S} > top_then AND pc1 < top_then AS bsl_hit,
  {_pool('lows_then', 'low_then')} AND lag(low) {S} < low_then AND pc1 > low_then AS ssl_hit,
  broke_up AND sl2 IS NOT NULL AND sh < sh2 AS choch_up FROM s4),
s6 AS (SELECT *, rn >= 19 AS ok,
  coalesce(sh, hi500) AS swing_high_5r, coalesce(sl, lo500) AS swing_low_5r FROM s5),
smc AS (SELECT *,
  {flag('ok AND broke_up')} AS bullish_bos, {flag('ok AND NOT coalesce(broke_up, false) AND broke_down')} AS bearish_bos,
  {flag('ok AND choch_up')} AS bullish_choch,
  {flag('ok AND NOT coalesce(choch_up, false) AND sh2 IS NOT NULL AND broke_down AND sl > sl2')} AS bearish_choch,
  {flag('ok AND sh > sh2 AND sl > sl2')} AS hh_hl_structure, {flag('ok AND sh < sh2 AND sl < sl2')} AS lh_ll_structure,
  {flag('ok AND ' + _in('bo'))} AS price_at_bullish_ob, {flag('ok AND ' + _in('so'))} AS price_at_bearish_ob,
  {flag('ok AND ' + _in('bg'))} AS price_in_bullish_fvg, {flag('ok AND ' + _in('sg'))} AS price_in_bearish_fvg,
  {flag('ok AND len(bg) > 0')} AS bullish_fvg, {flag('ok AND len(sg) > 0')} AS bearish_fvg,
  CASE WHEN ok AND len(bg) > 0 THEN (bg[-1].lo + bg[-1].hi) / 2 ELSE 0 END AS fvg_50_level,
  {flag('ok AND ' + _pool('highs', 'hi20'))} AS buy_side_liquidity, {flag('ok AND ' + _pool('lows', 'lo20'))} AS sell_side_liquidity,
  CASE WHEN ok AND {_pool('highs', 'hi20')} THEN hi20 ELSE 0 END AS bsl_level,
  CASE WHEN ok AND {_pool('lows', 'lo20')} THEN lo20 ELSE 0 END AS ssl_level,
  {flag('ok AND bsl_hit')} AS bsl_swept, {flag('ok AND ssl_hit')} AS ssl_swept,
  {flag('ok AND ssl_hit')} AS liq_sweep_bull, {flag('ok AND bsl_hit')} AS liq_sweep_bear,
  {flag('''ok AND (coalesce(close < top_p AND high > top_p, false) OR coalesce(close > low_p AND low < low_p, false)
     OR coalesce(bsl_hit, false) OR coalesce(ssl_hit, false))''')} AS liquidity_swept,
  {flag('ok AND rnd IS NOT NULL')} AS round_number_near, CASE WHEN ok THEN coalesce(rnd, 0) ELSE 0 END AS round_number_level,
  {flag('ok AND len(list_filter(shs[1:len(shs) - 1], lambda v: abs(close - v) < atr * 0.6::DOUBLE)) > 0')} AS role_reversal_bull,
  {flag('ok AND len(list_filter(sls[1:len(sls) - 1], lambda v: abs(close - v) < atr * 0.6::DOUBLE)) > 0')} AS role_reversal_bear,
  {flag('ok AND hl5 < hl20 * 0.45::DOUBLE')} AS consolidation,
  {flag('ok AND body > atr * 0.6::DOUBLE AND close > top_b')} AS breakout_real_bull,
  {flag('ok AND body > atr * 0.6::DOUBLE AND close < low_b')} AS breakout_real_bear,
  {flag('ok AND pos50 > 0.618::DOUBLE')} AS in_premium_zone, {flag('ok AND pos50 < 0.382::DOUBLE')} AS in_discount_zone,
  {flag('ok AND pos50 > 0.45::DOUBLE AND pos50 < 0.55::DOUBLE')} AS at_equilibrium,
  {flag('ok AND dn_r > 0.62::DOUBLE AND dn_r < 0.79::DOUBLE')} AS in_ote_zone_bull,
  {flag('ok AND up_r > 0.62::DOUBLE AND up_r < 0.79::DOUBLE')} AS in_ote_zone_bear,
  {flag('ok AND (dn_r > 0.62::DOUBLE AND dn_r < 0.79::DOUBLE OR up_r > 0.62::DOUBLE AND up_r < 0.79::DOUBLE)')} AS in_ote_zone,
  {flag('ok AND hr < 3')} AS kz_asian, {flag('ok AND hr >= 7 AND hr < 10')} AS kz_london,
  {flag('ok AND hr >= 12 AND hr < 15')} AS kz_newyork, {flag('ok AND hr >= 12 AND hr < 16')} AS kz_overlap,
  {flag('ok AND hr = 15')} AS kz_london_close, {flag('ok AND hr = 13')} AS kz_gold
FROM (SELECT * REPLACE (CASE WHEN rn >= 19 THEN momentum_bull_count ELSE 0 END AS momentum_bull_count,
  CASE WHEN rn >= 19 THEN momentum_bear_count ELSE 0 END AS momentum_bear_count),
  CASE WHEN ok THEN swing_high_5r ELSE 0 END AS swing_high_5, CASE WHEN ok THEN swing_low_5r ELSE 0 END AS swing_low_5 FROM s6)),
smcs AS (SELECT *,
  price_at_bullish_ob * 10 + price_in_bullish_fvg * 8 + bullish_bos * 7 + in_ote_zone_bull * 5 + in_discount_zone * 4
  + buy_side_liquidity * 4 + liq_sweep_bull * 8 + kz_london * 3 + kz_overlap * 3 + bullish_choch * 6
  + hh_hl_structure * 5 + role_reversal_bull * 6 + least(momentum_bull_count, 3) * 2 + breakout_real_bull * 4 AS smc_bull_score,
  price_at_bearish_ob * 10 + price_in_bearish_fvg * 8 + bearish_bos * 7 + in_ote_zone_bear * 5 + in_premium_zone * 4
  + sell_side_liquidity * 4 + liq_sweep_bear * 8 + kz_london * 3 + kz_overlap * 3 + bearish_choch * 6
  + lh_ll_structure * 5 + role_reversal_bear * 6 + least(momentum_bear_count, 3) * 2 + breakout_real_bear * 4 AS smc_bear_score
FROM smc),
smcn AS (SELECT *, smc_bull_score - smc_bear_score AS smc_net_score FROM smcs)"""


def inst_sql(source: str) -> str:
    """`inst`: institutional findings; `source` needs rsi_14."""
    return f""",
i1 AS (SELECT *, max(high) {w(20, 1)} AS t19, min(low) {w(20, 1)} AS l19, {strict('avg', 'spread', 14)} AS y14,
  max(high) {w(5)} - min(low) {w(5)} AS r5, max(high) {w(20)} - min(low) {w(20)} AS r20,
  min(low) {w(10, 1)} AS l9, max(high) {w(10, 1)} AS t9, min(rsi_14) {w(10, 1)} AS rl9, max(rsi_14) {w(10, 1)} AS rt9,
  lag(close, 4) {S} AS cl4, bar_epoch % 86400 // 3600 AS ihr FROM {source}),
inst AS (SELECT *,
  {flag('rn >= 19 AND low < l19 AND close > l19')} AS bullish_liquidity_sweep,
  {flag('rn >= 19 AND high > t19 AND close < t19')} AS bearish_liquidity_sweep,
  {flag('rn >= 19 AND body >= y14 * 1.5::DOUBLE AND close > open')} AS institutional_bullish,
  {flag('rn >= 19 AND body >= y14 * 1.5::DOUBLE AND close < open')} AS institutional_bearish,
  {flag('rn >= 19 AND ihr BETWEEN 7 AND 9')} AS kz_london_07_10, {flag('rn >= 19 AND ihr BETWEEN 12 AND 14')} AS kz_newyork_12_15,
  {flag('rn >= 19 AND ihr BETWEEN 12 AND 15')} AS kz_overlap_12_16,
  {flag('rn >= 19 AND ihr BETWEEN 7 AND 9 AND low < l19 AND close > l19 AND close > open')} AS judas_swing_bull,
  {flag('rn >= 19 AND ihr BETWEEN 7 AND 9 AND high > t19 AND close < t19 AND close < open')} AS judas_swing_bear,
  {flag('rn >= 19 AND r5 < r20 * 0.25::DOUBLE AND close - cl4 > y14 * 1.5::DOUBLE')} AS mm_bull_cycle,
  {flag('rn >= 19 AND r5 < r20 * 0.25::DOUBLE AND cl4 - close > y14 * 1.5::DOUBLE')} AS mm_bear_cycle,
  {flag('rn >= 19 AND body / (y14 + 1e-10::DOUBLE) > 1.8::DOUBLE AND close > open')} AS displacement_bull,
  {flag('rn >= 19 AND body / (y14 + 1e-10::DOUBLE) > 1.8::DOUBLE AND close < open')} AS displacement_bear,
  {flag('rn >= 19 AND low < l9 AND rsi_14 > rl9')} AS bullish_divergence,
  {flag('rn >= 19 AND high > t9 AND rsi_14 < rt9')} AS bearish_divergence,
  {flag('rn >= 19 AND ihr < 7')} AS po3_accumulation, {flag('rn >= 19 AND ihr BETWEEN 7 AND 11')} AS po3_manipulation,
  {flag('rn >= 19 AND ihr BETWEEN 12 AND 19')} AS po3_distribution FROM i1),
insts AS (SELECT *,
  bullish_liquidity_sweep * 8 + institutional_bullish * 6 + judas_swing_bull * 6 + mm_bull_cycle * 5
  + displacement_bull * 5 + bullish_divergence * 4 + kz_overlap_12_16 * 3 AS inst_bull_score,
  bearish_liquidity_sweep * 8 + institutional_bearish * 6 + judas_swing_bear * 6 + mm_bear_cycle * 5
  + displacement_bear * 5 + bearish_divergence * 4 + kz_overlap_12_16 * 3 AS inst_bear_score FROM inst)"""


def wyckoff_sql(source: str) -> str:
    narrow = "width < hl20 * 0.5::DOUBLE"
    return f""",
w1 AS (SELECT *, max(high) {w(51, 1)} AS wt, min(low) {w(51, 1)} AS wl, {strict('avg', 'volume', 20)} AS v20,
  {strict('avg', 'spread', 20)} AS whl20, lag(close, 1) {S} AS k1, lag(close, 2) {S} AS k2, lag(close, 4) {S} AS k4 FROM {source}),
w2 AS (SELECT *, wt - wl + 1e-10::DOUBLE AS width, rn >= 49 AS wok FROM w1),
wyck AS (SELECT *,
  {flag('wok AND width < whl20 * 0.5::DOUBLE AND close < wl + width * 0.35::DOUBLE')} AS wyckoff_accumulation,
  {flag('wok AND width < whl20 * 0.5::DOUBLE AND close > wt - width * 0.35::DOUBLE')} AS wyckoff_distribution,
  {flag('wok AND close > wt * 0.9::DOUBLE AND k4 < close')} AS wyckoff_markup,
  {flag('wok AND close < wl + width * 0.1::DOUBLE AND k4 > close')} AS wyckoff_markdown,
  {flag('wok AND low < wl AND close > wl')} AS wyckoff_spring, {flag('wok AND high > wt AND close < wt')} AS wyckoff_upthrust,
  {flag('wok AND close > wt AND close > k4')} AS wyckoff_sos, {flag('wok AND close < wl AND close < k4')} AS wyckoff_sow,
  {flag('wok AND volume > v20 * 2.5::DOUBLE AND close < k1 AND close < wl + width * 0.2::DOUBLE')} AS wyckoff_sc,
  {flag('wok AND close > k2 AND close < wl + width * 0.4::DOUBLE')} AS wyckoff_ar FROM w2)"""


def elliott_sql(source: str) -> str:
    return f""",
e1 AS (SELECT *, CASE WHEN count(*) {w(7)} = 7 AND (lag(close, 3) {S} = max(close) {w(7)} OR lag(close, 3) {S} = min(close) {w(7)})
  THEN lag(close, 3) {S} END AS pv FROM {source}),
e2 AS (SELECT *, {_seen('pv', 493)} AS pvs FROM e1),
e3 AS (SELECT *, pvs[-4] - pvs[-5] AS wv1, pvs[-3] - pvs[-4] AS wv2, pvs[-2] - pvs[-3] AS wv3,
  rn >= 29 AND len(pvs) >= 5 AS eok FROM e2),
elli AS (SELECT *,
  {flag('eok AND wv1 > 0 AND wv2 < 0 AND wv3 > 0 AND abs(wv3) > abs(wv1)')} AS elliott_impulse_bull,
  {flag('eok AND wv1 < 0 AND wv2 > 0 AND wv3 < 0 AND abs(wv3) > abs(wv1)')} AS elliott_impulse_bear,
  {flag('eok AND wv1 <> 0 AND wv2 <> 0 AND abs(wv3) < abs(wv1)')} AS elliott_correction,
  CASE WHEN eok THEN least(abs(wv3) / (abs(wv1) + 1e-10::DOUBLE), 5) ELSE 0 END AS elliott_wave_ratio,
  CASE WHEN eok THEN CAST(len(pvs) % 5 AS INTEGER) ELSE 0 END AS elliott_wave_count FROM e3)"""


def supply_demand_sql(source: str) -> str:
    return f""",
d1 AS (SELECT *, {strict('avg', 'spread', 10)} AS y10, min(low) {w(20)} AS dl20, max(high) {w(20)} AS dt20,
  min(low) {w(5)} AS dl5, avg(body) {w(5)} AS dep5, list(close - open) {w(30)} AS mv FROM {source}),
d2 AS (SELECT *, rn >= 19 AS dok, len(list_filter(mv, lambda m: m < y10 * -1.5::DOUBLE)) AS drops,
  len(list_filter(mv, lambda m: m > y10 * 1.5::DOUBLE)) AS rallies FROM d1),
sd AS (SELECT *, {flag('dok AND drops > 0 AND rallies > drops')} AS sd_demand_zone,
  {flag('dok AND rallies > 0 AND drops > rallies')} AS sd_supply_zone,
  {flag('dok AND close < dl20 + (dt20 - dl20) * 0.25::DOUBLE')} AS sd_at_demand,
  {flag('dok AND close > dt20 - (dt20 - dl20) * 0.25::DOUBLE')} AS sd_at_supply,
  CASE WHEN dok THEN least(dep5 / (y10 + 1e-10::DOUBLE) * 5, 10) ELSE 0 END AS sd_zone_strength,
  {flag('dok AND dl5 >= dl20 * 1.001::DOUBLE')} AS sd_zone_fresh FROM d2)"""


def chart_sql(source: str) -> str:
    return f""",
c1 AS (SELECT *, ({strict('avg', 'spread', 14)}) + 1e-10::DOUBLE AS cy, lag(high, 4) {S} AS h4, lag(high, 9) {S} AS h9,
  lag(low, 4) {S} AS l4, lag(low, 9) {S} AS l9x, lag(close, 9) {S} AS k9, lag(close, 14) {S} AS k14,
  max(high) {w(5)} - min(low) {w(5)} AS cr5, max(high) {w(20)} - min(low) {w(20)} AS cr20, rn >= 19 AS cok FROM {source}),
chart AS (SELECT *,
  {flag('cok AND abs(h4 - h9) < cy * 0.8::DOUBLE AND close < least(h4, h9) - cy')} AS chart_double_top,
  {flag('cok AND abs(l4 - l9x) < cy * 0.8::DOUBLE AND close > greatest(l4, l9x) + cy')} AS chart_double_bottom,
  {flag('cok AND k9 - k14 > cy * 2 AND close - k9 < 0 AND close - k9 > cy * -1.5::DOUBLE')} AS chart_bull_flag,
  {flag('cok AND k14 - k9 > cy * 2 AND k9 - close < 0 AND k9 - close > cy * -1.5::DOUBLE')} AS chart_bear_flag,
  {flag('cok AND cr20 > 0 AND cr5 < cr20 * 0.25::DOUBLE')} AS chart_consolidation FROM c1)"""


HARMONIC_LIMITS = {
    "gartley": "r1 BETWEEN 0.35908 AND 0.65508 AND r2 BETWEEN 0.35908 AND 0.93916 AND r3 BETWEEN 1.0622 AND 1.71508",
    "bat": "r1 BETWEEN 0.35908 AND 0.53 AND r2 BETWEEN 0.35908 AND 0.93916 AND r3 BETWEEN 1.52092 AND 2.77508",
    "butterfly": "r1 BETWEEN 0.35908 AND 0.65508 AND r2 BETWEEN 0.35908 AND 0.93916 AND r3 BETWEEN 1.52092 AND 2.77508",
    "crab": "r1 BETWEEN 0.35908 AND 0.65508 AND r2 BETWEEN 0.35908 AND 0.93916 AND r3 BETWEEN 2.46092 AND 3.83508",
}


def harmonic_sql(source: str) -> str:
    flags = ", ".join(
        f"{flag(f'hok AND {limits} AND turn {sign} 0')} AS {name}_{side}"
        for name, limits in HARMONIC_LIMITS.items()
        for side, sign in (("bull", "<"), ("bear", ">"))
    )
    return f""",
h1 AS (SELECT *, CASE WHEN count(*) {w(7)} < 7 THEN NULL WHEN lag(high, 3) {S} = max(high) {w(7)} THEN lag(high, 3) {S}
  WHEN lag(low, 3) {S} = min(low) {w(7)} THEN lag(low, 3) {S} END AS hp FROM {source}),
h2 AS (SELECT *, {_seen('hp', 493)} AS hps FROM h1),
h3 AS (SELECT *, abs(hps[-4] - hps[-5]) AS xa, abs(hps[-3] - hps[-4]) AS ab, abs(hps[-2] - hps[-3]) AS bc,
  abs(hps[-1] - hps[-2]) AS cd, hps[-1] - hps[-2] AS turn FROM h2),
h4 AS (SELECT *, rn >= 29 AND len(hps) >= 5 AND xa >= 1e-10::DOUBLE AS hok, ab / (xa + 1e-10::DOUBLE) AS r1,
  bc / (ab + 1e-10::DOUBLE) AS r2, cd / (bc + 1e-10::DOUBLE) AS r3 FROM h3),
harm AS (SELECT *, {flags} FROM h4)"""


def reaction_sql(source: str, engulf: str = "body", size: str = "true_range", zones: bool = True, min_rows: int = 3) -> str:
    """`react`: candle reaction; with zones, `source` needs the structure flags."""
    tr = "CASE WHEN {p} IS NOT NULL THEN greatest(high - low, abs(high - {p}), abs(low - {p})) END".format(p=f"lag(close) {S}")
    if size != "true_range":
        tr = "high - low"
    if engulf == "body":
        bull = "close > open AND close >= greatest(po, q1) AND open <= least(po, q1) AND body > abs(q1 - po)"
        bear = "close < open AND close <= least(po, q1) AND open >= greatest(po, q1) AND body > abs(q1 - po)"
    else:
        bull = "close > open AND close > ph AND open < pl AND body > abs(q1 - po)"
        bear = "close < open AND close < pl AND open > ph AND body > abs(q1 - po)"
    bz = "(price_in_bullish_fvg = 1 OR price_at_bullish_ob = 1) AND close > (high + low) / 2" if zones else "false"
    sz = f"NOT ({bz}) AND (price_in_bearish_fvg = 1 OR price_at_bearish_ob = 1) AND close < (high + low) / 2" if zones else "false"

    def side(wick: str, pin: str, pos: str, mom: str, eng: str, zone: str) -> str:
        return (
            f"{wick} / rg * 100 * 0.20::DOUBLE + (CASE WHEN {pin} = 1 THEN 85 ELSE {wick} / rg * 60 END) * 0.18::DOUBLE "
            f"+ {pos} * 100 * 0.18::DOUBLE + (CASE WHEN {mom} THEN 75 ELSE 20 END) * 0.15::DOUBLE + ats * 0.10::DOUBLE "
            f"+ (CASE WHEN {eng} = 1 THEN 95 ELSE 0 END) * 0.14::DOUBLE + (CASE WHEN {zone} THEN 90 ELSE 0 END) * 0.05::DOUBLE"
        )

    d = f"rn < {min_rows - 1}"
    return f""",
r1 AS (SELECT *, lag(open) {S} AS po, lag(close) {S} AS q1, lag(high) {S} AS ph, lag(low) {S} AS pl,
  greatest(high - low, 1e-10::DOUBLE) AS rg, least(open, close) - low AS lw, high - greatest(open, close) AS uw, {tr} AS rtr FROM {source}),
r2 AS (SELECT *, avg(rtr) {w(14)} AS ratr FROM r1),
r3 AS (SELECT *, least(rg / (ratr + 1e-10::DOUBLE) * 70, 100) AS ats, (close - low) / rg AS cp,
  {flag('lw >= body * 2 AND body <= rg * 0.25::DOUBLE')} AS pb, {flag('uw >= body * 2 AND body <= rg * 0.25::DOUBLE')} AS ps,
  {flag(bull)} AS eb, {flag(bear)} AS es FROM r2),
r4 AS (SELECT *, {side('lw', 'pb', 'cp', 'close > q1 AND close > open', 'eb', bz)} AS bs,
  {side('uw', 'ps', '(1 - cp)', 'close < q1 AND close < open', 'es', sz)} AS ss FROM r3),
react AS (SELECT *, CASE WHEN {d} THEN 50 ELSE bs END AS bull_score, CASE WHEN {d} THEN 50 ELSE ss END AS bear_score,
  CASE WHEN {d} THEN 0 ELSE bs - ss END AS net_score, CASE WHEN {d} THEN 0 ELSE (bs - ss) / 100 * 0.12::DOUBLE END AS signal_boost,
  CASE WHEN {d} THEN 0 ELSE greatest(pb, ps) END AS pin_bar, CASE WHEN {d} THEN 0 ELSE greatest(eb, es) END AS engulfing,
  CASE WHEN {d} THEN 0 ELSE pb END AS pin_bull, CASE WHEN {d} THEN 0 ELSE ps END AS pin_bear,
  CASE WHEN {d} THEN 0 ELSE eb END AS bull_engulf, CASE WHEN {d} THEN 0 ELSE es END AS bear_engulf,
  CASE WHEN {d} THEN 50 ELSE ats END AS atr_score, CASE WHEN {d} THEN 0.5 ELSE cp END AS close_pos,
  CASE WHEN NOT ({d}) AND cp > 0.67::DOUBLE THEN 1 ELSE 0 END AS close_upper_third,
  CASE WHEN NOT ({d}) AND cp < 0.33::DOUBLE THEN 1 ELSE 0 END AS close_lower_third FROM r4)"""
