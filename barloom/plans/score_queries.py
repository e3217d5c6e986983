"""Rules, votes, points, consensus, decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import patterns as P
from barloom.operators import profile as V
from barloom.operators import scoring as K
from barloom.operators import training as J
from barloom.operators import voting as G
from barloom.operators import zones as Z
from barloom.operators.analysis import analyse, score
from barloom.operators.indicators import indicator_frame
from barloom.operators.mtf import boost_table, timeframe_agreement
from barloom.operators.series import number_rows
from barloom.operators.structure import FINDINGS, FOUNDATIONS, LOOKBACK, scores
from barloom.plans import context_queries as C
from barloom.plans import structure_sql as Q
from barloom.plans.registry import epoch, query, r, rounded
from barloom.plans.sqlparts import BARS, INDICATORS, NUMBERED, S, rd, with_
from barloom.session import cut_lineage
from barloom.sources.samples import bars

# ---------------------------------------------------------------- model probabilities

MODELS = {"boosted": (7, 3, 0.58), "forest": (11, 5, 0.545), "logistic": (13, 2, 0.51)}

PROBS = """,
probs AS (SELECT key, bar_epoch, m.model, m.acc,
  0.30::DOUBLE + ((bar_epoch // 3600 * m.a + length(key) * m.b) % 41) / 100.0::DOUBLE AS prob
  FROM b, (VALUES ('boosted', 7, 3, 0.58::DOUBLE), ('forest', 11, 5, 0.545::DOUBLE), ('logistic', 13, 2, 0.51::DOUBLE)) AS m(model, a, b, acc)),
fused AS (SELECT key, bar_epoch, round(sum(prob * greatest({floor}::DOUBLE, acc - 0.5::DOUBLE)) / sum(greatest({floor}::DOUBLE, acc - 0.5::DOUBLE)), 9) AS base_prob,
  count(*) AS n_models, avg(CASE WHEN prob < 0.5::DOUBLE THEN 1.0::DOUBLE ELSE 0 END) AS oppose_share_green,
  avg(CASE WHEN prob > 0.5::DOUBLE THEN 1.0::DOUBLE ELSE 0 END) AS oppose_share_red FROM probs GROUP BY ALL)"""


def model_probs(spark, sf, source=None):
    """Stand-in model probabilities of every bar, from its position in time and its key."""
    source = bars(spark, sf) if source is None else source
    hour = F.floor(F.unix_timestamp("bar_start") / 3600)
    entries = [
        F.struct(
            F.lit(name).alias("model"),
            (0.30 + ((hour * a + F.length("key") * b) % 41) / 100.0).alias("prob"),
        )
        for name, (a, b, _) in MODELS.items()
    ]
    return source.select("key", "bar_start", F.explode(F.array(*entries)).alias("_m")).select("key", "bar_start", "_m.*")


def accuracies(spark):
    return spark.createDataFrame([(n, acc) for n, (_, _, acc) in MODELS.items()], "model string, accuracy double")


@query(
    "prob_fusion",
    with_(BARS, NUMBERED, PROBS.format(floor=0.05))
    + f"SELECT key, bar_epoch, n_models, {rd('base_prob', 'oppose_share_green', 'oppose_share_red')} FROM fused",
)
def prob_fusion(spark, sf):
    fused = J.fuse(model_probs(spark, sf), accuracies(spark))
    return fused.select("key", epoch(), "n_models", *rounded("base_prob", "oppose_share_green", "oppose_share_red"))


@query(
    "prob_fusion_all_models",
    with_(BARS, NUMBERED, PROBS.format(floor=0.02)) + f"SELECT key, bar_epoch, {rd('base_prob')} FROM fused",
)
def prob_fusion_all_models(spark, sf):
    """Fusion over all members, with the lower skill floor and default."""
    fused = J.fuse(model_probs(spark, sf), accuracies(spark), floor=0.02, default=0.52)
    return fused.select("key", epoch(), *rounded("base_prob"))


@query(
    "model_agreement",
    with_(BARS, NUMBERED, PROBS.format(floor=0.05))
    + """SELECT key, bar_epoch, count(*) FILTER (prob > 0.5::DOUBLE) AS accepting,
  round(avg(CASE WHEN prob > 0.5::DOUBLE THEN 1.0::DOUBLE ELSE 0 END) + 1e-11::DOUBLE, 6) + 0.0::DOUBLE AS accept_share,
  round(avg(prob) FILTER (prob > 0.5::DOUBLE) + 1e-11::DOUBLE, 6) + 0.0::DOUBLE AS accept_confidence,
  arg_max(model, row(abs(prob - 0.5::DOUBLE), model)) AS most_decisive FROM probs GROUP BY key, bar_epoch""",
)
def model_agreement(spark, sf):
    return J.model_agreement(model_probs(spark, sf)).select(
        "key", epoch(), "accepting", *rounded("accept_share", "accept_confidence"), "most_decisive"
    )


@query(
    "stacking_matrix",
    with_(BARS, NUMBERED, PROBS.format(floor=0.05))
    + """SELECT key, bar_epoch, round(max(prob) FILTER (model = 'boosted') + 1e-11::DOUBLE, 6) AS boosted,
  round(max(prob) FILTER (model = 'forest') + 1e-11::DOUBLE, 6) AS forest, round(max(prob) FILTER (model = 'logistic') + 1e-11::DOUBLE, 6) AS logistic
FROM probs GROUP BY key, bar_epoch""",
)
def stacking_matrix(spark, sf):
    return J.stacking_rows(model_probs(spark, sf), list(MODELS)).select("key", epoch(), *rounded(*MODELS))


# ---------------------------------------------------------------- rules and points over the bar table

WIDE = (
    INDICATORS
    + Q.smc_sql("feat")
    + Q.inst_sql("smcn")
    + Q.wyckoff_sql("insts")
    + Q.elliott_sql("wyck")
    + Q.supply_demand_sql("elli")
    + Q.chart_sql("sd")
    + Q.harmonic_sql("chart")
    + Q.reaction_sql("harm")
)

_PAIRS = {
    "ob": ("price_at_bullish_ob", "price_at_bearish_ob"), "gap": ("price_in_bullish_fvg", "price_in_bearish_fvg"),
    "ote": ("in_ote_zone_bull", "in_ote_zone_bear"), "sweep": ("bullish_liquidity_sweep", "bearish_liquidity_sweep"),
    "swept": ("ssl_swept", "bsl_swept"), "edge": ("in_discount_zone", "in_premium_zone"),
    "turn": ("bullish_choch", "bearish_choch"), "pin": ("pin_bull", "pin_bear"), "eng": ("bull_engulf", "bear_engulf"),
    "bos": ("bullish_bos", "bearish_bos"), "judas": ("judas_swing_bull", "judas_swing_bear"),
    "liq": ("liq_sweep_bull", "liq_sweep_bear"), "struct": ("hh_hl_structure", "lh_ll_structure"),
    "role": ("role_reversal_bull", "role_reversal_bear"), "run": ("momentum_bull_count", "momentum_bear_count"),
}


def _rule_side(i: int) -> str:
    c = {name: pair[i] for name, pair in _PAIRS.items()}
    net = "net_score" if i == 0 else "(-net_score)"
    pd = (
        f"({c['ob']} * 3 + {c['gap']} * 2 + greatest({c['swept']}, {c['sweep']}) * 3 + {c['ote']} * 2 + {c['edge']} + {c['turn']} * 2)"
    )
    return f"""{c['ob']} * {c['bos']} * 20 * kz + {c['gap']} * 15 * kz + {c['ote']} * 10 + {c['sweep']} * 18 * kz + {c['judas']} * 15
  + CASE WHEN {net} > 40 THEN least({net} * 0.3::DOUBLE, 15) ELSE 0 END + {c['pin']} * greatest({c['ob']}, {c['gap']}) * 12
  + {c['eng']} * 10 + {c['liq']} * 20 * kz + CASE WHEN {pd} >= 5 THEN {pd} * 2 * kz ELSE 0 END
  + greatest({c['swept']}, {c['sweep']}) * {c['turn']} * greatest({c['ob']}, {c['gap']}) * 35 * kz
  + {c['struct']} * greatest({c['ob']}, {c['ote']}, {c['edge']}) * 12 * kz + {c['role']} * greatest({c['pin']}, {c['eng']}) * 15 * kz
  + CASE WHEN round_number_near = 1 AND {net} > 30 THEN 8 ELSE 0 END + CASE WHEN {c['run']} >= 3 THEN least({c['run']} * 2, 8) ELSE 0 END"""


RULES = f""",
ru0 AS (SELECT *, CASE WHEN utc_hour BETWEEN 7 AND 9 OR utc_hour BETWEEN 12 AND 15 THEN 1.3::DOUBLE ELSE 1 END AS kz FROM {{src}}),
ru1 AS (SELECT *, {_rule_side(0)} AS rb, {_rule_side(1)} AS rs FROM ru0),
ru2 AS (SELECT *, rb + CASE WHEN close_upper_third = 1 AND rb > rs THEN 6 ELSE 0 END AS rb2 FROM ru1),
ru3 AS (SELECT *, (rb2 + breakout_real_bull * 10) * CASE WHEN consolidation = 1 THEN 0.5::DOUBLE ELSE 1 END AS rule_bull,
  (rs + CASE WHEN close_lower_third = 1 AND rs > rb2 THEN 6 ELSE 0 END + breakout_real_bear * 10) * CASE WHEN consolidation = 1 THEN 0.5::DOUBLE ELSE 1 END AS rule_bear FROM ru2),
ru4 AS (SELECT *, CASE WHEN rn >= 9 AND rule_bull > rule_bear AND rule_bull > 15 THEN 'GREEN'
  WHEN rn >= 9 AND rule_bear > rule_bull AND rule_bear > 15 THEN 'RED' ELSE 'SKIP' END AS rule_direction FROM ru3),
rules AS (SELECT *, CASE WHEN rule_direction = 'SKIP' THEN 0 ELSE least(0.5::DOUBLE + greatest(rule_bull, rule_bear) / 160 * 0.45::DOUBLE, 0.95::DOUBLE) END AS rule_confidence FROM ru4)"""

_STEPS = ((*FOUNDATIONS, P.institutional), FINDINGS, scores, P.candle_reaction)


def _rule_frame(spark, sf):
    return indicator_frame(bars(spark, sf), ["rsi"], back=LOOKBACK + 16).then(*_STEPS)


@query(
    "rule_engine",
    with_(BARS, INDICATORS, Q.smc_sql("feat"), Q.inst_sql("smcn"), Q.reaction_sql("insts"), RULES.format(src="react"))
    + f"SELECT key, bar_epoch, rule_direction, {rd('rule_bull', 'rule_bear', 'rule_confidence')} FROM rules",
)
def rule_engine(spark, sf):
    df = K.rule_engine(_rule_frame(spark, sf).core())
    return df.select("key", epoch(), "rule_direction", *rounded("rule_bull", "rule_bear", "rule_confidence"))


def _fired_sql(name: str, test: str) -> str:
    return f"SELECT key, bar_epoch, {name} AS rule FROM rules WHERE {test}"


_FIRED = {
    "bull_ob_bos": "price_at_bullish_ob * bullish_bos = 1", "bear_ob_bos": "price_at_bearish_ob * bearish_bos = 1",
    "bull_fvg_entry": "price_in_bullish_fvg = 1", "bear_fvg_entry": "price_in_bearish_fvg = 1",
    "ote_bull": "in_ote_zone_bull = 1", "ote_bear": "in_ote_zone_bear = 1",
    "bull_liq_sweep": "bullish_liquidity_sweep = 1", "bear_liq_sweep": "bearish_liquidity_sweep = 1",
    "judas_bull": "judas_swing_bull = 1", "judas_bear": "judas_swing_bear = 1",
    "strong_bull_reaction": "net_score > 40", "strong_bear_reaction": "net_score < -40",
    "bull_engulf": "bull_engulf = 1", "bear_engulf": "bear_engulf = 1",
    "liq_sweep_bull": "liq_sweep_bull = 1", "liq_sweep_bear": "liq_sweep_bear = 1",
    "close_upper_third": "close_upper_third = 1 AND rb > rs", "close_lower_third": "close_lower_third = 1 AND rs > rb2",
    "breakout_real_bull": "breakout_real_bull = 1", "breakout_real_bear": "breakout_real_bear = 1",
    "consolidation_penalty": "consolidation = 1",
}


def _compound_sql(i: int) -> dict[str, str]:
    """Name (an SQL expression) and test of one side's rules with several conditions or a count in their name."""
    c, tag = {name: pair[i] for name, pair in _PAIRS.items()}, ("bull", "bear")[i]
    net, structure = ("net_score", "-net_score")[i], ("hh_hl", "lh_ll")[i]
    taken = f"greatest({c['swept']}, {c['sweep']})"
    points = f"({c['ob']} * 3 + {c['gap']} * 2 + {taken} * 3 + {c['ote']} * 2 + {c['edge']} + {c['turn']} * 2)"
    return {
        f"'pin_bar_ob_{tag}'": f"{c['pin']} * greatest({c['ob']}, {c['gap']}) = 1",
        f"'pd_array_{tag}_' || CAST({points} AS INTEGER)": f"{points} >= 5",
        f"'smc_full_{tag}'": f"{taken} * {c['turn']} * greatest({c['ob']}, {c['gap']}) = 1",
        f"'{structure}_key_level'": f"{c['struct']} * greatest({c['ob']}, {c['ote']}, {c['edge']}) = 1",
        f"'role_reversal_{tag}_retest'": f"{c['role']} * greatest({c['pin']}, {c['eng']}) = 1",
        f"'round_number_{tag}_reject'": f"round_number_near = 1 AND {net} > 30",
        f"'momentum_{tag}_' || CAST({c['run']} AS INTEGER)": f"{c['run']} >= 3",
    }


@query(
    "rules_fired",
    with_(BARS, INDICATORS, Q.smc_sql("feat"), Q.inst_sql("smcn"), Q.reaction_sql("insts"), RULES.format(src="react"))
    + " UNION ALL ".join(_fired_sql(n, t) for n, t in ({f"'{n}'": t for n, t in _FIRED.items()} | _compound_sql(0) | _compound_sql(1)).items()),
)
def rules_fired(spark, sf):
    """All rules that fired, one row each."""
    df = K.rule_engine(_rule_frame(spark, sf).core())
    return df.select("key", epoch(), F.explode("rules_fired").alias("rule"))


DIR = f", dd AS (SELECT *, {C.GREEN_IF_UP} FROM {{src}})"


def _pick(bull: str, bear: str) -> str:
    return f"(CASE WHEN direction = 'GREEN' THEN {bull} ELSE {bear} END)"


def _opp(bull: str, bear: str, plus: int, minus: int) -> str:
    return f"CASE WHEN {_pick(bull, bear)} = 1 THEN {plus} WHEN {_pick(bear, bull)} = 1 THEN {minus} ELSE 0 END"


_HB = "greatest(gartley_bull, bat_bull, butterfly_bull, crab_bull)"
_HS = "greatest(gartley_bear, bat_bear, butterfly_bear, crab_bear)"
SMC_POINTS = f"""(
  {_opp('price_at_bullish_ob', 'price_at_bearish_ob', 10, -5)} + {_opp('price_in_bullish_fvg', 'price_in_bearish_fvg', 8, -3)}
  + {_opp('bullish_bos', 'bearish_bos', 7, -4)} + {_opp('in_ote_zone_bull', 'in_ote_zone_bear', 5, 3)}
  + {_pick('buy_side_liquidity', 'sell_side_liquidity')} * 5 + {_pick('liq_sweep_bull', 'liq_sweep_bear')} * 8 + liquidity_swept * 4
  + {_pick('greatest(judas_swing_bull, mm_bull_cycle)', 'greatest(judas_swing_bear, mm_bear_cycle)')} * 6
  + {_pick('greatest(bullish_liquidity_sweep, displacement_bull)', 'greatest(bearish_liquidity_sweep, displacement_bear)')} * 5
  + {_pick('wyckoff_spring', 'wyckoff_upthrust')} * 8 + {_pick('wyckoff_sos', 'wyckoff_sow')} * 6 + {_pick(_HB, _HS)} * 8
  + sd_zone_fresh * {_pick('sd_at_demand', 'sd_at_supply')} * 6 + {_pick('elliott_impulse_bull', 'elliott_impulse_bear')} * 7
  + {_pick('chart_double_bottom', 'chart_double_top')} * 8 + {_pick('chart_bull_flag', 'chart_bear_flag')} * 5
  + {_pick('hh_hl_structure', 'lh_ll_structure')} * 5 + {_pick('role_reversal_bull', 'role_reversal_bear')} * 7 + round_number_near * 4
  + least({_pick('momentum_bull_count', 'momentum_bear_count')}, 3) * 2 + {_pick('breakout_real_bull', 'breakout_real_bear')} * 5
  ) * CASE WHEN consolidation = 1 THEN 0.6::DOUBLE ELSE 1 END"""
_NET = _pick("net_score", "(-net_score)")
REACTION_POINTS = f"""(CASE WHEN {_NET} > 60 THEN 25 WHEN {_NET} > 40 THEN 20 WHEN {_NET} > 20 THEN 14 WHEN {_NET} > 0 THEN 8 ELSE 0 END
  + {_pick('pin_bull', 'pin_bear')} * 5 + {_pick('bull_engulf', 'bear_engulf')} * 6)"""


def ai_points_sql(confidence: str, meta: str) -> str:
    c = confidence
    return f"""(CASE WHEN {c} >= 0.80::DOUBLE THEN 30 WHEN {c} >= 0.75::DOUBLE THEN 25 WHEN {c} >= 0.70::DOUBLE THEN 20 WHEN {c} >= 0.65::DOUBLE THEN 14
  WHEN {c} >= 0.60::DOUBLE THEN 8 ELSE 0 END + CASE WHEN {meta} >= 0.75::DOUBLE THEN 5 ELSE 0 END)"""


PATTERN_COUNT = f"({_pick('pin_bull', 'pin_bear')} + {_pick('bull_engulf', 'bear_engulf')} + {_pick('gartley_bull + bat_bull + butterfly_bull + crab_bull', 'gartley_bear + bat_bear + butterfly_bear + crab_bear')})"
_Z = {c: f"coalesce({c}, 0)" for c in ("rsi_14", "macd_hist", "bb_pos", "stoch_k", "adx_14")}
CONSENSUS = f"""(CAST({_pick(_Z['rsi_14'] + ' < 65', _Z['rsi_14'] + ' > 35')} AS INTEGER) + CAST({_pick(_Z['macd_hist'] + ' > 0', _Z['macd_hist'] + ' < 0')} AS INTEGER)
  + CAST({_pick(_Z['bb_pos'] + ' < 0.75::DOUBLE', _Z['bb_pos'] + ' > 0.25::DOUBLE')} AS INTEGER) + CAST({_pick(_Z['stoch_k'] + ' < 80', _Z['stoch_k'] + ' > 20')} AS INTEGER)
  + CAST({_pick('ema_5 > ema_20', 'ema_5 < ema_20')} AS INTEGER) + CAST({_Z['adx_14']} > 20 AS INTEGER)
  + CAST({_pick('smc_net_score > 0', 'smc_net_score < 0')} AS INTEGER) + CAST({PATTERN_COUNT} > 0 AS INTEGER))"""


def _point_frame(spark, sf):
    f = indicator_frame(bars(spark, sf), ["averages", "bands", "rsi", "macd", "stochastic", "trend"], back=LOOKBACK + 16)
    patterns = (P.institutional, P.wyckoff, P.elliott, P.supply_demand, P.chart_patterns, P.harmonics)
    return f.then((*FOUNDATIONS, *patterns), FINDINGS, scores, P.candle_reaction)


@query(
    "layer_points",
    with_(BARS, WIDE, DIR.format(src="react"))
    + f""", o AS (SELECT key, bar_epoch, direction, {SMC_POINTS} AS smc_pts, CAST({REACTION_POINTS} AS INTEGER) AS reaction_pts,
  CAST({CONSENSUS} AS INTEGER) AS consensus, CAST({PATTERN_COUNT} AS INTEGER) AS n_patterns FROM dd)
SELECT key, bar_epoch, direction, reaction_pts, consensus, n_patterns, {rd('smc_pts')} FROM o""",
)
def layer_points(spark, sf):
    """Structure and reaction points, consensus checks and agreeing patterns of every bar's own colour."""
    d = C.green_if_up()
    names = K.pattern_names(d)
    df = _point_frame(spark, sf).core()
    return df.select(
        "key",
        epoch(),
        d.alias("direction"),
        r(K.smc_points(d)).alias("smc_pts"),
        K.reaction_points(d).alias("reaction_pts"),
        K.consensus(d, F.size(names) > 0).alias("consensus"),
        F.size(names).alias("n_patterns"),
    )


@query(
    "pattern_names",
    with_(BARS, WIDE, DIR.format(src="react"))
    + " UNION ALL ".join(
        [
            f"SELECT key, bar_epoch, '{n}' AS pattern FROM dd WHERE direction = '{d}' AND {c} = 1"
            for n, c, d in (
                ("pin_bar_bull", "pin_bull", "GREEN"), ("bullish_engulfing", "bull_engulf", "GREEN"),
                ("pin_bar_bear", "pin_bear", "RED"), ("bearish_engulfing", "bear_engulf", "RED"),
                *[(f"{h}_bull", f"{h}_bull", "GREEN") for h in P.HARMONICS],
                *[(f"{h}_bear", f"{h}_bear", "RED") for h in P.HARMONICS],
            )
        ]
    ),
)
def pattern_names(spark, sf):
    f = indicator_frame(bars(spark, sf), [], back=LOOKBACK + 16).then(
        (lambda x: P.candle_reaction(x, zones=False), P.harmonics)
    )
    return f.core("key", epoch(), F.explode(K.pattern_names(C.green_if_up())).alias("pattern"))


# ---------------------------------------------------------------- the whole score

CONTEXT = (
    WIDE
    + C.VOTE_REGIME.format(src="react")
    + C.SPIKE.format(src="vreg")
    + C.SYNTH
    + C.MTF
    + C.AGREE
    + C.TOUCHES
    + C.STATES
    + C.NEAR
    + C.BEST_ZONE
    + C.profile_sql("every")
    + C.MOOD
    + C.MOOD_ASOF
    + C.FLOW
    + PROBS.format(floor=0.02)
    + f""",
kal AS (
  SELECT key, rn, bar_epoch, close, close AS x, 1.0::DOUBLE AS p FROM b WHERE rn = 0
  UNION ALL
  SELECT b.key, b.rn, b.bar_epoch, b.close,
    kal.x + (kal.p + 1e-5::DOUBLE) / (kal.p + 1e-5::DOUBLE + 0.01::DOUBLE) * (b.close - kal.x),
    (1 - (kal.p + 1e-5::DOUBLE) / (kal.p + 1e-5::DOUBLE + 0.01::DOUBLE)) * (kal.p + 1e-5::DOUBLE)
  FROM kal JOIN b ON b.key = kal.key AND b.rn = kal.rn + 1),
kt AS (SELECT key, bar_epoch, coalesce(x - lag(x, 2) {S}, 0) AS kvel FROM kal),
vpj AS (SELECT b.key, b.bar_epoch, b.close, v.poc, v.vah, v.val, v.hvn, v.lvn FROM b LEFT JOIN vpn v ON v.key = b.key AND v.snap = b.rn),
vpz AS (SELECT key, bar_epoch, {C.classify_sql('close')} AS vp_zone,
  coalesce(abs(close - poc) / greatest(abs(poc) * 0.0001::DOUBLE, 1e-8::DOUBLE) < 5, false) AS vp_at_poc FROM vpj),
ctx AS (SELECT spike.*, m.mtf_direction, m.mtf_agreement, m.killzone, m.tf60_bias, m.tf15_bias, m.tf5_bias, m.tf2_bias,
  y.synth_net_sentiment, y.synth_exhaustion, y.synth_divergence, y.synth_signal_bias, z.rz_score, z.rz_signal,
  v.vp_zone, v.vp_at_poc, mo.buyer_ratio, mo.is_fresh, mo.extreme, mo.velocity, fo.os_imbalance,
  p.base_prob, p.oppose_share_green, p.oppose_share_red, lag(spike.close) OVER (PARTITION BY spike.key ORDER BY spike.bar_epoch) AS prev_close,
  CASE WHEN kt.kvel > 1e-6::DOUBLE THEN 1 WHEN kt.kvel < -1e-6::DOUBLE THEN -1 ELSE 0 END AS kalman_trend
  FROM spike JOIN mtf m USING (key, bar_epoch) JOIN synth y USING (key, bar_epoch) JOIN rz z USING (key, bar_epoch)
  JOIN vpz v USING (key, bar_epoch) JOIN mx mo USING (key, bar_epoch) JOIN flow fo USING (key, bar_epoch)
  JOIN fused p USING (key, bar_epoch) JOIN kt USING (key, bar_epoch))"""
)
VOTE = """,
dv0 AS (SELECT *, coalesce(di_diff, 0) AS di, abs(base_prob - 0.5::DOUBLE) * 3 AS aw, least(abs(coalesce(di_diff, 0)) / 50, 0.8::DOUBLE) AS dw,
  least(abs(smc_net_score) / 60::DOUBLE, 0.7::DOUBLE) AS zw FROM rules),
dv1 AS (SELECT *,
  CASE WHEN base_prob >= 0.55::DOUBLE THEN aw ELSE 0 END + CASE WHEN rule_direction = 'GREEN' THEN rule_confidence * 1.2::DOUBLE ELSE 0 END
  + CASE WHEN mtf_direction = 'bull' THEN mtf_agreement ELSE 0 END + CASE WHEN di > 8 THEN dw ELSE 0 END + CASE WHEN smc_net_score > 15 THEN zw ELSE 0 END AS green_weight,
  CASE WHEN base_prob <= 0.45::DOUBLE THEN aw ELSE 0 END + CASE WHEN rule_direction = 'RED' THEN rule_confidence * 1.2::DOUBLE ELSE 0 END
  + CASE WHEN mtf_direction = 'bear' THEN mtf_agreement ELSE 0 END + CASE WHEN di < -8 THEN dw ELSE 0 END + CASE WHEN smc_net_score < -15 THEN zw ELSE 0 END AS red_weight FROM dv0),
dvt AS (SELECT *, CASE WHEN green_weight > red_weight THEN 'GREEN' WHEN red_weight > green_weight THEN 'RED'
  WHEN coalesce(close >= prev_close, base_prob >= 0.5::DOUBLE) THEN 'GREEN' ELSE 'RED' END AS direction FROM dv1)"""
META = "0.75::DOUBLE"
SCORE = (
    C.CROWD.format(src="dvt")
    + C.SYNTH_MULT.format(src="crowd")
    + f""",
sc0 AS (SELECT *, CAST({C.mtf_points_sql()} AS INTEGER) AS mtf_pts, {SMC_POINTS} AS smc_pts, {REACTION_POINTS} AS reaction_pts,
  {ai_points_sql(_pick('base_prob', '(1 - base_prob)'), META)} AS ai_pts, {CONSENSUS} AS consensus,
  CASE WHEN {_pick(_HB, _HS)} = 1 THEN 0.05::DOUBLE ELSE 0 END AS hboost, {_pick('oppose_share_green', 'oppose_share_red')} AS oppose_share,
  (kalman_trend = 1 AND direction = 'GREEN') OR (kalman_trend = -1 AND direction = 'RED') AS agrees FROM synm),
sc1 AS (SELECT *, least(greatest(0, least(1, ((mtf_pts + smc_pts + reaction_pts + ai_pts) / 130::DOUBLE + 0.04::DOUBLE)
  * CASE WHEN coalesce(adx_14, 0) < 15 THEN 0.75::DOUBLE ELSE 1 END + CASE WHEN agrees THEN 0.02::DOUBLE ELSE -0.03::DOUBLE END)) + hboost, 0.99::DOUBLE) AS layer_confidence FROM sc0),
sc2 AS (SELECT *, CASE WHEN consensus >= 7 THEN least(layer_confidence + 0.04::DOUBLE, 1) WHEN consensus >= 5 THEN layer_confidence
  ELSE layer_confidence * greatest(1 - (5 - consensus) * 0.04::DOUBLE, 0.75::DOUBLE) END AS c2,
  {_pick("tf60_bias = 'bear'", "tf60_bias = 'bull'")} AS op60, {_pick("tf15_bias = 'bear'", "tf15_bias = 'bull'")} AS op15,
  {_pick("mtf_direction = 'bear'", "mtf_direction = 'bull'")} AS opm FROM sc1),
sc3 AS (SELECT *, c2 * CASE WHEN op60 AND op15 THEN 0.72::DOUBLE WHEN op60 OR op15 THEN 0.85::DOUBLE WHEN opm THEN 0.93::DOUBLE ELSE 1 END
  * CASE WHEN oppose_share >= 0.6::DOUBLE THEN 0.85::DOUBLE ELSE 1 END * CASE WHEN mtf_agreement < 0.4::DOUBLE THEN 0.97::DOUBLE ELSE 1 END
  * spike_factor AS checked_confidence FROM sc2),
sc4 AS (SELECT *, CASE WHEN rz_score >= 65 AND rz_signal = direction THEN least(checked_confidence * (1 + rz_score / 1000), 0.99::DOUBLE)
  WHEN rz_score >= 65 AND rz_signal <> 'NONE' THEN checked_confidence * (1 - rz_score / 500) ELSE checked_confidence END AS c4 FROM sc3),
sc5 AS (SELECT *, CASE WHEN {_pick("vp_zone = 'AT_SUPPORT'", "vp_zone = 'AT_RESISTANCE'")} THEN least(c4 * 1.05::DOUBLE, 0.99::DOUBLE)
  WHEN {_pick("vp_zone = 'AT_RESISTANCE'", "vp_zone = 'AT_SUPPORT'")} THEN c4 * 0.9::DOUBLE
  WHEN vp_zone = 'LVN_FAST_MOVE' THEN least(c4 * 1.03::DOUBLE, 0.99::DOUBLE) ELSE c4 END
  * CASE WHEN vp_at_poc THEN 0.97::DOUBLE ELSE 1 END * sent_mult * synth_mult AS c5 FROM sc4),
sc6 AS (SELECT *, greatest(0, least(0.99::DOUBLE, CASE WHEN {_pick('os_imbalance', '(-os_imbalance)')} > 0.2::DOUBLE THEN least(c5 * 1.04::DOUBLE, 0.99::DOUBLE)
  WHEN {_pick('os_imbalance', '(-os_imbalance)')} < -0.2::DOUBLE THEN c5 * 0.94::DOUBLE ELSE c5 END)) AS confidence FROM sc5),
scored AS (SELECT *, CASE WHEN confidence >= 0.82::DOUBLE THEN 'ELITE' WHEN confidence >= 0.75::DOUBLE THEN 'HIGH'
  WHEN confidence >= 0.62::DOUBLE THEN 'MODERATE' ELSE 'SKIP' END AS grade FROM sc6)"""
)
FULL = with_(BARS, CONTEXT, RULES.format(src="ctx"), VOTE, SCORE).replace("WITH ", "WITH RECURSIVE ", 1)


def context(spark, sf):
    """The bar table with everything the score reads.

    Bars, the wide feature table and the joined table are each written once: several branches read
    them, and the plan above starts from a short one.
    """
    source = cut_lineage(bars(spark, sf))
    wide = cut_lineage(analyse(source))
    on = ["key", "tf_sec", "bar_start"]
    numbered = number_rows(source)
    plain = source.select(*on, "close")
    profile = V.classify(V.profile(V.histogram_per_bar(source))).select(*on, "vp_zone", "vp_at_poc")
    states = Z.zone_states(Z.touches(numbered, F.lit(C.ZONE)))
    zones = Z.best_zone(plain, Z.zones_near(source, states, F.lit(C.ZONE))).select(*on, "rz_score", "rz_signal")
    frames = timeframe_agreement(source, 3600).select(
        *on, "mtf_direction", "mtf_agreement", "killzone", "tf60_bias", "tf15_bias", "tf5_bias", "tf2_bias"
    )
    mood = C.mood_bars(spark, sf, plain).select(*on, "buyer_ratio", "is_fresh", "extreme", "velocity")
    flow = C.flow_bars(spark, sf, plain).select(*on, "os_imbalance")
    fused = J.fuse(model_probs(spark, sf, plain), accuracies(spark), floor=0.02, default=0.52)
    df = wide
    for part in (frames, zones, profile, mood, flow):
        df = df.join(part, on)
    return cut_lineage(df.join(fused, ["key", "bar_start"]))


@query(
    "signal_scores",
    FULL
    + f"""SELECT key, bar_epoch, direction, grade, mtf_pts, CAST(reaction_pts AS INTEGER) AS reaction_pts, CAST(ai_pts AS INTEGER) AS ai_pts,
  CAST(consensus AS INTEGER) AS consensus, {rd('smc_pts', 'green_weight', 'red_weight', 'layer_confidence', 'checked_confidence', 'confidence', digits=9)} FROM scored""",
)
def signal_scores(spark, sf):
    """Direction, layer points, staged confidence and grade of every bar."""
    df = score(context(spark, sf))
    return df.select(
        "key", epoch(), "direction", "grade", "mtf_pts", "reaction_pts", "ai_pts", "consensus",
        *rounded("smc_pts", "green_weight", "red_weight", "layer_confidence", "checked_confidence", "confidence", digits=9),
    )
