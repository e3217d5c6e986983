"""The eight voters of every bar, the critic and the final decision."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import voting as G
from barloom.operators.analysis import score
from barloom.operators.mtf import boost_table
from barloom.operators.retention import newest_rows
from barloom.plans.context_queries import BOOSTS
from barloom.plans.registry import epoch, query, r, rounded
from barloom.plans.score_queries import FULL, context
from barloom.plans.sqlparts import rd
from barloom.session import cut_lineage
from barloom.sources.samples import ticks


def _vote(agent: str, score_: str, direction: str, confidence: str) -> str:
    return f"SELECT key, bar_epoch, '{agent}' AS agent, {direction} AS vote, {confidence} AS confidence, CAST({score_} AS DOUBLE) AS score FROM va2"


def _side(score_: str, threshold: str) -> str:
    return f"CASE WHEN {score_} > {threshold}::DOUBLE THEN 'GREEN' WHEN {score_} < -{threshold}::DOUBLE THEN 'RED' ELSE 'NEUTRAL' END"


def _conf(score_: str, scale: str, cap: str = "0.92") -> str:
    return f"least({cap}::DOUBLE, 0.5::DOUBLE + abs({score_}) * {scale}::DOUBLE)"


VOTES = f""",
va0 AS (SELECT *, kz_london_07_10 + kz_newyork_12_15 + kz_overlap_12_16 > 0 AS kill,
  inst_bull_score * 0.5::DOUBLE + displacement_bull * 3 + in_ote_zone_bull * 4 + judas_swing_bull * 3 + mm_bull_cycle * 2 AS bp,
  inst_bear_score * 0.5::DOUBLE + displacement_bear * 3 + in_ote_zone_bear * 4 + judas_swing_bear * 3 + mm_bear_cycle * 2 AS sp2,
  greatest(-1, least(1, net_score / 5)) AS a0 FROM scored),
va1 AS (SELECT *, (bp - sp2) / greatest(bp + sp2 + 1, 1) AS iraw,
  greatest(-1, least(1, a0 + bull_engulf * 0.2::DOUBLE)) AS a1 FROM va0),
va1b AS (SELECT *, greatest(-1, least(1, a1 - bear_engulf * 0.2::DOUBLE)) AS a2 FROM va1),
va1c AS (SELECT *, greatest(-1, least(1, greatest(-1, least(1, a2 + pin_bull * 0.15::DOUBLE)) - pin_bear * 0.15::DOUBLE)) AS a3 FROM va1b),
va1d AS (SELECT *, greatest(-1, least(1, greatest(-1, least(1, a3 + hh_hl_structure * 0.1::DOUBLE)) - lh_ll_structure * 0.1::DOUBLE)) AS a4 FROM va1c),
va2 AS (SELECT *, greatest(-1, least(1, smc_net_score / 60::DOUBLE)) AS s_smc,
  greatest(-1, least(1, CASE WHEN kill AND iraw <> 0 THEN iraw * 1.25::DOUBLE WHEN kill THEN 0.1::DOUBLE ELSE iraw END)) AS s_ict,
  CASE WHEN coalesce(rsi_14, 0) > 65 AND coalesce(macd_hist, 0) > 0 THEN least(1, a4 + 0.08::DOUBLE)
    WHEN coalesce(rsi_14, 0) < 35 AND coalesce(macd_hist, 0) < 0 THEN greatest(-1, a4 - 0.08::DOUBLE) ELSE a4 END AS s_act,
  CASE WHEN mtf_direction = 'bull' THEN mtf_agreement WHEN mtf_direction = 'bear' THEN -mtf_agreement ELSE 0 END AS s_mtf,
  (base_prob - 0.5::DOUBLE) * 2 AS s_ml,
  greatest(-1, least(1, CASE vp_zone WHEN 'AT_SUPPORT' THEN 0.4::DOUBLE WHEN 'AT_RESISTANCE' THEN -0.4 WHEN 'BELOW_VALUE_AREA' THEN 0.2 WHEN 'ABOVE_VALUE_AREA' THEN -0.2 ELSE 0 END
    * CASE WHEN vp_at_poc THEN 0.8::DOUBLE ELSE 1 END + CASE WHEN os_imbalance > 0.3::DOUBLE THEN 0.25::DOUBLE WHEN os_imbalance < -0.3::DOUBLE THEN -0.25 ELSE 0 END)) AS s_vol,
  CASE WHEN sent_mult > 1.05::DOUBLE THEN 0.25::DOUBLE WHEN sent_mult < 0.95::DOUBLE THEN -0.25 ELSE 0 END
    + CASE WHEN synth_signal_bias = 'GREEN' THEN 0.3::DOUBLE WHEN synth_signal_bias = 'RED' THEN -0.3 ELSE 0 END AS s_sen,
  CASE WHEN rz_signal = 'GREEN' THEN rz_score / 100 WHEN rz_signal = 'RED' THEN -rz_score / 100 ELSE 0 END AS s_rz FROM va1d),
votes AS (
  {_vote('smc', 's_smc', _side('s_smc', '0.10'), _conf('s_smc', '0.38'))}
  UNION ALL {_vote('ict', 's_ict', _side('s_ict', '0.15'), f"CASE WHEN kill THEN least({_conf('s_ict', '0.35')} * 1.08::DOUBLE, 0.92::DOUBLE) ELSE {_conf('s_ict', '0.35')} END")}
  UNION ALL {_vote('price_action', 's_act', _side('s_act', '0.10'), _conf('s_act', '0.35'))}
  UNION ALL {_vote('mtf', 's_mtf', _side('s_mtf', '0'), _conf('s_mtf', '0.42'))}
  UNION ALL {_vote('ml', 's_ml', "CASE WHEN base_prob > 0.55::DOUBLE THEN 'GREEN' WHEN base_prob < 0.45::DOUBLE THEN 'RED' ELSE 'NEUTRAL' END", 'least(0.92::DOUBLE, abs(s_ml) * 0.8::DOUBLE + 0.1::DOUBLE)')}
  UNION ALL {_vote('volume', 's_vol', _side('s_vol', '0.15'), _conf('s_vol', '0.35'))}
  UNION ALL {_vote('sentiment', 's_sen', _side('s_sen', '0.15'), _conf('s_sen', '0.30', '0.85'))}
  UNION ALL {_vote('rejection_zone', 's_rz', _side('s_rz', '0.15'), _conf('s_rz', '0.42'))})"""
DECISION = f""",
wv AS (SELECT v.*, s.direction AS proposed, s.confidence AS pc, s.vote_regime, v.confidence * b.boost AS ew FROM votes v
  JOIN scored s ON s.key = v.key AND s.bar_epoch = v.bar_epoch JOIN {BOOSTS.replace('AS boosts', 'AS b')} ON b.vote_regime = s.vote_regime AND b.agent = v.agent),
cr0 AS (SELECT key, bar_epoch, first(proposed) AS proposed, first(pc) AS pc, first(vote_regime) AS regime,
  sum(CASE WHEN vote = proposed THEN ew ELSE 0 END) AS agree_weight, sum(CASE WHEN vote <> proposed AND vote <> 'NEUTRAL' THEN ew ELSE 0 END) AS oppose_weight,
  sum(CASE WHEN vote = 'NEUTRAL' THEN ew ELSE 0 END) * 0.5::DOUBLE AS nw, sum(CASE WHEN vote = 'GREEN' THEN ew ELSE 0 END) AS gw, sum(CASE WHEN vote = 'RED' THEN ew ELSE 0 END) AS rw,
  count(*) FILTER (vote = 'GREEN') AS ng, count(*) FILTER (vote = 'RED') AS nr,
  count(*) FILTER (agent = 'mtf' AND vote <> proposed AND vote <> 'NEUTRAL') > 0 AS mo,
  count(*) FILTER (agent IN ('smc', 'ict') AND vote <> proposed AND vote <> 'NEUTRAL') = 2 AS so FROM wv GROUP BY key, bar_epoch),
cr1 AS (SELECT *, (agree_weight + nw * 0.5::DOUBLE) / CASE WHEN agree_weight + oppose_weight + nw > 0 THEN agree_weight + oppose_weight + nw ELSE 1 END AS agreement FROM cr0),
cr2 AS (SELECT *, least(0.99::DOUBLE, CASE WHEN agreement >= 0.75::DOUBLE THEN least(pc * (1 + (agreement - 0.75::DOUBLE) * 0.4::DOUBLE), 0.99::DOUBLE)
  WHEN agreement >= 0.6::DOUBLE THEN least(pc * 1.05::DOUBLE, 0.99::DOUBLE) WHEN agreement >= 0.4::DOUBLE THEN pc * 0.9::DOUBLE ELSE pc * 0.75::DOUBLE END
  * CASE WHEN mo THEN 0.9::DOUBLE ELSE 1 END * CASE WHEN so THEN 0.85::DOUBLE ELSE 1 END) AS critic_confidence,
  CASE WHEN gw / CASE WHEN gw + rw > 0 THEN gw + rw ELSE 1 END >= 0.55::DOUBLE THEN 'GREEN' WHEN rw / CASE WHEN gw + rw > 0 THEN gw + rw ELSE 1 END >= 0.55::DOUBLE THEN 'RED' ELSE proposed END AS final_direction,
  CASE WHEN ng + nr >= 2 THEN 1 - greatest(ng, nr) / (ng + nr)::DOUBLE ELSE 0 END AS conflict FROM cr1),
decided AS (SELECT *, final_direction <> proposed AS direction_changed, least(0.99::DOUBLE, critic_confidence * CASE WHEN final_direction <> proposed THEN 0.93::DOUBLE ELSE 1 END
  * CASE WHEN conflict > 0.35::DOUBLE THEN 1 - conflict * 0.25::DOUBLE ELSE 1 END) AS final_confidence FROM cr2)"""


def _scored(spark, sf):
    return score(context(spark, sf))


@query("agent_votes", FULL + VOTES + f"SELECT key, bar_epoch, agent, vote, {rd('confidence', 'score', digits=9)} FROM votes")
def agent_votes(spark, sf):
    return G.votes(_scored(spark, sf)).select("key", epoch(), "agent", "vote", *rounded("confidence", "score", digits=9))


@query(
    "agent_decision",
    FULL
    + VOTES
    + DECISION
    + f"""SELECT key, bar_epoch, proposed, final_direction, direction_changed, regime,
  {rd('agreement', 'agree_weight', 'oppose_weight', 'conflict', 'critic_confidence', 'final_confidence', digits=9)} FROM decided""",
)
def agent_decision(spark, sf):
    """Critic, conflict and final direction of every bar from the weighted votes."""
    scored = cut_lineage(_scored(spark, sf))
    decided = G.decide(G.weighted(G.votes(scored), scored, boost_table(spark)))
    return decided.select(
        "key", epoch(), "proposed", "final_direction", "direction_changed", "regime",
        *rounded("agreement", "agree_weight", "oppose_weight", "conflict", "critic_confidence", "final_confidence", digits=9),
    )


@query(
    "agent_summary",
    FULL
    + VOTES
    + f"SELECT key, agent, bar_epoch, vote, {rd('confidence', 'score', digits=9)} FROM votes QUALIFY row_number() OVER (PARTITION BY key, agent ORDER BY bar_epoch DESC) = 1",
)
def agent_summary(spark, sf):
    latest = G.agent_summary(G.votes(_scored(spark, sf)))
    return latest.select("key", "agent", epoch(), "vote", *rounded("confidence", "score", digits=9))


def _said(agent: str, default: str, *named: tuple[str, str]) -> str:
    found = "list_filter([" + ", ".join(f"CASE WHEN {condition} THEN '{text}' END" for condition, text in named) + "], lambda x: x IS NOT NULL)"
    return f"SELECT key, bar_epoch, '{agent}' AS agent, CASE WHEN len({found}) > 0 THEN {found} ELSE ['{default}'] END AS said FROM va2"


SAID = " UNION ALL ".join(
    [
        _said("smc", "SMC neutral", ("bullish_bos > 0", "BOS bullish"), ("bearish_bos > 0", "BOS bearish"), ("bullish_choch > 0", "CHOCH bullish"), ("bearish_choch > 0", "CHOCH bearish"),
              ("price_at_bullish_ob > 0", "Bullish Order Block active"), ("price_at_bearish_ob > 0", "Bearish Order Block active"), ("liquidity_swept > 0", "Liquidity swept"),
              ("hh_hl_structure > 0", "HH/HL bullish structure"), ("lh_ll_structure > 0", "LH/LL bearish structure"), ("in_ote_zone > 0", "Price in OTE zone"), ("round_number_near > 0", "Round number confluence")),
        _said("ict", "ICT neutral", ("kill", "Kill Zone active"), ("in_ote_zone_bull > 0", "OTE zone long"), ("in_ote_zone_bear > 0", "OTE zone short"), ("displacement_bull > 0", "Bullish displacement"),
              ("displacement_bear > 0", "Bearish displacement"), ("judas_swing_bull > 0", "Judas swing bull"), ("judas_swing_bear > 0", "Judas swing bear"), ("mm_bull_cycle > 0", "MM bull cycle"), ("mm_bear_cycle > 0", "MM bear cycle")),
        _said("price_action", "PA neutral", ("bull_engulf > 0", "Bullish Engulfing"), ("bear_engulf > 0", "Bearish Engulfing"), ("pin_bull > 0", "Pin Bar (bull)"), ("pin_bear > 0", "Pin Bar (bear)"),
              ("hh_hl_structure > 0", "HH/HL bullish structure"), ("lh_ll_structure > 0", "LH/LL bearish structure"), ("round_number_near > 0", "Round number level")),
        "SELECT key, bar_epoch, 'mtf', ['MTF ' || mtf_direction] FROM va2",
        "SELECT key, bar_epoch, 'ml', ['Fused probability'] FROM va2",
        _said("volume", "Volume neutral", *[(f"vp_zone = '{z}'", t) for z, t in (("AT_SUPPORT", "At VP Support"), ("AT_RESISTANCE", "At VP Resistance"), ("BELOW_VALUE_AREA", "Below Value Area"),
              ("ABOVE_VALUE_AREA", "Above Value Area"), ("LVN_FAST_MOVE", "LVN fast move"))], ("vp_at_poc", "At POC"), ("os_imbalance > 0.3::DOUBLE", "Buy imbalance"), ("os_imbalance < -0.3::DOUBLE", "Sell imbalance")),
        _said("sentiment", "Sentiment neutral", ("sent_mult > 1.05::DOUBLE", "Sentiment aligns"), ("sent_mult < 0.95::DOUBLE", "Sentiment opposes"), ("synth_signal_bias = 'GREEN'", "Synthetic bullish"),
              ("synth_signal_bias = 'RED'", "Synthetic bearish"), ("synth_exhaustion > 0.7::DOUBLE", "Exhaustion signal")),
        _said("rejection_zone", "No active rejection zone near price", ("rz_signal = 'GREEN'", "RZ supports BUY"), ("rz_signal = 'RED'", "RZ supports SELL")),
    ]
)


@query("agent_reasons", FULL + VOTES + f", said AS ({SAID}) SELECT s.key, s.bar_epoch, s.agent, v.vote, array_to_string(s.said, '; ') AS reasons FROM said s JOIN votes v USING (key, bar_epoch, agent)")
def agent_reasons(spark, sf):
    """Every voter's reasons, bar by bar."""
    cast = G.votes(_scored(spark, sf))
    return cast.select("key", epoch(), "agent", "vote", F.concat_ws("; ", "reasons").alias("reasons"))


@query(
    "agent_critique",
    FULL
    + VOTES
    + DECISION
    + f""",
op AS (SELECT key, bar_epoch, list(agent || '=' || vote || ' (w=' || printf('%.2f', ew + 1e-9::DOUBLE) || ')' ORDER BY list_position([{', '.join(f"'{a}'" for a in G.AGENTS)}], agent))
    FILTER (vote <> proposed AND vote <> 'NEUTRAL') AS against FROM wv GROUP BY ALL),
cq AS (SELECT d.*, list_concat(list_concat([replace(CASE WHEN agreement >= 0.75::DOUBLE THEN 'Strong consensus {{}}' WHEN agreement >= 0.6::DOUBLE THEN 'Moderate consensus {{}}'
    WHEN agreement >= 0.4::DOUBLE THEN 'Mixed signals {{}} -- penalised' ELSE 'Opposing consensus {{}} -- hard penalty' END, '{{}}', printf('%.0f', (agreement + 1e-11::DOUBLE) * 100) || '%')], coalesce(against, [])),
    list_filter([CASE WHEN mo THEN 'MTF opposes -- extra -10%' END, CASE WHEN so THEN 'SMC + ICT both oppose -- hard -15%' END], lambda x: x IS NOT NULL))[:6] AS cl
  FROM decided d JOIN op USING (key, bar_epoch))
SELECT key, bar_epoch, final_direction, array_to_string(cl, '; ') AS critique, CASE WHEN final_confidence >= 0.82::DOUBLE THEN 'ELITE' WHEN final_confidence >= 0.75::DOUBLE THEN 'HIGH'
  WHEN final_confidence >= 0.62::DOUBLE THEN 'MODERATE' ELSE 'SKIP' END AS grade, final_confidence < 0.62::DOUBLE AS blocked FROM cq""",
)
def agent_critique(spark, sf):
    """The critic's words on every bar, the grade after the decision, and whether that blocks the signal."""
    scored = cut_lineage(_scored(spark, sf))
    spoken = cut_lineage(G.weighted(G.votes(scored), scored, boost_table(spark)))
    done = G.regraded(G.critique(spoken, G.decide(spoken)))
    return done.select("key", epoch(), "final_direction", F.concat_ws("; ", "critique").alias("critique"), "grade", "blocked")


@query(
    "engine_snapshot_full",
    FULL
    + f""",
tk AS (SELECT key, arg_max(price, seq) AS last_price, 1706659200 - max(sec) AS tick_age FROM ticks GROUP BY key),
nw AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY key ORDER BY bar_epoch DESC) = 1)
SELECT key, bar_epoch, last_price, tick_age, vp_zone, vp_at_poc, rz_signal, synth_signal_bias, is_fresh, direction, grade, {rd('close', 'rz_score', 'buyer_ratio', 'os_imbalance')} FROM nw JOIN tk USING (key)""",
)
def engine_snapshot_full(spark, sf):
    """The newest bar of every key with zone, profile, sentiment, order flow and score, and its last tick."""
    scored = _scored(spark, sf)
    last = ticks(spark, sf).groupBy("key").agg(F.max_by("price", "seq").alias("last_price"), (1706659200 - F.max(F.unix_timestamp("ts"))).alias("tick_age"))
    newest = newest_rows(scored, 1, ["key"]).join(last, "key")
    return newest.select(
        "key", epoch(), "last_price", "tick_age", "vp_zone", "vp_at_poc", "rz_signal", "synth_signal_bias", "is_fresh", "direction", "grade",
        *rounded("close", "rz_score", "buyer_ratio", "os_imbalance"),
    )
