"""Eight voters per bar, the critic over their votes and the final decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.scoring import GRADES, grade, on

CAP = 0.92

# The voters in the order in which they speak.
AGENTS = ("smc", "ict", "price_action", "mtf", "ml", "volume", "sentiment", "rejection_zone")


def _clip(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(x, F.lit(1.0)))


def _side(score: Column, threshold: float) -> Column:
    return F.when(score > threshold, "GREEN").when(score < -threshold, "RED").otherwise("NEUTRAL")


def _confidence(score: Column, scale: float, cap: float = CAP) -> Column:
    return F.least(F.lit(cap), F.lit(0.5) + F.abs(score) * scale)


def _reasons(default: str, *named: tuple[Column, str]) -> Column:
    found = F.array_compact(F.array(*[F.when(condition, F.lit(text)) for condition, text in named]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def _step(score: Column, condition: Column, amount: float) -> Column:
    return F.when(condition, _clip(score + amount)).otherwise(score)


def _scores(df: DataFrame, action_scale: float) -> DataFrame:
    kill_zone = on("kz_london_07_10") | on("kz_newyork_12_15") | on("kz_overlap_12_16")

    def points(side: str) -> Column:
        return (
            F.col(f"inst_{side}_score") * 0.5
            + F.col(f"displacement_{side}") * 3
            + F.col(f"in_ote_zone_{side}") * 4
            + F.col(f"judas_swing_{side}") * 3
            + F.col(f"mm_{side}_cycle") * 2
        )

    bull, bear = points("bull"), points("bear")
    raw = (bull - bear) / F.greatest(bull + bear + 1, F.lit(1.0))
    action = _clip(F.col("net_score") / action_scale)
    action = _step(action, on("bull_engulf"), 0.20)
    action = _step(action, on("bear_engulf"), -0.20)
    action = _step(action, on("pin_bull"), 0.15)
    action = _step(action, on("pin_bear"), -0.15)
    action = _step(action, on("hh_hl_structure"), 0.10)
    action = _step(action, on("lh_ll_structure"), -0.10)
    rsi, macd = F.coalesce(F.col("rsi_14"), F.lit(0.0)), F.coalesce(F.col("macd_hist"), F.lit(0.0))
    rising, falling = (rsi > 65) & (macd > 0), (rsi < 35) & (macd < 0)
    action = F.when(rising, _clip(action + 0.08)).when(falling, _clip(action - 0.08)).otherwise(action)
    frames = (
        F.when(F.col("mtf_direction") == "bull", F.col("mtf_agreement"))
        .when(F.col("mtf_direction") == "bear", -F.col("mtf_agreement"))
        .otherwise(0.0)
    )
    place = F.lit(0.0)
    for zone, value in {"AT_SUPPORT": 0.4, "AT_RESISTANCE": -0.4, "BELOW_VALUE_AREA": 0.2, "ABOVE_VALUE_AREA": -0.2}.items():
        place = F.when(F.col("vp_zone") == zone, F.lit(value)).otherwise(place)
    flow = F.when(F.col("os_imbalance") > 0.30, 0.25).when(F.col("os_imbalance") < -0.30, -0.25).otherwise(0.0)
    mood = F.when(F.col("sent_mult") > 1.05, 0.25).when(F.col("sent_mult") < 0.95, -0.25).otherwise(0.0)
    bias = (
        F.when(F.col("synth_signal_bias") == "GREEN", 0.30).when(F.col("synth_signal_bias") == "RED", -0.30).otherwise(0.0)
    )
    zone = (
        F.when(F.col("rz_signal") == "GREEN", F.col("rz_score") / 100)
        .when(F.col("rz_signal") == "RED", -F.col("rz_score") / 100)
        .otherwise(0.0)
    )
    return df.withColumns(
        {
            "_kill": kill_zone,
            "_s_smc": _clip(F.col("smc_net_score") / 60),
            "_s_ict": _clip(F.when(kill_zone & (raw != 0), raw * 1.25).when(kill_zone, 0.10).otherwise(raw)),
            "_s_action": action,
            "_s_mtf": frames,
            "_s_ml": (F.col("base_prob") - 0.5) * 2,
            "_s_volume": _clip(place * F.when(F.col("vp_at_poc"), 0.8).otherwise(1.0) + flow),
            "_s_sentiment": _clip(mood + bias),
            "_s_zone": zone,
        }
    )


def votes(df: DataFrame, action_scale: float = 5.0) -> DataFrame:
    """One row per bar and voter: direction, confidence, score and reasons.

    Reads the structure, pattern, reaction, timeframe, profile, flow, sentiment and zone columns and
    `base_prob`.
    """
    df = _scores(df, action_scale)

    def vote(agent: str, score: str, direction: Column, confidence: Column, reasons: Column) -> Column:
        return F.struct(
            F.lit(agent).alias("agent"),
            direction.alias("vote"),
            confidence.alias("confidence"),
            F.col(score).cast("double").alias("score"),
            reasons.alias("reasons"),
        )

    # The reasons are fixed values: phrases that a reader of the votes knows.
    s = {name: F.col(f"_s_{name}") for name in ("smc", "ict", "action", "mtf", "ml", "volume", "sentiment", "zone")}
    p, zone_name = F.col("base_prob"), F.col("vp_zone")
    kill = F.col("_kill")
    ict_confidence = _confidence(s["ict"], 0.35)
    ballots = [
        vote("smc", "_s_smc", _side(s["smc"], 0.10), _confidence(s["smc"], 0.38), _reasons(
            "SMC neutral",
            (on("bullish_bos"), "BOS bullish"), (on("bearish_bos"), "BOS bearish"),
            (on("bullish_choch"), "CHOCH bullish"), (on("bearish_choch"), "CHOCH bearish"),
            (on("price_at_bullish_ob"), "Bullish Order Block active"),
            (on("price_at_bearish_ob"), "Bearish Order Block active"),
            (on("liquidity_swept"), "Liquidity swept"), (on("hh_hl_structure"), "HH/HL bullish structure"),
            (on("lh_ll_structure"), "LH/LL bearish structure"), (on("in_ote_zone"), "Price in OTE zone"),
            (on("round_number_near"), "Round number confluence"))),
        vote("ict", "_s_ict", _side(s["ict"], 0.15),
             F.when(kill, F.least(ict_confidence * 1.08, F.lit(CAP))).otherwise(ict_confidence), _reasons(
            "ICT neutral",
            (kill, "Kill Zone active"), (on("in_ote_zone_bull"), "OTE zone long"), (on("in_ote_zone_bear"), "OTE zone short"),
            (on("displacement_bull"), "Bullish displacement"), (on("displacement_bear"), "Bearish displacement"),
            (on("judas_swing_bull"), "Judas swing bull"), (on("judas_swing_bear"), "Judas swing bear"),
            (on("mm_bull_cycle"), "MM bull cycle"), (on("mm_bear_cycle"), "MM bear cycle"))),
        vote("price_action", "_s_action", _side(s["action"], 0.10), _confidence(s["action"], 0.35), _reasons(
            "PA neutral",
            (on("bull_engulf"), "Bullish Engulfing"), (on("bear_engulf"), "Bearish Engulfing"),
            (on("pin_bull"), "Pin Bar (bull)"), (on("pin_bear"), "Pin Bar (bear)"),
            (on("hh_hl_structure"), "HH/HL bullish structure"), (on("lh_ll_structure"), "LH/LL bearish structure"),
            (on("round_number_near"), "Round number level"))),
        vote("mtf", "_s_mtf", _side(s["mtf"], 0.0), _confidence(s["mtf"], 0.42),
             F.array(F.concat(F.lit("MTF "), F.col("mtf_direction")))),
        vote("ml", "_s_ml", F.when(p > 0.55, "GREEN").when(p < 0.45, "RED").otherwise("NEUTRAL"),
             F.least(F.lit(CAP), F.abs(s["ml"]) * 0.80 + 0.10), F.array(F.lit("Fused probability"))),
        vote("volume", "_s_volume", _side(s["volume"], 0.15), _confidence(s["volume"], 0.35), _reasons(
            "Volume neutral",
            (zone_name == "AT_SUPPORT", "At VP Support"), (zone_name == "AT_RESISTANCE", "At VP Resistance"),
            (zone_name == "BELOW_VALUE_AREA", "Below Value Area"), (zone_name == "ABOVE_VALUE_AREA", "Above Value Area"),
            (zone_name == "LVN_FAST_MOVE", "LVN fast move"), (F.col("vp_at_poc"), "At POC"),
            (F.col("os_imbalance") > 0.30, "Buy imbalance"), (F.col("os_imbalance") < -0.30, "Sell imbalance"))),
        vote("sentiment", "_s_sentiment", _side(s["sentiment"], 0.15), _confidence(s["sentiment"], 0.30, 0.85), _reasons(
            "Sentiment neutral",
            (F.col("sent_mult") > 1.05, "Sentiment aligns"), (F.col("sent_mult") < 0.95, "Sentiment opposes"),
            (F.col("synth_signal_bias") == "GREEN", "Synthetic bullish"), (F.col("synth_signal_bias") == "RED", "Synthetic bearish"),
            (F.col("synth_exhaustion") > 0.70, "Exhaustion signal"))),
        vote("rejection_zone", "_s_zone", _side(s["zone"], 0.15), _confidence(s["zone"], 0.42), _reasons(
            "No active rejection zone near price",
            (F.col("rz_signal") == "GREEN", "RZ supports BUY"), (F.col("rz_signal") == "RED", "RZ supports SELL"))),
    ]
    return df.select("key", "bar_start", F.explode(F.array(*ballots)).alias("_v")).select("key", "bar_start", "_v.*")


def weighted(votes_: DataFrame, proposals: DataFrame, boosts: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Votes with their effective weight: learned weight x regime boost x confidence.

    `proposals` holds key, bar_start, direction, confidence and vote_regime per bar; `weights` holds
    key, bar_start, agent, weight where learned weights are known.
    """
    asked = proposals.select("key", "bar_start", F.col("direction").alias("proposed"), F.col("confidence").alias("proposed_confidence"), "vote_regime")
    df = votes_.join(asked, ["key", "bar_start"]).join(boosts, ["vote_regime", "agent"], "left")
    if weights is not None:
        df = df.join(weights, ["key", "bar_start", "agent"], "left")
    learned = F.coalesce(F.col("weight"), F.lit(1.0)) if weights is not None else F.lit(1.0)
    return df.withColumn("effective", learned * F.coalesce("boost", F.lit(1.0)) * F.col("confidence"))


def decide(weighted_votes: DataFrame) -> DataFrame:
    """Critic and final decision per bar from the weighted votes; one aggregation."""
    vote, w = F.col("vote"), F.col("effective")
    proposed = F.col("proposed")
    against = (vote != proposed) & (vote != "NEUTRAL")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, w).otherwise(0.0))

    def any_against(agent: str) -> Column:
        return F.max(((F.col("agent") == agent) & against).cast("int")) == 1

    df = weighted_votes.groupBy("key", "bar_start").agg(
        F.first("proposed").alias("proposed"),
        F.first("proposed_confidence").alias("proposed_confidence"),
        F.first("vote_regime").alias("regime"),
        total(vote == proposed).alias("agree_weight"),
        total(against).alias("oppose_weight"),
        (total(vote == "NEUTRAL") * 0.5).alias("neutral_weight"),
        total(vote == "GREEN").alias("green_weight"),
        total(vote == "RED").alias("red_weight"),
        F.count_if(vote == "GREEN").alias("n_green"),
        F.count_if(vote == "RED").alias("n_red"),
        any_against("mtf").alias("mtf_against"),
        (any_against("smc") & any_against("ict")).alias("smc_ict_against"),
    )
    everything = F.col("agree_weight") + F.col("oppose_weight") + F.col("neutral_weight")
    share = (F.col("agree_weight") + F.col("neutral_weight") * 0.5) / F.when(everything > 0, everything).otherwise(1.0)
    df = df.withColumn("agreement", share)
    a, c = F.col("agreement"), F.col("proposed_confidence")
    banded = (
        F.when(a >= 0.75, F.least(c * (1 + (a - 0.75) * 0.40), F.lit(0.99)))
        .when(a >= 0.60, F.least(c * 1.05, F.lit(0.99)))
        .when(a >= 0.40, c * 0.90)
        .otherwise(c * 0.75)
    )
    critic = (
        banded
        * F.when(F.col("mtf_against"), 0.90).otherwise(1.0)
        * F.when(F.col("smc_ict_against"), 0.85).otherwise(1.0)
    )
    voted = F.col("green_weight") + F.col("red_weight")
    cast = F.when(voted > 0, voted).otherwise(1.0)
    final = (
        F.when(F.col("green_weight") / cast >= 0.55, "GREEN")
        .when(F.col("red_weight") / cast >= 0.55, "RED")
        .otherwise(F.col("proposed"))
    )
    sided = F.col("n_green") + F.col("n_red")
    split = F.when(sided >= 2, 1 - F.greatest("n_green", "n_red") / sided).otherwise(0.0)
    df = df.withColumns({"critic_confidence": F.least(critic, F.lit(0.99)), "final_direction": final, "conflict": split})
    changed = F.col("final_direction") != F.col("proposed")
    value = (
        F.col("critic_confidence")
        * F.when(changed, 0.93).otherwise(1.0)
        * F.when(F.col("conflict") > 0.35, 1 - F.col("conflict") * 0.25).otherwise(1.0)
    )
    return df.withColumns({"direction_changed": changed, "final_confidence": F.least(value, F.lit(0.99))})


# What the critic says of each band of agreement, and of two kinds of opposition.
CRITIC_BANDS = ((0.75, "Strong consensus {}"), (0.60, "Moderate consensus {}"), (0.40, "Mixed signals {} -- penalised"), (None, "Opposing consensus {} -- hard penalty"))
MTF_OPPOSES, SMC_ICT_OPPOSE = "MTF opposes -- extra -10%", "SMC + ICT both oppose -- hard -15%"


def critique(weighted_votes: DataFrame, decided: DataFrame, most: int = 6) -> DataFrame:
    """decided with `critique`: the consensus in words, each voter against the proposal with its weight, and extra penalties."""
    against = (F.col("vote") != F.col("proposed")) & (F.col("vote") != "NEUTRAL")
    number = F.coalesce(*(F.when(F.col("agent") == a, i) for i, a in enumerate(AGENTS)))
    said = F.concat(F.col("agent"), F.lit("="), F.col("vote"), F.lit(" (w="), F.format_number(F.col("effective") + 1e-9, 2), F.lit(")"))
    opposed = weighted_votes.groupBy("key", "bar_start").agg(F.array_sort(F.collect_list(F.when(against, F.struct(number.alias("n"), said.alias("text"))))).alias("_against"))
    percent = F.concat(F.format_number((F.col("agreement") + 1e-11) * 100, 0), F.lit("%"))
    band = F.lit(None).cast("string")
    for least, text in reversed(CRITIC_BANDS):
        phrase = F.replace(F.lit(text), F.lit("{}"), percent)
        band = phrase if least is None else F.when(F.col("agreement") >= least, phrase).otherwise(band)
    extra = [F.when(F.col("mtf_against"), F.lit(MTF_OPPOSES)), F.when(F.col("smc_ict_against"), F.lit(SMC_ICT_OPPOSE))]
    whole = F.concat(F.array(band), F.transform("_against", lambda a: a["text"]), F.array_compact(F.array(*extra)))
    return decided.join(opposed, ["key", "bar_start"]).withColumn("critique", F.slice(whole, 1, most)).drop("_against")


def regraded(decided: DataFrame, floor: float = dict(GRADES)["MODERATE"]) -> DataFrame:
    """decided with the `grade` of the final confidence, and `blocked` where it falls below the floor after the voters spoke."""
    return decided.withColumns({"grade": grade(F.col("final_confidence")), "blocked": F.col("final_confidence") < floor})


def weighted_sides(votes_: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Green and red totals per bar, each vote weighted by learned weight x confidence."""
    df = votes_ if weights is None else votes_.join(weights, ["key", "bar_start", "agent"], "left")
    w = F.col("confidence") * (F.coalesce(F.col("weight"), F.lit(1.0)) if weights is not None else F.lit(1.0))
    return df.groupBy("key", "bar_start").agg(
        F.sum(F.when(F.col("vote") == "GREEN", w).otherwise(0.0)).alias("green_score"),
        F.sum(F.when(F.col("vote") == "RED", w).otherwise(0.0)).alias("red_score"),
    )


def agent_summary(votes_: DataFrame, performance: DataFrame | None = None) -> DataFrame:
    """Newest vote of every voter per key, with its track record where known."""
    fields = F.struct("bar_start", "vote", "confidence", "score", F.slice("reasons", 1, 4).alias("reasons"))
    latest = votes_.groupBy("key", "agent").agg(F.max_by(fields, "bar_start").alias("_v")).select("key", "agent", "_v.*")
    return latest if performance is None else latest.join(performance, ["key", "agent"], "left")


def aggregate_samples(samples: DataFrame, recent: int = 5) -> DataFrame:
    """Pre-close samples of a bar to one signal: majority side, recent samples weighted 60 to 40.

    `samples` has key, bar_start, sample_no, direction, confidence; `recent` newest ones form the recent
    part. The recent part is the tail of an ordered list of one bar's samples (20 by design).
    """
    entry = F.struct("sample_no", "confidence")
    df = samples.groupBy("key", "bar_start").agg(
        F.count_if(F.col("direction") == "GREEN").alias("bull_votes"),
        F.count_if(F.col("direction") == "RED").alias("bear_votes"),
        F.count(F.lit(1)).alias("n_samples"),
        F.array_sort(F.collect_list(entry)).alias("_list"),
    )
    values = F.transform("_list", lambda s: s["confidence"])
    cut = F.greatest(F.size(values) - recent, F.lit(0))

    def mean(list_: Column) -> Column:
        return F.aggregate(list_, F.lit(0.0), lambda a, x: a + x) / F.size(list_)

    late = mean(F.slice(values, cut + 1, F.lit(recent)))
    early = F.when(cut > 0, mean(F.slice(values, F.lit(1), F.greatest(cut, F.lit(1))))).otherwise(late)
    ratio = F.greatest("bull_votes", "bear_votes") / F.col("n_samples")
    return df.select(
        "key",
        "bar_start",
        F.when(F.col("bull_votes") >= F.col("bear_votes"), "GREEN").otherwise("RED").alias("direction"),
        F.least((late * 0.60 + early * 0.40) * (0.60 + 0.40 * ratio), F.lit(0.99)).alias("confidence"),
        "bull_votes",
        "bear_votes",
        ratio.alias("vote_ratio"),
        "n_samples",
    )
