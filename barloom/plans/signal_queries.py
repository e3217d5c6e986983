"""Signal selection, settlement, statistics and learned tables, over signals made from bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.sessions import threshold_session
from barloom.operators import learning as L
from barloom.operators import scoring as K
from barloom.operators import signals as X
from barloom.operators import training as J
from barloom.operators import voting as G
from barloom.operators.indicators import indicator_frame
from barloom.operators.mtf import boost_table, voting_regime
from barloom.operators.retention import newest_epochs, newest_rows
from barloom.operators.series import frame
from barloom.plans.context_queries import BOOSTS, GREEN_IF_UP, VOTE_REGIME
from barloom.plans.registry import epoch, ints, query, r, rounded
from barloom.plans.score_queries import PROBS, model_probs
from barloom.plans.sqlparts import BARS, INDICATORS, NUMBERED, S, rd, strict, w, with_
from barloom.session import cut_lineage
from barloom.sources.samples import bars

SIGNALS = f""",
sg0 AS (SELECT *, {strict('avg', 'close', 10)} AS m10, avg(spread) {w(15)} AS r15 FROM b),
sig AS (SELECT key, tf_sec, bar_epoch, rn, open, high, low, close, key || '_' || bar_epoch AS signal_id, bar_epoch * 1000 + ascii(key) AS seq,
  CASE WHEN close > m10 THEN 'GREEN' ELSE 'RED' END AS direction,
  0.55::DOUBLE + ((bar_epoch // 3600 * 7 + length(key) * 3) % 40) / 100.0::DOUBLE AS confidence,
  CAST(bar_epoch % 86400 // 3600 AS INTEGER) AS utc_hour, ((bar_epoch // 3600 * 3 + length(key)) % 101) / 100.0::DOUBLE AS agreement,
  ((bar_epoch // 3600 * 5 + length(key)) % 161) - 80.0::DOUBLE AS net,
  CASE WHEN rn >= 19 AND r15 > 0 THEN least(50, 14 + 30 * (spread / r15 - 1)) ELSE 20 END AS adx FROM sg0 WHERE m10 IS NOT NULL),
outc0 AS (SELECT s.*, s.close AS entry_close, n.close AS exit_close FROM sig s
  LEFT JOIN bars n ON n.key = s.key AND n.bar_epoch = s.bar_epoch + s.tf_sec),
outc AS (SELECT *, CASE WHEN exit_close = entry_close THEN 'EXPIRED' WHEN exit_close IS NULL THEN NULL
  WHEN (exit_close > entry_close) = (direction = 'GREEN') THEN 'WIN' ELSE 'LOSS' END AS outcome,
  CASE WHEN exit_close IS NOT NULL THEN bar_epoch + 2 * tf_sec END AS settled_epoch FROM outc0)"""
SIG = with_(BARS, NUMBERED, SIGNALS)
AS_OF = 1706659200


def as_of():
    return F.timestamp_seconds(F.lit(AS_OF))


def signals(spark, sf):
    """One signal per bar: side of the ten-bar mean, confidence from the position in time."""
    hour, size = F.floor(F.unix_timestamp("bar_start") / 3600), F.length("key")
    f = frame(bars(spark, sf), back=24)
    f = f.with_columns({"_m10": f.mean("close", 10), "adx": X.range_index(f)})
    rows = f.core().filter("_m10 IS NOT NULL")
    return rows.select(
        "key", "tf_sec", "bar_start", "rn", "open", "high", "low", "close", "adx",
        F.concat_ws("_", "key", F.unix_timestamp("bar_start").cast("string")).alias("signal_id"),
        (F.unix_timestamp("bar_start") * 1000 + F.ascii("key")).alias("seq"),
        F.when(F.col("close") > F.col("_m10"), "GREEN").otherwise("RED").alias("direction"),
        (0.55 + ((hour * 7 + size * 3) % 40) / 100.0).alias("confidence"),
        F.hour("bar_start").alias("utc_hour"),
        (((hour * 3 + size) % 101) / 100.0).alias("agreement"),
        (((hour * 5 + size) % 161) - 80.0).alias("net"),
    )


def outcomes(spark, sf):
    return cut_lineage(X.settle(signals(spark, sf), bars(spark, sf)))


# ---------------------------------------------------------------- gates and selection


@query(
    "signal_gates",
    SIG
    + """, g AS (SELECT *, CASE WHEN confidence >= 0.82::DOUBLE THEN 'ELITE' WHEN confidence >= 0.75::DOUBLE THEN 'HIGH'
  WHEN confidence >= 0.62::DOUBLE THEN 'MODERATE' ELSE 'SKIP' END AS grade FROM sig)
SELECT key, bar_epoch, grade, CASE WHEN rn < 149 THEN 'min_history' WHEN bar_epoch // 3600 % 11 = 0 THEN 'news' WHEN grade = 'SKIP' THEN 'low_score'
  WHEN confidence < 0.7::DOUBLE THEN 'below_threshold' WHEN bar_epoch // 3600 % 7 >= 5 THEN 'circuit_breaker'
  WHEN bar_epoch // 3600 % 9 > 5 THEN 'too_late' END AS block_reason FROM g""",
)
def signal_gates(spark, sf):
    hour = F.floor(F.unix_timestamp("bar_start") / 3600)
    grade = K.grade(F.col("confidence"))
    reason = X.block_reason(
        F.col("rn"), hour % 11 == 0, grade, F.col("confidence"), F.lit(0.7), hour % 7, hour % 9
    )
    return signals(spark, sf).select("key", epoch(), grade.alias("grade"), reason.alias("block_reason"))


WINDOW = """,
wp AS (SELECT *, bar_epoch // 3600 % 5 AS place, bar_epoch // 18000 AS window_no FROM sig),
ws AS (SELECT *, round(agreement * 40 + [70, 90, 85, 65, 40][place + 1] * 0.2::DOUBLE + CASE WHEN direction = 'GREEN' THEN net ELSE -net END * 0.25::DOUBLE
  + confidence * 15, 9) AS score FROM wp)"""


def _scored(spark, sf):
    place = F.floor(F.unix_timestamp("bar_start") / 3600) % 5
    value = X.candle_score(F.col("agreement"), F.col("net"), F.col("confidence"), F.col("direction"), place)
    return signals(spark, sf).withColumn("score", F.round(value, 9))


@query("candle_scores", SIG + WINDOW + f"SELECT key, bar_epoch, {rd('score')} FROM ws")
def candle_scores(spark, sf):
    return _scored(spark, sf).select("key", epoch(), *rounded("score"))


@query(
    "window_top3",
    SIG
    + WINDOW
    + """, e AS (SELECT *, confidence >= 0.62::DOUBLE AS eligible, CASE WHEN confidence >= 0.62::DOUBLE THEN score END AS es FROM ws),
l AS (SELECT *, coalesce(list(es) FILTER (es IS NOT NULL) OVER (PARTITION BY key, window_no ORDER BY bar_epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS bef,
  row_number() OVER (PARTITION BY key, window_no ORDER BY eligible DESC, score DESC, bar_epoch) AS rk FROM e)
SELECT key, bar_epoch, window_no, eligible AND len(list_filter(bef, lambda s: s >= score)) < 3 AS accepted, eligible AND rk <= 3 AS retained FROM l""",
)
def window_top3(spark, sf):
    return X.window_selection(_scored(spark, sf)).select("key", epoch(), "window_no", "accepted", "retained")


@query(
    "best_per_interval",
    SIG
    + """SELECT bar_epoch // 7200 * 7200 AS interval_epoch, arg_max(key, row(confidence, -seq)) AS key, arg_max(signal_id, row(confidence, -seq)) AS signal_id,
  max(confidence) AS confidence FROM sig WHERE confidence >= 0.62::DOUBLE GROUP BY ALL""",
)
def best_per_interval(spark, sf):
    best = X.best_per_interval(signals(spark, sf), "2 hours")
    return best.select(epoch("interval_start", "interval_epoch"), "key", "signal_id", "confidence")


# ---------------------------------------------------------------- settlement and statistics


@query(
    "settle_signals",
    SIG + "SELECT signal_id, key, bar_epoch, direction, entry_close, exit_close, outcome, coalesce(settled_epoch, 0) AS settled_epoch FROM outc",
)
def settle_signals(spark, sf):
    return outcomes(spark, sf).select(
        "signal_id", "key", epoch(), "direction", "entry_close", "exit_close", "outcome",
        F.coalesce(F.unix_timestamp("settled_at"), F.lit(0)).cast("bigint").alias("settled_epoch"),
    )


@query(
    "expire_pending",
    SIG
    + """SELECT signal_id, CASE WHEN outcome IS NULL AND bar_epoch < 1706659200 - 3600 THEN 'EXPIRED' ELSE outcome END AS outcome FROM outc""",
)
def expire_pending(spark, sf):
    return X.expire(outcomes(spark, sf), as_of()).select("signal_id", "outcome")


@query(
    "manual_override",
    SIG + "SELECT signal_id, CASE WHEN utc_hour = 3 AND direction = 'RED' THEN 'WIN' ELSE outcome END AS outcome FROM outc",
)
def manual_override(spark, sf):
    settled = outcomes(spark, sf)
    manual = settled.filter("utc_hour = 3 AND direction = 'RED'").select("signal_id", F.lit("WIN").alias("outcome"))
    return X.override(settled, manual).select("signal_id", "outcome")


@query(
    "signal_stats",
    SIG
    + """, s AS (SELECT key, count(*) AS total, count(*) FILTER (outcome IN ('WIN', 'LOSS')) AS settled, count(*) FILTER (outcome = 'WIN') AS wins,
  count(*) FILTER (outcome = 'LOSS') AS losses, count(*) FILTER (outcome IS NULL) AS pending FROM outc GROUP BY key)
SELECT key, total, settled, wins, losses, pending, round(CASE WHEN settled = 0 THEN 0 ELSE wins / settled::DOUBLE END + 1e-11::DOUBLE, 6) AS win_rate FROM s""",
)
def signal_stats(spark, sf):
    return X.statistics(outcomes(spark, sf)).select("key", "total", "settled", "wins", "losses", "pending", *rounded("win_rate"))


@query(
    "win_rates",
    SIG
    + """SELECT key, round(avg(CASE WHEN outcome = 'WIN' THEN 1.0::DOUBLE ELSE 0 END) + 1e-11::DOUBLE, 6) AS win_rate, count(*) AS settled
FROM outc WHERE outcome IN ('WIN', 'LOSS') GROUP BY key HAVING count(*) >= 5""",
)
def win_rates(spark, sf):
    return X.win_rate(outcomes(spark, sf)).select("key", *rounded("win_rate"), "settled")


@query(
    "bad_hours",
    SIG
    + """SELECT key, utc_hour, round(avg(CASE WHEN outcome = 'WIN' THEN 1.0::DOUBLE ELSE 0 END) + 1e-11::DOUBLE, 6) AS win_rate, count(*) AS settled
FROM outc WHERE outcome IN ('WIN', 'LOSS') GROUP BY key, utc_hour
HAVING count(*) >= 3 AND avg(CASE WHEN outcome = 'WIN' THEN 1.0::DOUBLE ELSE 0 END) <= 0.65""",
)
def bad_hours(spark, sf):
    return X.bad_hours(outcomes(spark, sf), limit=0.65).select("key", "utc_hour", *rounded("win_rate"), "settled")


@query(
    "signal_history",
    SIG + "SELECT key, signal_id, direction, confidence FROM outc QUALIFY row_number() OVER (PARTITION BY key ORDER BY bar_epoch DESC) <= 50",
)
def signal_history(spark, sf):
    return newest_rows(signals(spark, sf).drop("rn"), 50).select("key", "signal_id", "direction", "confidence")


@query(
    "signal_retention_500",
    SIG + "SELECT signal_id, bar_epoch FROM sig ORDER BY bar_epoch DESC, signal_id LIMIT 500",
)
def signal_retention_500(spark, sf):
    newest = signals(spark, sf).orderBy(F.col("bar_start").desc(), "signal_id").limit(500)
    return newest.select("signal_id", epoch())


@query(
    "loss_streak",
    SIG
    + """, c AS (SELECT *, coalesce(sum(CASE WHEN outcome = 'WIN' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY bar_epoch), 0) AS island FROM outc)
SELECT key, bar_epoch, outcome, CAST(sum(CASE WHEN outcome = 'LOSS' THEN 1 ELSE 0 END) OVER (PARTITION BY key, island ORDER BY bar_epoch) AS INTEGER) AS streak FROM c""",
)
def loss_streak(spark, sf):
    return X.loss_streak(outcomes(spark, sf)).select("key", epoch(), "outcome", "streak")


# ---------------------------------------------------------------- learned tables

BUCKETS = """,
bu AS (SELECT key, bar_epoch, outcome, CASE WHEN utc_hour >= 8 AND utc_hour < 13 THEN 'LONDON' WHEN utc_hour >= 13 AND utc_hour < 17 THEN 'OVERLAP'
    WHEN utc_hour >= 17 AND utc_hour < 21 THEN 'NEW_YORK' ELSE 'ASIAN' END AS session,
  CASE WHEN adx < 18 THEN 'CHOP' WHEN adx < 28 THEN 'TREND' ELSE 'STRONG_TREND' END AS volatility FROM outc WHERE outcome IN ('WIN', 'LOSS')),
bn AS (SELECT *, row_number() OVER q AS n, sum(CASE WHEN outcome = 'WIN' THEN 1 ELSE 0 END) OVER q AS wins FROM bu
  WINDOW q AS (PARTITION BY key, session, volatility ORDER BY bar_epoch ROWS UNBOUNDED PRECEDING)),
at AS (SELECT key, session, volatility, n, bar_epoch, wins, 0.62::DOUBLE AS threshold FROM bn WHERE n = 1
  UNION ALL
  SELECT bn.key, bn.session, bn.volatility, bn.n, bn.bar_epoch, bn.wins, CASE WHEN bn.n < 8 THEN at.threshold
    WHEN bn.wins / bn.n::DOUBLE < 0.62::DOUBLE THEN least(at.threshold + 0.03::DOUBLE, 0.85::DOUBLE)
    WHEN bn.wins / bn.n::DOUBLE > 0.62::DOUBLE + 0.05::DOUBLE THEN greatest(at.threshold - 0.01::DOUBLE, 0.62::DOUBLE) ELSE at.threshold END
  FROM at JOIN bn ON bn.key = at.key AND bn.session = at.session AND bn.volatility = at.volatility AND bn.n = at.n + 1)"""
THRESHOLDS = SIG.replace("WITH ", "WITH RECURSIVE ", 1) + BUCKETS.replace("at AS (", "thr AS (").replace("at.", "thr.").replace("FROM at JOIN", "FROM thr JOIN")


@query(
    "adaptive_threshold",
    THRESHOLDS
    + "SELECT key, session, volatility, bar_epoch, round(threshold + 1e-11::DOUBLE, 6) AS threshold, CAST(wins AS BIGINT) AS wins, CAST(n - wins AS BIGINT) AS losses FROM thr",
)
def adaptive_threshold(spark, sf):
    walked = L.adaptive_threshold(L.threshold_buckets(outcomes(spark, sf)))
    return walked.select("key", "session", "volatility", epoch(), *rounded("threshold"), "wins", "losses")


@query(
    "current_thresholds",
    THRESHOLDS
    + """SELECT key, session, volatility, round(arg_max(threshold, n) + 1e-11::DOUBLE, 6) AS threshold, CAST(max(wins) AS BIGINT) AS wins,
  CAST(max(n) - max(wins) AS BIGINT) AS losses FROM thr GROUP BY ALL""",
)
def current_thresholds(spark, sf):
    now = L.current_thresholds(L.adaptive_threshold(L.threshold_buckets(outcomes(spark, sf))))
    return now.select("key", "session", "volatility", *rounded("threshold"), "wins", "losses")


@query(
    "range_index",
    SIG + f"SELECT key, bar_epoch, {rd('adx')} FROM sig",
)
def range_index(spark, sf):
    return signals(spark, sf).select("key", epoch(), *rounded("adx"))


# Three simple voters stand in for the eight, so the track record can be checked by hand.
VOTERS = """,
vt AS (SELECT key, bar_epoch, 'trend' AS agent, direction AS vote, 0.6::DOUBLE AS confidence FROM sig
  UNION ALL SELECT key, bar_epoch, 'colour', CASE WHEN close > open THEN 'GREEN' WHEN close < open THEN 'RED' ELSE 'NEUTRAL' END, 0.7::DOUBLE FROM sig
  UNION ALL SELECT key, bar_epoch, 'hour', CASE WHEN utc_hour < 8 THEN 'GREEN' WHEN utc_hour < 16 THEN 'RED' ELSE 'NEUTRAL' END, confidence FROM sig)"""
CREDITS = (
    VOTERS
    + """,
cr AS (SELECT v.key, v.agent, v.bar_epoch, (v.vote = o.direction) = (o.outcome = 'WIN') AS correct FROM vt v JOIN outc o USING (key, bar_epoch)
  WHERE v.vote <> 'NEUTRAL' AND o.outcome IN ('WIN', 'LOSS')),
pf AS (SELECT *, CAST(sum(CAST(correct AS INTEGER)) OVER q AS BIGINT) AS wins, count(*) OVER q AS total,
  avg(CAST(correct AS INTEGER)::DOUBLE) OVER (PARTITION BY key, agent ORDER BY bar_epoch ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS recent_rate
  FROM cr WINDOW q AS (PARTITION BY key, agent ORDER BY bar_epoch ROWS UNBOUNDED PRECEDING)),
pw AS (SELECT *, total - wins AS losses, CASE WHEN total < 5 THEN 1 ELSE greatest(0.2::DOUBLE, least(2, 1 + (recent_rate - 0.5::DOUBLE) * 4)) END AS weight FROM pf)"""
)


def simple_votes(spark, sf, source=None):
    rows = signals(spark, sf) if source is None else source
    colour = F.when(F.col("close") > F.col("open"), "GREEN").when(F.col("close") < F.col("open"), "RED").otherwise("NEUTRAL")
    hour = F.when(F.col("utc_hour") < 8, "GREEN").when(F.col("utc_hour") < 16, "RED").otherwise("NEUTRAL")
    ballots = [
        F.struct(F.lit(n).alias("agent"), v.alias("vote"), c.alias("confidence"))
        for n, v, c in (
            ("trend", F.col("direction"), F.lit(0.6)), ("colour", colour, F.lit(0.7)), ("hour", hour, F.col("confidence")),
        )
    ]
    return rows.select("key", "bar_start", F.explode(F.array(*ballots)).alias("_v")).select("key", "bar_start", "_v.*")


def _performance(spark, sf):
    settled = outcomes(spark, sf)
    return L.agent_performance(L.credited(simple_votes(spark, sf, settled), settled))


@query(
    "agent_weights",
    SIG + CREDITS + f"SELECT key, agent, bar_epoch, wins, losses, total, {rd('recent_rate', 'weight')} FROM pw",
)
def agent_weights(spark, sf):
    return _performance(spark, sf).select(
        "key", "agent", epoch(), "wins", "losses", "total", *rounded("recent_rate", "weight")
    )


@query(
    "current_agent_weights",
    SIG
    + CREDITS
    + f"SELECT key, agent, wins, losses, total, {rd('weight')} FROM pw QUALIFY row_number() OVER (PARTITION BY key, agent ORDER BY bar_epoch DESC) = 1",
)
def current_agent_weights(spark, sf):
    return L.current_weights(_performance(spark, sf)).select("key", "agent", "wins", "losses", "total", *rounded("weight"))


@query(
    "outcome_log_first",
    SIG
    + """, d AS (SELECT signal_id, seq, confidence FROM sig UNION ALL SELECT signal_id, seq + 5, confidence - 1 FROM sig WHERE utc_hour % 3 = 0)
SELECT signal_id, arg_min(confidence, seq) AS confidence, min(seq) AS seq FROM d GROUP BY signal_id""",
)
def outcome_log_first(spark, sf):
    """Repeated inserts of a signal id keep the first record."""
    first = signals(spark, sf).select("signal_id", "seq", "confidence", "utc_hour")
    again = first.filter("utc_hour % 3 = 0").withColumns({"seq": F.col("seq") + 5, "confidence": F.col("confidence") - 1})
    return L.outcome_log(first.unionByName(again)).select("signal_id", "confidence", "seq")


DIAG = """,
bh AS (SELECT key, utc_hour, count(*) AS total, count(*) FILTER (outcome = 'WIN') AS wins, avg(CASE WHEN outcome = 'WIN' THEN 1.0::DOUBLE ELSE 0 END) AS win_rate
  FROM outc WHERE outcome IN ('WIN', 'LOSS') AND settled_epoch >= 1706659200 - 15 * 86400 GROUP BY key, utc_hour
  HAVING count(*) >= 8 AND avg(CASE WHEN outcome = 'WIN' THEN 1.0::DOUBLE ELSE 0 END) < 0.7),
bb AS (SELECT key, CASE WHEN confidence >= 0.9::DOUBLE THEN '90-99' WHEN confidence >= 0.8::DOUBLE THEN '80-89' WHEN confidence >= 0.7::DOUBLE THEN '70-79' ELSE 'below70' END AS band,
  count(*) AS total, avg(CASE WHEN outcome = 'WIN' THEN 1.0::DOUBLE ELSE 0 END) AS win_rate FROM outc
  WHERE outcome IN ('WIN', 'LOSS') AND settled_epoch >= 1706659200 - 14 * 86400 GROUP BY ALL
  HAVING count(*) >= 8 AND avg(CASE WHEN outcome = 'WIN' THEN 1.0::DOUBLE ELSE 0 END) < 0.75)"""


def _diagnosis(spark, sf):
    settled = outcomes(spark, sf)
    return L.diagnose_hours(settled, as_of(), days=15, limit=0.7), L.diagnose_bands(settled, as_of(), limit=0.75)


@query("bad_hour_diagnosis", SIG + DIAG + f"SELECT key, utc_hour, total, wins, {rd('win_rate')} FROM bh")
def bad_hour_diagnosis(spark, sf):
    return _diagnosis(spark, sf)[0].select("key", "utc_hour", "total", "wins", *rounded("win_rate"))


@query("overconfidence_bands", SIG + DIAG + f"SELECT key, band, total, {rd('win_rate')} FROM bb")
def overconfidence_bands(spark, sf):
    return _diagnosis(spark, sf)[1].select("key", "band", "total", *rounded("win_rate"))


@query(
    "hour_multipliers",
    SIG
    + DIAG
    + """, cur AS (SELECT DISTINCT key, utc_hour, 0.75::DOUBLE + utc_hour / 100.0::DOUBLE AS multiplier FROM sig WHERE utc_hour % 2 = 0),
j AS (SELECT coalesce(c.key, h.key) AS key, coalesce(c.utc_hour, h.utc_hour) AS utc_hour,
  CASE WHEN h.key IS NOT NULL THEN greatest(0.7::DOUBLE, coalesce(c.multiplier, 1) - 0.04::DOUBLE) ELSE c.multiplier END AS m FROM cur c FULL JOIN bh h ON c.key = h.key AND c.utc_hour = h.utc_hour),
n AS (SELECT key, count(*) AS bands FROM bb GROUP BY key)
SELECT j.key, j.utc_hour, round(CASE WHEN n.bands > 0 THEN greatest(0.7::DOUBLE, m * pow(0.97::DOUBLE, n.bands)) ELSE m END + 1e-11::DOUBLE, 6) AS multiplier FROM j LEFT JOIN n ON n.key = j.key""",
)
def hour_multipliers(spark, sf):
    current = signals(spark, sf).filter("utc_hour % 2 = 0").select(
        "key", "utc_hour", (0.75 + F.col("utc_hour") / 100.0).alias("multiplier")
    ).distinct()
    return L.updated_multipliers(current, *_diagnosis(spark, sf)).select("key", "utc_hour", *rounded("multiplier"))


@query(
    "problem_log",
    SIG
    + DIAG
    + """, pl AS (SELECT 'BAD_HOUR' AS kind, key, utc_hour, win_rate FROM bh UNION ALL SELECT 'OVERCONFIDENCE', key, -1, win_rate FROM bb)
SELECT kind, key, utc_hour, round(win_rate + 1e-11::DOUBLE, 6) AS win_rate FROM pl""",
)
def problem_log(spark, sf):
    return L.problem_log(*_diagnosis(spark, sf), as_of()).select("kind", "key", "utc_hour", *rounded("win_rate"))


@query(
    "evolution_log",
    SIG
    + DIAG
    + """, pl AS (SELECT 'BAD_HOUR' AS kind, key, utc_hour, key || ' UTC-' || lpad(CAST(utc_hour AS VARCHAR), 2, '0') || 'h: ' || total || ' signals, ' || printf('%.1f', win_rate * 100 + 1e-9::DOUBLE) || '% WR' AS detail, win_rate FROM bh
  UNION ALL SELECT 'OVERCONFIDENCE', key, -1, key || ' confidence ' || band || '%: ' || printf('%.1f', win_rate * 100 + 1e-9::DOUBLE) || '% WR on ' || total || ' signals', win_rate FROM bb)
SELECT 1706659200 AS logged_epoch, kind, key, utc_hour, detail, round(win_rate + 1e-11::DOUBLE, 6) AS win_rate FROM pl ORDER BY kind, key, utc_hour, detail LIMIT 20""",
)
def evolution_log(spark, sf):
    """The newest 20 findings with time and detail."""
    log = L.newest_findings(L.problem_log(*_diagnosis(spark, sf), as_of()), 20)
    return log.select(F.unix_timestamp("logged_at").alias("logged_epoch"), "kind", "key", "utc_hour", "detail", *rounded("win_rate"))


@query(
    "last_signal",
    SIG + "SELECT key, bar_epoch, signal_id, direction, confidence FROM sig QUALIFY row_number() OVER (PARTITION BY key ORDER BY bar_epoch DESC) = 1",
)
def last_signal(spark, sf):
    """The newest signal of every key."""
    fields = F.struct("bar_start", "signal_id", "direction", "confidence")
    newest = signals(spark, sf).groupBy("key").agg(F.max_by(fields, "bar_start").alias("_s"))
    return newest.select("key", epoch("_s.bar_start"), "_s.signal_id", "_s.direction", "_s.confidence")


@query(
    "marker_dedupe",
    SIG
    + """SELECT key, tf_sec, bar_epoch, arg_min(copy, arrival) AS copy FROM (SELECT key, tf_sec, bar_epoch, bar_epoch * 1000 AS arrival, 'first' AS copy FROM sig
  UNION ALL SELECT key, tf_sec, bar_epoch, bar_epoch * 1000 + CASE WHEN utc_hour < 6 THEN -1 ELSE 1 END AS arrival, 'second' AS copy FROM sig WHERE utc_hour < 12)
WHERE 1706659200 - bar_epoch <= 86400 * 2 GROUP BY ALL""",
)
def marker_dedupe(spark, sf):
    """The marker that arrived first for each bar; some bars have a second one that came earlier or later."""
    rows = signals(spark, sf).withColumns({"seq": F.unix_timestamp("bar_start") * 1000, "copy": F.lit("first")})
    rows = rows.select("key", "tf_sec", "bar_start", "utc_hour", "seq", "copy")
    again = rows.filter("utc_hour < 12").withColumns(
        {"seq": F.col("seq") + F.when(F.col("utc_hour") < 6, -1).otherwise(1), "copy": F.lit("second")}
    )
    return X.deduplicate_markers(rows.unionByName(again), as_of(), 86400 * 2).select("key", "tf_sec", epoch(), "copy")


@query(
    "vote_retention",
    SIG + VOTERS + "SELECT key, bar_epoch, agent, vote FROM vt QUALIFY dense_rank() OVER (PARTITION BY key ORDER BY bar_epoch DESC) <= 200",
)
def vote_retention(spark, sf):
    return newest_epochs(simple_votes(spark, sf), 200).select("key", epoch(), "agent", "vote")


# ---------------------------------------------------------------- voting


@query(
    "weighted_votes",
    SIG
    + CREDITS
    + """SELECT v.key, v.bar_epoch, round(sum(CASE WHEN vote = 'GREEN' THEN coalesce(p.weight, 1) * v.confidence ELSE 0 END) + 1e-11::DOUBLE, 6) AS green_score,
  round(sum(CASE WHEN vote = 'RED' THEN coalesce(p.weight, 1) * v.confidence ELSE 0 END) + 1e-11::DOUBLE, 6) AS red_score
FROM vt v LEFT JOIN pw p ON p.key = v.key AND p.agent = v.agent AND p.bar_epoch = v.bar_epoch GROUP BY v.key, v.bar_epoch""",
)
def weighted_votes(spark, sf):
    settled = outcomes(spark, sf)
    votes = simple_votes(spark, sf, settled)
    weights = L.agent_performance(L.credited(votes, settled)).select("key", "bar_start", "agent", "weight")
    return G.weighted_sides(votes, weights).select("key", epoch(), *rounded("green_score", "red_score"))


SAMPLES = """,
sa AS (SELECT b.key, b.bar_epoch, i AS sample_no, CASE WHEN (bar_epoch // 3600 + i * length(key)) % 3 = 0 THEN 'RED' ELSE 'GREEN' END AS direction,
  0.5::DOUBLE + ((bar_epoch // 3600 * 3 + i * 7) % 45) / 100.0::DOUBLE AS confidence FROM b, (SELECT unnest(range(0, 20)) AS i) t)"""


@query(
    "preclose_samples",
    with_(BARS, NUMBERED, SAMPLES)
    + """, a AS (SELECT key, bar_epoch, count(*) FILTER (direction = 'GREEN') AS bull_votes, count(*) FILTER (direction = 'RED') AS bear_votes, count(*) AS n_samples,
  avg(confidence) FILTER (sample_no >= 15) AS late, avg(confidence) FILTER (sample_no < 15) AS early FROM sa GROUP BY key, bar_epoch)
SELECT key, bar_epoch, CASE WHEN bull_votes >= bear_votes THEN 'GREEN' ELSE 'RED' END AS direction, bull_votes, bear_votes, n_samples,
  round(least((late * 0.6::DOUBLE + early * 0.4::DOUBLE) * (0.6::DOUBLE + 0.4::DOUBLE * greatest(bull_votes, bear_votes) / n_samples), 0.99) + 1e-11::DOUBLE, 6) AS confidence FROM a""",
)
def preclose_samples(spark, sf):
    hour, i = F.floor(F.unix_timestamp("bar_start") / 3600), F.col("sample_no")
    samples = (
        bars(spark, sf, reuse=False)
        .select("key", "bar_start", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("sample_no"))
        .withColumns(
            {
                "direction": F.when((hour + i * F.length("key")) % 3 == 0, "RED").otherwise("GREEN"),
                "confidence": 0.5 + ((hour * 3 + i * 7) % 45) / 100.0,
            }
        )
    )
    return G.aggregate_samples(samples).select(
        "key", epoch(), "direction", "bull_votes", "bear_votes", "n_samples", *rounded("confidence")
    )


# ---------------------------------------------------------------- training sets

LABELLED = f""",
lb AS (SELECT *, CAST(lead(close) {S} > lead(open) {S} AS INTEGER) AS label FROM b)"""


def labelled(spark, sf, families=()):
    f = indicator_frame(bars(spark, sf), list(families), ahead=1)
    return f.then(J.next_bar_label)


@query("next_bar_label", with_(BARS, NUMBERED, LABELLED) + "SELECT key, bar_epoch, label FROM lb WHERE label IS NOT NULL")
def next_bar_label(spark, sf):
    return labelled(spark, sf).core("key", epoch(), "label").filter("label IS NOT NULL")


@query(
    "sequence_windows",
    with_(BARS, NUMBERED, LABELLED)
    + f""", s AS (SELECT key, bar_epoch, label, list(close) {w(30)} AS cs, list(spread) {w(30)} AS hs FROM lb)
SELECT key, bar_epoch, label, len(cs) AS steps, round(cs[1] + 1e-11::DOUBLE, 6) AS first_close, round(list_sum(hs) + 1e-11::DOUBLE, 6) AS sum_range FROM s WHERE len(cs) = 30 AND label IS NOT NULL""",
)
def sequence_windows(spark, sf):
    """Training sequences of 30 bars, shown by their length, first close and summed range."""
    f = labelled(spark, sf).with_columns({"range": F.col("high") - F.col("low")})
    f = f.then(lambda x: J.sequence_windows(x, ["close", "range"]))
    rows = f.core().filter("sequence IS NOT NULL AND label IS NOT NULL")
    total = F.aggregate("sequence", F.lit(0.0), lambda a, s: a + F.get(s, F.lit(1)))
    return rows.select(
        "key",
        epoch(),
        "label",
        F.size("sequence").cast("bigint").alias("steps"),
        r(F.get(F.get("sequence", F.lit(0)), F.lit(0))).alias("first_close"),
        r(total).alias("sum_range"),
    )


@query(
    "ts_cv_folds",
    with_(BARS, NUMBERED, LABELLED)
    + """, n AS (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM lb WHERE label IS NOT NULL)
SELECT key, bar_epoch, CAST(greatest(0, 5 - (n - rn - 1) // (n // 6)) AS INTEGER) AS fold FROM n""",
)
def ts_cv_folds(spark, sf):
    rows = labelled(spark, sf).core().filter("label IS NOT NULL")
    return J.expanding_folds(rows).select("key", epoch(), "fold")


@query(
    "chronological_split",
    with_(BARS, NUMBERED, LABELLED)
    + """, n AS (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM lb WHERE label IS NOT NULL)
SELECT key, bar_epoch, rn < CAST(floor(n * 0.8::DOUBLE) AS BIGINT) AS is_train FROM n""",
)
def chronological_split(spark, sf):
    rows = labelled(spark, sf).core().filter("label IS NOT NULL")
    return J.chronological_split(rows).select("key", epoch(), "is_train")


@query(
    "retrain_cohorts",
    with_(BARS, NUMBERED)
    + "SELECT key, bar_epoch, CASE WHEN rn >= 150 THEN (rn - 150) // 20 ELSE -1 END AS cohort, rn >= 150 AND (rn + 1) % 20 = 0 AS retrain_due FROM b",
)
def retrain_cohorts(spark, sf):
    rows = frame(bars(spark, sf), back=0).core()
    return J.retrain_cohorts(rows).select(
        "key", epoch(), F.coalesce("cohort", F.lit(-1).cast("bigint")).alias("cohort"), "retrain_due"
    )


@query(
    "standardised_features",
    with_(BARS, INDICATORS, f", lz AS (SELECT *, lead(close) {S} AS nxt FROM feat)")
    + """, tr AS (SELECT avg(coalesce(rsi_14, 0)) AS m, stddev_samp(coalesce(rsi_14, 0)) AS s FROM lz WHERE nxt IS NOT NULL AND bar_epoch < 1705968000)
SELECT key, bar_epoch, round((coalesce(rsi_14, 0) - m) / s + 1e-11::DOUBLE, 6) + 0.0::DOUBLE AS rsi_scaled FROM lz, tr WHERE nxt IS NOT NULL""",
)
def standardised_features(spark, sf):
    """RSI standardised with mean and deviation of the rows before a cut in time."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = labelled(spark, sf, ["rsi"]).core().filter("label IS NOT NULL").na.fill(0.0, ["rsi_14"])
    rows = cut_lineage(rows)
    scaler = Pipeline(stages=[
        VectorAssembler(inputCols=["rsi_14"], outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
    ]).fit(rows.filter(F.unix_timestamp("bar_start") < 1705968000))
    scaled = scaler.transform(rows)
    return scaled.select("key", epoch(), r(vector_to_array("features")[0]).alias("rsi_scaled"))


BUFFER = """,
bf AS (SELECT o.key, o.bar_epoch, CAST(o.outcome = 'WIN' AS INTEGER) AS label, CASE WHEN o.bar_epoch // 3600 % 17 = 0 THEN 2 ELSE 3 END AS len_p
  FROM outc o WHERE o.outcome IN ('WIN', 'LOSS')),
bk AS (SELECT * FROM bf QUALIFY row_number() OVER (PARTITION BY key ORDER BY bar_epoch DESC) <= 400)"""


def stacking_buffer(spark, sf):
    """Model probabilities and results of decided signals; now and then a model was missing."""
    decided = outcomes(spark, sf).filter("outcome IN ('WIN', 'LOSS')")
    hour, size = F.floor(F.unix_timestamp("bar_start") / 3600), F.length("key")
    probs = [0.30 + ((hour * a + size * b) % 41) / 100.0 for a, b in ((7, 3), (11, 5), (13, 2))]
    vector = F.when(hour % 17 == 0, F.array(*probs[:2])).otherwise(F.array(*probs))
    return decided.select(
        "key", "tf_sec", "bar_start", vector.alias("probs"), (F.col("outcome") == "WIN").cast("int").alias("label")
    )


@query(
    "stacking_buffer",
    SIG + BUFFER + "SELECT key, bar_epoch, label, CAST(len_p AS INTEGER) AS n_probs FROM bk",
)
def stacking_buffer_newest(spark, sf):
    """The newest 400 buffered rows of each key."""
    kept = newest_rows(stacking_buffer(spark, sf), 400)
    return kept.select("key", epoch(), "label", F.size("probs").alias("n_probs"))


@query(
    "stacking_trigger",
    SIG
    + BUFFER
    + """, nw AS (SELECT key, arg_max(len_p, bar_epoch) AS width, count(*) AS n FROM bk GROUP BY key)
SELECT bk.key, n, count(*) AS usable, n >= 50 AND n % 25 = 0 AS due FROM bk JOIN nw ON nw.key = bk.key AND bk.len_p = nw.width GROUP BY bk.key, n""",
)
def stacking_trigger(spark, sf):
    buffered = newest_rows(stacking_buffer(spark, sf), 400).withColumn("ts", F.col("bar_start"))
    return J.stacking_trigger(buffered).select("key", "n", "usable", "due")
