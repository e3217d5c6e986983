"""The whole chain of signals: real gates, learned thresholds, voters' records, settlement."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import chain as H
from barloom.operators import learning as L
from barloom.operators import signals as X
from barloom.operators import voting as G
from barloom.operators.analysis import score
from barloom.operators.joins import near_events
from barloom.operators.mtf import boost_table
from barloom.operators.series import frame
from barloom.plans import context_queries as C
from barloom.plans import signal_queries as S
from barloom.plans.registry import epoch, query, rounded
from barloom.plans.score_queries import FULL, context
from barloom.plans.sqlparts import rd, w
from barloom.plans.vote_queries import VOTES
from barloom.session import cut_lineage
from barloom.sources.samples import bars

_ORDER = ", ".join(f"'{name}'" for name in H.AGENTS)

INPUT = (
    C.NEWS
    + C.AFFECTED
    + f""",
est AS (SELECT key, bar_epoch, CASE WHEN rn >= 19 AND r15 > 0 THEN least(50, 14 + 30 * (spread / r15 - 1)) ELSE 20 END AS est FROM (SELECT *, avg(spread) {w(15)} AS r15 FROM b) t),
cast_votes AS (SELECT v.key, v.bar_epoch, list(CASE v.vote WHEN 'GREEN' THEN 1 WHEN 'RED' THEN -1 ELSE 0 END ORDER BY list_position([{_ORDER}], v.agent)) AS v,
    list(coalesce(bo.boost, 1) * v.confidence ORDER BY list_position([{_ORDER}], v.agent)) AS bal
  FROM votes v JOIN scored s ON s.key = v.key AND s.bar_epoch = v.bar_epoch
  LEFT JOIN {C.BOOSTS.replace('AS boosts', 'AS bo')} ON bo.vote_regime = s.vote_regime AND bo.agent = v.agent GROUP BY v.key, v.bar_epoch),
chain_in AS (SELECT s.key, CAST(3600 AS BIGINT) AS tf, s.bar_epoch AS bar_at, s.rn, CASE WHEN s.direction = 'GREEN' THEN 1 ELSE -1 END AS side, s.confidence,
    coalesce(s.adx_14, 0) AS adx, est.est, EXISTS (SELECT 1 FROM hit h WHERE h.key = s.key AND abs(h.sec - s.bar_epoch) <= 900) AS in_news,
    s.mtf_agreement AS agreement, s.net_score AS net, s.close, c.v, c.bal
  FROM scored s JOIN est ON est.key = s.key AND est.bar_epoch = s.bar_epoch JOIN cast_votes c ON c.key = s.key AND c.bar_epoch = s.bar_epoch)"""
)

_BUCKET = "(CASE WHEN {h} >= 8 AND {h} < 13 THEN 0 WHEN {h} >= 13 AND {h} < 17 THEN 1 WHEN {h} >= 17 AND {h} < 21 THEN 2 ELSE 3 END * 3 + CASE WHEN {x} < 18 THEN 0 WHEN {x} < 28 THEN 1 ELSE 2 END + 1)"
_BAND = "CASE WHEN {c} >= 0.9::DOUBLE THEN 0 WHEN {c} >= 0.8::DOUBLE THEN 1 WHEN {c} >= 0.7::DOUBLE THEN 2 ELSE 3 END"


def _each(expression: str) -> str:
    """Sum over the eight voters."""
    return f"list_sum(list_transform(range(1, 9), lambda i: {expression}))"


def _set(list_: str, place: str, value: str) -> str:
    return f"list_transform({list_}, lambda x, i: CASE WHEN i = {place} THEN {value} ELSE x END)"


def chain_sql(source: str, floor: str = "0.62") -> str:
    """The chain over `source` as a recursion: one step a bar, the state in lists."""
    return f""",
cin AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY bar_at) AS n FROM {source}),
chain AS (
  SELECT key, 0::BIGINT AS n, 0::BIGINT AS bar_at, 0::DOUBLE AS close, NULL::VARCHAR AS settled, list_transform(range(12), lambda x: 0.62::DOUBLE) AS thr,
    list_transform(range(12), lambda x: 0::BIGINT) AS wins, list_transform(range(12), lambda x: 0::BIGINT) AS losses, 0::BIGINT AS streak,
    list_transform(range(8), lambda x: 0::BIGINT) AS trades, list_transform(range(8), lambda x: []::BIGINT[]) AS recent, list_transform(range(24), lambda x: NULL::DOUBLE) AS mult,
    []::STRUCT(t BIGINT, hour BIGINT, band INTEGER, won BIGINT)[] AS hist, NULL::BIGINT AS diagnosed, NULL::BIGINT AS s_at, 0 AS s_side, 0::DOUBLE AS s_conf, []::INTEGER[] AS s_v,
    -1::BIGINT AS win, []::DOUBLE[] AS scores, 0::DOUBLE AS factor, 0::DOUBLE AS threshold, NULL::VARCHAR AS reason, NULL::INTEGER AS final, NULL::DOUBLE AS fconf, NULL::DOUBLE AS share,
    NULL::DOUBLE AS conflict, NULL::DOUBLE AS score
  FROM (SELECT DISTINCT key FROM cin) k
  UNION ALL
  SELECT key, n, bar_at, close, settled, thr, wins, losses, streak, trades, recent, mult, hist, diagnosed, CASE WHEN reason IS NULL THEN bar_at END, coalesce(final, 0), coalesce(fconf, 0), v,
    win, scores, factor, threshold, reason, final, fconf, share, conflict, score
  FROM (SELECT * REPLACE (CASE WHEN reason IS NULL AND full_window THEN 'window_full' ELSE reason END AS reason,
      CASE WHEN reason IS NOT NULL OR full_window THEN scores WHEN len(scores) < 3 THEN list_append(scores, score)
        ELSE {_set('scores', 'list_position(scores, list_min(scores))', 'score')} END AS scores)
    FROM (SELECT * REPLACE (CASE WHEN reason IS NULL THEN bar_at // (tf * 5) ELSE win END AS win, CASE WHEN reason IS NULL AND bar_at // (tf * 5) <> win THEN [] ELSE scores END AS scores),
        reason IS NULL AND bar_at // (tf * 5) = win AND len(scores) >= 3 AND score <= list_min(scores) AS full_window
      FROM (SELECT *, CASE WHEN reason IS NULL THEN agreement * 40 + [70, 90, 85, 65, 40][bar_at // tf % 5 + 1] * 0.2::DOUBLE + CASE WHEN final = 1 THEN net ELSE -net END * 0.25::DOUBLE + fconf * 15 END AS score
        FROM (SELECT * REPLACE (CASE WHEN reason IS NULL AND fconf < {floor}::DOUBLE THEN 'agents_below_threshold' ELSE reason END AS reason)
          FROM (SELECT *, CASE WHEN reason IS NULL THEN least(0.99::DOUBLE, value2 * CASE WHEN final <> side THEN 0.93::DOUBLE ELSE 1 END * CASE WHEN conflict > 0.35::DOUBLE THEN 1 - conflict * 0.25::DOUBLE ELSE 1 END) END AS fconf
            FROM (SELECT *, CASE WHEN reason IS NULL THEN CASE WHEN green / cast_ >= 0.55::DOUBLE THEN 1 WHEN red / cast_ >= 0.55::DOUBLE THEN -1 ELSE side END END AS final,
                least(0.99::DOUBLE, CASE WHEN share >= 0.75::DOUBLE THEN least(value * (1 + (share - 0.75::DOUBLE) * 0.4::DOUBLE), 0.99::DOUBLE) WHEN share >= 0.6::DOUBLE THEN least(value * 1.05::DOUBLE, 0.99::DOUBLE)
                  WHEN share >= 0.4::DOUBLE THEN value * 0.9::DOUBLE ELSE value * 0.75::DOUBLE END * CASE WHEN v[4] = -side THEN 0.9::DOUBLE ELSE 1 END * CASE WHEN v[1] = -side AND v[2] = -side THEN 0.85::DOUBLE ELSE 1 END) AS value2
              FROM (SELECT *, CASE WHEN reason IS NULL THEN (agree + neutral * 0.5::DOUBLE) / CASE WHEN agree + oppose + neutral > 0 THEN agree + oppose + neutral ELSE 1 END END AS share,
                  CASE WHEN green + red > 0 THEN green + red ELSE 1 END AS cast_,
                  CASE WHEN reason IS NULL THEN CASE WHEN ng + nr >= 2 THEN 1 - greatest(ng, nr) / (ng + nr)::DOUBLE ELSE 0 END END AS conflict
                FROM (SELECT *, {_each('CASE WHEN v[i] = side THEN ew[i] ELSE 0 END')} AS agree, {_each('CASE WHEN v[i] = -side THEN ew[i] ELSE 0 END')} AS oppose,
                    {_each('CASE WHEN v[i] = 0 THEN ew[i] ELSE 0 END')} * 0.5::DOUBLE AS neutral, {_each('CASE WHEN v[i] = 1 THEN ew[i] ELSE 0 END')} AS green,
                    {_each('CASE WHEN v[i] = -1 THEN ew[i] ELSE 0 END')} AS red, {_each('CASE WHEN v[i] = 1 THEN 1 ELSE 0 END')} AS ng, {_each('CASE WHEN v[i] = -1 THEN 1 ELSE 0 END')} AS nr
                  FROM (SELECT *, CASE WHEN rn < 149 THEN 'min_history' WHEN in_news THEN 'news' WHEN value < {floor}::DOUBLE THEN 'low_score' WHEN value < threshold THEN 'below_threshold'
                      WHEN streak >= 5 THEN 'circuit_breaker' END AS reason,
                      list_transform(range(1, 9), lambda i: bal[i] * CASE WHEN trades[i] < 5 THEN 1 ELSE greatest(0.2::DOUBLE, least(2, 1 + (list_avg(recent[i]) - 0.5::DOUBLE) * 4)) END) AS ew
                    FROM (SELECT *, greatest(0, least(0.99::DOUBLE, confidence * factor)) AS value
                      FROM (SELECT *, coalesce(mult[hour + 1], 1) AS factor, thr[{_BUCKET.format(h='hour', x='adx')}] AS threshold
                        FROM (SELECT * EXCLUDE (due, bad, n_bad) REPLACE (CASE WHEN due THEN list_transform(list_transform(mult, lambda x, i: CASE WHEN list_contains(bad, i - 1) THEN greatest(0.7::DOUBLE, coalesce(x, 1) - 0.04::DOUBLE) ELSE x END),
                              lambda x: CASE WHEN x IS NULL OR n_bad = 0 THEN x ELSE CASE n_bad WHEN 1 THEN greatest(0.7::DOUBLE, x * 0.97::DOUBLE) WHEN 2 THEN greatest(0.7::DOUBLE, greatest(0.7::DOUBLE, x * 0.97::DOUBLE) * 0.97::DOUBLE)
                              WHEN 3 THEN greatest(0.7::DOUBLE, greatest(0.7::DOUBLE, greatest(0.7::DOUBLE, x * 0.97::DOUBLE) * 0.97::DOUBLE) * 0.97::DOUBLE)
                              ELSE greatest(0.7::DOUBLE, greatest(0.7::DOUBLE, greatest(0.7::DOUBLE, greatest(0.7::DOUBLE, x * 0.97::DOUBLE) * 0.97::DOUBLE) * 0.97::DOUBLE) * 0.97::DOUBLE) END END) ELSE mult END AS mult,
                            CASE WHEN due THEN now ELSE diagnosed END AS diagnosed)
                          FROM (SELECT *, list_filter(range(24), lambda h: len(list_filter(hist, lambda e: e.hour = h AND e.t >= now - 604800)) >= 8
                                AND list_avg(list_transform(list_filter(hist, lambda e: e.hour = h AND e.t >= now - 604800), lambda e: e.won)) < 0.42::DOUBLE) AS bad,
                              len(list_filter(range(4), lambda b: len(list_filter(hist, lambda e: e.band = b AND e.t >= now - 1209600)) >= 8
                                AND list_avg(list_transform(list_filter(hist, lambda e: e.band = b AND e.t >= now - 1209600), lambda e: e.won)) < 0.5::DOUBLE)) AS n_bad
                            FROM (SELECT * REPLACE (
                                  list_transform(thr, lambda x, i: CASE WHEN o = 0 THEN x WHEN i = bucket AND wins[i] + losses[i] >= 8 AND wins[i] / (wins[i] + losses[i])::DOUBLE < 0.62::DOUBLE THEN least(x + 0.03::DOUBLE, 0.85::DOUBLE)
                                    WHEN i = bucket AND wins[i] + losses[i] >= 8 AND wins[i] / (wins[i] + losses[i])::DOUBLE > 0.62::DOUBLE + 0.05::DOUBLE THEN greatest(x - 0.01::DOUBLE, 0.62::DOUBLE) ELSE x END) AS thr)
                              FROM (SELECT * REPLACE (list_transform(wins, lambda x, i: x + CASE WHEN i = bucket AND o = 1 THEN 1 ELSE 0 END) AS wins,
                                    list_transform(losses, lambda x, i: x + CASE WHEN i = bucket AND o = -1 THEN 1 ELSE 0 END) AS losses,
                                    CASE o WHEN 1 THEN 0 WHEN -1 THEN streak + 1 ELSE streak END AS streak,
                                    list_transform(trades, lambda x, i: x + CASE WHEN o <> 0 AND s_v[i] <> 0 THEN 1 ELSE 0 END) AS trades,
                                    list_transform(recent, lambda x, i: CASE WHEN o <> 0 AND s_v[i] <> 0 THEN list_append(x, CASE WHEN (s_v[i] = s_side) = (o = 1) THEN 1 ELSE 0 END)[-30:] ELSE x END) AS recent,
                                    CASE WHEN o <> 0 THEN list_append(hist, {{'t': now, 'hour': s_hour, 'band': {_BAND.format(c='s_conf')}, 'won': CASE WHEN o = 1 THEN 1 ELSE 0 END}}) ELSE hist END AS hist),
                                  CASE o WHEN 1 THEN 'WIN' WHEN -1 THEN 'LOSS' WHEN 0 THEN 'EXPIRED' END AS settled, diagnosed IS NULL OR now - diagnosed >= 21600 AS due
                                FROM (SELECT c.* EXCLUDE (n, bar_at, close, settled, factor, threshold, reason, final, fconf, share, conflict, score), r.* EXCLUDE (key), r.bar_at + r.tf AS now, r.bar_at % 86400 // 3600 AS hour,
                                    c.s_at % 86400 // 3600 AS s_hour, CAST(sign(r.close - c.close) AS INTEGER) * CASE WHEN c.s_at = r.bar_at - r.tf THEN c.s_side END AS o,
                                    CASE WHEN c.s_at = r.bar_at - r.tf THEN {_BUCKET.format(h='(c.s_at % 86400 // 3600)', x='r.est')} END AS bucket
                                  FROM chain c JOIN cin r ON r.key = c.key AND r.n = c.n + 1) t1) t2) t3) t4) t5) t6) t7) t8) t9) t10) t11) t12) t13) t14) t15)
)"""


CHAIN = FULL + VOTES + INPUT + chain_sql("chain_in")


def chain_input(spark, sf):
    """Scored bars with votes, news flag and range index, and the votes themselves."""
    scored = cut_lineage(score(context(spark, sf)))
    votes = cut_lineage(G.votes(scored))
    plain = bars(spark, sf)
    f = frame(plain, back=24)
    indexed = f.with_columns({"range_index": X.range_index(f)}).core("key", "bar_start", "range_index")
    news = near_events(plain, C._news_hits(spark, sf), ["key"], "bar_start", "ts", 900, "left_semi")
    flagged = news.select("key", "bar_start", F.lit(True).alias("flag"))
    rows = scored.select(
        "key", "tf_sec", "bar_start", "rn", "direction", "confidence", F.col("adx_14").alias("adx"), F.col("mtf_agreement").alias("agreement"),
        F.col("net_score").cast("double").alias("net"), "close", "vote_regime",
    )
    whole = rows.join(H.ballots(votes, scored, boost_table(spark)), ["key", "bar_start"]).join(indexed, ["key", "bar_start"]).join(flagged, ["key", "bar_start"], "left")
    return whole.withColumn("in_news", F.coalesce("flag", F.lit(False))).drop("flag", "vote_regime"), votes


def chain(spark, sf):
    rows, votes = chain_input(spark, sf)
    return cut_lineage(H.signal_chain(rows)), votes


@query(
    "signal_chain",
    CHAIN
    + f"""SELECT key, bar_at AS bar_epoch, settled, CAST(streak AS INTEGER) AS streak, {rd('factor', 'threshold')}, reason AS block_reason,
  CASE final WHEN 1 THEN 'GREEN' WHEN -1 THEN 'RED' END AS final_direction, round(fconf + 1e-11::DOUBLE, 6) + 0.0::DOUBLE AS final_confidence,
  CASE WHEN fconf >= 0.82::DOUBLE THEN 'ELITE' WHEN fconf >= 0.75::DOUBLE THEN 'HIGH' WHEN fconf >= 0.62::DOUBLE THEN 'MODERATE' WHEN fconf IS NOT NULL THEN 'SKIP' END AS grade,
  round(score + 1e-11::DOUBLE, 6) + 0.0::DOUBLE AS score FROM chain WHERE n > 0""",
)
def signal_chain(spark, sf):
    """Every bar through gates, voters, window and settlement, each step on what was settled before it."""
    done, _ = chain(spark, sf)
    return done.select(
        "key", epoch(), "settled", "streak", *rounded("multiplier", "threshold"), "block_reason", "final_direction", *rounded("final_confidence"), "grade", *rounded("score")
    ).withColumnRenamed("multiplier", "factor")


@query(
    "signal_block_reasons",
    CHAIN + "SELECT key, coalesce(reason, 'sent') AS reason, count(*) AS n FROM chain WHERE n > 0 GROUP BY ALL",
)
def signal_block_reasons(spark, sf):
    done, _ = chain(spark, sf)
    return done.groupBy("key", F.coalesce("block_reason", F.lit("sent")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "threshold_asof",
    S.THRESHOLDS
    + """, known AS (SELECT t.key, t.session, t.volatility, o.settled_epoch, arg_max(t.threshold, t.n) AS threshold FROM thr t JOIN outc o ON o.key = t.key AND o.bar_epoch = t.bar_epoch GROUP BY ALL),
asked AS (SELECT key, bar_epoch, bar_epoch + 3600 AS ended, CASE WHEN utc_hour >= 8 AND utc_hour < 13 THEN 'LONDON' WHEN utc_hour >= 13 AND utc_hour < 17 THEN 'OVERLAP'
    WHEN utc_hour >= 17 AND utc_hour < 21 THEN 'NEW_YORK' ELSE 'ASIAN' END AS session, CASE WHEN adx < 18 THEN 'CHOP' WHEN adx < 28 THEN 'TREND' ELSE 'STRONG_TREND' END AS volatility FROM sig)
SELECT a.key, a.bar_epoch, a.session, a.volatility, round(coalesce(k.threshold, 0.62::DOUBLE) + 1e-11::DOUBLE, 6) AS threshold
FROM asked a ASOF LEFT JOIN known k ON k.key = a.key AND k.session = a.session AND k.volatility = a.volatility AND a.ended >= k.settled_epoch""",
)
def threshold_asof(spark, sf):
    """The learned threshold of each bar's own session and volatility, as of that bar."""
    settled = S.outcomes(spark, sf)
    history = L.adaptive_threshold(L.threshold_buckets(settled))
    known = L.threshold_asof(settled.select("key", "tf_sec", "bar_start", "utc_hour", "adx"), history)
    return known.select("key", epoch(), "session", "volatility", *rounded("threshold"))


@query(
    "agent_track_record",
    CHAIN
    + f""",
won AS (SELECT p.key, p.bar_at, p.final AS side, q.settled = 'WIN' AS won FROM chain p JOIN chain q ON q.key = p.key AND q.n = p.n + 1 AND q.bar_at = p.bar_at + 3600
  WHERE p.n > 0 AND p.reason IS NULL AND q.settled IN ('WIN', 'LOSS')),
crd AS (SELECT v.key, v.agent, v.bar_epoch, (CASE v.vote WHEN 'GREEN' THEN 1 ELSE -1 END = w.side) = w.won AS correct FROM votes v JOIN won w ON w.key = v.key AND w.bar_at = v.bar_epoch WHERE v.vote <> 'NEUTRAL'),
rec AS (SELECT key, agent, CAST(count(*) FILTER (correct) AS BIGINT) AS wins, CAST(count(*) FILTER (NOT correct) AS BIGINT) AS losses,
  list_avg(list(CAST(correct AS INTEGER) ORDER BY bar_epoch)[-30:]) AS rate FROM crd GROUP BY key, agent),
lv AS (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY key, agent ORDER BY bar_epoch DESC) = 1)
SELECT lv.key, lv.agent, lv.bar_epoch, lv.vote, {rd('confidence')}, coalesce(wins, 0) AS wins, coalesce(losses, 0) AS losses, round(coalesce(rate, 0) + 1e-11::DOUBLE, 6) + 0.0::DOUBLE AS recent_rate,
  round(CASE WHEN coalesce(wins + losses, 0) < 5 THEN 1 ELSE greatest(0.2::DOUBLE, least(2, 1 + (rate - 0.5::DOUBLE) * 4)) END + 1e-11::DOUBLE, 6) AS weight
FROM lv LEFT JOIN rec ON rec.key = lv.key AND rec.agent = lv.agent""",
)
def agent_track_record(spark, sf):
    """Every voter's newest vote with its record on the signals that the chain has sent."""
    done, votes = chain(spark, sf)
    settled = H.outcomes(done).withColumn("direction", F.col("final_direction"))
    record = L.current_weights(L.agent_performance(L.credited(votes, settled)))
    known = G.agent_summary(votes, record)
    zero = F.lit(0).cast("bigint")
    return known.select(
        "key", "agent", epoch(), "vote", *rounded("confidence"), F.coalesce("wins", zero).alias("wins"), F.coalesce("losses", zero).alias("losses"),
        F.coalesce("recent_rate", F.lit(0.0)).alias("recent_rate"), F.coalesce("weight", F.lit(1.0)).alias("weight"),
    ).select("key", "agent", "bar_epoch", "vote", "confidence", "wins", "losses", *rounded("recent_rate", "weight"))
