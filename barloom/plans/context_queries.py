"""Volume profile, rejection zones, sentiment, timeframes, regime, price filter and news."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.sessions import market_open
from barloom.operators import mtf as T
from barloom.operators import profile as V
from barloom.operators import sentiment as N
from barloom.operators import zones as Z
from barloom.operators.bars import roll_up
from barloom.operators.indicators import indicator_frame
from barloom.operators.joins import asof_join, near_events, near_news
from barloom.operators.patterns import session_ranges
from barloom.operators.series import frame, number_rows
from barloom.plans.registry import epoch, ints, query, r, rounded
from barloom.plans.sqlparts import BARS, INDICATORS, NUMBERED, S, VOLUME_BARS, ema, rd, strict, w, with_
from barloom.sources.feeds import pair_currencies, parse_news, spelt_currencies, symbol_currencies
from barloom.sources.samples import bars, table, volume_bars

# ---------------------------------------------------------------- volume profile


def profile_sql(snapshots: str) -> str:
    """Profiles (vpn) at each series' newest bar, at the last bar of each day, or at every bar."""
    snaps = {
        "newest": "SELECT key, max(rn) AS snap FROM b GROUP BY key",
        "daily": "SELECT key, max(rn) AS snap FROM b GROUP BY key, bar_epoch // 86400",
        "every": "SELECT key, rn AS snap FROM b",
    }[snapshots]
    centre = "(lo + (i + 0.5::DOUBLE) * ((hi - lo) / 50))"
    return f""",
pts AS ({snaps}),
win AS (SELECT p.key, p.snap, b.low, b.high, b.volume, min(b.low) OVER q AS lo, max(b.high) OVER q AS hi
  FROM pts p JOIN b ON b.key = p.key AND b.rn <= p.snap AND b.rn > p.snap - 500 WHERE p.snap >= 19
  WINDOW q AS (PARTITION BY p.key, p.snap)),
cov AS (SELECT *, list_filter(range(0, 50), lambda i: {centre} >= low AND {centre} <= high) AS lv FROM win WHERE hi > lo),
sp AS (SELECT key, snap, lo, hi, unnest(lv) AS level, volume / len(lv) AS share FROM cov),
lvl AS (SELECT key, snap, lo, hi, level, round(sum(share), 9) AS v FROM sp GROUP BY ALL),
mp AS (SELECT key, snap, lo, hi, map_from_entries(list((level, v))) AS m FROM lvl GROUP BY ALL),
vp1 AS (SELECT key, snap, lo, hi, list_transform(range(0, 50), lambda i: coalesce(m[i], 0)) AS vs FROM mp),
vp2 AS (SELECT *, list_position(vs, list_max(vs)) - 1 AS poc_i, list_sum(vs) AS total FROM vp1),
vp3 AS (SELECT *, list_reduce(
  list_prepend({{'lo': poc_i, 'hi': poc_i, 'acc': vs[poc_i + 1]}},
    list_transform(range(0, 49), lambda i: {{'lo': poc_i, 'hi': poc_i, 'acc': 0::DOUBLE}})),
  lambda a, x: CASE WHEN a.acc >= total * 0.7::DOUBLE OR (a.hi >= 49 AND a.lo <= 0) THEN a
    WHEN a.hi < 49 AND (a.lo <= 0 OR vs[a.hi + 2] >= vs[a.lo]) THEN {{'lo': a.lo, 'hi': a.hi + 1, 'acc': a.acc + vs[a.hi + 2]}}
    ELSE {{'lo': a.lo - 1, 'hi': a.hi, 'acc': a.acc + vs[a.lo]}} END) AS area FROM vp2),
vpn AS (SELECT key, snap, lo, hi, vs, total,
  lo + (poc_i + 0.5::DOUBLE) * ((hi - lo) / 50) AS poc, lo + (area.hi + 0.5::DOUBLE) * ((hi - lo) / 50) AS vah,
  lo + (area.lo + 0.5::DOUBLE) * ((hi - lo) / 50) AS val,
  list_transform(list_filter(range(0, 50), lambda i: vs[i + 1] > total / 50 * 1.5::DOUBLE), lambda i: {centre}) AS hvn,
  list_transform(list_filter(range(0, 50), lambda i: vs[i + 1] < total / 50 * 0.5::DOUBLE), lambda i: {centre}) AS lvn FROM vp3)"""


def classify_sql(price: str = "price") -> str:
    p = price
    return f"""CASE WHEN poc IS NULL THEN 'NEUTRAL' WHEN abs({p} - poc) <= {p} * 0.0001::DOUBLE * 5 THEN 'AT_POC'
  WHEN len(list_filter(hvn, lambda n: n > poc AND abs({p} - n) <= {p} * 0.0001::DOUBLE * 8)) > 0 THEN 'AT_RESISTANCE'
  WHEN len(list_filter(hvn, lambda n: n < poc AND abs({p} - n) <= {p} * 0.0001::DOUBLE * 8)) > 0 THEN 'AT_SUPPORT'
  WHEN len(list_filter(lvn, lambda n: abs({p} - n) <= {p} * 0.0001::DOUBLE * 8)) > 0 THEN 'LVN_FAST_MOVE'
  WHEN {p} >= val AND {p} <= vah THEN 'IN_VALUE_AREA' WHEN {p} > vah THEN 'ABOVE_VALUE_AREA' ELSE 'BELOW_VALUE_AREA' END"""


@query(
    "volume_profile",
    with_(VOLUME_BARS, NUMBERED, profile_sql("newest"))
    + f""", u AS (SELECT key, lo, hi, total, unnest(range(0, 50)) AS level, unnest(vs) AS volume FROM vpn),
k AS (SELECT *, volume > total / 50 * 1.5::DOUBLE AS is_hvn, volume < total / 50 * 0.5::DOUBLE AS is_lvn,
  lo + (level + 0.5::DOUBLE) * ((hi - lo) / 50) AS price FROM u)
SELECT key, CAST(level AS INTEGER) AS level, is_hvn, is_lvn, {rd('price')}, {rd('volume', digits=4)} FROM k""",
)
def volume_profile(spark, sf):
    """Histogram of the last 500 bars of each series, one row per level."""
    numbered = number_rows(volume_bars(spark, sf))
    h = V.histogram(numbered, V.last_bar(numbered))
    total = F.aggregate("volumes", F.lit(0.0), lambda a, x: a + x)
    long = h.withColumn("_total", total).select("*", F.posexplode("volumes").alias("level", "v"))
    return long.select(
        "key",
        "level",
        (F.col("v") > F.col("_total") / 50 * 1.5).alias("is_hvn"),
        (F.col("v") < F.col("_total") / 50 * 0.5).alias("is_lvn"),
        r(V.level_price(F.col("level"))).alias("price"),
        r("v", 4).alias("volume"),
    )


@query(
    "value_area_daily",
    with_(BARS, NUMBERED, profile_sql("daily"))
    + f""", j AS (SELECT v.*, b.close AS price, b.bar_epoch FROM vpn v JOIN b ON b.key = v.key AND b.rn = v.snap),
o AS (SELECT key, bar_epoch, poc, vah, val, {classify_sql()} AS vp_zone,
  coalesce(list_min(list_filter(hvn, lambda n: n > price)), vah) AS vp_hvn_resistance,
  coalesce(list_min(list_filter(hvn, lambda n: n < price)), val) AS vp_hvn_support,
  abs(price - poc) / greatest(abs(poc) * 0.0001::DOUBLE, 1e-8::DOUBLE) < 5 AS vp_at_poc FROM j)
SELECT key, bar_epoch, vp_zone, vp_at_poc, {rd('poc', 'vah', 'val', 'vp_hvn_resistance', 'vp_hvn_support')} FROM o""",
)
def value_area_daily(spark, sf):
    """Profile, value area and price class at the last bar of every day."""
    numbered = number_rows(bars(spark, sf))
    p = V.classify(V.profile(V.histogram(numbered, V.last_bar_per_day(numbered))))
    return p.select(
        "key",
        epoch("snap_start"),
        "vp_zone",
        "vp_at_poc",
        *rounded("poc", "vah", "val", "vp_hvn_resistance", "vp_hvn_support"),
    )


# ---------------------------------------------------------------- rejection zones

ZONE = 5.0
TOUCHES = """,
t0 AS (SELECT key, tf_sec, bar_epoch, rn, volume, greatest(high - low, 1e-10::DOUBLE) AS rg, body, high, low,
  high - greatest(open, close) AS uw, least(open, close) - low AS lw FROM b WHERE rn >= 2),
touches AS (
  SELECT key, tf_sec, bar_epoch, 'SELLER' AS side, 0 AS turn, uw / rg AS wick, high AS price,
    CAST(round_even(high / 5.0::DOUBLE, 0) AS BIGINT) AS level_no FROM t0 WHERE uw / rg >= 0.25::DOUBLE AND body / rg < 0.6::DOUBLE
  UNION ALL
  SELECT key, tf_sec, bar_epoch, 'BUYER', 1, lw / rg, low, CAST(round_even(low / 5.0::DOUBLE, 0) AS BIGINT)
  FROM t0 WHERE lw / rg >= 0.25::DOUBLE AND body / rg < 0.6::DOUBLE)"""
STATES = """,
z1 AS (SELECT *, coalesce(bar_epoch - lag(bar_epoch) OVER (PARTITION BY key, level_no ORDER BY bar_epoch, turn) > 259200, true) AS fresh FROM touches),
z2 AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY key, level_no ORDER BY bar_epoch, turn) AS life FROM z1),
z3 AS (SELECT *, list(wick) OVER q AS ws, list(side) OVER q AS sds FROM z2
  WINDOW q AS (PARTITION BY key, level_no, life ORDER BY bar_epoch, turn ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
z4 AS (SELECT *, CAST(len(ws) AS INTEGER) AS touch_count, list_sum(ws) / len(ws) AS avg_wick, list_max(ws) AS max_wick,
  ws[-4:] AS w4 FROM z3),
states AS (SELECT *, touch_count >= 2 AND len(list_filter(range(2, len(w4) + 1), lambda i: w4[i] < w4[i - 1] * 0.9::DOUBLE)) = 0 AS growing,
  CASE WHEN len(list_filter(sds, lambda s: s = 'SELLER')) * 2 >= touch_count THEN 'SELLER' ELSE 'BUYER' END AS zone_side FROM z4)"""


def score_sql(age: str) -> str:
    return f"""CASE WHEN touch_count < 2 THEN 0 ELSE least(least(touch_count * 12, 36) + CASE WHEN growing THEN 28 ELSE 8 END
  + least(avg_wick * 60, 24) + CASE WHEN {age} < 3600 THEN 12 ELSE 0 END, 100) END"""


GRADE = "CASE WHEN score >= 80 THEN 'S' WHEN score >= 65 THEN 'A' WHEN score >= 50 THEN 'B' WHEN score >= 35 THEN 'C' ELSE 'D' END"
SIGNAL = "CASE WHEN score < 50 THEN 'NONE' WHEN zone_side = 'SELLER' THEN 'RED' ELSE 'GREEN' END"


def _states(spark, sf):
    return Z.zone_states(Z.touches(bars(spark, sf), F.lit(ZONE)))


@query(
    "rejection_touches",
    with_(BARS, NUMBERED, TOUCHES)
    + f"SELECT key, bar_epoch, side, level_no, price, {rd('wick')} FROM touches",
)
def rejection_touches(spark, sf):
    return Z.touches(bars(spark, sf), F.lit(ZONE)).select("key", epoch(), "side", "level_no", "price", *rounded("wick"))


@query(
    "rejection_zone_states",
    with_(BARS, NUMBERED, TOUCHES, STATES)
    + f"""SELECT key, bar_epoch, level_no, turn, touch_count, growing, zone_side, {rd('avg_wick', 'max_wick')} FROM states""",
)
def rejection_zone_states(spark, sf):
    return _states(spark, sf).select(
        "key", epoch(), "level_no", "turn", "touch_count", "growing", "zone_side", *rounded("avg_wick", "max_wick")
    )


CAPACITY = 6
_WEIGHT = """CASE WHEN len(z.w) < 2 THEN 0 ELSE round(least(least(len(z.w) * 12, 36)
  + CASE WHEN len(list_filter(range(2, len(z.w[-4:]) + 1), lambda i: z.w[-4:][i] < z.w[-4:][i - 1] * 0.9::DOUBLE)) = 0 THEN 28 ELSE 8 END
  + least(list_sum(z.w) / len(z.w) * 60, 24) + CASE WHEN now - z.ts < 3600 THEN 12 ELSE 0 END, 100), 9) END"""
MEMORY = f""",
tq AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY bar_epoch, turn) AS n FROM touches),
zm AS (
  SELECT key, 0::BIGINT AS n, 0::BIGINT AS now, NULL::BIGINT AS level_no, 0 AS turn, []::STRUCT(l BIGINT, w DOUBLE[], s INTEGER[], ts BIGINT)[] AS zs, NULL::BIGINT AS evicted
  FROM (SELECT DISTINCT key FROM tq) k
  UNION ALL
  SELECT key, n, now, level_no, turn, CASE WHEN len(list_filter(kept, lambda z: z.l = level_no)) > 0
      THEN list_transform(kept, lambda z: CASE WHEN z.l = level_no THEN {{'l': z.l, 'w': list_append(z.w, wick)[-10:], 's': list_append(z.s, sold)[-10:], 'ts': now}} ELSE z END)
      ELSE list_append(kept, {{'l': level_no, 'w': [wick], 's': [sold], 'ts': now}}) END, evicted
  FROM (SELECT *, list_filter(live, lambda z: evicted IS NULL OR z.l <> evicted) AS kept
    FROM (SELECT *, CASE WHEN len(list_filter(live, lambda z: z.l = level_no)) = 0 AND len(live) >= {CAPACITY} THEN live[list_position(weights, list_min(weights))].l END AS evicted
      FROM (SELECT *, list_transform(live, lambda z: {_WEIGHT}) AS weights
        FROM (SELECT t.key, t.n, t.bar_epoch AS now, t.level_no, t.turn, t.wick, CASE WHEN t.side = 'SELLER' THEN 1 ELSE 0 END AS sold, list_filter(zm.zs, lambda z: t.bar_epoch - z.ts <= 259200) AS live
          FROM zm JOIN tq t ON t.key = zm.key AND t.n = zm.n + 1) a) b) c) d)"""


@query(
    "rejection_zone_memory",
    with_(BARS, NUMBERED, TOUCHES, MEMORY).replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", own AS (SELECT *, list_filter(zs, lambda z: z.l = level_no)[1] AS z FROM zm WHERE n > 0),
st AS (SELECT key, now AS bar_epoch, level_no, turn, CAST(len(z.w) AS INTEGER) AS touch_count, list_sum(z.w) / len(z.w) AS avg_wick, list_max(z.w) AS max_wick,
  len(z.w) >= 2 AND len(list_filter(range(2, len(z.w[-4:]) + 1), lambda i: z.w[-4:][i] < z.w[-4:][i - 1] * 0.9::DOUBLE)) = 0 AS growing,
  CASE WHEN 2 * list_sum(z.s) >= len(z.s) THEN 'SELLER' ELSE 'BUYER' END AS zone_side, CAST(len(zs) AS INTEGER) AS n_zones, coalesce(evicted, -1) AS evicted FROM own)
SELECT key, bar_epoch, level_no, turn, touch_count, growing, zone_side, n_zones, evicted, {rd('avg_wick', 'max_wick')} FROM st""",
)
def rejection_zone_memory(spark, sf):
    """Zones as a memory of six of them keeps them, the weakest going when a new level comes."""
    kept = Z.zone_memory(Z.touches(bars(spark, sf), F.lit(ZONE)), CAPACITY)
    return kept.select("key", epoch(), "level_no", "turn", "touch_count", "growing", "zone_side", "n_zones", F.coalesce("evicted", F.lit(-1)).alias("evicted"), *rounded("avg_wick", "max_wick"))


@query(
    "rejection_zones",
    with_(BARS, NUMBERED, TOUCHES, STATES)
    + f""", l AS (SELECT * FROM states WHERE bar_epoch <= 1706396400
  QUALIFY row_number() OVER (PARTITION BY key, level_no ORDER BY bar_epoch DESC, turn DESC) = 1),
s AS (SELECT *, {score_sql('1706396400 - bar_epoch')} AS score FROM l WHERE 1706396400 - bar_epoch <= 259200),
k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, level_no) <= 200)
SELECT key, level_no, bar_epoch, touch_count, growing, zone_side, {rd('score')}, {GRADE} AS grade, {SIGNAL} AS signal FROM k""",
)
def rejection_zones(spark, sf):
    """Live zones late in the month, within the capacity of a series."""
    as_of = F.timestamp_seconds(F.lit(1706396400))
    snap = Z.snapshot(_states(spark, sf), as_of)
    return snap.select(
        "key", "level_no", epoch(), "touch_count", "growing", "zone_side", r("score").alias("score"), "grade", "signal"
    )


NEAR = f""",
ask AS (SELECT key, bar_epoch, close, unnest(generate_series(CAST(ceil(close / 5.0::DOUBLE - 2) AS BIGINT),
  CAST(floor(close / 5.0::DOUBLE + 2) AS BIGINT))) AS level_no FROM b),
st AS (SELECT * FROM states QUALIFY row_number() OVER (PARTITION BY key, level_no, bar_epoch ORDER BY turn DESC) = 1),
nr AS (SELECT a.key, a.bar_epoch, a.level_no, a.bar_epoch - s.bar_epoch AS age, s.touch_count, s.growing, s.avg_wick, s.zone_side
  FROM ask a ASOF JOIN st s ON a.key = s.key AND a.level_no = s.level_no AND a.bar_epoch >= s.bar_epoch),
near AS (SELECT *, {score_sql('age')} AS score FROM nr WHERE age <= 259200)"""


@query(
    "zones_near_price",
    with_(BARS, NUMBERED, TOUCHES, STATES, NEAR)
    + f"SELECT key, bar_epoch, level_no, touch_count, growing, zone_side, {rd('score')} FROM near",
)
def zones_near_price(spark, sf):
    near = Z.zones_near(bars(spark, sf), _states(spark, sf), F.lit(ZONE))
    return near.select(
        "key", epoch(), "level_no", "touch_count", "growing", "zone_side", r("score").alias("score")
    )


BEST_ZONE = f""",
bz AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY key, bar_epoch ORDER BY score DESC, level_no) = 1),
rz AS (SELECT b.key, b.bar_epoch, CASE WHEN score >= 35 THEN score ELSE 0 END AS rz_score,
  CASE WHEN score >= 35 THEN {GRADE} ELSE 'D' END AS rz_grade, CASE WHEN score >= 35 THEN {SIGNAL} ELSE 'NONE' END AS rz_signal,
  CASE WHEN score >= 35 THEN touch_count ELSE 0 END AS rz_touches, CASE WHEN score >= 35 THEN growing ELSE false END AS rz_growing,
  CASE WHEN score >= 35 THEN zone_side ELSE 'NONE' END AS rz_side FROM b LEFT JOIN bz USING (key, bar_epoch))"""


@query(
    "best_zone",
    with_(BARS, NUMBERED, TOUCHES, STATES, NEAR, BEST_ZONE)
    + f"SELECT key, bar_epoch, rz_grade, rz_signal, rz_touches, rz_growing, rz_side, {rd('rz_score')} FROM rz",
)
def best_zone(spark, sf):
    source = bars(spark, sf)
    best = Z.best_zone(source, Z.zones_near(source, _states(spark, sf), F.lit(ZONE)))
    return best.select(
        "key", epoch(), "rz_grade", "rz_signal", "rz_touches", "rz_growing", "rz_side", r("rz_score").alias("rz_score")
    )


# ---------------------------------------------------------------- sentiment

SYNTH = f""",
y1 AS (SELECT *, CASE WHEN close > open THEN body ELSE -body END AS sbody, greatest(high - low, 1e-10::DOUBLE) AS yrg,
  ({strict('avg', 'gain', 14)}) AS g14, ({strict('avg', 'loss', 14)}) AS ls14 FROM f2),
y2 AS (SELECT *, (high - greatest(open, close)) / yrg AS uwr, (least(open, close) - low) / yrg AS lwr,
  CASE WHEN close > open THEN yrg END AS upr, CASE WHEN NOT close > open THEN yrg END AS dnr,
  100 - 100 / (1 + CASE WHEN ls14 > 0 THEN g14 / (ls14 + 1e-10::DOUBLE) ELSE 0 END) AS srsi FROM y1),
y3 AS (SELECT *, list(uwr) {w(10)} AS us, list(lwr) {w(10)} AS lws, avg(upr) {w(30)} AS um, avg(dnr) {w(30)} AS dm,
  sum(sbody) {w(30)} AS nb, sum(body) {w(30)} AS ab, avg(body) {w(6, 3)} AS b_then, avg(body) {w(3)} AS b_now,
  list(close) {w(14)} AS p14, list(srsi) {w(14)} AS rs14 FROM y2),
y4 AS (SELECT *, list_sum(list_transform(us, lambda x, i: x * (0.5::DOUBLE + 0.5::DOUBLE * (i - 1) / 9))) / 7.5::DOUBLE AS seller,
  list_sum(list_transform(lws, lambda x, i: x * (0.5::DOUBLE + 0.5::DOUBLE * (i - 1) / 9))) / 7.5::DOUBLE AS buyer,
  CASE WHEN dm + um > 1e-10::DOUBLE THEN (dm - um) / (dm + um) ELSE 0 END AS effort, nb / (ab + 1e-10::DOUBLE) AS bdir,
  CASE WHEN b_then > 1e-10::DOUBLE THEN greatest(0, least((b_then - b_now) / b_then, 1)) ELSE 0 END AS exh,
  list_position(p14, list_min(p14)) AS la, list_position(p14, list_max(p14)) AS ha FROM y3),
y5 AS (SELECT *, greatest(-1, least(-seller * 0.3::DOUBLE + buyer * 0.3::DOUBLE - effort * 0.2::DOUBLE + bdir * 0.2::DOUBLE, 1)) AS net,
  CASE WHEN rn >= 28 AND la > 2 AND p14[la] < list_min(p14[1:la - 1]) * 0.998::DOUBLE AND rs14[la] > list_min(rs14[1:la - 1]) THEN 'BULL'
    WHEN rn >= 28 AND ha > 2 AND p14[ha] > list_max(p14[1:ha - 1]) * 1.002::DOUBLE AND rs14[ha] < list_max(rs14[1:ha - 1]) THEN 'BEAR'
    ELSE 'NONE' END AS synth_divergence FROM y4),
synth AS (SELECT *, CASE WHEN rn >= 9 THEN round(0.5::DOUBLE + net / 2, 3) ELSE 0.5 END AS synth_buyer_ratio,
  CASE WHEN rn >= 9 THEN round(net, 3) ELSE 0 END AS synth_net_sentiment, CASE WHEN rn >= 9 THEN round(exh, 3) ELSE 0 END AS synth_exhaustion,
  CASE WHEN rn >= 9 THEN round(seller, 3) ELSE 0 END AS synth_seller_wick, CASE WHEN rn >= 9 THEN round(buyer, 3) ELSE 0 END AS synth_buyer_wick,
  CASE WHEN rn >= 9 THEN round(effort, 3) ELSE 0 END AS synth_effort_imb,
  CASE WHEN rn < 9 THEN 'NEUTRAL' WHEN net > 0.15::DOUBLE AND exh <= 0.4::DOUBLE THEN 'GREEN' WHEN net < -0.15::DOUBLE AND exh <= 0.4::DOUBLE THEN 'RED'
    WHEN exh > 0.5::DOUBLE AND net > 0.10::DOUBLE THEN 'RED' WHEN exh > 0.5::DOUBLE AND net < -0.10::DOUBLE THEN 'GREEN'
    WHEN synth_divergence = 'BULL' THEN 'GREEN' WHEN synth_divergence = 'BEAR' THEN 'RED' ELSE 'NEUTRAL' END AS synth_signal_bias FROM y5)"""
GREEN_IF_UP = "CASE WHEN close > open THEN 'GREEN' ELSE 'RED' END AS direction"


def green_if_up():
    return F.when(F.col("close") > F.col("open"), "GREEN").otherwise("RED")


@query(
    "synthetic_sentiment",
    with_(BARS, INDICATORS, SYNTH)
    + f"SELECT key, bar_epoch, synth_divergence, synth_signal_bias, {rd(*N.SYNTHETIC, digits=3)} FROM synth",
)
def synthetic_sentiment(spark, sf):
    f = indicator_frame(bars(spark, sf), ["moves"]).then(N.synthetic_sentiment)
    return f.core("key", epoch(), "synth_divergence", "synth_signal_bias", *rounded(*N.SYNTHETIC, digits=3))


SYNTH_MULT = """,
sm1 AS (SELECT *, least(abs(synth_net_sentiment), 0.5::DOUBLE) * 0.3::DOUBLE AS st,
  CASE WHEN synth_divergence <> 'NONE' THEN 0.03::DOUBLE ELSE 0 END AS bon FROM {src}),
synm AS (SELECT *, round(CASE WHEN synth_signal_bias = 'NEUTRAL' THEN 1
    WHEN synth_signal_bias = direction AND synth_exhaustion > 0.5::DOUBLE THEN (1 + st + bon) * 0.92::DOUBLE
    WHEN synth_signal_bias = direction THEN 1 + st + bon ELSE 1 - st END + 1e-11::DOUBLE, 3) AS synth_mult,
  CASE WHEN synth_signal_bias = 'NEUTRAL' THEN 'NEUTRAL'
    WHEN synth_signal_bias = direction AND synth_exhaustion > 0.5::DOUBLE THEN 'ALIGNED_BUT_EXHAUSTED'
    WHEN synth_signal_bias = direction THEN 'ALIGNED' ELSE 'OPPOSED' END AS synth_align FROM sm1)"""


@query(
    "synthetic_multiplier",
    with_(BARS, INDICATORS, SYNTH)
    + f", sd1 AS (SELECT *, {GREEN_IF_UP} FROM synth)"
    + SYNTH_MULT.format(src="sd1")
    + f"SELECT key, bar_epoch, direction, synth_align, {rd('synth_mult')} FROM synm",
)
def synthetic_multiplier(spark, sf):
    f = indicator_frame(bars(spark, sf), ["moves"]).then(N.synthetic_sentiment)
    d = green_if_up()
    return f.core("key", epoch(), "close", "open", *N.SYNTHETIC, "synth_divergence", "synth_signal_bias").withColumns(
        {"direction": d, **N.synthetic_multiplier(d)}
    ).select("key", "bar_epoch", "direction", "synth_align", r("synth_mult").alias("synth_mult"))


# Mood and order-size messages, made from click and view events; the receiving key follows the user.
MOOD = """,
mood0 AS (SELECT event_id AS seq, ts, ['click', 'error', 'purchase', 'signup', 'view'][user_id % 5 + 1] AS key,
  least(value / 200, 1) AS v, event_id FROM events WHERE event_type = 'click'),
mood1 AS (SELECT key, ts, seq, CAST(floor(epoch(ts)) AS BIGINT) AS sec, CASE WHEN event_id % 2 = 0 THEN v * 100 ELSE v END AS raw FROM mood0),
mood AS (SELECT key, ts, seq, sec, greatest(0, least(CASE WHEN raw > 1 THEN raw / 100 ELSE raw END, 1)) AS ratio FROM mood1)"""


def mood_messages(spark, sf):
    events = table(spark, sf, "events").filter(F.col("event_type") == "click")
    v = F.least(F.col("value") / 200, F.lit(1.0))
    shown = F.when(F.col("event_id") % 2 == 0, v * 100).otherwise(v)
    names = ("value", "up", "mood")
    body = F.to_json(F.struct(*[F.when(F.col("event_id") % 3 == i, shown).alias(n) for i, n in enumerate(names)]))
    keys = F.array(*[F.lit(k) for k in ("click", "error", "purchase", "signup", "view")])
    return events.select(
        F.get(keys, (F.col("user_id") % 5).cast("int")).alias("key"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        body.alias("raw"),
    )


def mood_samples(spark, sf):
    raw = mood_messages(spark, sf).withColumn("ratio", N.parse_mood(F.col("raw")))
    return raw.filter(F.col("ratio").isNotNull()).drop("raw")


@query("mood_messages", with_("x AS (SELECT 1)", MOOD) + f"SELECT key, seq, {rd('ratio')} FROM mood")
def mood_parsed(spark, sf):
    return mood_samples(spark, sf).select("key", "seq", *rounded("ratio"))


MOOD_ASOF = f""",
mn AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, seq) - 1 AS srn,
  lag(ratio, 59) OVER (PARTITION BY key ORDER BY ts, seq) AS kept FROM mood),
ms AS (SELECT * FROM mn QUALIFY row_number() OVER (PARTITION BY key, ts ORDER BY seq DESC) = 1),
ma AS (SELECT b.*, b.bar_epoch + b.tf_sec AS bend, m.ratio, m.kept, m.srn, m.sec AS msec FROM b
  ASOF LEFT JOIN ms m ON b.key = m.key AND make_timestamp((b.bar_epoch + b.tf_sec) * 1000000) >= m.ts),
mt AS (SELECT a.key, a.bar_epoch, count(s.ratio) AS n, arg_min(s.ratio, row(s.ts, s.seq)) AS first_ratio FROM ma a
  LEFT JOIN mood s ON s.key = a.key AND s.sec BETWEEN a.bend - 14400 AND a.bend GROUP BY a.key, a.bar_epoch),
mv AS (SELECT a.*, coalesce(ratio, 0.5) AS buyer_ratio, coalesce(bend - msec <= 7200, false) AS is_fresh,
  CASE WHEN srn >= 4 AND n >= 2 THEN ratio - CASE WHEN n > 60 THEN kept ELSE first_ratio END ELSE 0 END AS velocity
  FROM ma a JOIN mt USING (key, bar_epoch)),
mx AS (SELECT *, CASE WHEN buyer_ratio >= 0.75::DOUBLE THEN 'EUPHORIC_TOP' WHEN buyer_ratio <= 0.25::DOUBLE THEN 'DESPAIR_BOTTOM' ELSE 'NEUTRAL' END AS extreme FROM mv)"""
CROWD = """,
crowd AS (SELECT *, CASE WHEN NOT is_fresh THEN 1::DOUBLE
  WHEN (extreme = 'EUPHORIC_TOP' AND direction = 'RED') OR (extreme = 'DESPAIR_BOTTOM' AND direction = 'GREEN') THEN 1.15
  WHEN extreme <> 'NEUTRAL' THEN 0.82 WHEN velocity > 0.1::DOUBLE AND direction = 'RED' THEN 1.05
  WHEN velocity < -0.1::DOUBLE AND direction = 'GREEN' THEN 1.05
  WHEN (buyer_ratio > 0.55::DOUBLE AND direction = 'GREEN') OR (buyer_ratio < 0.45::DOUBLE AND direction = 'RED') THEN 0.97 ELSE 1 END AS sent_mult,
  CASE WHEN NOT is_fresh THEN 'STALE'
  WHEN (extreme = 'EUPHORIC_TOP' AND direction = 'RED') OR (extreme = 'DESPAIR_BOTTOM' AND direction = 'GREEN') THEN 'CONTRARIAN_EDGE'
  WHEN extreme <> 'NEUTRAL' THEN 'TRAPPING_CROWD' WHEN velocity > 0.1::DOUBLE AND direction = 'RED' THEN 'BUYER_TRAP_SETUP'
  WHEN velocity < -0.1::DOUBLE AND direction = 'GREEN' THEN 'SELLER_CAPITULATION'
  WHEN (buyer_ratio > 0.55::DOUBLE AND direction = 'GREEN') OR (buyer_ratio < 0.45::DOUBLE AND direction = 'RED') THEN 'WITH_CROWD'
  ELSE 'NEUTRAL' END AS sent_align FROM {src})"""


def mood_bars(spark, sf, source=None):
    source = bars(spark, sf) if source is None else source
    left = source.withColumn("bar_end", F.timestamp_seconds(F.unix_timestamp("bar_start") + F.col("tf_sec")))
    return N.mood_asof(left, mood_samples(spark, sf), "bar_end", max_age=7200, trail=14400)


@query(
    "mood_asof",
    with_(BARS, NUMBERED, MOOD, MOOD_ASOF)
    + f"SELECT key, bar_epoch, is_fresh, extreme, {rd('buyer_ratio', 'velocity')} FROM mx",
)
def mood_asof(spark, sf):
    return mood_bars(spark, sf).select("key", epoch(), "is_fresh", "extreme", *rounded("buyer_ratio", "velocity"))


@query(
    "crowd_multiplier",
    with_(BARS, NUMBERED, MOOD, MOOD_ASOF, f", md AS (SELECT *, {GREEN_IF_UP} FROM mx)", CROWD.format(src="md"))
    + f"SELECT key, bar_epoch, direction, sent_align, {rd('sent_mult')} FROM crowd",
)
def crowd_multiplier(spark, sf):
    d = green_if_up()
    return mood_bars(spark, sf).withColumns({"direction": d, **N.crowd_multiplier(d)}).select(
        "key", epoch(), "direction", "sent_align", r("sent_mult").alias("sent_mult")
    )


FLOW = """,
fl AS (SELECT ['click', 'error', 'purchase', 'signup', 'view'][user_id % 5 + 1] AS key, ts, event_id AS seq,
  CAST(floor(epoch(ts)) AS BIGINT) AS sec, value AS buy, CAST(user_id AS DOUBLE) AS sell FROM events WHERE event_type = 'view'),
fs AS (SELECT * FROM fl QUALIFY row_number() OVER (PARTITION BY key, ts ORDER BY seq DESC) = 1),
fj AS (SELECT b.*, f.buy, f.sell, b.bar_epoch + b.tf_sec - f.sec <= 7200 AND f.buy + f.sell > 0 AS fresh FROM b
  ASOF LEFT JOIN fs f ON b.key = f.key AND make_timestamp((b.bar_epoch + b.tf_sec) * 1000000) >= f.ts),
flow AS (SELECT *, CASE WHEN fresh THEN round(buy + sell, 2) ELSE 0 END AS os_total,
  CASE WHEN fresh THEN round(buy / (buy + sell), 3) ELSE 0.5 END AS os_buy_pct,
  CASE WHEN fresh THEN round((buy - sell) / (buy + sell), 3) ELSE 0 END AS os_imbalance FROM fj)"""


def flow_bars(spark, sf, source=None):
    events = table(spark, sf, "events").filter(F.col("event_type") == "view")
    pairs = (("buy", "sell"), ("up_volume", "down_volume"), ("up", "down"))
    fields = [
        F.when(F.col("event_id") % 3 == i, value).alias(name)
        for i, pair in enumerate(pairs)
        for name, value in zip(pair, (F.col("value"), F.col("user_id")))
    ]
    keys = F.array(*[F.lit(k) for k in ("click", "error", "purchase", "signup", "view")])
    raw = events.select(
        F.get(keys, (F.col("user_id") % 5).cast("int")).alias("key"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.to_json(F.struct(*fields)).alias("raw"),
    )
    sizes = raw.withColumns(N.parse_order_sizes(F.col("raw"))).drop("raw")
    source = bars(spark, sf) if source is None else source
    left = source.withColumn("bar_end", F.timestamp_seconds(F.unix_timestamp("bar_start") + F.col("tf_sec")))
    return N.order_flow_asof(left, sizes, "bar_end", max_age=7200)


@query(
    "order_flow",
    with_(BARS, NUMBERED, FLOW) + f"SELECT key, bar_epoch, {rd('os_total', 'os_buy_pct', 'os_imbalance', digits=3)} FROM flow",
)
def order_flow(spark, sf):
    return flow_bars(spark, sf).select("key", epoch(), *rounded("os_total", "os_buy_pct", "os_imbalance", digits=3))


# ---------------------------------------------------------------- timeframes

MTF = f""",
hl0 AS (SELECT b.key AS k0, t.m, b.key || '|' || t.m AS key, b.bar_epoch // (3600 * t.m) * (3600 * t.m) AS bucket, b.bar_epoch AS be,
  b.open, b.high, b.low, b.close FROM bars b, (SELECT unnest([2, 5, 15, 60]) AS m) t),
hb AS (SELECT k0, m, key, bucket AS bar_epoch, arg_min(open, be) AS open, max(high) AS high, min(low) AS low, arg_max(close, be) AS close
  FROM hl0 GROUP BY ALL),
he AS (SELECT *, row_number() {S} AS n, {ema('close', 20)} AS e20, {ema('close', 50)} AS e50, max(high) {w(20)} AS t20, min(low) {w(20)} AS l20 FROM hb),
hs AS (SELECT *, (e20 - lag(e20, 3) {S}) / (close + 1e-10::DOUBLE) AS slope FROM he),
ht AS (SELECT *, coalesce(n >= 10 AND e20 > e50 AND slope > 0, false) AS up, coalesce(n >= 10 AND e20 < e50 AND slope < 0, false) AS dn,
  close > t20 * 0.98::DOUBLE AS bu, close < l20 * 1.02::DOUBLE AS bd FROM hs),
hz AS (SELECT k0, m, bar_epoch, bar_epoch + 3600 * m AS known, bu AS bos_bull, bd AS bos_bear,
  CASE WHEN up THEN 'bull' WHEN dn THEN 'bear' ELSE 'neutral' END AS bias,
  CASE WHEN n < 10 THEN 0 WHEN (up AND bu) OR (dn AND bd) THEN least(least(abs(slope) * 1000 + 0.5::DOUBLE, 1) + 0.2::DOUBLE, 1)
    WHEN up OR dn THEN least(abs(slope) * 1000 + 0.5::DOUBLE, 1) ELSE 0.3::DOUBLE END AS strength FROM ht)"""
AGREE = """,
ag0 AS (SELECT b.*, a.bias AS b60, a.strength AS s60, c.bias AS b15, c.strength AS s15, d.bias AS b5, d.strength AS s5, e.bias AS b2, e.strength AS s2
  FROM b ASOF LEFT JOIN (SELECT * FROM hz WHERE m = 60) a ON a.k0 = b.key AND b.bar_epoch + 3600 >= a.known
  ASOF LEFT JOIN (SELECT * FROM hz WHERE m = 15) c ON c.k0 = b.key AND b.bar_epoch + 3600 >= c.known
  ASOF LEFT JOIN (SELECT * FROM hz WHERE m = 5) d ON d.k0 = b.key AND b.bar_epoch + 3600 >= d.known
  ASOF LEFT JOIN (SELECT * FROM hz WHERE m = 2) e ON e.k0 = b.key AND b.bar_epoch + 3600 >= e.known),
ag1 AS (SELECT *,
  CASE WHEN b60 = 'bull' THEN s60 * 0.35::DOUBLE ELSE 0 END + CASE WHEN b15 = 'bull' THEN s15 * 0.28::DOUBLE ELSE 0 END
  + CASE WHEN b5 = 'bull' THEN s5 * 0.22::DOUBLE ELSE 0 END + CASE WHEN b2 = 'bull' THEN s2 * 0.15::DOUBLE ELSE 0 END AS bull_weight,
  CASE WHEN b60 = 'bear' THEN s60 * 0.35::DOUBLE ELSE 0 END + CASE WHEN b15 = 'bear' THEN s15 * 0.28::DOUBLE ELSE 0 END
  + CASE WHEN b5 = 'bear' THEN s5 * 0.22::DOUBLE ELSE 0 END + CASE WHEN b2 = 'bear' THEN s2 * 0.15::DOUBLE ELSE 0 END AS bear_weight,
  coalesce(b60, 'neutral') AS tf60_bias, coalesce(b15, 'neutral') AS tf15_bias, coalesce(b5, 'neutral') AS tf5_bias,
  coalesce(b2, 'neutral') AS tf2_bias, bar_epoch % 86400 // 3600 AS khr FROM ag0),
mtf AS (SELECT *, CASE WHEN bull_weight > bear_weight THEN 'bull' WHEN bear_weight > bull_weight THEN 'bear' ELSE 'neutral' END AS mtf_direction,
  CASE WHEN bull_weight = bear_weight THEN 0.3::DOUBLE ELSE greatest(bull_weight, bear_weight) / (1 + 1e-10::DOUBLE) END AS mtf_agreement,
  tf60_bias = tf15_bias AND tf60_bias <> 'neutral' AS mtf_aligned,
  CASE WHEN khr BETWEEN 7 AND 9 THEN 'london' WHEN khr BETWEEN 12 AND 15 THEN 'overlap' ELSE 'none' END AS killzone FROM ag1)"""


@query(
    "mtf_bias",
    with_(BARS, MTF)
    + f"SELECT k0 AS key, CAST(m * 3600 AS INTEGER) AS tf_sec, bar_epoch, bias, bos_bull, bos_bear, {rd('strength')} FROM hz",
)
def mtf_bias(spark, sf):
    states = T.timeframe_bias(roll_up(bars(spark, sf), tuple(T.TF_WEIGHTS)))
    return states.select("key", "tf_sec", epoch(), "bias", "bos_bull", "bos_bear", *rounded("strength"))


@query(
    "mtf_agreement",
    with_(BARS, NUMBERED, MTF, AGREE)
    + f"""SELECT key, bar_epoch, mtf_direction, mtf_aligned, killzone, tf60_bias, tf15_bias, tf5_bias, tf2_bias,
  {rd('mtf_agreement', 'bull_weight', 'bear_weight')} FROM mtf""",
)
def mtf_agreement(spark, sf):
    df = T.timeframe_agreement(bars(spark, sf), 3600)
    return df.select(
        "key", epoch(), "mtf_direction", "mtf_aligned", "killzone", "tf60_bias", "tf15_bias", "tf5_bias", "tf2_bias",
        *rounded("mtf_agreement", "bull_weight", "bear_weight"),
    )


def mtf_points_sql(direction: str = "direction") -> str:
    want = f"CASE WHEN {direction} = 'GREEN' THEN 'bull' ELSE 'bear' END"
    terms = " + ".join(
        f"CASE WHEN tf{m}_bias = {want} THEN {p} ELSE 0 END" for m, p in ((60, 12), (15, 10), (5, 10), (2, 8))
    )
    return f"CASE WHEN killzone <> 'none' THEN 5 ELSE 0 END + {terms}"


@query(
    "mtf_points",
    with_(BARS, NUMBERED, MTF, AGREE)
    + f""", d AS (SELECT *, {GREEN_IF_UP} FROM mtf)
SELECT key, bar_epoch, direction, CAST({mtf_points_sql()} AS INTEGER) AS mtf_pts FROM d""",
)
def mtf_points(spark, sf):
    d = green_if_up()
    df = T.timeframe_agreement(bars(spark, sf), 3600)
    return df.select("key", epoch(), d.alias("direction"), T.mtf_points(d).alias("mtf_pts"))


@query(
    "market_regime",
    with_(BARS, INDICATORS)
    + f""", g1 AS (SELECT *, {strict('avg', 'spread', 14)} AS y14, coalesce({strict('avg', 'spread', 50)}, {strict('avg', 'spread', 14)}) AS y50 FROM f3),
g2 AS (SELECT *, 100 * abs(pdm14 - mdm14) / (pdm14 + mdm14 + 1e-10::DOUBLE) AS rdx, y14 / (y50 + 1e-10::DOUBLE) AS ratio FROM g1),
g3 AS (SELECT *, {strict('avg', 'rdx', 14)} AS adx FROM g2),
g4 AS (SELECT key, bar_epoch, CASE WHEN rn < 19 THEN 'unknown' WHEN adx > 25 AND ratio < 1.5::DOUBLE THEN 'trend'
    WHEN ratio > 1.8::DOUBLE THEN 'volatile' ELSE 'range' END AS regime,
  CASE WHEN rn < 19 THEN 0.5 WHEN adx > 25 AND ratio < 1.5::DOUBLE THEN least(adx / 50, 1) WHEN ratio > 1.8::DOUBLE THEN least(ratio / 3, 1)
    ELSE 1 - least(adx / 30, 1) END AS regime_score FROM g3)
SELECT key, bar_epoch, regime, {rd('regime_score')} FROM g4""",
)
def market_regime(spark, sf):
    return frame(bars(spark, sf), back=96).then(T.regime).core("key", epoch(), "regime", *rounded("regime_score"))


VOTE_REGIME = f""",
vr0 AS (SELECT *, CASE WHEN rn >= 14 THEN spread / greatest({strict('avg', 'spread', 14)}, 1e-10::DOUBLE) ELSE 1 END AS vratio FROM {{src}}),
vreg AS (SELECT *, CASE WHEN coalesce(adx_14, 0) >= 30 THEN 'trending' WHEN vratio > 2.5::DOUBLE THEN 'volatile'
  WHEN coalesce(adx_14, 0) < 20 THEN 'ranging' ELSE 'quiet' END AS vote_regime, round(vratio, 2) AS vote_atr_ratio FROM vr0)"""
BOOSTS = "(VALUES " + ", ".join(
    f"('{g}', '{a}', {b}::DOUBLE)" for g, bs in T.REGIME_BOOSTS.items() for a, b in zip(T.VOTERS, bs)
) + ") AS boosts(vote_regime, agent, boost)"


@query(
    "voting_regime",
    with_(BARS, INDICATORS, VOTE_REGIME.format(src="feat"))
    + f"SELECT key, bar_epoch, vote_regime, agent, boost, {rd('vote_atr_ratio')} FROM vreg JOIN {BOOSTS} USING (vote_regime)",
)
def voting_regime(spark, sf):
    """Regime of every bar with the weight boost of every voter."""
    f = indicator_frame(bars(spark, sf), ["trend"]).then(T.voting_regime)
    rows = f.core("key", epoch(), "vote_regime", *rounded("vote_atr_ratio"))
    return rows.join(F.broadcast(T.boost_table(spark)), "vote_regime")


SPIKE = f""",
sp0 AS (SELECT *, {strict('avg', 'spread', 14)} AS spy FROM {{src}}),
sp1 AS (SELECT *, lag(spy) {S} AS spb FROM sp0),
spike AS (SELECT *, CASE WHEN rn >= 20 AND spb > 0 THEN spread / (spb + 1e-10::DOUBLE) END AS spike_ratio,
  CASE WHEN rn >= 20 AND spb > 0 AND spread / (spb + 1e-10::DOUBLE) > 3 THEN 0.65::DOUBLE
    WHEN rn >= 20 AND spb > 0 AND spread / (spb + 1e-10::DOUBLE) > 2 THEN 0.8 ELSE 1 END AS spike_factor FROM sp1)"""


@query(
    "range_spike",
    with_(BARS, NUMBERED, SPIKE.format(src="b")) + f"SELECT key, bar_epoch, {rd('spike_ratio', 'spike_factor')} FROM spike",
)
def range_spike(spark, sf):
    return frame(bars(spark, sf), back=32).then(T.range_spike).core("key", epoch(), *rounded("spike_ratio", "spike_factor"))


KALMAN_SQL = (
    with_(BARS, NUMBERED).replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", kal AS (
  SELECT key, rn, bar_epoch, close, close AS x, 1.0::DOUBLE AS p, 1.0::DOUBLE AS k FROM b WHERE rn = 0
  UNION ALL
  SELECT b.key, b.rn, b.bar_epoch, b.close,
    kal.x + (kal.p + 1e-5::DOUBLE) / (kal.p + 1e-5::DOUBLE + 0.01::DOUBLE) * (b.close - kal.x),
    (1 - (kal.p + 1e-5::DOUBLE) / (kal.p + 1e-5::DOUBLE + 0.01::DOUBLE)) * (kal.p + 1e-5::DOUBLE),
    (kal.p + 1e-5::DOUBLE) / (kal.p + 1e-5::DOUBLE + 0.01::DOUBLE)
  FROM kal JOIN b ON b.key = kal.key AND b.rn = kal.rn + 1),
kv AS (SELECT key, bar_epoch, x AS kalman_price, k AS kalman_gain, close - x AS kalman_deviation,
  coalesce(x - lag(x, 2) {S}, 0) AS kalman_velocity FROM kal)
SELECT key, bar_epoch, {rd('kalman_price', 'kalman_gain', 'kalman_deviation', 'kalman_velocity')},
  CASE WHEN kalman_velocity > 1e-6::DOUBLE THEN 1 WHEN kalman_velocity < -1e-6::DOUBLE THEN -1 ELSE 0 END AS kalman_trend FROM kv"""
)


@query("price_filter", KALMAN_SQL)
def price_filter(spark, sf):
    return T.price_filter(bars(spark, sf)).core(
        "key", epoch(), *rounded("kalman_price", "kalman_gain", "kalman_deviation", "kalman_velocity"), "kalman_trend"
    )


@query(
    "profile_per_bar",
    with_(BARS, NUMBERED, profile_sql("every"))
    + f""", j AS (SELECT v.*, b.key AS k, b.close AS price, b.bar_epoch FROM b LEFT JOIN vpn v ON v.key = b.key AND v.snap = b.rn),
o AS (SELECT k AS key, bar_epoch, poc, vah, val, {classify_sql()} AS vp_zone,
  coalesce(list_min(list_filter(hvn, lambda n: n > price)), vah) AS vp_hvn_resistance,
  coalesce(list_min(list_filter(hvn, lambda n: n < price)), val) AS vp_hvn_support,
  coalesce(abs(price - poc) / greatest(abs(poc) * 0.0001::DOUBLE, 1e-8::DOUBLE) < 5, false) AS vp_at_poc FROM j)
SELECT key, bar_epoch, vp_zone, vp_at_poc, {rd('poc', 'vah', 'val', 'vp_hvn_resistance', 'vp_hvn_support')} FROM o""",
)
def profile_per_bar(spark, sf):
    """Every bar classed against the profile of its own last 500 bars."""
    p = V.classify(V.profile(V.histogram_per_bar(bars(spark, sf))))
    return p.select("key", epoch(), "vp_zone", "vp_at_poc", *rounded("poc", "vah", "val", "vp_hvn_resistance", "vp_hvn_support"))


# ---------------------------------------------------------------- sessions and news


@query(
    "asian_range_asof",
    with_(BARS, NUMBERED)
    + f""", d AS (SELECT key, bar_epoch // 86400 AS day, max(high) AS asian_range_high, min(low) AS asian_range_low,
  bar_epoch // 86400 * 86400 + 21600 AS known FROM b WHERE bar_epoch % 86400 // 3600 < 6 GROUP BY ALL)
SELECT b.key, b.bar_epoch, asian_range_high, asian_range_low FROM b
ASOF LEFT JOIN d ON d.key = b.key AND b.bar_epoch >= d.known""",
)
def asian_range_asof(spark, sf):
    """Range of the last finished Asian session at every bar."""
    source = bars(spark, sf)
    ranges = session_ranges(source).drop("day")
    joined = asof_join(source, ranges, ["key", "tf_sec"], "bar_start", "known_from", 86400 * 30, name="asia")
    return joined.select("key", epoch(), F.col("asia.asian_range_high"), F.col("asia.asian_range_low"))


@query(
    "rolling_range_360",
    with_(BARS, NUMBERED)
    + f"SELECT key, bar_epoch, max(high) {w(360)} AS range_high, min(low) {w(360)} AS range_low FROM b",
)
def rolling_range_360(spark, sf):
    f = frame(bars(spark, sf), back=360)
    highs = {"range_high": f.over(F.max("high"), 360), "range_low": f.over(F.min("low"), 360)}
    return f.with_columns(highs).core("key", epoch(), "range_high", "range_low")


@query(
    "market_hours_by_symbol",
    with_(BARS)
    + """, y AS (SELECT *, CASE key WHEN 'view' THEN 'BTCUSD' WHEN 'purchase' THEN 'PEPEUSDT' WHEN 'click' THEN 'ETHEUR' ELSE 'EURUSD' END AS symbol, bar_epoch % 604800 // 3600 AS wh FROM bars)
SELECT key, bar_epoch, symbol, symbol LIKE 'BTC%' OR symbol LIKE 'ETH%' OR symbol LIKE '%USDT' OR NOT (wh >= 45 AND wh < 93) AS market_open FROM y""",
)
def market_hours_by_symbol(spark, sf):
    """Whether a symbol trades: some never close, the others from Friday 21:00 to Sunday 21:00."""
    names = {"view": "BTCUSD", "purchase": "PEPEUSDT", "click": "ETHEUR"}
    symbol = F.coalesce(*[F.when(F.col("key") == k, n) for k, n in names.items()], F.lit("EURUSD"))
    rows = bars(spark, sf, reuse=False).withColumn("symbol", symbol)
    return rows.select("key", epoch(), "symbol", market_open(F.col("bar_start"), F.col("symbol")).alias("market_open"))


NEWS = """,
news AS (SELECT ts, CAST(floor(epoch(ts) / 60) AS BIGINT) * 60 AS sec, event_id,
  ['CLI', 'VIE', 'PUR', 'USD'][user_id % 4 + 1] AS currency,
  CASE WHEN value > 30 THEN 'High' WHEN value > 10 THEN 'Medium' ELSE 'Low' END AS impact FROM events WHERE event_type = 'error')"""


def raw_news(spark, sf):
    """Calendar entries as the feed sends them, made from error events."""
    events = table(spark, sf, "events").filter(F.col("event_type") == "error")
    currency = F.get(F.array(*[F.lit(c) for c in ("CLI", "VIE", "PUR", "USD")]), (F.col("user_id") % 4).cast("int"))
    impact = F.when(F.col("value") > 30, "High").when(F.col("value") > 10, "Medium").otherwise("Low")
    ts = F.col("ts").cast("timestamp")
    twelve, full = F.lower(F.date_format(ts, "h:mma")), F.date_format(ts, "HH:mm")
    return events.select(
        F.to_json(
            F.struct(
                F.date_format(ts, "yyyy-MM-dd").alias("date"),
                F.when(F.col("event_id") % 3 == 0, full).otherwise(twelve).alias("time"),
                currency.alias("country"),
                impact.alias("impact"),
                F.concat(F.lit("event "), F.col("event_id")).alias("title"),
            )
        ).alias("value")
    )


@query(
    "news_calendar",
    with_("x AS (SELECT 1)", NEWS)
    + """SELECT 'event ' || event_id AS title, sec AS news_epoch, currency, lower(impact) AS impact FROM news
WHERE impact <> 'Low' AND event_id % 3 <> 0""",
)
def news_calendar(spark, sf):
    """High and medium events; entries whose time is not in the twelve-hour form are dropped."""
    parsed = parse_news(raw_news(spark, sf))
    return parsed.select("title", epoch("ts", "news_epoch"), "currency", "impact")


@query(
    "news_calendar_layouts",
    with_("x AS (SELECT 1)", NEWS)
    + "SELECT 'event ' || event_id AS title, sec AS news_epoch, currency FROM news WHERE impact = 'High'",
)
def news_calendar_layouts(spark, sf):
    """High events only, with the fallback time layouts."""
    parsed = parse_news(raw_news(spark, sf), impacts=("high",), layouts=("h:mma", "H:mm"))
    return parsed.select("title", epoch("ts", "news_epoch"), "currency")


AFFECTED = """,
hit AS (SELECT DISTINCT k.key, n.sec FROM news n JOIN (VALUES ('click', 'CLI'), ('click', 'USD'), ('view', 'VIE'), ('view', 'USD'),
  ('purchase', 'PUR'), ('purchase', 'USD'), ('error', 'USD'), ('signup', 'USD')) AS k(key, currency) ON k.currency = n.currency
  WHERE n.impact <> 'Low')"""


def _news_hits(spark, sf):
    """News per affected key: a symbol is affected by its own currencies and by the dollar."""
    pairs = {"click": "CLI", "view": "VIE", "purchase": "PUR", "error": None, "signup": None}
    news = parse_news(raw_news(spark, sf), layouts=("h:mma", "H:mm"))
    dimension = symbol_currencies(spark, {k: [c, "USD"] if c else ["USD"] for k, c in pairs.items()})
    return news.join(dimension, "currency").select("key", "ts")


@query(
    "news_windows",
    with_(BARS, NEWS, AFFECTED)
    + """SELECT key, bar_epoch, close FROM bars b
WHERE EXISTS (SELECT 1 FROM hit h WHERE h.key = b.key AND abs(h.sec - b.bar_epoch) <= 900)""",
)
def news_windows(spark, sf):
    blocked = near_events(bars(spark, sf), _news_hits(spark, sf), ["key"], "bar_start", "ts", 900, "left_semi")
    return blocked.select("key", epoch(), "close")


@query(
    "news_block_anti",
    with_(BARS, NEWS, AFFECTED)
    + """SELECT key, bar_epoch, close FROM bars b
WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.key = b.key AND abs(h.sec - b.bar_epoch) <= 900)""",
)
def news_block_anti(spark, sf):
    free = near_events(bars(spark, sf), _news_hits(spark, sf), ["key"], "bar_start", "ts", 900, "left_anti")
    return free.select("key", epoch(), "close")


SYMBOLS = {"click": "frxCLIVIE", "view": "VIEUSD", "purchase": "PURUSDT", "error": "ERR"}
_BY_SYMBOL = """,
sy AS (SELECT b.key, b.bar_epoch, b.close, CASE key WHEN 'click' THEN 'frxCLIVIE' WHEN 'view' THEN 'VIEUSD' WHEN 'purchase' THEN 'PURUSDT' WHEN 'error' THEN 'ERR' ELSE 'USDPUR' END AS symbol FROM bars b)"""


def _symbol():
    return F.coalesce(*[F.when(F.col("key") == k, n) for k, n in SYMBOLS.items()], F.lit("USDPUR"))


@query(
    "news_windows_by_symbol",
    with_(BARS, NEWS, _BY_SYMBOL)
    + """, pl AS (SELECT *, replace(replace(upper(symbol), 'FRX', ''), 'USDT', '') AS pair FROM sy)
SELECT key, bar_epoch, symbol FROM pl WHERE EXISTS (SELECT 1 FROM news n WHERE n.impact <> 'Low' AND abs(n.sec - bar_epoch) <= 900
  AND (length(pair) < 6 OR n.currency IN (pair[:3], pair[4:6]) OR n.currency = 'USD'))""",
)
def news_windows_by_symbol(spark, sf):
    """Bars near news of one of their symbol's currencies or the dollar; a symbol without two currencies heeds all news."""
    news = parse_news(raw_news(spark, sf), layouts=("h:mma", "H:mm"))
    rows = bars(spark, sf).withColumn("symbol", _symbol())
    return near_news(rows, news, pair_currencies(F.col("symbol"))).select("key", epoch(), "symbol")


@query(
    "news_high_impact",
    with_(BARS, NEWS, _BY_SYMBOL)
    + """SELECT key, bar_epoch, symbol FROM sy WHERE length(symbol) >= 6 AND EXISTS (SELECT 1 FROM news n WHERE n.impact = 'High' AND abs(n.sec - bar_epoch) <= 900
  AND n.currency IN (symbol[:3], symbol[4:6], 'USD'))""",
)
def news_high_impact(spark, sf):
    """The strict rule: high impact only, currencies as the symbol spells them, none for short symbols."""
    news = parse_news(raw_news(spark, sf), impacts=("high",), layouts=("h:mma", "H:mm"))
    rows = bars(spark, sf).withColumn("symbol", _symbol())
    return near_news(rows, news, spelt_currencies(F.col("symbol"))).select("key", epoch(), "symbol")
