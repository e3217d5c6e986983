"""Ticks to bars: building, repairing, rolling up and auditing."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.sessions import market_open
from barloom.operators import bars as B
from barloom.plans.registry import epoch, ints, query, r, rounded
from barloom.plans.sqlparts import BARS, NUMBERED, TICKS, S, rd, with_
from barloom.sources.samples import bars, ticks

PRICES = ("open", "high", "low", "close")


@query("ohlc_hourly", with_(BARS) + "SELECT key, tf_sec, bar_epoch, open, high, low, close, n_ticks FROM bars")
def ohlc_hourly(spark, sf):
    return bars(spark, sf, reuse=False).select("key", "tf_sec", epoch(), *PRICES, "n_ticks")


CARRY_SQL = """,
carried AS (
  SELECT key, tf_sec, bar_epoch, close, n_ticks, lag(close) {S} AS pc, open, high, low FROM bars)
""".replace("{S}", S)


@query(
    "ohlc_carry_open",
    with_(BARS, CARRY_SQL)
    + """SELECT key, tf_sec, bar_epoch, coalesce(pc, open) AS open, greatest(high, coalesce(pc, high)) AS high,
  least(low, coalesce(pc, low)) AS low, close, n_ticks FROM carried""",
)
def ohlc_carry_open(spark, sf):
    return B.carry_open(bars(spark, sf)).select("key", "tf_sec", epoch(), *PRICES, "n_ticks")


@query(
    "ohlc_snap_open",
    with_(BARS, CARRY_SQL)
    + """, s AS (SELECT *, CASE WHEN abs(open - pc) > pc * 0.001::DOUBLE THEN pc END AS sn FROM carried)
SELECT key, tf_sec, bar_epoch, coalesce(sn, open) AS open, greatest(high, coalesce(sn, high)) AS high,
  least(low, coalesce(sn, low)) AS low, close, n_ticks FROM s""",
)
def ohlc_snap_open(spark, sf):
    return B.snap_open(bars(spark, sf)).select("key", "tf_sec", epoch(), *PRICES, "n_ticks")


@query(
    "ohlc_gap_fill",
    with_(BARS)
    + """, spine AS (
  SELECT key, unnest(generate_series(min(bar_epoch), max(bar_epoch), 3600)) AS bar_epoch FROM bars GROUP BY key),
j AS (SELECT s.key, s.bar_epoch, b.open, b.high, b.low, b.n_ticks,
  last_value(b.close IGNORE NULLS) OVER (PARTITION BY s.key ORDER BY s.bar_epoch) AS close
  FROM spine s LEFT JOIN bars b USING (key, bar_epoch))
SELECT key, 3600::INTEGER AS tf_sec, bar_epoch, coalesce(open, close) AS open, coalesce(high, close) AS high,
  coalesce(low, close) AS low, close, coalesce(n_ticks, 0) AS n_ticks, n_ticks IS NULL AS filled FROM j""",
)
def ohlc_gap_fill(spark, sf):
    return B.fill_gaps(bars(spark, sf)).select(
        "key", "tf_sec", epoch(), *PRICES, F.col("n_ticks").cast("bigint").alias("n_ticks"), "filled"
    )


LADDER_SQL = """,
ladder AS (
  SELECT b.*, t.tf AS htf, bar_epoch // t.tf * t.tf AS bucket
  FROM bars b, (SELECT unnest([7200, 18000, 54000, 216000, 864000])::INTEGER AS tf) t)"""


@query(
    "bars_rollup_ladder",
    with_(BARS, LADDER_SQL)
    + """SELECT key, htf AS tf_sec, bucket AS bar_epoch, arg_min(open, bar_epoch) AS open, max(high) AS high,
  min(low) AS low, arg_max(close, bar_epoch) AS close, CAST(sum(n_ticks) AS BIGINT) AS n_ticks,
  bucket + htf <= 1706659200 AS closed FROM ladder GROUP BY key, htf, bucket""",
)
def bars_rollup_ladder(spark, sf):
    as_of = F.timestamp_seconds(F.lit(1706659200))
    return B.roll_up(bars(spark, sf, reuse=False), as_of=as_of).select("key", "tf_sec", epoch(), *PRICES, "n_ticks", "closed")


@query(
    "live_htf_view",
    with_(BARS, LADDER_SQL)
    + """SELECT key, htf AS htf_sec, bucket AS htf_epoch, bar_epoch, first(open) OVER q AS open,
  max(high) OVER q AS high, min(low) OVER q AS low, close, CAST(sum(n_ticks) OVER q AS BIGINT) AS n_ticks
FROM ladder WINDOW q AS (PARTITION BY key, htf, bucket ORDER BY bar_epoch ROWS UNBOUNDED PRECEDING)""",
)
def live_htf_view(spark, sf):
    return B.live_roll_up(bars(spark, sf, reuse=False)).select(
        "key", "htf_sec", epoch("htf_start", "htf_epoch"), epoch(), *PRICES, "n_ticks"
    )


LATE_TICKS = """,
arrivals AS (
  SELECT key, seq + 40 * CAST(seq % 7 = 0 AS BIGINT) AS shift, seq AS orig, sec, price FROM ticks),
marked AS (
  SELECT *, shift * 2 + CAST(orig % 7 = 0 AS BIGINT) AS seq FROM arrivals),
audited AS (
  SELECT *, max(sec) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest
  FROM marked)"""


def _late_ticks(spark, sf):
    """The ticks in a disturbed arrival order: every seventh comes 40 places late."""
    held = (F.col("seq") % 7 == 0).cast("bigint")
    return ticks(spark, sf).select(
        "key",
        F.timestamp_seconds(F.unix_timestamp("ts")).alias("ts"),
        ((F.col("seq") + 40 * held) * 2 + held).alias("seq"),
        "price",
    )


@query(
    "late_tick_audit",
    with_(TICKS, LATE_TICKS)
    + """SELECT key, seq, sec, price, coalesce(sec < newest, false) AS dropped,
  coalesce(sec // 3600 < newest // 3600, false) AS late FROM audited""",
)
def late_tick_audit(spark, sf):
    return B.flag_late_ticks(_late_ticks(spark, sf), 3600).select(
        "key", "seq", epoch("ts", "sec"), "price", "dropped", "late"
    )


@query(
    "tick_stats",
    with_(TICKS, LATE_TICKS)
    + """, f AS (SELECT *, coalesce(sec < newest, false) AS dropped FROM audited)
SELECT key, count(*) FILTER (NOT dropped) AS received, count(*) FILTER (dropped) AS dropped,
  arg_max(price, row(sec, seq)) FILTER (NOT dropped) AS last_price, max(sec) FILTER (NOT dropped) AS last_sec
FROM f GROUP BY key""",
)
def tick_stats(spark, sf):
    flagged = B.flag_late_ticks(_late_ticks(spark, sf), 3600)
    return B.tick_stats(flagged).select("key", "received", "dropped", "last_price", epoch("last_ts", "last_sec"))


@query(
    "ohlc_late_discarded",
    with_(TICKS, LATE_TICKS)
    + """SELECT key, sec // 3600 * 3600 AS bar_epoch, arg_min(price, seq) AS open, max(price) AS high,
  min(price) AS low, arg_max(price, seq) AS close, count(*) AS n_ticks
FROM audited WHERE NOT coalesce(sec // 3600 < newest // 3600, false) GROUP BY ALL""",
)
def ohlc_late_discarded(spark, sf):
    kept = B.flag_late_ticks(_late_ticks(spark, sf), 3600).filter(~F.col("late"))
    return B.ohlc(kept, 3600).select("key", epoch(), *PRICES, "n_ticks")


@query(
    "live_bar_updates",
    with_(TICKS)
    + """SELECT key, seq, sec // 3600 * 3600 AS bar_epoch, first(price) OVER q AS open, max(price) OVER q AS high,
  min(price) OVER q AS low, price AS close, count(*) OVER q AS n_ticks
FROM ticks WINDOW q AS (PARTITION BY key, sec // 3600 ORDER BY seq ROWS UNBOUNDED PRECEDING)""",
)
def live_bar_updates(spark, sf):
    return B.live_bars(ticks(spark, sf), 3600).select("key", "seq", epoch(), *PRICES, "n_ticks")


@query(
    "closed_bars_only",
    with_(BARS)
    + """SELECT key, tf_sec, bar_epoch, open, high, low, close FROM bars WHERE bar_epoch + tf_sec <= 1706569200""",
)
def closed_bars_only(spark, sf):
    closed = B.is_closed(F.timestamp_seconds(F.lit(1706569200)))
    return bars(spark, sf, reuse=False).filter(closed).select("key", "tf_sec", epoch(), *PRICES)


@query(
    "gap_report",
    with_(BARS)
    + f""", n AS (SELECT *, lead(bar_epoch) {S} AS next_epoch FROM bars)
SELECT key, tf_sec, bar_epoch, next_epoch, (next_epoch - bar_epoch) // tf_sec - 1 AS missing
FROM n WHERE next_epoch - bar_epoch > tf_sec""",
)
def gap_report(spark, sf):
    return B.gap_report(bars(spark, sf)).select(
        "key", "tf_sec", epoch(), epoch("next_start", "next_epoch"), "missing"
    )


@query(
    "backfill_plan",
    with_(BARS)
    + """, s AS (SELECT key, tf_sec, max(bar_epoch) AS last_epoch, count(*) AS stored FROM bars GROUP BY key, tf_sec)
SELECT key, tf_sec, last_epoch, stored, stored < 700 AS cold_start,
  CASE WHEN stored < 700 THEN 3500 ELSE least(3500, greatest(0, (1706832000 - last_epoch) // tf_sec)) END AS fetch
FROM s""",
)
def backfill_plan(spark, sf):
    plan = B.backfill_plan(bars(spark, sf, reuse=False), F.timestamp_seconds(F.lit(1706832000)), target=3500)
    return plan.select(
        "key", "tf_sec", epoch("last_start", "last_epoch"), "stored", "cold_start", F.col("fetch").cast("bigint").alias("fetch")
    )


@query(
    "market_hours",
    with_(BARS)
    + """, t AS (SELECT *, dayofweek(to_timestamp(bar_epoch) AT TIME ZONE 'UTC') AS dow,
  bar_epoch % 86400 // 3600 AS hr FROM bars)
SELECT key, bar_epoch, CASE WHEN dow = 6 THEN false WHEN dow = 0 THEN hr >= 21 WHEN dow = 5 THEN hr < 21
  ELSE true END AS is_open FROM t""",
)
def market_hours(spark, sf):
    return bars(spark, sf, reuse=False).select("key", epoch(), market_open(F.col("bar_start")).alias("is_open"))


@query(
    "update_throttle",
    with_(TICKS)
    + """SELECT key, epoch_us(ts) // 900000000 AS slot, arg_max(epoch_us(ts), seq) AS ts_us,
  arg_max(price, seq) AS price, count(*) AS merged FROM ticks GROUP BY ALL""",
)
def update_throttle(spark, sf):
    slower = B.downsample(ticks(spark, sf), 900_000)
    return slower.select("key", "slot", F.unix_micros("ts").alias("ts_us"), "price", "merged")


@query(
    "feed_silence",
    with_(TICKS)
    + """, g AS (SELECT key, lag(epoch_us(ts)) OVER q AS a, epoch_us(ts) AS b FROM ticks
  WINDOW q AS (PARTITION BY key ORDER BY ts, seq))
SELECT key, a AS from_us, b AS until_us, round((b - a) / 1e6::DOUBLE + 1e-11::DOUBLE, 6) + 0.0::DOUBLE AS seconds,
  (b - a) / 1e6::DOUBLE > 14400 AS hard
FROM g WHERE (b - a) / 1e6::DOUBLE > 7200""",
)
def feed_silence(spark, sf):
    spans = B.silent_spans(ticks(spark, sf), 7200, 14400)
    return spans.select(
        "key",
        F.unix_micros("silent_from").alias("from_us"),
        F.unix_micros("silent_until").alias("until_us"),
        r("seconds").alias("seconds"),
        "hard",
    )


@query(
    "feed_trailing_silence",
    with_(TICKS)
    + """, l AS (SELECT key, max(epoch_us(ts)) AS last_us FROM ticks GROUP BY key), s AS (SELECT *, (1706659200000000 - last_us) / 1e6::DOUBLE AS secs FROM l)
SELECT key, last_us, round(secs + 1e-11::DOUBLE, 6) + 0.0::DOUBLE AS seconds, secs > 300 AS soft, secs > 600 AS hard FROM s""",
)
def feed_trailing_silence(spark, sf):
    """Seconds from the last tick of each key to a given moment."""
    last = B.trailing_silence(ticks(spark, sf), F.timestamp_seconds(F.lit(1706659200)), 300, 600)
    return last.select("key", F.unix_micros("last_tick").alias("last_us"), r("seconds").alias("seconds"), "soft", "hard")
