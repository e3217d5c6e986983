"""Reading, merging, retaining and publishing bars; feed messages; read projections."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barloom.functions.sessions import market_open
from barloom.operators import bars as B
from barloom.operators.indicators import indicator_frame, latest
from barloom.operators.retention import merge_latest, newest_rows
from barloom.operators.series import seq_block, time_block
from barloom.plans.registry import epoch, query, r, rounded
from barloom.plans.sqlparts import BARS, NUMBERED, TICKS, rd, with_
from barloom.sources import feeds
from barloom.sources.samples import bars, ticks
from barloom.session import shared_folder
from barloom.sources.tables import messages, read_bars, upsert_bars, write_bars

PRICES = ("open", "high", "low", "close")


@query(
    "bars_latest_n",
    with_(BARS) + "SELECT key, tf_sec, bar_epoch, open, high, low, close FROM bars QUALIFY row_number() OVER (PARTITION BY key ORDER BY bar_epoch DESC) <= 300",
)
def bars_latest_n(spark, sf):
    return newest_rows(bars(spark, sf), 300).select("key", "tf_sec", epoch(), *PRICES)


@query(
    "bar_retention_topn",
    with_(BARS, ", l AS (SELECT key, 3600 * m AS tf_sec, bar_epoch // (3600 * m) * (3600 * m) AS bar_epoch FROM bars, (SELECT unnest([1, 2, 5]) AS m) t)")
    + "SELECT DISTINCT key, CAST(tf_sec AS INTEGER) AS tf_sec, bar_epoch FROM l QUALIFY dense_rank() OVER (PARTITION BY key, tf_sec ORDER BY bar_epoch DESC) <= 200",
)
def bar_retention_topn(spark, sf):
    """Newest 200 bars of every series over three timeframes."""
    every = B.roll_up(bars(spark, sf), (1, 2, 5))
    return newest_rows(every, 200).select("key", "tf_sec", epoch())


@query(
    "bar_retention_1500",
    with_(TICKS)
    + "SELECT DISTINCT key, sec // 60 * 60 AS bar_epoch FROM ticks QUALIFY dense_rank() OVER (PARTITION BY key ORDER BY sec // 60 DESC) <= 1500",
)
def bar_retention_1500(spark, sf):
    """Newest 1500 minute bars of every series, which lie in several blocks."""
    return newest_rows(bars(spark, sf, 60), 1500).select("key", epoch())


@query(
    "bars_upsert",
    with_(BARS)
    + """SELECT key, tf_sec, bar_epoch, CASE WHEN bar_epoch % 7200 = 0 AND bar_epoch >= 1705276800 THEN close + 1 ELSE close END AS close FROM bars""",
)
def bars_upsert(spark, sf):
    """A stored bar table after an upsert: some bars are replaced by newer versions, others are new."""
    made = bars(spark, sf)
    path = f"{shared_folder(spark)}/barloom/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    start = F.timestamp_seconds(F.lit(1705276800))
    changed = (F.unix_timestamp("bar_start") % 7200 == 0) & (F.col("bar_start") >= start)
    write_bars(made.filter((F.unix_timestamp("bar_start") % 10800 != 0) | (F.col("bar_start") < start)), path)
    fresh = made.filter(changed | ((F.unix_timestamp("bar_start") % 10800 == 0) & (F.col("bar_start") >= start)))
    upsert_bars(spark, fresh.withColumn("close", F.col("close") + F.when(changed, 1).otherwise(0)), path)
    return read_bars(spark, path).select("key", "tf_sec", epoch(), "close")


@query("bar_counts", with_(BARS) + "SELECT key, tf_sec, count(*) AS n_bars FROM bars GROUP BY key, tf_sec")
def bar_counts(spark, sf):
    return bars(spark, sf, reuse=False).groupBy("key", "tf_sec").agg(F.count(F.lit(1)).alias("n_bars"))


@query(
    "bars_merge_latest_wins",
    with_(BARS)
    + "SELECT key, tf_sec, bar_epoch, open, high, low, CASE WHEN bar_epoch // 3600 % 3 = 0 THEN close + 1 ELSE close END AS close FROM bars WHERE bar_epoch // 3600 % 5 <> 0 OR bar_epoch // 3600 % 3 = 0",
)
def bars_merge_latest_wins(spark, sf):
    """Stored bars (some missing) merged with fresh ones (some corrected); fresh wins."""
    hour = F.floor(F.unix_timestamp("bar_start") / 3600)
    every = bars(spark, sf)
    stored = every.filter(hour % 5 != 0)
    fresh = every.filter(hour % 3 == 0).withColumn("close", F.col("close") + 1)
    return merge_latest([stored, fresh]).select("key", "tf_sec", epoch(), *PRICES)


@query(
    "bar_messages",
    with_(BARS)
    + "SELECT 'candle:' || key || ':3600' AS topic, bar_epoch, round(close + 1e-11::DOUBLE, 6) AS close FROM bars",
)
def bar_messages(spark, sf):
    """Published messages read back by their consumer."""
    sent = messages(bars(spark, sf, reuse=False))
    body = F.from_json("value", "epoch BIGINT, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE").alias("b")
    return sent.select("topic", body).select("topic", F.col("b.epoch").alias("bar_epoch"), r("b.close").alias("close"))


@query(
    "kline_messages",
    with_(BARS)
    + "SELECT key, 3600::INTEGER AS tf_sec, bar_epoch, open, high, low, close, CAST(n_ticks AS DOUBLE) AS volume, bar_epoch // 3600 % 2 = 0 AS closed FROM bars WHERE bar_epoch // 3600 % 10 <> 0",
)
def kline_messages(spark, sf):
    """Kline events with text prices; every tenth message is another event and is skipped."""
    hour = F.floor(F.unix_timestamp("bar_start") / 3600)
    k = F.struct(
        (F.unix_timestamp("bar_start") * 1000).alias("t"),
        *[F.col(name).cast("string").alias(name[0]) for name in PRICES],
        F.col("n_ticks").cast("string").alias("v"),
        (hour % 2 == 0).alias("x"),
        F.lit("1h").alias("i"),
    )
    kind = F.when(hour % 10 == 0, "depthUpdate").otherwise("kline")
    raw = bars(spark, sf, reuse=False).select(F.to_json(F.struct(kind.alias("e"), F.col("key").alias("s"), k.alias("k"))).alias("value"))
    return feeds.parse_klines(raw).select("key", "tf_sec", epoch(), *PRICES, "volume", "closed")


@query(
    "ohlc_messages",
    with_(BARS)
    + "SELECT key, 3600::INTEGER AS tf_sec, bar_epoch, open, high, low, close, 1705968000 >= bar_epoch + 3600 AS closed FROM bars WHERE bar_epoch // 3600 % 10 <> 0",
)
def ohlc_messages(spark, sf):
    hour = F.floor(F.unix_timestamp("bar_start") / 3600)
    body = F.struct(
        F.col("key").alias("symbol"),
        F.unix_timestamp("bar_start").alias("open_time"),
        *[F.col(name).cast("string").alias(name) for name in PRICES],
        F.col("tf_sec").alias("granularity"),
    )
    kind = F.when(hour % 10 == 0, "tick").otherwise("ohlc")
    raw = bars(spark, sf, reuse=False).select(F.to_json(F.struct(kind.alias("msg_type"), body.alias("ohlc"))).alias("value"))
    parsed = feeds.parse_ohlc(raw, F.timestamp_seconds(F.lit(1705968000)))
    return parsed.select("key", "tf_sec", epoch(), *PRICES, "closed")


@query(
    "tick_messages",
    with_(TICKS) + "SELECT key, seq, sec, price - 50 AS price FROM ticks WHERE key <> 'signup' AND price - 50 > 0",
)
def tick_messages(spark, sf):
    """Tick messages of known symbols with a positive price."""
    body = F.struct(
        F.concat(F.lit("frx"), F.col("key")).alias("symbol"),
        (F.col("price") - 50).alias("quote"),
        F.unix_timestamp("ts").alias("epoch"),
    )
    raw = ticks(spark, sf).select("seq", F.to_json(F.struct(body.alias("tick"))).alias("value"))
    names = [(f"frx{k}", k) for k in ("click", "error", "purchase", "view")]
    known = spark.createDataFrame(names, "feed_symbol string, key string")
    return feeds.parse_ticks(raw, known).select("key", "seq", epoch("ts", "sec"), "price")


@query(
    "feed_symbols",
    with_(BARS)
    + """, t AS (SELECT key, bar_epoch, dayofweek(to_timestamp(bar_epoch) AT TIME ZONE 'UTC') AS dow, bar_epoch % 86400 // 3600 AS hr FROM bars)
SELECT key, bar_epoch, CASE WHEN (CASE WHEN dow = 6 THEN false WHEN dow = 0 THEN hr >= 21 WHEN dow = 5 THEN hr < 21 ELSE true END) THEN key ELSE key || '_otc' END AS feed_name,
  key AS internal FROM t""",
)
def feed_symbols(spark, sf):
    name = feeds.feed_symbol(F.col("key"), market_open(F.col("bar_start")))
    named = bars(spark, sf, reuse=False).select("key", epoch(), name.alias("feed_name"))
    return named.withColumn("internal", feeds.internal_symbol(F.col("feed_name")))


@query(
    "history_rows",
    with_(BARS)
    + "SELECT key, tf_sec, bar_epoch, open, high, low, CASE WHEN bar_epoch // 3600 % 4 = 0 THEN close + 2 ELSE close END AS close FROM bars",
)
def history_rows(spark, sf):
    """History pages: text fields, repeated bars (the later page wins) and broken rows."""
    hour = F.floor(F.unix_timestamp("bar_start") / 3600)
    every = bars(spark, sf)

    def page(rows, number, close, start):
        fields = F.struct(
            F.col("key").alias("symbol"), F.col("tf_sec").alias("granularity"), start.alias("epoch"),
            *[F.col(n).cast("string").alias(n) for n in ("open", "high", "low")], close.cast("string").alias("close"),
        )
        return rows.select(F.lit(number).alias("page"), F.to_json(fields).alias("value"))

    good = F.unix_timestamp("bar_start").cast("string")
    first = page(every, 0, F.col("close"), good)
    second = page(every.filter(hour % 4 == 0), 1, F.col("close") + 2, good)
    broken = page(every.filter(hour % 6 == 0), 2, F.lit("n/a"), good)
    raw = first.unionByName(second).unionByName(broken)
    return feeds.parse_history(raw).select("key", "tf_sec", epoch(), *PRICES)


@query(
    "incremental_ticks",
    with_(TICKS)
    + """, seen AS (SELECT key, max(seq) AS last_seq FROM ticks WHERE sec < 1705363200 GROUP BY key)
SELECT t.key, t.seq, t.price FROM ticks t JOIN seen s ON s.key = t.key AND t.seq > s.last_seq""",
)
def incremental_ticks(spark, sf):
    """Ticks after the last one seen per key."""
    every = ticks(spark, sf)
    seen = every.filter(F.unix_timestamp("ts") < 1705363200).groupBy("key").agg(F.max("seq").alias("last_seq"))
    return every.join(seen, "key").filter("seq > last_seq").select("key", "seq", "price")


@query(
    "ticks_latest_n",
    with_(TICKS) + "SELECT key, seq, price FROM ticks QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) <= 100",
)
def ticks_latest_n(spark, sf):
    kept = newest_rows(ticks(spark, sf), 100, keys=("key",), order=("seq",), block=seq_block())
    return kept.select("key", "seq", "price")


@query(
    "ticks_in_interval",
    with_(TICKS) + "SELECT key, seq, price FROM ticks WHERE ts >= TIMESTAMP '2024-01-10 12:00:00' AND ts < TIMESTAMP '2024-01-10 13:00:00'",
)
def ticks_in_interval(spark, sf):
    """Half-open time range; both bounds reach the file scan."""
    start, end = (F.lit(x).cast("timestamp") for x in ("2024-01-10 12:00:00", "2024-01-10 13:00:00"))
    return ticks(spark, sf).filter((F.col("ts") >= start) & (F.col("ts") < end)).select("key", "seq", "price")


@query(
    "ticks_since",
    with_(TICKS) + "SELECT key, seq, price FROM ticks WHERE ts >= TIMESTAMP '2024-01-29 00:00:00'",
)
def ticks_since(spark, sf):
    start = F.lit("2024-01-29 00:00:00").cast("timestamp")
    return ticks(spark, sf).filter(F.col("ts") >= start).select("key", "seq", "price")


@query(
    "engine_snapshot",
    with_(BARS, NUMBERED)
    + """, t AS (SELECT key, arg_max(price, seq) AS last_price, 1706659200 - max(sec) AS tick_age FROM ticks GROUP BY key),
l AS (SELECT key, arg_max(close, bar_epoch) AS close, arg_max(bar_epoch, bar_epoch) AS bar_epoch, arg_max(n_ticks, bar_epoch) AS n_ticks FROM b GROUP BY key)
SELECT key, bar_epoch, close, n_ticks, last_price, tick_age FROM l JOIN t USING (key)""",
)
def engine_snapshot(spark, sf):
    """Newest bar and tick per key with the age of the tick."""
    newest = bars(spark, sf, reuse=False).groupBy("key").agg(F.max_by(F.struct("bar_start", "close", "n_ticks"), "bar_start").alias("_b"))
    last = ticks(spark, sf).groupBy("key").agg(
        F.max_by("price", "seq").alias("last_price"), (1706659200 - F.max(F.unix_timestamp("ts"))).alias("tick_age")
    )
    return newest.join(last, "key").select("key", epoch("_b.bar_start"), "_b.close", "_b.n_ticks", "last_price", "tick_age")
