"""Feed messages (JSON text in a `value` column) to typed rows; works on batches and on streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KLINE = "e STRING, s STRING, k STRUCT<t: BIGINT, o: STRING, h: STRING, l: STRING, c: STRING, v: STRING, x: BOOLEAN, i: STRING>"
OHLC = (
    "msg_type STRING, error STRING, ohlc STRUCT<symbol: STRING, open_time: BIGINT, open: STRING, high: STRING, "
    "low: STRING, close: STRING, granularity: INT>"
)
TICK = "tick STRUCT<symbol: STRING, quote: DOUBLE, epoch: BIGINT>"
NEWS = "date STRING, time STRING, country STRING, impact STRING, title STRING"
HISTORY = "symbol STRING, granularity INT, epoch STRING, open STRING, high STRING, low STRING, close STRING"

# Seconds of the interval names a kline message carries.
INTERVALS = {"1m": 60, "2m": 120, "5m": 300, "15m": 900, "1h": 3600, "4h": 14400, "1d": 86400}


def _number(value: Column) -> Column:
    return value.try_cast("double")


def parse_klines(raw: DataFrame) -> DataFrame:
    """Kline events to bars; other events and unreadable messages are left out."""
    m = F.from_json("value", KLINE)
    interval = F.lit(None).cast("int")
    for name, seconds in INTERVALS.items():
        interval = F.when(F.col("m.k.i") == name, F.lit(seconds)).otherwise(interval)
    return (
        raw.select(m.alias("m"))
        .filter("m.e = 'kline'")
        .select(
            F.col("m.s").alias("key"),
            interval.alias("tf_sec"),
            F.timestamp_millis("m.k.t").alias("bar_start"),
            *[_number(F.col(f"m.k.{x[0]}")).alias(x) for x in ("open", "high", "low", "close", "volume")],
            F.col("m.k.x").alias("closed"),
        )
    )


def parse_ohlc(raw: DataFrame, as_of: Column) -> DataFrame:
    """Ohlc events to bars; a bar is closed once its interval has ended."""
    m = F.from_json("value", OHLC)
    start, size = F.col("m.ohlc.open_time"), F.col("m.ohlc.granularity")
    return (
        raw.select("*", m.alias("m"))
        .filter("m.msg_type = 'ohlc' AND m.error IS NULL")
        .select(
            F.col("m.ohlc.symbol").alias("key"),
            size.alias("tf_sec"),
            F.timestamp_seconds(start).alias("bar_start"),
            *[_number(F.col(f"m.ohlc.{x}")).alias(x) for x in ("open", "high", "low", "close")],
            (F.unix_timestamp(as_of) >= start + size).alias("closed"),
        )
    )


def parse_ticks(raw: DataFrame, symbols: DataFrame) -> DataFrame:
    """Tick messages of known symbols with a positive price. `symbols` maps feed_symbol to key."""
    m = F.from_json("value", TICK)
    keep = [c for c in raw.columns if c != "value"]
    flat = raw.select(
        *keep,
        m["tick"]["symbol"].alias("feed_symbol"),
        F.timestamp_seconds(m["tick"]["epoch"]).alias("ts"),
        m["tick"]["quote"].alias("price"),
    ).filter("price > 0")
    return flat.join(symbols, "feed_symbol").drop("feed_symbol")


def feed_symbol(key: Column, is_open: Column) -> Column:
    """Name of a key on the feed: the off-hours variant while its market is closed."""
    return F.when(is_open, key).otherwise(F.concat(key, F.lit("_otc")))


def internal_symbol(name: Column, prefix: str = "frx", suffix: str = "_otc") -> Column:
    """Key behind a feed name."""
    return F.regexp_replace(F.regexp_replace(name, f"^{prefix}", ""), f"{suffix}$", "")


def symbol_currencies(spark: SparkSession, currencies: dict[str, Sequence[str]]) -> DataFrame:
    """Dimension key, currency; one row per currency that moves the key."""
    rows = [(key, currency) for key, names in currencies.items() for currency in names]
    return spark.createDataFrame(rows, "key string, currency string")


def pair_currencies(symbol: Column) -> Column:
    """Base and quote currency of a symbol, and the dollar that moves every symbol; null where it does not spell two."""
    plain = F.replace(F.replace(F.upper(symbol), F.lit("FRX"), F.lit("")), F.lit("USDT"), F.lit(""))
    both = F.array(F.substring(plain, 1, 3), F.substring(plain, 4, 3), F.lit("USD"))
    return F.when(F.length(plain) >= 6, F.array_distinct(both))


def spelt_currencies(symbol: Column) -> Column:
    """The first and second three letters of a symbol as they stand, and the dollar; none for a symbol shorter than six."""
    both = F.array_distinct(F.array(F.substring(symbol, 1, 3), F.substring(symbol, 4, 3), F.lit("USD")))
    return F.when(F.length(symbol) >= 6, both).otherwise(F.array().cast("array<string>"))


def parse_news(
    raw: DataFrame, impacts: Sequence[str] = ("high", "medium"), layouts: Sequence[str] = ("h:mma",)
) -> DataFrame:
    """Calendar entries of the wanted impacts; entries without a readable time are dropped."""
    # A generator stands between the parse and its fields, so an entry's text and time are each parsed once.
    m = raw.select(F.inline(F.array(F.from_json("value", NEWS)))).filter(F.lower("impact").isin(*impacts))
    when = F.upper(F.concat_ws(" ", F.col("date"), F.col("time")))
    # A failed parse costs an exception, so a layout is only tried on texts of its own kind.
    halves = when.rlike("[AP]M$")
    parsed = F.coalesce(
        *[
            F.when(halves if layout.endswith("a") else ~halves, F.try_to_timestamp(when, F.lit(f"yyyy-MM-dd {layout}")))
            for layout in layouts
        ]
    )
    known = m.select(F.explode(F.array_compact(F.array(parsed))).alias("ts"), "country", "impact", "title")
    return known.select("ts", F.col("country").alias("currency"), F.lower("impact").alias("impact"), "title")


def parse_history(raw: DataFrame) -> DataFrame:
    """History rows to bars: numbers read leniently, rows without a time dropped, one row per bar start."""
    m = F.from_json("value", HISTORY)
    rows = raw.select(m.alias("m"), *[c for c in raw.columns if c != "value"])
    seconds = _number(F.col("m.epoch")).cast("bigint")
    order = "page" if "page" in raw.columns else None
    flat = rows.select(
        F.col("m.symbol").alias("key"),
        F.col("m.granularity").alias("tf_sec"),
        F.timestamp_seconds(seconds).alias("bar_start"),
        *[_number(F.col(f"m.{x}")).alias(x) for x in ("open", "high", "low", "close")],
        (F.col(order) if order else F.lit(0)).alias("page"),
    ).filter("bar_start IS NOT NULL AND close IS NOT NULL")
    values = F.struct("open", "high", "low", "close")
    return (
        flat.groupBy("key", "tf_sec", "bar_start")
        .agg(F.max_by(values, "page").alias("_v"))
        .select("key", "tf_sec", "bar_start", "_v.*")
    )
