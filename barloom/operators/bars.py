"""Ticks to bars, roll-ups, gap handling and bar hygiene."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.series import (
    KEYS,
    Framed,
    frame,
    number_rows,
    prefix_scan,
    seq_block,
)

LADDER = (2, 5, 15, 60, 240)
"""Higher timeframes as multiples of the base timeframe."""


def bucket_start(ts: Column, seconds: Column | int) -> Column:
    """Start of the epoch-aligned bucket of a timestamp."""
    size = F.lit(seconds) if isinstance(seconds, int) else seconds
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / size) * size)


def ohlc(ticks: DataFrame, tf_sec: int) -> DataFrame:
    """Tumbling bars. First and last price follow arrival order; partial aggregation before the shuffle."""
    volume = [F.sum("volume").alias("volume")] if "volume" in ticks.columns else []
    return (
        ticks.groupBy("key", bucket_start(F.col("ts"), tf_sec).alias("bar_start"))
        .agg(
            F.min_by("price", "seq").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "seq").alias("close"),
            *volume,
            F.count(F.lit(1)).alias("n_ticks"),
        )
        .withColumn("tf_sec", F.lit(tf_sec))
    )


def flag_late_ticks(ticks: DataFrame, tf_sec: int = 60, block: Column | None = None) -> DataFrame:
    """Mark ticks older than an accepted one (`dropped`) and ticks of an already closed bar (`late`)."""
    scanned = prefix_scan(
        ticks,
        ["key"],
        seq_block() if block is None else block,
        ["seq"],
        {"_newest": ("max", F.col("ts"))},
        inclusive=False,
    )
    minute = bucket_start(F.col("ts"), tf_sec)
    return scanned.select(
        *ticks.columns,
        F.coalesce(F.col("ts") < F.col("_newest"), F.lit(False)).alias("dropped"),
        F.coalesce(minute < bucket_start(F.col("_newest"), tf_sec), F.lit(False)).alias("late"),
    )


def tick_stats(flagged: DataFrame) -> DataFrame:
    """Per key: accepted and dropped ticks, last accepted price and time."""
    accepted = ~F.col("dropped")
    return flagged.groupBy("key").agg(
        F.count_if(accepted).alias("received"),
        F.count_if("dropped").alias("dropped"),
        F.max_by("price", F.when(accepted, F.struct("ts", "seq"))).alias("last_price"),
        F.max(F.when(accepted, F.col("ts"))).alias("last_ts"),
    )


def live_bars(ticks: DataFrame, tf_sec: int, block: Column | None = None) -> DataFrame:
    """The bar as it stood after each tick (running open, high, low, close, count)."""
    opened = ticks.withColumn("bar_start", bucket_start(F.col("ts"), tf_sec)).withColumn("tf_sec", F.lit(tf_sec))
    return prefix_scan(
        opened,
        ["key", "tf_sec", "bar_start"],
        seq_block() if block is None else block,
        ["seq"],
        {
            "open": ("first", F.col("price")),
            "high": ("max", F.col("price")),
            "low": ("min", F.col("price")),
            "close": ("last", F.col("price")),
            "n_ticks": ("count", F.lit(1)),
        },
    )


def carry_open(bars: DataFrame, **blocks) -> DataFrame:
    """Open each bar at the previous close and widen high and low to include it."""

    def step(f: Framed) -> Framed:
        before = f.prev("close")
        return f.with_columns(
            {
                "high": F.greatest("high", before),
                "low": F.least("low", before),
                "open": F.coalesce(before, F.col("open")),
            }
        )

    return step(frame(bars, back=1, **blocks)).core(*bars.columns)


def snap_open(bars: DataFrame, tolerance: float = 0.001, **blocks) -> DataFrame:
    """Replace the open by the previous close where they differ by more than `tolerance` of it."""

    def step(f: Framed) -> Framed:
        before = f.prev("close")
        snapped = F.when(F.abs(F.col("open") - before) > before * F.lit(tolerance), before)
        return f.with_columns(
            {
                "high": F.greatest("high", snapped),
                "low": F.least("low", snapped),
                "open": F.coalesce(snapped, F.col("open")),
            }
        )

    return step(frame(bars, back=1, **blocks)).core(*bars.columns)


def fill_gaps(bars: DataFrame, **blocks) -> DataFrame:
    """Add a flat bar at the carried close for every empty interval inside a series.

    Each bar produces the empty intervals up to its successor, so a gap is filled where its left
    neighbour lives and no spine of the whole series is built or joined.
    """
    f = frame(bars, back=0, ahead=1, **blocks)
    following = F.unix_timestamp(f.next("bar_start"))
    f = f.with_columns({"_gap": F.coalesce((following - F.unix_timestamp("bar_start")) / F.col("tf_sec"), F.lit(1))})
    slot = F.posexplode(F.sequence(F.lit(0), F.col("_gap").cast("int") - 1)).alias("_slot", "_n")
    wide = f.core(*bars.columns, "_gap").select(*bars.columns, slot)
    filled = F.col("_slot") > 0

    def value(name: str) -> Column:
        if name == "bar_start":
            moved = F.unix_timestamp("bar_start") + F.col("_slot") * F.col("tf_sec")
            return F.timestamp_seconds(moved).alias(name)
        if name in ("open", "high", "low"):
            return F.when(filled, F.col("close")).otherwise(F.col(name)).alias(name)
        if name in ("n_ticks", "volume"):
            return F.when(filled, F.lit(0)).otherwise(F.col(name)).alias(name)
        return F.col(name)

    return wide.select(*[value(c) for c in bars.columns], filled.alias("filled"))


def roll_up(bars: DataFrame, multiples: Sequence[int] = LADDER, as_of: Column | None = None) -> DataFrame:
    """Aggregate base bars to every higher timeframe in one pass; `closed` needs the bucket to have ended."""
    size = F.explode(F.array(*[F.col("tf_sec") * F.lit(m) for m in multiples]))
    volume = [F.sum("volume").alias("volume")] if "volume" in bars.columns else []
    rolled = (
        bars.withColumn("_tf", size)
        .withColumn("_bucket", bucket_start(F.col("bar_start"), F.col("_tf")))
        .groupBy("key", F.col("_tf").alias("tf_sec"), F.col("_bucket").alias("bar_start"))
        .agg(
            F.min_by("open", bars["bar_start"]).alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", bars["bar_start"]).alias("close"),
            *volume,
            F.sum("n_ticks").alias("n_ticks"),
        )
    )
    return rolled if as_of is None else rolled.withColumn("closed", is_closed(as_of))


def bar_end() -> Column:
    return F.timestamp_seconds(F.unix_timestamp("bar_start") + F.col("tf_sec"))


def is_closed(as_of: Column) -> Column:
    return bar_end() <= as_of


def live_roll_up(bars: DataFrame, multiples: Sequence[int] = LADDER) -> DataFrame:
    """The higher-timeframe bar as it stood after each base bar.

    A bucket holds at most max(multiples) base bars, which bounds each window partition.
    """
    size = F.explode(F.array(*[F.col("tf_sec") * F.lit(m) for m in multiples]))
    dealt = bars.withColumn("htf_sec", size).withColumn("htf_start", bucket_start(F.col("bar_start"), F.col("htf_sec")))
    so_far = (
        Window.partitionBy("key", "htf_sec", "htf_start")
        .orderBy("bar_start")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return dealt.select(
        "key",
        "htf_sec",
        "htf_start",
        "bar_start",
        F.first("open").over(so_far).alias("open"),
        F.max("high").over(so_far).alias("high"),
        F.min("low").over(so_far).alias("low"),
        F.col("close"),
        F.sum("n_ticks").over(so_far).alias("n_ticks"),
    )


def gap_report(bars: DataFrame, **blocks) -> DataFrame:
    """Each hole in a series: the bar before it, the bar after it and the number of missing bars."""
    f = frame(bars, back=0, ahead=1, **blocks)
    f = f.with_columns({"next_start": f.next("bar_start")})
    span = F.unix_timestamp("next_start") - F.unix_timestamp("bar_start")
    return (
        f.core("key", "tf_sec", "bar_start", "next_start")
        .filter(span > F.col("tf_sec"))
        .withColumn("missing", F.floor(span / F.col("tf_sec")) - 1)
    )


def backfill_plan(bars: DataFrame, as_of: Column, target: int = 5000, cold_share: float = 0.2) -> DataFrame:
    """Per series: missing bars up to `as_of`, and whether so little is stored that all is fetched anew."""
    missing = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp("last_start")) / F.col("tf_sec"))
    cold = F.col("stored") < F.lit(target * cold_share)
    return (
        bars.groupBy(*KEYS)
        .agg(F.max("bar_start").alias("last_start"), F.count(F.lit(1)).alias("stored"))
        .withColumn("cold_start", cold)
        .withColumn("fetch", F.when(cold, F.lit(target)).otherwise(F.least(F.lit(target), F.greatest(F.lit(0), missing))))
    )


def downsample(ticks: DataFrame, millis: int) -> DataFrame:
    """At most one update per interval and key: the last one."""
    slot = F.floor(F.unix_micros("ts") / F.lit(millis * 1000))
    return ticks.groupBy("key", slot.alias("slot")).agg(
        F.max_by(F.struct("ts", "price"), "seq").alias("_last"), F.count(F.lit(1)).alias("merged")
    ).select("key", "slot", "_last.ts", "_last.price", "merged")


def silent_spans(ticks: DataFrame, soft: float, hard: float) -> DataFrame:
    """Spans without a tick longer than `soft` seconds; `hard` marks the long ones.

    Ticks are first reduced to the earliest and latest one of each `soft` seconds. No longer span fits inside such a cell,
    so every span lies between two neighbouring cells, and a key has as many rows as its time has cells, however many ticks.
    """
    cell = F.floor(F.unix_micros("ts") / F.lit(int(soft * 1e6)))
    cells = ticks.groupBy("key", cell.alias("_cell")).agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    before = Window.partitionBy("key").orderBy("_cell")
    spans = cells.withColumn("silent_from", F.lag("_last").over(before))
    seconds = (F.unix_micros("_first") - F.unix_micros("silent_from")) / F.lit(1e6)
    return (
        spans.select("key", "silent_from", F.col("_first").alias("silent_until"), seconds.alias("seconds"))
        .filter(F.col("seconds") > soft)
        .withColumn("hard", F.col("seconds") > hard)
    )


def trailing_silence(ticks: DataFrame, as_of: Column, soft: float, hard: float) -> DataFrame:
    """Per key: its last tick, the seconds since then, and whether that is more than `soft` and `hard` allow."""
    last = ticks.groupBy("key").agg(F.max("ts").alias("last_tick"))
    seconds = (F.unix_micros(as_of) - F.unix_micros("last_tick")) / F.lit(1e6)
    return last.withColumn("seconds", seconds).withColumns({"soft": F.col("seconds") > soft, "hard": F.col("seconds") > hard})
