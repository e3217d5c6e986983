"""Bars, roll-ups, selection and de-duplication on streams of ticks and signals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.operators.joins import near_events
from barloom.operators.signals import best_per_interval
from barloom.sources.tables import upsert_bars, write_bars

CARRIED = "key string, tf_sec int, bar_start timestamp, open double, high double, low double, close double, n_ticks bigint"
CARRY_STATE = "last_sec bigint, last_close double"


def tick_bars(ticks: DataFrame, tf_sec: int, lateness: str = "10 minutes") -> DataFrame:
    """Tumbling bars of a tick stream; prices in order of arrival.

    Written in append mode each bar comes once, when the watermark has passed its end, and later ticks
    are dropped; in update mode the open bar comes again with every change. Ticks are combined before
    the shuffle, so a busy key costs one row per bar and task.
    """
    window = F.window("ts", f"{tf_sec} seconds")
    return (
        ticks.withWatermark("ts", lateness)
        .groupBy("key", window.alias("window"))
        .agg(
            F.min_by("price", "seq").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "seq").alias("close"),
            F.count(F.lit(1)).alias("n_ticks"),
        )
        .select(
            "key",
            F.lit(tf_sec).alias("tf_sec"),
            F.col("window.start").alias("bar_start"),
            "open",
            "high",
            "low",
            "close",
            "n_ticks",
        )
    )


_BAR = ["key", "tf_sec", "bar_start", "open", "high", "low", "close", "n_ticks"]


def _carried(name: str, tf: int, bars: pd.DataFrame, last_start: int | None, last_close: float | None, until: int | None = None, rows: int = 100_000) -> Iterator[pd.DataFrame]:
    """Bars (start in seconds, in order) opened at the previous close, with flat bars for the intervals between, in slices.

    Flat bars also follow the last bar up to, not including, `until`. A long gap comes in slices of so many rows.
    """
    starts = bars["start"].to_numpy(np.int64)
    before = np.concatenate([[np.nan if last_close is None else last_close], bars["close"].to_numpy(float)])[:-1]
    own = bars.assign(open=np.where(np.isnan(before), bars["open"], before), high=np.fmax(bars["high"], before), low=np.fmin(bars["low"], before))
    edges = np.concatenate([[last_start] if last_start is not None else [], starts, [until] if until is not None else []]).astype(np.int64)
    closes = np.concatenate([[last_close] if last_start is not None else [], bars["close"].to_numpy(float)])
    n_flat = np.maximum(np.diff(edges) // tf - 1, 0)
    done = 0
    for i in range(len(n_flat)):  # one step for each bar of the batch that a gap follows, or the whole run without gaps
        if n_flat[i] == 0:
            continue
        at = np.searchsorted(starts, edges[i], "right")
        yield own.iloc[done:at]
        done = at
        for first in range(0, int(n_flat[i]), rows):
            flat = edges[i] + tf * (1 + np.arange(first, min(first + rows, int(n_flat[i]))))
            yield pd.DataFrame({"start": flat} | {c: closes[i] for c in ("open", "high", "low", "close")} | {"n_ticks": 0})
    yield own.iloc[done:]


def _shaped(name: str, tf: int, part: pd.DataFrame) -> pd.DataFrame:
    return part.assign(key=name, tf_sec=tf, bar_start=pd.to_datetime(part["start"], unit="s"))[_BAR]


def _carry(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Open each bar of one series at the previous close and fill the intervals without ticks."""
    bars = pd.concat(list(batches)).sort_values("bar_start")
    name, tf = key
    last_start, last_close = state.get if state.exists else (None, None)
    bars = bars.assign(start=(bars["bar_start"] - pd.Timestamp(0)) // pd.Timedelta(seconds=1))
    state.update((int(bars["start"].iloc[-1]), float(bars["close"].iloc[-1])))
    for part in _carried(name, tf, bars, last_start, last_close):
        if len(part):
            yield _shaped(name, tf, part)


OPEN_BAR = ("start", "first_seq", "open", "high", "low", "last_seq", "close", "n_ticks")
CLOSING_STATE = ", ".join(f"{c} array<{'double' if c in ('open', 'high', 'low', 'close') else 'bigint'}>" for c in OPEN_BAR) + ", last_start bigint, last_close double, last_tick bigint"


def _merged(parts: pd.DataFrame) -> pd.DataFrame:
    """Parts of bars with the same start as one bar each; the first and last prices by arrival."""
    by_first, by_last = (parts.sort_values(c).groupby("start") for c in ("first_seq", "last_seq"))
    return pd.DataFrame(
        {
            "first_seq": by_first["first_seq"].first(), "open": by_first["open"].first(), "high": by_first["high"].max(), "low": by_first["low"].min(),
            "last_seq": by_last["last_seq"].last(), "close": by_last["close"].last(), "n_ticks": by_last["n_ticks"].sum(),
        }
    ).reset_index()


def closing_bars(ticks: DataFrame, tf_sec: int, lateness: str = "10 minutes", idle_seconds: int = 86400) -> DataFrame:
    """Carried and gap-free bars of a tick stream, each written as the watermark passes its end, whether a tick follows or not.

    A timer at the next bar's end closes it: a silent series gets a flat bar at every boundary until it has been silent for
    `idle_seconds`; what is missing then follows with its next tick. The state of a series is one row: its bars that are still
    open (as many as the lateness holds), the last closed one and the time of the last tick. Ticks behind the watermark are
    dropped. A series without any tick has no bars. Append mode.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (name,) = key
        *held, last_start, last_close, last_tick = state.get if state.exists else ([],) * len(OPEN_BAR) + (None, None, None)
        parts = [pd.DataFrame(dict(zip(OPEN_BAR, held, strict=True)))]
        for batch in batches:
            if len(batch):
                sec = ((batch["ts"] - pd.Timestamp(0)) // pd.Timedelta(seconds=1)).astype("int64")
                part = pd.DataFrame({"start": sec // tf_sec * tf_sec, "first_seq": batch["seq"], "last_seq": batch["seq"], "n_ticks": 1} | {c: batch["price"] for c in ("open", "high", "low", "close")})
                parts.append(_merged(part))
                last_tick = max(int(sec.max()), last_tick or 0)
        bars = _merged(pd.concat([p for p in parts if len(p)])) if any(len(p) for p in parts) else parts[0]
        if last_start is not None:
            bars = bars[bars["start"] > last_start]
        now = state.getCurrentWatermarkMs() // 1000
        ended = bars["start"] + tf_sec <= now
        closed, opened = bars[ended], bars[~ended]
        out = []
        if len(closed) or last_start is not None:
            # Flat bars run to the first open bar, or to what the watermark has passed and the series is not too long silent for.
            quiet = min(now // tf_sec * tf_sec, (last_tick + idle_seconds) // tf_sec * tf_sec)
            newest = int(closed["start"].iloc[-1]) if len(closed) else last_start
            until = max(newest + tf_sec, min(quiet, int(opened["start"].min()) if len(opened) else quiet))
            if len(closed) or until > newest + tf_sec:
                out = _carried(name, tf_sec, closed, last_start, last_close, until)
                last_close = float(closed["close"].iloc[-1]) if len(closed) else last_close
                last_start = until - tf_sec
        state.update((*([x.item() for x in opened[c].to_numpy()] for c in OPEN_BAR), last_start, last_close, last_tick))
        following = int(opened["start"].min()) if len(opened) else last_start + tf_sec
        if len(opened) or following < last_tick + idle_seconds:
            state.setTimeoutTimestamp(max((following + tf_sec) * 1000, state.getCurrentWatermarkMs() + 1))
        for part in out:
            if len(part):
                yield _shaped(name, tf_sec, part)

    plain = ticks.select("key", "ts", "seq", "price").withWatermark("ts", lateness)
    return plain.groupBy("key").applyInPandasWithState(run, CARRIED, CLOSING_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def carried_bars(bars: DataFrame) -> DataFrame:
    """Closed bars with carried open and with flat bars for empty intervals.

    Reads a stream of closed bars, such as the files `tick_bars` was written to, not ticks: the state
    per series is one time and one price, and a task sees at most one row per interval. Append mode; a
    stateful step of this kind cannot follow an aggregation in the same query.
    """
    return bars.groupBy("key", "tf_sec").applyInPandasWithState(
        _carry, CARRIED, CARRY_STATE, "append", GroupStateTimeout.NoTimeout
    )


def best_signals(signals: DataFrame, interval: str = "1 minute", lateness: str = "1 minute") -> DataFrame:
    """Most confident signal of all keys per interval, once the interval is over."""
    return best_per_interval(signals.withWatermark("bar_start", lateness), interval)


def first_markers(markers: DataFrame, lateness: str = "24 hours") -> DataFrame:
    """One marker per key, timeframe and bar; state older than the lateness is dropped."""
    return markers.withWatermark("bar_start", lateness).dropDuplicatesWithinWatermark(["key", "tf_sec", "bar_start"])


def news_blocked(bars: DataFrame, news: DataFrame, seconds: int = 900) -> DataFrame:
    """Streamed bars close to an event of a static calendar (key, ts)."""
    return near_events(bars, news, ["key"], "bar_start", "ts", seconds, "left_semi")


def store_bars(bars: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Upsert a stream of closed bars into the bar table, micro-batch by micro-batch.

    A batch that is replayed after a failure replaces the same rows again, so the table stays exact.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            spark.read.parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            write_bars(batch, path)
        else:
            upsert_bars(spark, batch, path)

    return (
        bars.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def publish(messages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write topic and value rows as files by topic; the same rows fit a Kafka sink unchanged."""
    return (
        messages.writeStream.format("json")
        .partitionBy("topic")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
