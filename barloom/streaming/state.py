"""Joins, selection and audits on streams that keep a bounded state per key."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.operators.bars import bucket_start
from barloom.operators.scoring import GRADES

_FORMAT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


# ---------------------------------------------------------------- as-of join


def asof_stream(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    lateness: str = "10 minutes",
    max_age_seconds: int | None = None,
    name: str = "match",
    tie: str | None = None,
) -> DataFrame:
    """Each left row with the newest right row at or before its time, as the struct column `name`; both sides are streams.

    A left row waits until the watermark has passed its time, when every right row that could match is there, so the order of
    arrival within the lateness does not matter. Of the right side a key keeps what is newer than the watermark and the newest
    one before it, until that is older than `max_age_seconds` (no match is). `tie` orders right rows of the same time. Rows
    behind the watermark are dropped; both sides share one watermark, their newest time less the lateness. Append mode.
    """
    keys = list(keys)
    rest = [c for c in left.columns if c not in keys]
    values = [c for c in right.columns if c not in keys]
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    shared = [F.col(c) for c in keys]
    stacked = left.select(*shared, F.col(left_ts).cast("timestamp").alias("ts"), micros(left_ts).alias("at"), F.lit(0).cast("bigint").alias("turn"), F.lit(0).alias("side"), F.to_json(F.struct(*rest), _FORMAT).alias("row")).unionByName(
        right.select(*shared, F.col(right_ts).cast("timestamp").alias("ts"), micros(right_ts).alias("at"), (F.col(tie).cast("bigint") if tie else F.lit(0).cast("bigint")).alias("turn"), F.lit(1).alias("side"), F.to_json(F.struct(*values), _FORMAT).alias("row"))
    )
    kinds = dict(left.dtypes)
    out = ", ".join(f"{c} {kinds[c]}" for c in keys) + ", left_row string, right_row string"
    held = "l_at array<bigint>, l_row array<string>, r_at array<bigint>, r_turn array<bigint>, r_row array<string>"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        l_at, l_row, r_at, r_turn, r_row = (list(x) for x in (state.get if state.exists else ([], [], [], [], [])))
        for batch in batches:
            own, other = batch[batch["side"] == 0], batch[batch["side"] == 1]
            l_at, l_row = l_at + own["at"].tolist(), l_row + own["row"].tolist()
            r_at, r_turn, r_row = r_at + other["at"].tolist(), r_turn + other["turn"].tolist(), r_row + other["row"].tolist()
        now = state.getCurrentWatermarkMs() * 1000
        order = sorted(range(len(r_at)), key=lambda i: (r_at[i], r_turn[i], r_row[i]))
        times, rows = np.array([r_at[i] for i in order], np.int64), [r_row[i] for i in order]
        asked = np.array(l_at, np.int64)
        ready = asked <= now
        if ready.any():
            found = np.searchsorted(times, asked[ready], "right") - 1
            matches = [None if i < 0 or (max_age_seconds is not None and t - times[i] > max_age_seconds * 1_000_000) else rows[i] for i, t in zip(found.tolist(), asked[ready].tolist(), strict=True)]
            yield pd.DataFrame({c: v for c, v in zip(keys, key, strict=True)} | {"left_row": [r for r, d in zip(l_row, ready, strict=True) if d], "right_row": matches})
        # Of the right rows that the watermark has passed only the newest can match what comes.
        first = max(int(np.searchsorted(times, now, "right")) - 1, 0)
        if max_age_seconds is not None and len(times) and times[first] < now - max_age_seconds * 1_000_000:
            first += 1
        kept = order[first:]
        waiting = [i for i, d in enumerate(ready.tolist()) if not d]
        state.update(([l_at[i] for i in waiting], [l_row[i] for i in waiting], [r_at[i] for i in kept], [r_turn[i] for i in kept], [r_row[i] for i in kept]))
        due = min((l_at[i] for i in waiting), default=None)
        if due is None and kept and max_age_seconds is not None:
            due = r_at[kept[0]] + max_age_seconds * 1_000_000
        if due is not None:
            state.setTimeoutTimestamp(max(-(-due // 1000), state.getCurrentWatermarkMs() + 1))
        elif not kept:
            state.remove()

    joined = stacked.withWatermark("ts", lateness).groupBy(*keys).applyInPandasWithState(run, out, held, "append", GroupStateTimeout.EventTimeTimeout)
    one, two = (f"struct<{', '.join(f'`{c}`: {kind}' for c, kind in df.select(*names).dtypes)}>" for df, names in ((left, rest), (right, values)))
    parsed = joined.withColumns({"_l": F.from_json("left_row", one, _FORMAT), name: F.from_json("right_row", two, _FORMAT)})
    return parsed.select(*keys, *[F.col(f"_l.`{c}`").alias(c) for c in rest], name)


# ---------------------------------------------------------------- top of a window


def window_top(signals: DataFrame, tf_sec: int, bars_per_window: int = 5, keep: int = 3, floor: float = dict(GRADES)["MODERATE"], lateness: str = "10 minutes") -> DataFrame:
    """Changes of the best `keep` signals of each window: action `add` on acceptance, `remove` for the one that it replaces.

    signals: key, bar_start, signal_id, confidence, score. A signal gets in if its confidence reaches the floor and there is a free
    place, or its score beats the worst of the window's, which is then taken back (of equal ones the latest). `no` counts a
    window's changes. Replaying them gives what is retained; all `add` rows are what was accepted. Signals of one batch count
    in order of time. A window's state goes when the watermark has passed its end. Append mode.
    """
    span = tf_sec * bars_per_window
    slot = F.floor(F.unix_timestamp("bar_start") / span)
    out = "key string, window_no bigint, no int, action string, bar_start timestamp, signal_id string, score double"
    held = "at array<bigint>, id array<string>, score array<double>, no int"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at, ids, scores, no = state.get if state.exists else ([], [], [], 0)
        best = list(zip(scores, at, ids, strict=True))
        rows = []
        whole = pd.concat(list(batches)).sort_values(["at", "signal_id"])
        for when, signal, confidence, score in whole[["at", "signal_id", "confidence", "score"]].itertuples(index=False):  # a window's few signals
            if confidence < floor:
                continue
            if len(best) >= keep:
                worst = min(best, key=lambda s: (s[0], -s[1]))
                if score <= worst[0]:
                    continue
                best.remove(worst)
                rows.append((*key, no := no + 1, "remove", worst[1], worst[2], worst[0]))
            best.append((float(score), int(when), signal))
            rows.append((*key, no := no + 1, "add", int(when), signal, float(score)))
        state.update(([s[1] for s in best], [s[2] for s in best], [s[0] for s in best], no))
        state.setTimeoutTimestamp(max((int(key[1]) + 1) * span * 1000, state.getCurrentWatermarkMs() + 1))
        if rows:
            made = pd.DataFrame(rows, columns=["key", "window_no", "no", "action", "bar_start", "signal_id", "score"])
            made["bar_start"] = pd.to_datetime(made["bar_start"], unit="s")
            yield made

    rows = signals.withWatermark("bar_start", lateness).select("key", slot.alias("window_no"), "bar_start", F.unix_timestamp("bar_start").alias("at"), "signal_id", "confidence", "score")
    return rows.groupBy("key", "window_no").applyInPandasWithState(run, out, held, "append", GroupStateTimeout.EventTimeTimeout)


def retained(changes: DataFrame) -> DataFrame:
    """What the windows hold after all changes: signals whose last change is an `add`."""
    last = changes.groupBy("key", "window_no", "signal_id").agg(F.max_by(F.struct("action", "bar_start", "score"), "no").alias("_c"))
    return last.filter("_c.action = 'add'").select("key", "window_no", "signal_id", "_c.bar_start", "_c.score")


# ---------------------------------------------------------------- audit of ticks


def audited_ticks(ticks: DataFrame, tf_sec: int = 60, observe: str | None = "ticks") -> DataFrame:
    """ticks with `dropped` (older than one before it by arrival) and `late` (its bar has closed), on a stream.

    The state of a key is its newest time. Ticks come in order of `seq` from batch to batch; inside one they are put in order. With
    `observe`, each progress report of the query carries the counts `received` and `dropped` under that name.
    """
    kinds = dict(ticks.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ticks.columns) + ", dropped boolean, _newest timestamp"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("seq")
        times = rows["ts"].to_numpy("datetime64[us]").astype(np.int64)
        low = np.iinfo(np.int64).min
        before = np.maximum.accumulate(np.concatenate([[low if newest is None else newest], times]))
        state.update((int(before[-1]),))
        known = before[:-1] > low
        seen = pd.Series(np.where(known, before[:-1], 0).astype("datetime64[us]")).where(known)
        yield rows.assign(dropped=(times < before[:-1]) & known, _newest=seen.to_numpy())

    flagged = ticks.groupBy("key").applyInPandasWithState(run, schema, "newest bigint", "append", GroupStateTimeout.NoTimeout)
    late = F.coalesce(bucket_start(F.col("ts"), tf_sec) < bucket_start(F.col("_newest"), tf_sec), F.lit(False))
    out = flagged.withColumn("late", late).drop("_newest")
    return out.observe(observe, F.count_if(~F.col("dropped")).alias("received"), F.count_if("dropped").alias("dropped")) if observe else out
