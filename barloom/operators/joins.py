"""Joins on time and on ranges, without theta joins over large inputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.series import prefix_scan, time_block


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    block_seconds: int,
    name: str = "match",
    split: dict[str, Column] | None = None,
    tie: str | None = None,
    allow_exact: bool = True,
) -> DataFrame:
    """Each left row with the newest right row at or before its time, as the struct column `name`.

    With `split`, a dict of column name to condition on the right table, the newest right row of
    each condition comes as its own column; any number of them costs one scan. Both tables are
    stacked and scanned together: one shuffle of the rows, on (keys, time block). `tie` orders right
    rows of the same time.
    """
    keys = list(keys)
    first, second = (0, 1) if allow_exact else (1, 0)
    payload = [c for c in left.columns if c not in keys]
    values = F.struct(*[c for c in right.columns if c not in keys])
    picks = {name: values} if split is None else {n: F.when(test, values) for n, test in split.items()}
    asked = left.select(
        *keys,
        F.col(left_ts).alias("_t"),
        F.lit(second).alias("_side"),
        F.lit(None).cast("bigint").alias("_tie"),
        F.struct(*payload).alias("_left"),
    )
    offered = right.select(
        *keys,
        F.col(right_ts).alias("_t"),
        F.lit(first).alias("_side"),
        (F.col(tie) if tie else F.lit(None)).cast("bigint").alias("_tie"),
        *[value.alias(n) for n, value in picks.items()],
    )
    scanned = prefix_scan(
        asked.unionByName(offered, allowMissingColumns=True),
        keys,
        time_block("_t", block_seconds),
        ["_t", "_side", "_tie"],
        {n: ("last", F.col(n)) for n in picks},
    )
    return scanned.filter(F.col("_left").isNotNull()).select(*keys, "_left.*", *picks)


def near_events(
    left: DataFrame,
    events: DataFrame,
    on: Sequence[str],
    left_ts: str,
    event_ts: str,
    seconds: int,
    how: str = "left_semi",
) -> DataFrame:
    """Rows with (`left_semi`) or without (`left_anti`) an event within `seconds` of their time.

    Time is cut into cells as wide as the reach; an event is entered in its own and both
    neighbouring cells, which makes the join an equi-join with a residual test. Events of the same
    second are merged first, so a cell holds at most one event per second whatever the input.
    """
    on = list(on)
    second = F.unix_timestamp(event_ts)
    cells = (
        events.select(*on, second.alias("_event"))
        .distinct()
        .withColumn("_cell", F.explode(F.array(*[F.floor(F.col("_event") / seconds) + d for d in (-1, 0, 1)])))
    )
    placed = left.withColumns({"_at": F.unix_timestamp(left_ts), "_cell": F.floor(F.unix_timestamp(left_ts) / seconds)})
    same = [placed[c] == cells[c] for c in (*on, "_cell")]
    close = F.abs(placed["_at"] - cells["_event"]) <= seconds
    condition = close
    for equal in same:
        condition = condition & equal
    return placed.join(cells, condition, how).drop("_at", "_cell")



def near_news(bars: DataFrame, news: DataFrame, currencies: Column, seconds: int = 900, how: str = "left_semi") -> DataFrame:
    """Bars with (`left_semi`) or without (`left_anti`) news (currency, ts) that moves them within `seconds`.

    currencies: the array that moves a bar's symbol; null: all news does, empty: none does. Equality on the currency, or on a
    mark that every entry bears too, keeps it an equi-join.
    """
    on = ["key", "tf_sec", "bar_start"]
    asked = bars.select(*on, F.explode(F.coalesce(currencies, F.array(F.lit("*")))).alias("currency"))
    marked = news.select(F.explode(F.array(F.col("currency"), F.lit("*"))).alias("currency"), "ts")
    hit = near_events(asked, marked, ["currency"], "bar_start", "ts", seconds, "left_semi").select(*on).distinct()
    return bars.join(hit, on, how)

def trailing_range(
    left: DataFrame,
    samples: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    sample_ts: str,
    seconds: int,
    aggregates: dict[str, Column],
    block_seconds: int,
) -> DataFrame:
    """Aggregates over the samples of the last `seconds` before each left row (both ends included).

    Samples are copied to the next time block where a range may reach back across the border.
    """
    keys = list(keys)
    payload = [c for c in left.columns if c not in keys]
    values = [c for c in samples.columns if c not in keys]
    at = F.unix_timestamp("_t")
    own = F.floor(at / block_seconds)
    bars = left.select(*keys, F.col(left_ts).alias("_t"), F.struct(*payload).alias("_left")).withColumn("_blk", own)
    reach = F.explode(F.array_distinct(F.array(own, F.floor((at + seconds) / block_seconds))))
    copies = samples.select(*keys, F.col(sample_ts).alias("_t"), *[F.col(v) for v in values]).withColumn("_blk", reach)
    stacked = bars.unionByName(copies, allowMissingColumns=True).withColumn("_sec", at)
    span = Window.partitionBy(*keys, "_blk").orderBy("_sec").rangeBetween(-seconds, 0)
    return (
        stacked.withColumns({name: value.over(span) for name, value in aggregates.items()})
        .filter(F.col("_left").isNotNull())
        .select(*keys, "_left.*", *aggregates)
    )
