"""The signal stream: gates, selection, settlement and statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.scoring import GRADES
from barloom.operators.series import frame, number_rows, prefix_scan, time_block

MODERATE = dict(GRADES)["MODERATE"]

# Score of the bar's place inside its window.
PLACE_SCORES = (70, 90, 85, 65, 40)


def block_reason(
    rn: Column, in_news: Column, grade: Column, confidence: Column, threshold: Column, streak: Column, lag_seconds: Column
) -> Column:
    """First gate that stops a signal, null where none does."""
    gates = (
        (rn < 149, "min_history"),
        (in_news, "news"),
        (grade == "SKIP", "low_score"),
        (confidence < threshold, "below_threshold"),
        (streak >= 5, "circuit_breaker"),
        (lag_seconds > 5, "too_late"),
    )
    return F.coalesce(*[F.when(condition, F.lit(name)) for condition, name in gates])


def candle_score(agreement: Column, net: Column, confidence: Column, direction: Column, place: Column) -> Column:
    """Rank of a signal inside its window from timeframe agreement, place, reaction and confidence."""
    scores = F.array(*[F.lit(float(s)) for s in PLACE_SCORES])
    aligned = F.when(direction == "GREEN", net).otherwise(-net)
    return agreement * 40 + F.coalesce(F.get(scores, place.cast("int")), F.lit(0.0)) * 0.20 + aligned * 0.25 + confidence * 15


def window_selection(signals: DataFrame, bars_per_window: int = 5, keep: int = 3, floor: float = MODERATE) -> DataFrame:
    """`accepted` on arrival and `retained` at the end, for the best `keep` signals of each window.

    An arriving signal gets in unless `keep` earlier eligible ones score at least as high; the kept set
    at the end is the top by score, earlier first on ties. A window of one series holds at most
    `bars_per_window` signals. Needs `score`.
    """
    slot = F.floor(F.unix_timestamp("bar_start") / (F.col("tf_sec") * bars_per_window))
    df = signals.withColumn("window_no", slot).withColumn("eligible", F.col("confidence") >= floor)
    series = Window.partitionBy("key", "tf_sec", "window_no")
    earlier = series.orderBy("bar_start").rowsBetween(Window.unboundedPreceding, -1)
    value = F.when(F.col("eligible"), F.col("score"))
    df = df.withColumn("_before", F.collect_list(value).over(earlier))
    better = F.size(F.filter("_before", lambda s: s >= F.col("score")))
    ranked = F.row_number().over(series.orderBy(F.col("eligible").desc(), F.col("score").desc(), "bar_start"))
    return df.withColumns(
        {
            "accepted": F.col("eligible") & (better < keep),
            "retained": F.col("eligible") & (ranked <= keep),
        }
    ).drop("_before")


def best_per_interval(signals: DataFrame, interval: str = "1 minute", floor: float = MODERATE) -> DataFrame:
    """The most confident signal of all keys per interval; the first to arrive wins a tie."""
    fields = [c for c in signals.columns if c not in ("confidence", "bar_start")]
    payload = F.struct("confidence", "bar_start", *fields)
    first = F.struct(F.col("confidence"), -F.col("seq"))
    return (
        signals.filter(F.col("confidence") >= floor)
        .groupBy(F.window("bar_start", interval).alias("_w"))
        .agg(F.max_by(payload, first).alias("_s"))
        .select(F.col("_w.start").alias("interval_start"), "_s.*")
    )


def settle(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """Outcome of each signal against the close of the very next bar; null while that bar is missing.

    Both closes come from `bars` by equality on the bar start, which needs no window over a series.
    """
    closes = bars.select("key", "tf_sec", F.unix_timestamp("bar_start").alias("_at"), F.col("close").alias("_close"))
    at = F.unix_timestamp("bar_start")
    timed = signals.withColumns({"_entry_at": at, "_exit_at": at + F.col("tf_sec")})
    entry = closes.select("key", "tf_sec", F.col("_at").alias("_entry_at"), F.col("_close").alias("entry_close"))
    leave = closes.select("key", "tf_sec", F.col("_at").alias("_exit_at"), F.col("_close").alias("exit_close"))
    joined = timed.join(entry, ["key", "tf_sec", "_entry_at"], "left").join(leave, ["key", "tf_sec", "_exit_at"], "left")
    move = F.signum(F.col("exit_close") - F.col("entry_close"))
    wanted = F.when(F.col("direction") == "GREEN", 1.0).otherwise(-1.0)
    outcome = F.when(move == 0, "EXPIRED").when(move == wanted, "WIN").when(move == -wanted, "LOSS")
    settled = F.when(outcome.isNotNull(), F.timestamp_seconds(F.col("_exit_at") + F.col("tf_sec")))
    return joined.withColumns({"outcome": outcome, "settled_at": settled}).drop("_entry_at", "_exit_at")


def expire(outcomes: DataFrame, as_of: Column, bars: int = 1) -> DataFrame:
    """Signals still open more than `bars` bars after their bar expire."""
    old = F.unix_timestamp("bar_start") < F.unix_timestamp(as_of) - F.col("tf_sec") * bars
    return outcomes.withColumn("outcome", F.when(F.col("outcome").isNull() & old, "EXPIRED").otherwise(F.col("outcome")))


def override(outcomes: DataFrame, manual: DataFrame) -> DataFrame:
    """Manual settlements (signal_id, outcome) replace computed ones."""
    chosen = manual.select("signal_id", F.col("outcome").alias("_manual"))
    merged = outcomes.join(chosen, "signal_id", "left")
    return merged.withColumn("outcome", F.coalesce("_manual", "outcome")).drop("_manual")


def _won() -> Column:
    return F.col("outcome") == "WIN"


def _decided() -> Column:
    return F.col("outcome").isin("WIN", "LOSS")


def statistics(outcomes: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    """Counts of signals, settled ones, wins, losses and open ones, and the win rate."""
    wins, decided = F.count_if(_won()), F.count_if(_decided())
    return outcomes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        decided.alias("settled"),
        wins.alias("wins"),
        F.count_if(F.col("outcome") == "LOSS").alias("losses"),
        F.count_if(F.col("outcome").isNull()).alias("pending"),
        F.coalesce(F.try_divide(wins, decided), F.lit(0.0)).alias("win_rate"),
    )


def win_rate(outcomes: DataFrame, keys: Sequence[str] = ("key",), min_settled: int = 5) -> DataFrame:
    """Share of wins among decided signals, for groups with enough of them."""
    return (
        outcomes.filter(_decided())
        .groupBy(*keys)
        .agg(F.avg(_won().cast("double")).alias("win_rate"), F.count(F.lit(1)).alias("settled"))
        .filter(F.col("settled") >= min_settled)
    )


def bad_hours(outcomes: DataFrame, min_settled: int = 3, limit: float = 0.35) -> DataFrame:
    return win_rate(outcomes, ("key", "utc_hour"), min_settled).filter(F.col("win_rate") <= limit)


def loss_streak(outcomes: DataFrame, block_seconds: int = 86400 * 30) -> DataFrame:
    """`streak`: losses since the last win, after each settled signal; expired ones leave it unchanged.

    Signals of several timeframes on the same bar start follow each other by timeframe. Losses so far minus losses at the last win. Both are running aggregates, so a series of any length
    is scanned block by block.
    """
    block = time_block("bar_start", block_seconds)
    keys, order = ["key"], [c for c in ("bar_start", "tf_sec") if c in outcomes.columns]
    lost = F.when(F.col("outcome") == "LOSS", 1).otherwise(0)
    counted = prefix_scan(outcomes, keys, block, order, {"_lost": ("sum", lost)})
    reset = F.when(_won(), F.col("_lost"))
    marked = prefix_scan(counted, keys, block, order, {"_at_win": ("max", reset)})
    return marked.withColumn("streak", (F.col("_lost") - F.coalesce("_at_win", F.lit(0))).cast("int")).drop("_lost", "_at_win")


def range_index(f, n: int = 15, min_rows: int = 20) -> Column:
    """Trend-strength estimate for the threshold bucket: last range against the mean of `n` ranges."""
    mean = f.over(F.avg(F.col("high") - F.col("low")), n)
    last = F.col("high") - F.col("low")
    estimate = F.least(F.lit(50.0), 14 + 30 * (last / mean - 1))
    return F.when((F.col("rn") >= min_rows - 1) & (mean > 0), estimate).otherwise(20.0)


def deduplicate_markers(markers: DataFrame, as_of: Column, ttl_seconds: int = 86400, order: str = "seq") -> DataFrame:
    """First marker by `order` per key, timeframe and bar, not older than the time to live."""
    fresh = F.unix_timestamp(as_of) - F.unix_timestamp("bar_start") <= ttl_seconds
    unique = ["key", "tf_sec", "bar_start"]
    first = F.min_by(F.struct(*[c for c in markers.columns if c not in unique]), order)
    return markers.filter(fresh).groupBy(*unique).agg(first.alias("_m")).select(*unique, "_m.*").select(*markers.columns)
