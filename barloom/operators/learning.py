"""Tables learned from outcomes: thresholds, voter weights, hour multipliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.sessions import threshold_session
from barloom.operators.joins import asof_join
from barloom.operators.series import frame, number_rows, prefix_scan, time_block

BASE, CEILING = 0.62, 0.85
STEP_UP, STEP_DOWN = 0.03, 0.01
TARGET, SLACK, MIN_SAMPLES = 0.62, 0.05, 8
CHUNK = 512
BUCKET = ("key", "session", "volatility")


def volatility_bucket(adx: Column) -> Column:
    return F.when(adx < 18, "CHOP").when(adx < 28, "TREND").otherwise("STRONG_TREND")


def threshold_buckets(outcomes: DataFrame) -> DataFrame:
    """Adds the session and volatility bucket of each outcome; needs `utc_hour` and `adx`."""
    return outcomes.withColumns(
        {"session": threshold_session(F.col("utc_hour")), "volatility": volatility_bucket(F.col("adx"))}
    )


def adaptive_threshold(outcomes: DataFrame, chunk: int = CHUNK, block_seconds: int = 86400 * 365) -> DataFrame:
    """The threshold after each decided outcome of its bucket.

    The running win rate gives a step per outcome: up below the target, down above it. A step with its
    limits, x -> min(hi, max(lo, x + d)), composes to a step of the same form, so chunks of a long
    history fold to one step each, the chunk steps fold again, and only then are the values inside a
    chunk filled in. No group larger than a chunk is ever held in one place.
    """
    keys = list(BUCKET)
    decided = outcomes.filter(F.col("outcome").isin("WIN", "LOSS"))
    won = F.when(F.col("outcome") == "WIN", 1).otherwise(0)
    counted = prefix_scan(
        decided,
        keys,
        time_block("bar_start", block_seconds),
        [c for c in ("bar_start", "tf_sec") if c in decided.columns],
        {"_n": ("count", F.lit(1)), "_wins": ("sum", won)},
    )
    rate = F.col("_wins") / F.col("_n")
    counted = counted.withColumns(
        {
            "_up": (F.col("_n") >= MIN_SAMPLES) & (rate < TARGET),
            "_down": (F.col("_n") >= MIN_SAMPLES) & (rate > TARGET + SLACK),
            "_chunk": F.floor((F.col("_n") - 1) / chunk),
        }
    )
    step = F.struct(
        F.when(F.col("_up"), STEP_UP).when(F.col("_down"), -STEP_DOWN).otherwise(0.0).alias("d"),
        F.when(F.col("_down"), BASE).otherwise(float("-inf")).alias("lo"),
        F.when(F.col("_up"), CEILING).otherwise(float("inf")).alias("hi"),
    )
    one = counted.withColumn("_step", step)
    chunks = one.groupBy(*keys, "_chunk").agg(
        _composed(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_step"))), lambda e: e["_step"])).alias("_step")
    )
    groups = chunks.withColumn("_group", F.floor(F.col("_chunk") / chunk))
    folded = groups.groupBy(*keys, "_group").agg(
        _composed(
            F.transform(F.array_sort(F.collect_list(F.struct("_chunk", "_step"))), lambda e: e["_step"])
        ).alias("_step")
    )
    # A bucket has one group per chunk^2 outcomes; their starts come first, then the chunks' starts.
    starts = _starts(folded, keys, "_group", [], F.lit(BASE), "_g0")
    inside = _starts(groups.join(starts, [*keys, "_group"]), [*keys, "_group"], "_chunk", [], F.col("_g0"), "_c0")
    entered = one.join(inside.select(*keys, "_chunk", "_c0"), [*keys, "_chunk"])
    so_far = Window.partitionBy(*keys, "_chunk").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    value = F.aggregate(F.collect_list("_step").over(so_far), F.col("_c0"), _apply)
    return entered.withColumns(
        {"threshold": value, "wins": F.col("_wins"), "losses": F.col("_n") - F.col("_wins")}
    ).drop("_n", "_wins", "_up", "_down", "_chunk", "_step", "_c0", "_group")


def _apply(x: Column, s: Column) -> Column:
    return F.least(s["hi"], F.greatest(s["lo"], x + s["d"]))


def _composed(steps: Column) -> Column:
    """One step equal to a list of steps applied in order."""
    nothing = F.struct(
        F.lit(0.0).alias("d"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi")
    )
    return F.aggregate(
        steps,
        nothing,
        lambda a, s: F.struct(
            (a["d"] + s["d"]).alias("d"), _apply(a["lo"], s).alias("lo"), _apply(a["hi"], s).alias("hi")
        ),
    )


def _starts(steps: DataFrame, keys: Sequence[str], order: str, extra: Sequence[str], start: Column, name: str) -> DataFrame:
    """The value each step starts from, when steps run in order from `start`."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.collect_list("_step").over(before), F.array())
    return steps.withColumn(name, F.aggregate(earlier, start, _apply)).drop("_step")


def current_thresholds(history: DataFrame) -> DataFrame:
    """Newest threshold and counts per bucket."""
    return history.groupBy(*BUCKET).agg(
        F.max_by(F.struct("threshold", "wins", "losses"), "bar_start").alias("_t")
    ).select(*BUCKET, "_t.*")


def threshold_asof(rows: DataFrame, history: DataFrame, block_seconds: int = 86400 * 30) -> DataFrame:
    """rows with the `threshold` of their own bucket as it stood when their bar closed; the base where none was learnt.

    rows: key, tf_sec, bar_start, utc_hour, adx. history: what `adaptive_threshold` returns, with `settled_at`. An outcome counts
    from its settlement on; one that settles as the bar closes is known to it. Several that settle at once count in order.
    """
    step = F.struct("settled_at", "wins", "losses", "threshold")
    newest = history.groupBy(*BUCKET, "settled_at").agg(F.max_by(step, F.col("wins") + F.col("losses")).alias("_s")).select(*BUCKET, "settled_at", "_s.threshold")
    ended = threshold_buckets(rows).withColumn("_end", F.timestamp_seconds(F.unix_timestamp("bar_start") + F.col("tf_sec")))
    known = asof_join(ended, newest, list(BUCKET), "_end", "settled_at", block_seconds, name="_known")
    return known.withColumn("threshold", F.coalesce("_known.threshold", F.lit(BASE))).drop("_known", "_end")


def credited(votes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Which voters were right: with the signal when it won, against it when it lost."""
    settled = outcomes.filter(F.col("outcome").isin("WIN", "LOSS")).select("key", "bar_start", "direction", "outcome")
    cast = votes.filter(F.col("vote") != "NEUTRAL")
    agreed = F.col("vote") == F.col("direction")
    return cast.join(settled, ["key", "bar_start"]).withColumn("correct", agreed == (F.col("outcome") == "WIN"))


def agent_performance(credits: DataFrame, window: int = 30, min_trades: int = 5, block_seconds: int = 86400 * 30) -> DataFrame:
    """Track record and weight of every voter after each settled signal, over its last `window` ones."""
    keys = ("key", "agent")
    right = F.when(F.col("correct"), 1).otherwise(0)
    counted = prefix_scan(
        credits,
        list(keys),
        time_block("bar_start", block_seconds),
        ["bar_start"],
        {"wins": ("sum", right), "total": ("count", F.lit(1))},
    ).withColumn("rn", F.col("total") - 1)
    f = frame(counted, back=window, keys=keys)
    rate = f.over(F.avg(F.col("correct").cast("double")), window)
    weight = F.greatest(F.lit(0.20), F.least(F.lit(2.0), 1 + (F.col("recent_rate") - 0.5) * 4))
    return (
        f.with_columns({"recent_rate": rate})
        .with_columns({"weight": F.when(F.col("total") < min_trades, 1.0).otherwise(weight)})
        .core("key", "agent", "bar_start", "wins", (F.col("total") - F.col("wins")).alias("losses"), "total", "recent_rate", "weight")
    )


def current_weights(performance: DataFrame) -> DataFrame:
    """Newest record per key and voter."""
    fields = F.struct("wins", "losses", "total", "recent_rate", "weight")
    return performance.groupBy("key", "agent").agg(F.max_by(fields, "bar_start").alias("_p")).select("key", "agent", "_p.*")


def outcome_log(records: DataFrame) -> DataFrame:
    """First record per signal id, in order of arrival (`seq`)."""
    payload = F.struct(*[c for c in records.columns if c != "signal_id"])
    return records.groupBy("signal_id").agg(F.min_by(payload, "seq").alias("_r")).select("signal_id", "_r.*")


def _recent(outcomes: DataFrame, as_of: Column, days: int) -> DataFrame:
    since = F.unix_timestamp("settled_at") >= F.unix_timestamp(as_of) - days * 86400
    return outcomes.filter(F.col("outcome").isin("WIN", "LOSS") & since)


def diagnose_hours(
    outcomes: DataFrame, as_of: Column, days: int = 7, min_settled: int = 8, limit: float = 0.42
) -> DataFrame:
    """Key and hour pairs that lost too often lately."""
    return (
        _recent(outcomes, as_of, days)
        .groupBy("key", "utc_hour")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("outcome") == "WIN").alias("wins"),
            F.avg((F.col("outcome") == "WIN").cast("double")).alias("win_rate"),
        )
        .filter((F.col("total") >= min_settled) & (F.col("win_rate") < limit))
    )


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.90, "90-99").when(confidence >= 0.80, "80-89").when(confidence >= 0.70, "70-79").otherwise("below70")


def diagnose_bands(
    outcomes: DataFrame, as_of: Column, days: int = 14, min_settled: int = 8, limit: float = 0.50
) -> DataFrame:
    """Confidence bands whose signals lost more often than they won."""
    return (
        _recent(outcomes, as_of, days)
        .groupBy("key", confidence_band(F.col("confidence")).alias("band"))
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.avg((F.col("outcome") == "WIN").cast("double")).alias("win_rate"),
        )
        .filter((F.col("total") >= min_settled) & (F.col("win_rate") < limit))
    )


def updated_multipliers(current: DataFrame, hours: DataFrame, bands: DataFrame, floor: float = 0.70) -> DataFrame:
    """Hour multipliers after one diagnosis: bad hours step down, then each bad band scales its key down.

    `current`: key, utc_hour, multiplier. Hours without an entry start at 1.
    """
    stepped = current.join(hours.select("key", "utc_hour", F.lit(True).alias("_bad")), ["key", "utc_hour"], "full")
    base = F.coalesce("multiplier", F.lit(1.0))
    bad = F.coalesce("_bad", F.lit(False))
    stepped = stepped.select(
        "key", "utc_hour", F.when(bad, F.greatest(F.lit(floor), base - 0.04)).otherwise(base).alias("_m")
    )
    counts = bands.groupBy("key").agg(F.count(F.lit(1)).alias("_bands"))
    scaled = F.col("_m") * F.pow(F.lit(0.97), F.coalesce("_bands", F.lit(0)))
    return stepped.join(counts, "key", "left").select(
        "key", "utc_hour", F.when(F.col("_bands") > 0, F.greatest(F.lit(floor), scaled)).otherwise(F.col("_m")).alias("multiplier")
    )


def problem_log(hours: DataFrame, bands: DataFrame, as_of: Column) -> DataFrame:
    """One log entry per finding."""
    percent = F.format_number(F.col("win_rate") * 100 + 1e-9, 1)
    bad = hours.select(
        as_of.alias("logged_at"),
        F.lit("BAD_HOUR").alias("kind"),
        "key",
        F.col("utc_hour").cast("int").alias("utc_hour"),
        F.concat_ws("", "key", F.lit(" UTC-"), F.lpad(F.col("utc_hour").cast("string"), 2, "0"), F.lit("h: "), F.col("total"), F.lit(" signals, "), percent, F.lit("% WR")).alias("detail"),
        "win_rate",
    )
    over = bands.select(
        as_of.alias("logged_at"),
        F.lit("OVERCONFIDENCE").alias("kind"),
        "key",
        F.lit(-1).alias("utc_hour"),
        F.concat_ws("", "key", F.lit(" confidence "), "band", F.lit("%: "), percent, F.lit("% WR on "), F.col("total"), F.lit(" signals")).alias("detail"),
        "win_rate",
    )
    return bad.unionByName(over)


def newest_findings(log: DataFrame, n: int = 20) -> DataFrame:
    """The newest n entries of the log, those of one diagnosis by kind, key, hour and detail."""
    return log.orderBy(F.col("logged_at").desc(), "kind", "key", "utc_hour", "detail").limit(n)
