"""Sentiment from price action, from mood samples and from order sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.joins import asof_join
from barloom.operators.series import Framed, Layers, frame, prefix_scan, time_block
from barloom.session import cut_lineage

TINY = 1e-10
SYNTHETIC = (
    "synth_buyer_ratio synth_net_sentiment synth_exhaustion synth_seller_wick synth_buyer_wick synth_effort_imb"
).split()


def synthetic_sentiment(f: Framed, lookback: int = 30, min_rows: int = 10) -> Layers:
    """Buyer and seller pressure, exhaustion and RSI divergence of the last bars.

    Needs `_gain` and `_loss` (the `moves` indicator family) in the frame.
    """
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    up, span = c > o, F.greatest(h - l, F.lit(TINY))
    gain, loss = f.mean("_gain", 14), f.mean("_loss", 14)
    yield {
        "_sbody": F.abs(c - o),
        "_signed_body": F.when(up, F.abs(c - o)).otherwise(-F.abs(c - o)),
        "_uw": (h - F.greatest(o, c)) / span,
        "_lw": (F.least(o, c) - l) / span,
        "_up_range": F.when(up, span),
        "_dn_range": F.when(~up, span),
        "_srsi": 100 - 100 / (1 + F.when(loss > 0, gain / (loss + TINY)).otherwise(0.0)),
    }
    weights = F.array(*[F.lit(0.5 + 0.5 * i / 9) for i in range(10)])

    def weighted(name: str) -> Column:
        terms = F.zip_with(F.collect_list(name).over(f.rows(-9)), weights, lambda x, k: x * k)
        return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 7.5

    yield {
        "_seller": weighted("_uw"),
        "_buyer": weighted("_lw"),
        "_up_mean": f.over(F.avg("_up_range"), lookback),
        "_dn_mean": f.over(F.avg("_dn_range"), lookback),
        "_net_body": f.over(F.sum("_signed_body"), lookback),
        "_all_body": f.over(F.sum("_sbody"), lookback),
        "_body_then": F.avg("_sbody").over(f.rows(-5, -3)),
        "_body_now": F.avg("_sbody").over(f.rows(-2)),
        "_p14": F.collect_list("close").over(f.rows(-13)),
        "_r14": F.collect_list("_srsi").over(f.rows(-13)),
    }
    both = F.col("_dn_mean") + F.col("_up_mean")
    yield {
        "_effort": F.when(both > TINY, (F.col("_dn_mean") - F.col("_up_mean")) / both).otherwise(0.0),
        "_direction": F.col("_net_body") / (F.col("_all_body") + TINY),
        "_exhaustion": F.when(
            F.col("_body_then") > TINY,
            F.greatest(
                F.lit(0.0), F.least((F.col("_body_then") - F.col("_body_now")) / F.col("_body_then"), F.lit(1.0))
            ),
        ).otherwise(0.0),
        "_lo_at": F.array_position("_p14", F.array_min("_p14")).cast("int"),
        "_hi_at": F.array_position("_p14", F.array_max("_p14")).cast("int"),
    }

    def before(values: str, at: str, pick) -> Column:
        return pick(F.slice(values, F.lit(1), F.greatest(F.col(at) - 1, F.lit(0))))

    def at(values: str, position: str) -> Column:
        return F.try_element_at(F.col(values), F.col(position))

    bull = (
        (F.col("_lo_at") > 2)
        & (at("_p14", "_lo_at") < before("_p14", "_lo_at", F.array_min) * 0.998)
        & (at("_r14", "_lo_at") > before("_r14", "_lo_at", F.array_min))
    )
    bear = (
        (F.col("_hi_at") > 2)
        & (at("_p14", "_hi_at") > before("_p14", "_hi_at", F.array_max) * 1.002)
        & (at("_r14", "_hi_at") < before("_r14", "_hi_at", F.array_max))
    )
    enough = F.col("rn") >= 28
    net = -F.col("_seller") * 0.30 + F.col("_buyer") * 0.30 - F.col("_effort") * 0.20 + F.col("_direction") * 0.20
    yield {
        "synth_divergence": F.when(enough & bull, "BULL").when(enough & bear, "BEAR").otherwise("NONE"),
        "_net": F.greatest(F.lit(-1.0), F.least(net, F.lit(1.0))),
    }
    n, e = F.col("_net"), F.col("_exhaustion")
    bias = (
        F.when((n > 0.15) & (e <= 0.4), "GREEN")
        .when((n < -0.15) & (e <= 0.4), "RED")
        .when((e > 0.5) & (n > 0.10), "RED")
        .when((e > 0.5) & (n < -0.10), "GREEN")
        .when(F.col("synth_divergence") == "BULL", "GREEN")
        .when(F.col("synth_divergence") == "BEAR", "RED")
        .otherwise("NEUTRAL")
    )
    known = F.col("rn") >= min_rows - 1
    numbers = {
        "synth_buyer_ratio": (0.5 + n / 2, 0.5),
        "synth_net_sentiment": (n, 0.0),
        "synth_exhaustion": (e, 0.0),
        "synth_seller_wick": (F.col("_seller"), 0.0),
        "synth_buyer_wick": (F.col("_buyer"), 0.0),
        "synth_effort_imb": (F.col("_effort"), 0.0),
    }
    yield {
        **{name: F.when(known, F.round(v, 3)).otherwise(default) for name, (v, default) in numbers.items()},
        "synth_signal_bias": F.when(known, bias).otherwise("NEUTRAL"),
    }


def synthetic_multiplier(direction: Column, digits: int = 3) -> dict[str, Column]:
    """Confidence multiplier and alignment of a direction with the synthetic sentiment columns.

    The multiplier is rounded with a tiny nudge, so that exact ties go up.
    """
    bias, strength = F.col("synth_signal_bias"), F.least(F.abs("synth_net_sentiment"), F.lit(0.5)) * 0.30
    aligned, tired = bias == direction, F.col("synth_exhaustion") > 0.5
    bonus = F.when(F.col("synth_divergence").isin("BULL", "BEAR"), 0.03).otherwise(0.0)
    plain = 1.0 + strength + bonus
    mult = (
        F.when(bias == "NEUTRAL", 1.0)
        .when(aligned & tired, plain * 0.92)
        .when(aligned, plain)
        .otherwise(1.0 - strength)
    )
    label = (
        F.when(bias == "NEUTRAL", "NEUTRAL")
        .when(aligned & tired, "ALIGNED_BUT_EXHAUSTED")
        .when(aligned, "ALIGNED")
        .otherwise("OPPOSED")
    )
    return {"synth_mult": F.round(mult + F.lit(1e-11), digits), "synth_align": label}


def json_number(raw: Column, *names: str) -> Column:
    """First present of several JSON fields, as a number; null where it is none."""
    return F.coalesce(*[F.get_json_object(raw, f"$.{name}") for name in names]).try_cast("double")


def parse_mood(raw: Column) -> Column:
    """Buyer ratio of a mood message: first known field, per cent turned into a ratio, clipped to 0..1."""
    value = json_number(raw, "value", "up", "mood")
    return F.greatest(F.lit(0.0), F.least(F.when(value > 1, value / 100).otherwise(value), F.lit(1.0)))


def mood_asof(
    bars: DataFrame,
    samples: DataFrame,
    at: str,
    max_age: int = 120,
    trail: int = 300,
    history: int = 60,
    min_samples: int = 5,
    block_seconds: int = 86400 * 7,
) -> DataFrame:
    """Mood at each bar: last value, freshness, crowd extreme and change over the trailing range.

    `samples` has key, ts, seq, ratio; `at` is the time column of `bars` to look back from. The trailing range is by whole
    seconds, both ends included. Its first sample and its last each come from one scan, and their running counts give how many
    lie between, so the work does not grow with the samples that a range holds.
    """
    counts = {"rn": ("count", F.lit(1)), "known": ("count", F.col("ratio"))}
    # Both passes of the scan read it, and messages are slow to parse.
    parsed = cut_lineage(samples.select("key", "ts", "seq", "ratio"))
    numbered = prefix_scan(parsed, ["key"], time_block("ts", block_seconds), ["ts", "seq"], counts).withColumn("rn", F.col("rn") - 1)
    f = frame(numbered, back=history, keys=["key"])
    # Read by three scans.
    oldest = cut_lineage(f.with_columns({"kept_first": f.prev("ratio", history - 1)}).core("key", "ts", "seq", "ratio", "rn", "known", "kept_first"))
    matched = asof_join(
        bars, oldest.drop("known").withColumn("mood_ts", F.col("ts")), ["key"], at, "ts", block_seconds, name="mood", tie="seq"
    )
    second = F.unix_timestamp(at)
    until = asof_join(
        matched.withColumn("_until", F.timestamp_seconds(second + 1)),
        oldest.select("key", "ts", "seq", "known"), ["key"], "_until", "ts", block_seconds, name="_last", tie="seq", allow_exact=False,
    )
    # The first sample at or after a time is the newest one at or before it when time runs backwards.
    backwards = oldest.filter(F.col("ratio").isNotNull()).select(
        "key", F.timestamp_micros(-F.unix_micros("ts")).alias("_back"), (-F.col("seq")).alias("_seq"), F.unix_timestamp("ts").alias("second"), "ratio", "known"
    )
    ranged = asof_join(
        until.withColumn("_since", F.timestamp_seconds(F.lit(trail) - second)),
        backwards, ["key"], "_since", "_back", block_seconds, name="_first", tie="_seq",
    )
    n = F.when(F.col("_first.second") <= second, F.col("_last.known") - F.col("_first.known") + 1).otherwise(0)
    ranged = ranged.withColumns({"_n": n, "_first": F.col("_first.ratio")}).drop("_until", "_since", "_last")
    value = F.coalesce(F.col("mood.ratio"), F.lit(0.5))
    age = F.unix_timestamp(at) - F.unix_timestamp("mood.mood_ts")
    start = F.when(F.col("_n") > history, F.col("mood.kept_first")).otherwise(F.col("_first"))
    enough = (F.col("mood.rn") >= min_samples - 1) & (F.col("_n") >= 2)
    return ranged.withColumns(
        {
            "buyer_ratio": value,
            "is_fresh": F.coalesce(age <= max_age, F.lit(False)),
            "extreme": F.when(value >= 0.75, "EUPHORIC_TOP").when(value <= 0.25, "DESPAIR_BOTTOM").otherwise("NEUTRAL"),
            "velocity": F.when(enough, F.col("mood.ratio") - start).otherwise(0.0),
        }
    ).drop("mood", "_n", "_first")


def crowd_multiplier(direction: Column) -> dict[str, Column]:
    """Contrarian multiplier and label of a direction, from the mood columns."""
    top, bottom = F.col("extreme") == "EUPHORIC_TOP", F.col("extreme") == "DESPAIR_BOTTOM"
    green, red = direction == "GREEN", direction == "RED"
    fade = (top & red) | (bottom & green)
    joining = (F.col("velocity") > 0.10) & red
    leaving = (F.col("velocity") < -0.10) & green
    agree = ((F.col("buyer_ratio") > 0.55) & green) | ((F.col("buyer_ratio") < 0.45) & red)
    ladder = (
        (~F.col("is_fresh"), 1.0, "STALE"),
        (fade, 1.15, "CONTRARIAN_EDGE"),
        (top | bottom, 0.82, "TRAPPING_CROWD"),
        (joining, 1.05, "BUYER_TRAP_SETUP"),
        (leaving, 1.05, "SELLER_CAPITULATION"),
        (agree, 0.97, "WITH_CROWD"),
    )
    mult, label = F.lit(1.0), F.lit("NEUTRAL")
    for condition, value, name in reversed(ladder):
        mult = F.when(condition, F.lit(value)).otherwise(mult)
        label = F.when(condition, F.lit(name)).otherwise(label)
    return {"sent_mult": mult, "sent_align": label}


def parse_order_sizes(raw: Column) -> dict[str, Column]:
    """Buy and sell size of an order-size message, whichever field names it uses."""
    return {
        "buy": F.coalesce(json_number(raw, "buy", "up_volume", "up"), F.lit(0.0)),
        "sell": F.coalesce(json_number(raw, "sell", "down_volume", "down"), F.lit(0.0)),
    }


def order_flow_asof(
    bars: DataFrame, sizes: DataFrame, at: str, max_age: int = 60, block_seconds: int = 86400 * 7
) -> DataFrame:
    """Order-flow totals and imbalance at each bar; stale or empty messages read as balanced."""
    # Both passes of the join read it, and messages are slow to parse.
    parsed = cut_lineage(sizes.withColumn("flow_ts", F.col("ts")))
    matched = asof_join(bars, parsed, ["key"], at, "ts", block_seconds, name="flow", tie="seq")
    total = F.col("flow.buy") + F.col("flow.sell")
    fresh = (F.unix_timestamp(at) - F.unix_timestamp("flow.flow_ts") <= max_age) & (total > 0)
    return matched.withColumns(
        {
            "os_total": F.when(fresh, F.round(total, 2)).otherwise(0.0),
            "os_buy_pct": F.when(fresh, F.round(F.col("flow.buy") / total, 3)).otherwise(0.5),
            "os_imbalance": F.when(fresh, F.round((F.col("flow.buy") - F.col("flow.sell")) / total, 3)).otherwise(0.0),
        }
    ).drop("flow")
