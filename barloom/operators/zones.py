"""Rejection zones: price levels that bars were repeatedly turned away from."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.joins import asof_join
from barloom.operators.series import bar_block, frame, number_rows

TINY = 1e-10
MEMORY = 10
MAX_AGE = 3 * 86400
CAPACITY = 200
ZONE_KEYS = ("key", "tf_sec", "level_no")

# Pip sizes by symbol; all other symbols use the default.
PIP_SIZES = {"XAUUSD": 0.01, "USDJPY": 0.01, "EURJPY": 0.01, "GBPJPY": 0.01}
DEFAULT_PIP = 0.0001


def pip_size(key: Column) -> Column:
    size = F.lit(DEFAULT_PIP)
    for symbol, pip in PIP_SIZES.items():
        size = F.when(key == symbol, F.lit(pip)).otherwise(size)
    return size


def touches(bars: DataFrame, zone_size: Column) -> DataFrame:
    """Rejections: a wick of at least a quarter of the range and a body below 0.6 of it, per side.

    The level is the wick's end on a grid of `zone_size`, rounded half to even.
    """
    numbered = number_rows(bars)
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    span = F.greatest(h - l, F.lit(TINY))
    small = F.abs(c - o) / span < 0.6
    upper, lower = (h - F.greatest(o, c)) / span, (F.least(o, c) - l) / span
    volume = F.coalesce(F.col("volume"), F.lit(1.0)) if "volume" in bars.columns else F.lit(1.0)

    def touch(side: str, order: int, wick: Column, price: Column) -> Column:
        entry = F.struct(
            F.lit(side).alias("side"), F.lit(order).alias("turn"), wick.alias("wick"), price.alias("price")
        )
        return F.when(small & (wick >= 0.25), entry)

    both = F.array_compact(F.array(touch("SELLER", 0, upper, h), touch("BUYER", 1, lower, l)))
    return (
        numbered.filter(F.col("rn") >= 2)
        .select("key", "tf_sec", "bar_start", volume.alias("volume"), zone_size.alias("_zone"), F.explode(both).alias("_t"))
        .select("key", "tf_sec", "bar_start", "volume", "_t.*", "_zone")
        .withColumn("level_no", F.bround(F.col("price") / F.col("_zone"), 0).cast("bigint"))
        .withColumn("level", F.round(F.col("level_no") * F.col("_zone"), 8))
        .drop("_zone")
    )


def zone_states(touched: DataFrame, max_age: int = MAX_AGE, memory: int = MEMORY, **blocks) -> DataFrame:
    """The zone after each touch: its last ten touches since the level was last idle for `max_age`."""
    numbered = number_rows(touched, ZONE_KEYS, ("bar_start", "turn"), bar_block())
    f = frame(numbered, back=memory + 1, keys=ZONE_KEYS, **blocks)
    idle = F.unix_timestamp("bar_start") - F.unix_timestamp(f.prev("bar_start"))
    f = f.with_columns({"_fresh": F.coalesce(idle > max_age, F.lit(True))})
    entry = F.struct(F.col("_fresh").alias("fresh"), F.col("wick"), F.col("side"))
    f = f.with_columns({"_all": F.collect_list(entry).over(f.rows(-(memory - 1)))})
    starts = F.transform("_all", lambda t, i: F.when(t["fresh"], i + 1).otherwise(F.lit(1)))
    f = f.with_columns({"_seen": F.slice("_all", F.array_max(starts), F.lit(memory))})
    wicks = F.transform("_seen", lambda t: t["wick"])
    count = F.size("_seen")
    last4 = F.slice(wicks, F.greatest(count - 3, F.lit(1)), F.lit(4))
    steps = F.transform(last4, lambda w, i: (i == 0) | (w >= F.get(last4, i - 1) * 0.9))
    sellers = F.size(F.filter("_seen", lambda t: t["side"] == "SELLER"))
    return f.with_columns(
        {
            "touch_count": count,
            "avg_wick": F.aggregate(wicks, F.lit(0.0), lambda a, x: a + x) / count,
            "max_wick": F.array_max(wicks),
            "growing": (count >= 2) & F.forall(steps, lambda s: s),
            "zone_side": F.when(sellers * 2 >= count, "SELLER").otherwise("BUYER"),
        }
    ).core(*ZONE_KEYS, "level", "bar_start", "turn", "touch_count", "avg_wick", "max_wick", "growing", "zone_side")


def _zone_score(wicks: list[float], age: int) -> float:
    """`score` of one zone, rounded so that the order of additions decides no eviction."""
    n = len(wicks)
    if n < 2:
        return 0.0
    total = 0.0
    for w in wicks:
        total += w
    last = wicks[-4:]
    growing = all(b >= a * 0.9 for a, b in zip(last, last[1:], strict=False))
    return round(min(min(n * 12, 36) + (28 if growing else 8) + min(total / n * 60, 24.0) + (12 if age < 3600 else 0), 100.0), 9)


def zone_memory(touched: DataFrame, capacity: int = CAPACITY, max_age: int = MAX_AGE, memory: int = MEMORY) -> DataFrame:
    """The zone after each touch as a series of at most `capacity` zones remembers it, and the level that had to go for it.

    Zones that nobody touched for `max_age` are forgotten. When a new level comes and all places are taken, the zone with the
    least score at that time goes (of equal ones the one that came first), so a level that comes back starts anew; `zone_states`
    has no such limit. Columns: keys, level_no, bar_start, turn, touch_count, avg_wick, max_wick, growing, zone_side, n_zones and
    evicted (level, or null).

    What is remembered depends on the touches before it in their order, so a series is a run of one task over sorted rows, one
    narrow row a touch; the task holds one series' zones and one batch.
    """
    ordered = touched.select("key", "tf_sec", "level_no", F.unix_timestamp("bar_start").alias("at"), "turn", "wick", (F.col("side") == "SELLER").alias("sold"))
    ordered = ordered.repartition("key", "tf_sec").sortWithinPartitions("key", "tf_sec", "at", "turn")
    schema = "key string, tf_sec int, level_no bigint, at bigint, turn int, touch_count int, avg_wick double, max_wick double, growing boolean, zone_side string, n_zones int, evicted bigint"
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [{"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[f.split()[1]] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zones: dict[int, tuple[list[float], list[bool], int]] = {}
        current = None
        for batch in batches:
            out = []
            for key, tf, level, at, turn, wick, sold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, tf) != current:
                    zones, current = {}, (key, tf)
                for old in [k for k, z in zones.items() if at - z[2] > max_age]:
                    del zones[old]
                gone = None
                if level not in zones:
                    if len(zones) >= capacity:
                        gone = min(zones, key=lambda k: _zone_score(zones[k][0], at - zones[k][2]))
                        del zones[gone]
                    zones[level] = ([], [], at)
                wicks, sides = (zones[level][0] + [wick])[-memory:], (zones[level][1] + [sold])[-memory:]
                zones[level] = (wicks, sides, at)
                last = wicks[-4:]
                growing = len(wicks) >= 2 and all(b >= a * 0.9 for a, b in zip(last, last[1:], strict=False))
                side = "SELLER" if 2 * sum(sides) >= len(sides) else "BUYER"
                out.append((key, tf, level, at, turn, len(wicks), sum(wicks) / len(wicks), max(wicks), growing, side, len(zones), gone))
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    done = ordered.mapInArrow(run, schema)
    return done.withColumn("at", F.timestamp_seconds("at")).withColumnRenamed("at", "bar_start")


def score(age: Column, recent_seconds: int = 3600) -> Column:
    """0 to 100 from touch count, pressure, wick size and recency; 0 below two touches."""
    frequency = F.least(F.col("touch_count") * 12, F.lit(36))
    pressure = F.when(F.col("growing"), 28).otherwise(8)
    wick = F.least(F.col("avg_wick") * 60, F.lit(24.0))
    recency = F.when(age < recent_seconds, 12).otherwise(0)
    return F.when(F.col("touch_count") < 2, 0.0).otherwise(
        F.least(frequency + pressure + wick + recency, F.lit(100.0))
    )


def grade(value: Column) -> Column:
    return F.when(value >= 80, "S").when(value >= 65, "A").when(value >= 50, "B").when(value >= 35, "C").otherwise("D")


def implied_signal(value: Column, side: Column) -> Column:
    return F.when(value < 50, "NONE").when(side == "SELLER", "RED").otherwise("GREEN")


def snapshot(states: DataFrame, as_of: Column, max_age: int = MAX_AGE, capacity: int = CAPACITY) -> DataFrame:
    """Live zones at a point in time, at most `capacity` per series, the strongest ones."""
    fields = F.struct("level", "bar_start", "touch_count", "avg_wick", "max_wick", "growing", "zone_side")
    last = (
        states.filter(F.col("bar_start") <= as_of)
        .groupBy(*ZONE_KEYS)
        .agg(F.max_by(fields, F.struct("bar_start", "turn")).alias("_z"))
        .select(*ZONE_KEYS, "_z.*")
    )
    age = F.unix_timestamp(as_of) - F.unix_timestamp("bar_start")
    live = last.filter(age <= max_age).withColumn("score", score(age))
    strongest = Window.partitionBy("key", "tf_sec").orderBy(F.col("score").desc(), "level_no")
    return (
        live.withColumn("_rank", F.row_number().over(strongest))
        .filter(F.col("_rank") <= capacity)
        .drop("_rank")
        .withColumns({"grade": grade(F.col("score")), "signal": implied_signal(F.col("score"), F.col("zone_side"))})
    )


def zones_near(
    bars: DataFrame, states: DataFrame, zone_size: Column, radius_zones: int = 2, max_age: int = MAX_AGE
) -> DataFrame:
    """Live zones within reach of each bar's close, scored at the bar's time.

    A price reaches a handful of grid levels, so the range join is an as-of join per level.
    """
    position = F.col("close") / F.col("_zone")
    levels = F.sequence(F.ceil(position - radius_zones), F.floor(position + radius_zones))
    asked = bars.select("key", "tf_sec", "bar_start", "close", zone_size.alias("_zone")).withColumn(
        "level_no", F.explode(levels)
    )
    right = states.withColumn("zone_start", F.col("bar_start"))
    matched = asof_join(
        asked, right, ZONE_KEYS, "bar_start", "bar_start", block_seconds=86400 * 30, name="zone", tie="turn"
    ).filter(F.col("zone").isNotNull())
    flat = matched.select("key", "tf_sec", "bar_start", "close", "level_no", *[
        F.col(f"zone.{c}").alias(c)
        for c in ("level", "zone_start", "touch_count", "avg_wick", "max_wick", "growing", "zone_side")
    ])
    age = F.unix_timestamp("bar_start") - F.unix_timestamp("zone_start")
    return flat.filter(age <= max_age).withColumn("score", score(age))


def best_zone(bars: DataFrame, near: DataFrame, min_score: float = 35.0) -> DataFrame:
    """The strongest zone near each bar, with defaults where none reaches `min_score`."""
    best = near.groupBy("key", "tf_sec", "bar_start").agg(
        F.max_by(
            F.struct("score", "touch_count", "growing", "zone_side"), F.struct(F.col("score"), -F.col("level_no"))
        ).alias("_z")
    )
    found = F.coalesce(F.col("_z.score") >= min_score, F.lit(False))
    value = F.col("_z.score")
    return bars.join(best, ["key", "tf_sec", "bar_start"], "left").withColumns(
        {
            "rz_score": F.when(found, value).otherwise(0.0),
            "rz_grade": F.when(found, grade(value)).otherwise("D"),
            "rz_signal": F.when(found, implied_signal(value, F.col("_z.zone_side"))).otherwise("NONE"),
            "rz_touches": F.when(found, F.col("_z.touch_count")).otherwise(0),
            "rz_growing": F.when(found, F.col("_z.growing")).otherwise(False),
            "rz_side": F.when(found, F.col("_z.zone_side")).otherwise("NONE"),
        }
    ).drop("_z")
