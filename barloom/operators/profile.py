"""Volume profile snapshots: price histogram, point of control, value area, nodes, price class."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.series import BLOCK_ROWS, KEYS, frame, number_rows

LEVELS = 50
LOOKBACK = 500
SHARE = 0.70


def last_bar_per_day(bars: DataFrame) -> DataFrame:
    """Snapshot points: the position and close of the last bar of each day, for numbered bars."""
    day = F.date_trunc("day", "bar_start").alias("day")
    return bars.groupBy("key", "tf_sec", day).agg(
        F.max("rn").alias("snap_rn"), F.max("bar_start").alias("snap_start"), F.max_by("close", "rn").alias("price")
    )


def last_bar(bars: DataFrame) -> DataFrame:
    """One snapshot point per series: its newest bar."""
    return bars.groupBy("key", "tf_sec").agg(
        F.max("rn").alias("snap_rn"), F.max("bar_start").alias("snap_start"), F.max_by("close", "rn").alias("price")
    )


def _centre(i: Column) -> Column:
    return F.col("_lo") + (i + 0.5) * ((F.col("_hi") - F.col("_lo")) / LEVELS)


def histogram(bars: DataFrame, points: DataFrame, lookback: int = LOOKBACK, min_rows: int = 20) -> DataFrame:
    """Per snapshot: volume of the last `lookback` bars by price level, as an array of 50.

    A bar's volume spreads evenly over the level centres inside its range. Bars meet snapshots in
    cells of `lookback` positions: a window touches at most two cells, and a cell holds at most
    `lookback` bars and snapshots of a series, however long the series is.
    """
    numbered = number_rows(bars)
    cell = F.floor(F.col("rn") / lookback)
    rows = numbered.select(
        "key",
        "tf_sec",
        "rn",
        "low",
        "high",
        (F.coalesce(F.col("volume"), F.lit(1.0)) if "volume" in bars.columns else F.lit(1.0)).alias("volume"),
        cell.alias("_cell"),
    )
    touched = F.array_distinct(
        F.array(
            F.floor(F.col("snap_rn") / lookback),
            F.floor(F.greatest(F.col("snap_rn") - (lookback - 1), F.lit(0)) / lookback),
        )
    )
    windows = points.filter(F.col("snap_rn") >= min_rows - 1).withColumn("_cell", F.explode(touched))
    snap = ["key", "tf_sec", "snap_rn", "snap_start", "price"]
    inside = (F.col("rn") <= F.col("snap_rn")) & (F.col("rn") > F.col("snap_rn") - lookback)
    whole = Window.partitionBy(*snap)
    covered = F.filter(
        F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda i: (_centre(i) >= F.col("low")) & (_centre(i) <= F.col("high"))
    )
    shares = (
        rows.join(windows, ["key", "tf_sec", "_cell"])
        .filter(inside)
        .withColumns({"_lo": F.min("low").over(whole), "_hi": F.max("high").over(whole)})
        .filter(F.col("_hi") > F.col("_lo"))
        .withColumn("_levels", covered)
        .withColumn("level", F.explode_outer("_levels"))
        .groupBy(*snap, "level")
        .agg(
            F.sum(F.when(F.size("_levels") > 0, F.col("volume") / F.size("_levels"))).alias("_volume"),
            F.first("_lo").alias("_lo"),
            F.first("_hi").alias("_hi"),
        )
    )
    # Rounding makes levels with the same bars exactly equal, whatever the order of the sums.
    entry = F.when(F.col("level").isNotNull(), F.struct("level", F.round("_volume", 9).alias("v")))
    dense = F.transform(
        F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda i: F.coalesce(F.try_element_at(F.col("_map"), i), F.lit(0.0))
    )
    return (
        shares.groupBy(*snap)
        .agg(
            F.map_from_entries(F.collect_list(entry)).alias("_map"),
            F.first("_lo").alias("low"),
            F.first("_hi").alias("high"),
        )
        .withColumn("volumes", dense)
        .drop("_map")
    )


def sliding_levels(low: np.ndarray, high: np.ndarray, volume: np.ndarray, rows: np.ndarray, lookback: int) -> list[tuple[float, float, np.ndarray] | None]:
    """Bounds and volumes by level of the window that ends at each of the rows; None where all prices are one.

    The level edges move with the window's bounds. A bar covers a run of levels, so its share enters a difference array at the
    run's first level and leaves it after the last; one running sum over the levels then gives all volumes.
    """
    out, middle = [], np.arange(LEVELS) + 0.5
    for j in rows:
        i = max(0, j - lookback + 1)
        lows, highs = low[i : j + 1], high[i : j + 1]
        bottom, top = lows.min(), highs.max()
        if not top > bottom:
            out.append(None)
            continue
        centres = bottom + middle * ((top - bottom) / LEVELS)
        first, after = np.searchsorted(centres, lows, "left"), np.searchsorted(centres, highs, "right")
        n = after - first
        share = np.where(n > 0, volume[i : j + 1] / np.maximum(n, 1), 0.0)
        change = np.bincount(first, share, LEVELS + 1) - np.bincount(after, share, LEVELS + 1)
        # Rounding makes levels with the same bars exactly equal, whatever the order of the sums.
        out.append((bottom, top, np.round(np.cumsum(change)[:LEVELS], 9) + 0.0))
    return out


def histogram_per_bar(bars: DataFrame, lookback: int = LOOKBACK, min_rows: int = 20, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """keys, bar_start, rn, price (close), low, high and volumes of every bar's own last `lookback` bars.

    low, high and volumes are null before `min_rows` bars, and where all prices of the window are one. Bars are dealt to blocks
    with the bars that the first windows reach back to, so a task holds one block, whatever the length of the series.
    """
    amount = F.coalesce(F.nanvl(F.col("volume").cast("double"), F.lit(1.0)), F.lit(1.0)) if "volume" in bars.columns else F.lit(1.0)
    prices = [F.col(c).cast("double").alias(name) for c, name in (("close", "price"), ("low", "low"), ("high", "high"))]
    numbered = number_rows(bars).select(*KEYS, "bar_start", "rn", *prices, amount.alias("volume"))
    dealt = frame(numbered, back=lookback, block_rows=block_rows).df
    kept = ["key", "tf_sec", "bar_start", "rn", "price"]

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("rn")
        low, high, volume, rn = (table.column(c).to_numpy() for c in ("low", "high", "volume", "rn"))
        own = np.flatnonzero(table.column("_core").to_numpy(zero_copy_only=False))
        full = own[rn[own] >= min_rows - 1]
        found = dict(zip(full.tolist(), sliding_levels(low, high, volume, full, lookback), strict=True))
        parts = [found.get(j) or (None, None, None) for j in own.tolist()]
        columns = [table.column(c).take(own) for c in kept]
        made = [pa.array([p[k] for p in parts], pa.float64()) for k in (0, 1)]
        return pa.Table.from_arrays([*columns, *made, pa.array([p[2] for p in parts], pa.list_(pa.float64()))], [*kept, "low", "high", "volumes"])

    schema = ", ".join(f"{c} {kind}" for c, kind in numbered.dtypes if c in kept) + ", low double, high double, volumes array<double>"
    return dealt.select(*kept, "low", "high", "volume", "_core", "_blk").groupBy(*KEYS, "_blk").applyInArrow(one, schema)


def level_price(i: Column) -> Column:
    return F.col("low") + (i + 0.5) * ((F.col("high") - F.col("low")) / LEVELS)


def profile(histograms: DataFrame, share: float = SHARE) -> DataFrame:
    """Point of control, high and low volume nodes, and the value area grown from the control level."""
    v = F.col("volumes")
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    steps = F.sequence(F.lit(1), F.lit(LEVELS - 1))
    start = F.struct(F.col("_poc").alias("lo"), F.col("_poc").alias("hi"), F.get(v, F.col("_poc")).alias("acc"))

    def grow(a: Column, _: Column) -> Column:
        above, below = F.get(v, a["hi"] + 1), F.get(v, a["lo"] - 1)
        up = above.isNotNull() & (below.isNull() | (above >= below))
        stay = (a["acc"] >= F.col("_total") * share) | (above.isNull() & below.isNull())
        return (
            F.when(stay, a)
            .when(up, F.struct(a["lo"].alias("lo"), (a["hi"] + 1).alias("hi"), (a["acc"] + above).alias("acc")))
            .otherwise(F.struct((a["lo"] - 1).alias("lo"), a["hi"].alias("hi"), (a["acc"] + below).alias("acc")))
        )

    def nodes(test) -> Column:
        hits = F.filter(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda i: test(F.get(v, i)))
        return F.transform(hits, level_price)

    df = histograms.withColumns({"_poc": (F.array_position(v, F.array_max(v)) - 1).cast("int"), "_total": total})
    df = df.withColumns(
        {
            "_area": F.aggregate(steps, start, grow),
            "hvn": nodes(lambda x: x > F.col("_total") / LEVELS * 1.5),
            "lvn": nodes(lambda x: x < F.col("_total") / LEVELS * 0.5),
        }
    )
    return df.withColumns(
        {
            "poc": level_price(F.col("_poc")),
            "vah": level_price(F.col("_area.hi")),
            "val": level_price(F.col("_area.lo")),
        }
    ).drop("_poc", "_area", "_total")


def classify(df: DataFrame, price: str = "price", support: str = "farthest") -> DataFrame:
    """Class of a price against a profile, and the nodes above and below it.

    Below the price, `farthest` takes the lowest node as support, `nearest` the highest.
    """
    p, poc = F.col(price), F.col("poc")
    pip = p * 0.0001

    def near(nodes: str, side=None) -> Column:
        return F.exists(F.col(nodes), lambda n: (F.abs(p - n) <= pip * 8) & (side(n) if side else F.lit(True)))

    above = F.filter("hvn", lambda n: n > p)
    below = F.filter("hvn", lambda n: n < p)
    pick = F.array_min if support == "farthest" else F.array_max
    zone = (
        F.when(poc.isNull(), "NEUTRAL")
        .when(F.abs(p - poc) <= pip * 5, "AT_POC")
        .when(near("hvn", lambda n: n > poc), "AT_RESISTANCE")
        .when(near("hvn", lambda n: n < poc), "AT_SUPPORT")
        .when(near("lvn"), "LVN_FAST_MOVE")
        .when((p >= F.col("val")) & (p <= F.col("vah")), "IN_VALUE_AREA")
        .when(p > F.col("vah"), "ABOVE_VALUE_AREA")
        .otherwise("BELOW_VALUE_AREA")
    )
    return df.withColumns(
        {
            "vp_zone": zone,
            "vp_hvn_resistance": F.coalesce(F.array_min(above), F.col("vah")),
            "vp_hvn_support": F.coalesce(pick(below), F.col("val")),
            "vp_at_poc": F.coalesce(F.abs(p - poc) / F.greatest(F.abs(poc) * 0.0001, F.lit(1e-8)) < 5, F.lit(False)),
        }
    )
