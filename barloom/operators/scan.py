"""Linear recurrences over a whole series: exponential averages and the price filter.

`y[n] = a[n] * y[n-1] + u[n]` has an associative composition, so a long series splits into
sub-blocks: each contributes the value it leaves at its end, the contributions reach the following
sub-blocks with a known decay, and inside a sub-block the recurrence is a running sum of scaled
terms. Decays are closed forms of the row position, so no step looks at rows one by one. A
contribution is carried for as many sub-blocks as it can still change a double.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEGLIGIBLE = 1e-18


@dataclass(frozen=True)
class Ema:
    """Exponential average with smoothing 2 / (span + 1), started at the first value."""

    name: str
    span: int
    source: str = "close"

    @property
    def keep(self) -> float:
        return 1.0 - 2.0 / (self.span + 1.0)

    def term(self, rn: Column) -> Column:
        value = F.col(self.source)
        return F.when(rn == 0, value).otherwise(value * F.lit(1.0 - self.keep))

    def growth(self, rn: Column, start: Column) -> Column:
        return F.pow(F.lit(1.0 / self.keep), rn - start)

    def decay(self, earlier: Column, later: Column) -> Column:
        return F.pow(F.lit(self.keep), later - earlier)


@dataclass(frozen=True)
class PriceFilter:
    """One-dimensional Kalman filter of a price (process noise q, measurement noise r, start variance 1).

    The variance recursion does not depend on the data and is a linear-fractional map, so gain and
    accumulated decay have closed forms in the row position.
    """

    name: str = "kalman_price"
    source: str = "close"
    q: float = 1e-5
    r: float = 1e-2

    @property
    def _roots(self) -> tuple[float, float, float, float]:
        # den[n+1] = num[n] + (q + r) den[n], num[n+1] = r num[n] + r q den[n]; scaled by r.
        half = (2.0 * self.r + self.q) / 2.0
        root = math.sqrt(self.q * self.q + 4.0 * self.q * self.r) / 2.0
        up, down = (half + root) / self.r, (half - root) / self.r
        den1 = (1.0 + self.q + self.r) / self.r
        a = (den1 - down) / (up - down)
        return up, down, a, 1.0 - a

    @property
    def keep(self) -> float:
        return 1.0 / self._roots[0]

    def _shape(self, rn: Column) -> Column:
        up, down, a, b = self._roots
        return F.lit(a) + F.lit(b) * F.pow(F.lit(down / up), rn)

    def gain(self, rn: Column) -> Column:
        """Weight of the new price at position rn (1 at the first row)."""
        up = self._roots[0]
        share = self._shape(rn - 1) / (self._shape(rn) * F.lit(up))
        return F.when(rn == 0, F.lit(1.0)).otherwise(F.lit(1.0) - share)

    def term(self, rn: Column) -> Column:
        return F.col(self.source) * self.gain(rn)

    def growth(self, rn: Column, start: Column) -> Column:
        return F.pow(F.lit(self._roots[0]), rn - start) * self._shape(rn)

    def decay(self, earlier: Column, later: Column) -> Column:
        return F.pow(F.lit(self.keep), later - earlier) * self._shape(earlier) / self._shape(later)


def _reach(scans: Sequence, sub_rows: int) -> int:
    slowest = max(scan.keep for scan in scans)
    return max(1, math.ceil(math.log(NEGLIGIBLE) / (sub_rows * math.log(slowest))))


def carry_markers(rows: DataFrame, keys: Sequence[str], scans: Sequence, sub_rows: int) -> DataFrame:
    """One row per sub-block with the value each scan brings in from all earlier sub-blocks."""
    rn = F.col("rn")
    end = (F.col("_sub") + 1) * F.lit(sub_rows) - 1
    left = rows.groupBy(*keys, "_sub").agg(
        *[F.sum(s.term(rn) * s.decay(rn, end)).alias(f"_l_{s.name}") for s in scans]
    )
    step = F.explode(F.sequence(F.lit(1), F.lit(_reach(scans, sub_rows))))
    reached = left.withColumn("_step", step).withColumn("_to", F.col("_sub") + F.col("_step"))
    into = F.col("_to") * F.lit(sub_rows) - 1
    carried = reached.groupBy(*keys, "_to").agg(
        *[F.sum(F.col(f"_l_{s.name}") * s.decay(end, into)).alias(f"_u_{s.name}") for s in scans]
    )
    return carried.select(
        *keys,
        F.col("_to").alias("_sub"),
        (F.col("_to") * F.lit(sub_rows) - 1).alias("rn"),
        *[f"_u_{s.name}" for s in scans],
        F.lit(True).alias("_marker"),
    )


def resolve(framed, scans: Sequence, sub_rows: int, columns: Sequence[str]):
    """Turn terms and markers into the scan values, then drop the markers."""
    from barloom.operators.series import Framed

    rn, start = F.col("rn"), F.col("_sub") * F.lit(sub_rows)
    so_far = (
        Window.partitionBy(*framed.keys, "_blk", "_sub")
        .orderBy("rn")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    marker = F.coalesce(F.col("_marker"), F.lit(False))
    values = {
        s.name: F.sum(
            F.when(marker, F.col(f"_u_{s.name}")).otherwise(s.term(rn)) * s.growth(rn, start)
        ).over(so_far)
        / s.growth(rn, start)
        for s in scans
    }
    df = framed.df.withColumns(values).filter(~marker)
    return Framed(df.select(*columns, "_sub", "_blk", "_core", *values), framed.keys)


def chained_ema(inner: Column, inner_span: int, outer: Column, outer_span: int) -> Column:
    """Exponential average of an exponential average, from two averages of the same source.

    Two first-order filters in a row split into partial fractions: the result is a fixed mix of
    both single averages. Seeding at the first value equals a constant past, which the mix keeps.
    """
    q, p = 1.0 - 2.0 / (inner_span + 1.0), 1.0 - 2.0 / (outer_span + 1.0)
    return outer * F.lit((1.0 - q) * p / (p - q)) + inner * F.lit((1.0 - p) * q / (q - p))


def restarted(framed, value: Column | str, source: Column | str, span: int, lookback: int) -> Column:
    """The average as it reads when started afresh at the first row of the last `lookback` rows."""
    q = 1.0 - 2.0 / (span + 1.0)
    value = F.col(value) if isinstance(value, str) else value
    offset = framed.prev(value, lookback - 1) - framed.prev(source, lookback - 1)
    return value - F.coalesce(offset * F.lit(q ** (lookback - 1)), F.lit(0.0))
