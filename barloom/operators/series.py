"""Ordered series as distributed tables.

A series (all bars of one key and timeframe, all ticks of one key) can be far larger than one task
should hold, so no operator here partitions a window by the series key alone. Three building blocks
keep every window inside a block of bounded size:

* `prefix_scan`  - running aggregates over the whole past: block totals are folded first, then each
  row combines its block's carry with a window inside the block.
* `number_rows`  - exact position of a row in its series, a prefix scan over counts.
* `Framed`       - row frames of bounded reach: rows are dealt to blocks by position and the rows a
  frame needs from the neighbours are copied in (a halo), then dropped again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ("key", "tf_sec")
BLOCK_ROWS = 4096
SUB_ROWS = 256


def bar_block(rows: int = BLOCK_ROWS) -> Column:
    """Block id of a bar from its start time: at most `rows` bars of one series share it."""
    return F.floor(F.unix_timestamp("bar_start") / (F.col("tf_sec") * F.lit(rows)))


def seq_block(seq: str = "seq", rows: int = 1 << 20) -> Column:
    """Block id of a tick from its unique arrival number: at most `rows` ticks share it."""
    return F.floor(F.col(seq) / F.lit(rows))


def time_block(ts: str, seconds: int) -> Column:
    return F.floor(F.unix_timestamp(ts) / F.lit(seconds))


def _fold(kind: str, earlier: Column, own: Column) -> Column:
    if kind in ("sum", "count"):
        return F.coalesce(earlier, F.lit(0)) + F.coalesce(own, F.lit(0))
    if kind == "max":
        return F.greatest(earlier, own)
    if kind == "min":
        return F.least(earlier, own)
    if kind == "first":
        return F.coalesce(earlier, own)
    if kind == "last":
        return F.coalesce(own, earlier)
    raise ValueError(f"unknown running aggregate: {kind}")


def _running(kind: str, value: Column, window: WindowSpec) -> Column:
    if kind in ("first", "last"):
        return getattr(F, kind)(value, ignorenulls=True).over(window)
    return getattr(F, kind)(value).over(window)


def prefix_scan(
    df: DataFrame,
    keys: Sequence[str],
    block: Column,
    order: Sequence[str],
    measures: dict[str, tuple[str, Column]],
    inclusive: bool = True,
) -> DataFrame:
    """Running aggregates over all earlier rows of a series (and the row itself if `inclusive`).

    `measures` maps an output column to (kind, value) with kind one of sum, count, max, min, first,
    last; first and last skip nulls. `block` must not decrease along `order`. The rows shuffle once,
    on (keys, block); only one row per block takes part in the fold over the whole series.
    """
    keys = list(keys)
    values = {f"_v_{name}": value for name, (_, value) in measures.items()}
    rows = df.withColumns({"_pb": block, **values})

    totals = []
    for name, (kind, _) in measures.items():
        value = F.col(f"_v_{name}")
        if kind in ("first", "last"):
            at = F.when(value.isNotNull(), F.struct(*order))
            pick = F.min_by if kind == "first" else F.max_by
            totals.append(pick(value, at).alias(f"_t_{name}"))
        else:
            totals.append(getattr(F, kind)(value).alias(f"_t_{name}"))
    before = Window.partitionBy(*keys).orderBy("_pb").rowsBetween(Window.unboundedPreceding, -1)
    carries = (
        rows.groupBy(*keys, "_pb")
        .agg(*totals)
        .select(
            *keys,
            "_pb",
            *[
                _running("sum" if kind == "count" else kind, F.col(f"_t_{name}"), before).alias(f"_c_{name}")
                for name, (kind, _) in measures.items()
            ],
        )
    )
    inside = (
        Window.partitionBy(*keys, "_pb")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    scanned = rows.join(carries, [*keys, "_pb"], "left").withColumns(
        {
            name: _fold(kind, F.col(f"_c_{name}"), _running(kind, F.col(f"_v_{name}"), inside))
            for name, (kind, _) in measures.items()
        }
    )
    return scanned.select(*[c for c in df.columns if c not in measures], *measures)


def number_rows(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ("bar_start",),
    block: Column | None = None,
    name: str = "rn",
) -> DataFrame:
    """0-based position of each row in its series."""
    if name in df.columns:
        return df
    block = bar_block() if block is None else block
    numbered = prefix_scan(df, keys, block, order, {name: ("count", F.lit(1))})
    return numbered.withColumn(name, F.col(name) - 1)


def grouped_positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cell: Column, name: str = "rn"
) -> DataFrame:
    """`number_rows` for series without a natural time grid; `cell` bounds the rows per block."""
    return number_rows(df, keys, order, cell, name)


def side_by_side(*families: Iterator[dict[str, Column]]) -> Iterator[dict[str, Column]]:
    """Merge families layer by layer."""
    running = list(families)
    while running:
        layer, alive = {}, []
        for family in running:
            columns = next(family, None)
            if columns is not None:
                layer.update(columns)
                alive.append(family)
        running = alive
        if layer:
            yield layer


Layers = Iterator[dict[str, Column]]


class Framed:
    """Series rows dealt to blocks with halo rows, so row frames of bounded reach stay local.

    Add column families with `then` and finish with `core`. All windows share one partitioning and one
    order, so Spark plans a single exchange and a single sort for a whole feature family.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str] = KEYS):
        self.df = df
        self.keys = list(keys)
        self.order = Window.partitionBy(*self.keys, "_blk").orderBy("_sub", "rn")

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def rows(self, first: int, last: int = 0) -> WindowSpec:
        return self.order.rowsBetween(first, last)

    def prev(self, value: Column | str, n: int = 1) -> Column:
        return F.lag(value, n).over(self.order)

    def next(self, value: Column | str, n: int = 1) -> Column:
        return F.lead(value, n).over(self.order)

    def over(self, aggregate: Column, n: int) -> Column:
        """`aggregate` over the last n rows, fewer at the start of the series."""
        return aggregate.over(self.rows(-(n - 1)))

    def strict(self, fn, value: Column | str, n: int) -> Column:
        """`fn` over the last n rows, null until n values are there."""
        value = F.col(value) if isinstance(value, str) else value
        frame = self.rows(-(n - 1))
        return F.when(F.count(value).over(frame) == n, fn(value).over(frame))

    def mean(self, value: Column | str, n: int) -> Column:
        return self.strict(F.avg, value, n)

    def with_columns(self, columns: dict[str, Column]) -> Framed:
        return Framed(self.df.withColumns(columns), self.keys)

    def then(self, *steps) -> Framed:
        """Add column families. A step is a family or a tuple of families that stand side by side.

        A family is a generator: it yields layers, dicts of columns that may use all earlier layers.
        The k-th layers of families in a tuple go into one projection, so their windows share one pass
        over the sorted rows.
        """
        framed = self
        for step in steps:
            families = step if isinstance(step, tuple) else (step,)
            for layer in side_by_side(*[family(framed) for family in families]):
                framed = framed.with_columns(layer)
        return framed

    def core(self, *columns: str | Column) -> DataFrame:
        """The rows of the series without the copies made for neighbours."""
        rows = self.df.filter("_core")
        return rows.select(*columns) if columns else rows.drop("_blk", "_sub", "_core")


def _deal(df: DataFrame, position: Column, back: int, ahead: int, block_rows: int) -> DataFrame:
    first = F.greatest(F.lit(0), F.floor((position - F.lit(ahead)) / F.lit(block_rows)))
    last = F.floor((position + F.lit(back)) / F.lit(block_rows))
    return df.withColumn("_blk", F.explode(F.sequence(first, last)))


def frame(
    df: DataFrame,
    back: int,
    ahead: int = 0,
    keys: Sequence[str] = KEYS,
    block_rows: int = BLOCK_ROWS,
    scans: Sequence = (),
    sub_rows: int = SUB_ROWS,
) -> Framed:
    """Deal a numbered series to blocks so that frames reaching `back` and `ahead` rows are whole.

    `scans` are running decays over the whole past (see `scan.py`); their carries enter the same
    exchange as marker rows, one per sub-block, so no join on the rows is needed.
    """
    from barloom.operators.scan import carry_markers, resolve

    back = -(-back // sub_rows) * sub_rows
    block_rows = -(-block_rows // sub_rows) * sub_rows
    numbered = number_rows(df, keys)
    rows = numbered.withColumns({"_sub": F.floor(F.col("rn") / F.lit(sub_rows))})
    if not scans:
        dealt = _deal(rows, F.col("rn"), back, ahead, block_rows)
        return Framed(dealt.withColumn("_core", _is_core(block_rows)), keys)

    markers = carry_markers(rows, keys, scans, sub_rows)
    first_rn = F.col("_sub") * F.lit(sub_rows)
    dealt = _deal(rows, F.col("rn"), back, ahead, block_rows).unionByName(
        _deal(markers, first_rn, back, ahead, block_rows), allowMissingColumns=True
    )
    # Asked for by name, since the scans alone would move the rows by sub-block and the frames again.
    moved = dealt.withColumn("_core", _is_core(block_rows)).repartition(*keys, "_blk")
    return resolve(Framed(moved, keys), scans, sub_rows, numbered.columns)


def _is_core(block_rows: int) -> Column:
    return F.col("_blk") == F.floor(F.col("rn") / F.lit(block_rows))
