"""Newest rows, merges and retention on keyed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.series import KEYS, bar_block


#: Default of spark.sql.optimizer.windowGroupLimitThreshold.
GROUP_LIMIT = 1000


def newest_rows(
    df: DataFrame, n: int, keys: Sequence[str] = KEYS, order: Sequence[str] = ("bar_start",), block: Column | None = None
) -> DataFrame:
    """The newest `n` rows of each series.

    Up to GROUP_LIMIT rows, Spark keeps only the newest of each partition before it moves any (a limit within the window).
    Beyond that, the rows of each block of a series are counted first; only blocks that fewer than n rows follow are needed, so
    what a task ranks is n rows and one block more, however long the series is. `block` must not decrease along `order`.
    """
    if n <= GROUP_LIMIT:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order)))
        return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")
    placed = df.withColumn("_blk", bar_block() if block is None else block)
    newer = Window.partitionBy(*keys).orderBy(F.col("_blk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*keys, "_blk").agg(F.count(F.lit(1)).alias("_n")).withColumn("_newer", F.coalesce(F.sum("_n").over(newer), F.lit(0)))
    needed = placed.join(counts.filter(F.col("_newer") < n).select(*keys, "_blk"), [*keys, "_blk"], "left_semi")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order)))
    return needed.withColumn("_rank", rank).filter(F.col("_rank") <= n).select(*df.columns)


def merge_latest(sources: Sequence[DataFrame], unique: Sequence[str] = ("key", "tf_sec", "bar_start")) -> DataFrame:
    """Union of several tables, one row per unique key; later tables win."""
    columns = sources[0].columns
    stacked = None
    for rank, source in enumerate(sources):
        part = source.select(*columns).withColumn("_rank", F.lit(rank))
        stacked = part if stacked is None else stacked.unionByName(part)
    payload = F.struct(*[c for c in columns if c not in unique])
    return (
        stacked.groupBy(*unique).agg(F.max_by(payload, "_rank").alias("_row")).select(*unique, "_row.*").select(*columns)
    )


def newest_epochs(df: DataFrame, n: int, keys: Sequence[str] = ("key",), epoch: str = "bar_start") -> DataFrame:
    """All rows of the newest `n` distinct epochs of each key.

    Epochs are made distinct first and ranked with a per-partition limit, so no task sees a whole key.
    """
    newest = Window.partitionBy(*keys).orderBy(F.col(epoch).desc())
    kept = (
        df.select(*keys, epoch)
        .distinct()
        .withColumn("_rank", F.row_number().over(newest))
        .filter(F.col("_rank") <= n)
        .drop("_rank")
    )
    return df.join(kept, [*keys, epoch], "left_semi")
