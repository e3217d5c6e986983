"""Contiguous shards of near equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.session import cut_lineage


def byte_shards(rows: DataFrame, order: list[str], size: str, n_shards: int = 8) -> DataFrame:
    """The rows with `shard` (0 to n_shards - 1) and `slot` (place in the shard, from 0).

    The rows are dealt by ranges of `order`, so that no partition has to hold a key as a whole, and written once. Each
    range has a total of bytes and rows; the running sums of these few totals are where the range begins, and a running
    sum inside the range gives every row its first byte in the whole table. The row belongs to the shard in whose equal
    part of all bytes its middle byte lies, so shards follow the order and differ by less than the largest row.

    Rows that tie in the order (repeated rows) are told apart by their place in the scan; they are interchangeable. Null
    values in the order come first; a null size counts as 0. An empty table gives no rows. If all sizes are 0, all rows
    are in shard 0. Columns `shard`, `slot` and those that start with `__` must not be in rows.
    """
    ranged = rows.withColumn("__tie", F.monotonically_increasing_id()).withColumn("__size", F.coalesce(F.col(size), F.lit(0)).cast("bigint"))
    keys = [*order, "__tie"]
    dealt = cut_lineage(ranged.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()))

    totals = dealt.groupBy("__range").agg(F.sum("__size").alias("__bytes"), F.count(F.lit(1)).alias("__rows"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = totals.select(
        "__range",
        F.coalesce(F.sum("__bytes").over(before), F.lit(0)).alias("__first_byte"),
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__first_row"),
        F.sum("__bytes").over(whole).alias("__all"),
    )
    inside = Window.partitionBy("__range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        dealt.join(starts, "__range")
        .withColumn("__middle", 2 * (F.col("__first_byte") + F.sum("__size").over(inside)) - F.col("__size"))
        .withColumn("__row", F.col("__first_row") + F.count(F.lit(1)).over(inside) - 1)
        .withColumn("shard", F.expr(f"least({n_shards - 1}, coalesce(__middle * {n_shards} div nullif(2 * __all, 0), 0))").cast("int"))
    )
    first = placed.groupBy("shard").agg(F.min("__row").alias("__from"))
    # One row for each shard: as many as the parameter says.
    return (
        placed.join(F.broadcast(first), "shard")
        .withColumn("slot", F.col("__row") - F.col("__from"))
        .select(*rows.columns, "shard", "slot")
    )


def shard_documents(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """Every document with size, checksum, law, shard and slot.

    The order is doc_id (null first), then the text by two checksums, so a rerun gives the same shards. A document's size
    is its bytes of UTF-8 plus 1, a null text counting as empty. Only columns doc_id and text are read.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).cast("bigint").alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
    )
    out = byte_shards(rows, ["doc_id", "text_crc32", "text_hash"], "size", n_shards)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
