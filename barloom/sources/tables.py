"""Bar tables on shared storage: read, upsert, retention, publishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.retention import merge_latest, newest_rows

PARTITIONS = ("tf_sec", "day")


def with_day(bars: DataFrame) -> DataFrame:
    return bars.withColumn("day", F.to_date("bar_start"))


def read_bars(spark: SparkSession, path: str, keys: list[str] | None = None, tf_sec: int | None = None, since: str | None = None) -> DataFrame:
    """Stored bars; timeframe and date prune partitions, the key is pushed into the files."""
    df = spark.read.parquet(path)
    if tf_sec is not None:
        df = df.filter(F.col("tf_sec") == tf_sec)
    if since is not None:
        df = df.filter(F.col("day") >= F.lit(since).cast("date"))
    if keys is not None:
        df = df.filter(F.col("key").isin(*keys))
    return df


def write_bars(bars: DataFrame, path: str) -> None:
    """Replace exactly the (timeframe, day) partitions the bars fall into."""
    (
        with_day(bars)
        .repartition("tf_sec", "day", "key")
        .sortWithinPartitions("key", "bar_start")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*PARTITIONS)
        .parquet(path)
    )


def upsert_bars(spark: SparkSession, bars: DataFrame, path: str) -> None:
    """Write bars so that a bar stored before is replaced by its newer version.

    Only the stored partitions the new bars touch are read and rewritten. The merged rows are
    checkpointed first because they are read from the partitions that get replaced.
    """
    from barloom.session import cut_lineage

    fresh = with_day(bars)
    touched = fresh.select(*PARTITIONS).distinct()
    stored = spark.read.parquet(path).join(touched, list(PARTITIONS), "left_semi").select(*fresh.columns)
    write_bars(cut_lineage(merge_latest([stored, fresh]).drop("day")), path)


def trim_bars(spark: SparkSession, path: str, target: str, keep: int = 5000) -> None:
    """Write the newest `keep` bars of each series to another table."""
    write_bars(newest_rows(spark.read.parquet(path).drop("day"), keep), target)


def topic(key: Column, tf_sec: Column) -> Column:
    """Topic a bar is published under."""
    return F.concat_ws(":", F.lit("candle"), key, tf_sec.cast("string"))


def messages(bars: DataFrame) -> DataFrame:
    """Bars as messages: topic and JSON value."""
    body = F.struct(
        F.unix_timestamp("bar_start").alias("epoch"), "open", "high", "low", "close",
        *(["volume"] if "volume" in bars.columns else []),
        *(["closed"] if "closed" in bars.columns else []),
    )
    return bars.select(topic(F.col("key"), F.col("tf_sec")).alias("topic"), F.to_json(body).alias("value"))
