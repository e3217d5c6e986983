"""Ticks and bars derived from the supplied test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.bars import ohlc
from barloom.session import cut_lineage


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    """events as ticks: key, ts, arrival number, price."""
    return table(spark, folder, "events").select(
        F.col("event_type").alias("key"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("price"),
    )


def bars(spark: SparkSession, folder: str, tf_sec: int = 3600, reuse: bool = True) -> DataFrame:
    """Hourly bars of the event ticks, without volume.

    With `reuse` the bars are written once where the cluster names a folder for it, since positions,
    frames and joins read them more than once and the ticks are far larger.
    """
    made = ohlc(ticks(spark, folder), tf_sec)
    return cut_lineage(made) if reuse else made


def trades(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem as trades with volume; all trades of a day share one timestamp.

    Order and line number repeat in the table, so the price completes the order of arrival. One number
    instead of a struct keeps the bar aggregation a hash aggregation.
    """
    price = F.col("l_extendedprice") / F.col("l_quantity")
    order = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("decimal(20,0)")
    return table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("key"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        (order * 10**12 + F.round(price * 10**6).cast("decimal(12,0)")).cast("decimal(38,0)").alias("seq"),
        price.alias("price"),
        F.col("l_quantity").alias("volume"),
    )


def volume_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars with volume."""
    return cut_lineage(ohlc(trades(spark, folder), 86400))
