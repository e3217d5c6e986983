"""Registered queries and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

NUDGE = 1e-11

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def r(value: Column | str, digits: int = 6) -> Column:
    """Rounded double without negative zero, as the SQL side writes it.

    The nudge sends exact ties up on both sides, whose last bits differ with the order of operations.
    """
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value.cast("double") + F.lit(NUDGE), digits) + F.lit(0.0)


def rounded(*names: str, digits: int = 6) -> list[Column]:
    return [r(name, digits).alias(name) for name in names]


def ints(*names: str) -> list[Column]:
    return [F.coalesce(F.col(name).cast("int"), F.lit(0)).alias(name) for name in names]


def epoch(name: str = "bar_start", alias: str = "bar_epoch") -> Column:
    return F.unix_timestamp(name).alias(alias)
