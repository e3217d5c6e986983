"""Clock predicates on event time (UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hour ranges [from, to) of trading sessions and kill zones.
SESSIONS = {"london_session": (7, 16), "ny_session": (12, 21), "asian_session": (0, 8), "overlap_session": (12, 16)}
KILL_ZONES = {
    "kz_asian": (0, 3),
    "kz_london": (7, 10),
    "kz_newyork": (12, 15),
    "kz_overlap": (12, 16),
    "kz_london_close": (15, 16),
    "kz_gold": (13, 14),
}
THRESHOLD_SESSIONS = {"LONDON": (8, 13), "OVERLAP": (13, 17), "NEW_YORK": (17, 21)}


def within(hour: Column, span: tuple[int, int]) -> Column:
    return (hour >= span[0]) & (hour < span[1])


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0 (also for an unknown condition)."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


# Symbols that start or end so never close.
OPEN_STARTS, OPEN_ENDS = ("BTC", "ETH"), ("USDT",)


def never_closes(symbol: Column) -> Column:
    found = F.lit(False)
    for start in OPEN_STARTS:
        found = found | symbol.startswith(start)
    for end in OPEN_ENDS:
        found = found | symbol.endswith(end)
    return F.coalesce(found, F.lit(False))


def market_open(ts: Column, symbol: Column | None = None) -> Column:
    """Open from Sunday 21:00 to Friday 21:00; always for a symbol that never closes."""
    day, hour = F.dayofweek(ts), F.hour(ts)
    week = F.when(day == 7, False).when(day == 1, hour >= 21).when(day == 6, hour < 21).otherwise(True)
    return week if symbol is None else never_closes(symbol) | week


def threshold_session(hour: Column) -> Column:
    label = F.lit("ASIAN")
    for name, span in THRESHOLD_SESSIONS.items():
        label = F.when(within(hour, span), F.lit(name)).otherwise(label)
    return label
