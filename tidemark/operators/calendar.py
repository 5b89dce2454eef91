"""Trading sessions: the calendar table, offsets, and rebalance dates.

A calendar has one row per session of an exchange, so the windows here that order all of it see
some thousands of rows whatever the size of the price table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Up to so many rows a table of dates is broadcast: three centuries of sessions.
FEW_DATES = 100_000


def small(dates: DataFrame, like: DataFrame | None = None, most: int = FEW_DATES) -> DataFrame:
    """``dates`` marked for broadcast if it has at most ``most`` rows.

    Counted is ``like`` where it is given: a stored table with at least as many rows.
    """
    return F.broadcast(dates) if (dates if like is None else like).count() <= most else dates


def sessions(prices: DataFrame) -> DataFrame:
    """``session`` and ``session_idx`` (from 1) of every date that has a price."""
    days = prices.select(F.col("date").alias("session")).distinct()
    return days.select("session", F.row_number().over(Window.orderBy("session")).alias("session_idx"))


def snap_map(calendar: DataFrame, lead_in: int = 31) -> DataFrame:
    """``day`` -> ``day_idx`` of the first session on or after it, for all days up to the last session.

    It begins ``lead_in`` days before the first session.
    """
    after = F.coalesce(F.date_add(F.lag("session").over(Window.orderBy("session")), 1), F.date_sub("session", lead_in))
    spans = calendar.select("session", after.alias("after"), F.col("session_idx").alias("day_idx"))
    return spans.select(F.explode(F.sequence("after", "session")).alias("day"), "day_idx")


def offset(rows: DataFrame, calendar: DataFrame, n: int, on: str = "date", to: str = "target") -> DataFrame:
    """``rows`` with ``to``: the date snapped forward to a session, then moved by ``n`` sessions.

    Null where that lies outside the calendar.
    """
    moved = snap_map(calendar).join(calendar.select(F.col("session").alias(to), (F.col("session_idx") - n).alias("day_idx")), "day_idx").select(F.col("day").alias(on), to)
    return rows.join(moved, on, "left")


def month_ends(calendar: DataFrame) -> DataFrame:
    """``date``: the last session of each month."""
    return calendar.groupBy(F.date_trunc("month", "session").alias("m")).agg(F.max("session").alias("date")).select("date")


def between(calendar: DataFrame, start: str | Column, end: str | Column) -> DataFrame:
    """Sessions from ``start`` to ``end``, both included."""
    return calendar.where(F.col("session").between(start, end))


def next_dates(dates: DataFrame) -> DataFrame:
    """``date`` and ``next_date``, the date after it (null for the last)."""
    return dates.select("date", F.lead("date").over(Window.orderBy("date")).alias("next_date"))
