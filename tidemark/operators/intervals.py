"""Membership intervals and joins on ranges of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import calendar as cal
from .segments import sum_before


def membership_intervals(log: DataFrame) -> DataFrame:
    """ticker, start, end of a log (ticker, ts, seq, date, action); [start, end), null for open ends.

    Repeated additions count once; a removal without an addition leaves the start open.  Removals are
    counted day by day, so no task orders the whole log of a ticker.
    """
    log = log.where(F.col("action").isin("added", "removed"))
    removed = F.when(F.col("action") == "removed", 1).otherwise(0)
    log = sum_before(log.withColumn("__day", F.to_date("ts")), ["ticker"], "__day", ["ts", "seq"], removed, "island")
    of = lambda action: F.min(F.when(F.col("action") == action, F.col("date")))
    return log.groupBy("ticker", "island").agg(of("added").alias("start"), of("removed").alias("end")).select("ticker", "start", "end")


def inside(date: Column, start: Column, end: Column) -> Column:
    """Whether a date lies in [start, end), nulls being open ends."""
    return (start.isNull() | (start <= date)) & (end.isNull() | (date < end))


def members_on(intervals: DataFrame, dates: DataFrame) -> DataFrame:
    """date, ticker for every date of the (small) date table and every member on it."""
    return intervals.join(cal.small(dates), inside(dates["date"], intervals["start"], intervals["end"])).select("date", "ticker").distinct()


def not_members(rows: DataFrame, intervals: DataFrame) -> DataFrame:
    """Rows (date, ticker ...) whose ticker is no member at the date: equi-join on the ticker, range within."""
    own = intervals.select(F.col("ticker").alias("__t"), "start", "end")
    return rows.join(own, (F.col("ticker") == F.col("__t")) & inside(F.col("date"), F.col("start"), F.col("end")), "left_anti")


def in_universe_at(events: DataFrame, universe: DataFrame, on: str = "date") -> DataFrame:
    """Events whose ticker was in ``universe`` (date, ticker) at the last universe date on or before them.

    Each universe date holds until the next one.  Only distinct days meet universe dates by range (two
    small tables); the events then take an equi-join.
    """
    spans = cal.next_dates(universe.select("date").distinct()).select(F.col("date").alias("__u"), F.col("next_date").alias("__n"))
    at = events.select(on).distinct()
    days = at.join(cal.small(spans), (spans["__u"] <= at[on]) & (spans["__n"].isNull() | (at[on] < spans["__n"]))).select(on, "__u")
    return events.join(days, on).join(universe.select(F.col("date").alias("__u"), "ticker"), ["__u", "ticker"], "left_semi").drop("__u")


def first_in_range(events: DataFrame, marks: DataFrame, low: Column, high: Column, key: str = "ticker", on: str = "date", to: str = "matched") -> DataFrame:
    """``events`` with the earliest mark of their key in (low, high]; events without one go.

    Marks and events are unioned and one window per key, from the latest on, carries the next mark
    back: linear work, where an equi-join with a range would pair every event with every mark.
    """
    asked = events.select(F.col(key).alias("__k"), low.alias("__at"), F.lit(0).alias("__mark"), F.lit(None).cast(marks.schema[on].dataType).alias("__m"), F.struct(*events.columns, high.alias("__high")).alias("__row"))
    kinds = marks.where(F.col(on).isNotNull()).select(F.col(key).alias("__k"), F.col(on).alias("__at"), F.lit(1).alias("__mark"), F.col(on).alias("__m"))
    later = Window.partitionBy("__k").orderBy(F.desc("__at"), "__mark").rowsBetween(Window.unboundedPreceding, 0)
    found = asked.unionByName(kinds, allowMissingColumns=True).withColumn(to, F.last("__m", ignorenulls=True).over(later))
    return found.where((F.col("__mark") == 0) & F.col("__k").isNotNull() & (F.col(to) <= F.col("__row.__high"))).select("__row.*", to).drop("__high")
