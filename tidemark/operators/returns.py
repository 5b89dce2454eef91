"""Forward, holding-period, event and trailing returns, with and without delisting rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import calendar as cal
from .asof import at_points


def spans(prices: DataFrame) -> DataFrame:
    """ticker, first, last: the first and last day with a price, and ``last_price``."""
    own = prices.where(F.col("close_adj").isNotNull())
    return own.groupBy("ticker").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.max_by("close_adj", "date").alias("last_price"))


def _held(prices: DataFrame, dates: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """Every ticker with every date of a small date table (of at most the rows of ``like``) at which it has a price history."""
    own = spans(prices)
    return own.join(cal.small(dates, like), (own["first"] <= dates["date"]) & (dates["date"] <= own["last"]))


def _simple(found: DataFrame, to: str) -> DataFrame:
    return found.where("p0 > 0").select("date", "ticker", (F.col("p1") / F.col("p0") - 1).alias(to))


def forward_returns(prices: DataFrame, dates: DataFrame, calendar: DataFrame, horizon: int, to: str = "fwd_ret_raw") -> DataFrame:
    """date, ticker and the return from each date over ``horizon`` sessions; no row unless realised."""
    targets = cal.offset(dates, calendar, horizon)
    pairs = _held(prices, targets, dates).where("target <= last").select("ticker", "date", "target")
    return _simple(at_points(prices, pairs, {"p0": "date", "p1": "target"}), to)


def lead_return(prices: DataFrame, rows: int) -> DataFrame:
    """``fwd_ret``: the return over the ticker's next ``rows`` rows, null past the end."""
    w = Window.partitionBy("ticker").orderBy("date")
    return prices.withColumn("fwd_ret", F.lead("close_adj", rows).over(w) / F.col("close_adj") - 1)


def trailing_return(rows: int, x: str = "close_adj") -> Column:
    """The return over a ticker's last ``rows`` rows."""
    return F.col(x) / F.lag(x, rows).over(Window.partitionBy("ticker").orderBy("date")) - 1


def _terminal(found: DataFrame, liquidated: DataFrame, target: str, to: str) -> DataFrame:
    """Return to ``target``; of a name that ended before it, to its last price, or -1 if it was liquidated."""
    flagged = found.join(liquidated.select("ticker").distinct().withColumn("liquidated", F.lit(True)), "ticker", "left")
    value = F.when(F.col(target) <= F.col("last"), F.col("p1") / F.col("p0") - 1).when(F.col("liquidated"), -1.0).otherwise(F.col("last_price") / F.col("p0") - 1)
    return flagged.where("p0 > 0").select("date", "ticker", value.alias(to))


def delisting_aware_returns(prices: DataFrame, pairs: DataFrame, calendar: DataFrame, horizon: int, liquidated: DataFrame, to: str = "fwd_ret_raw") -> DataFrame:
    """Forward returns of (date, ticker) pairs; names that stop trading get their terminal return."""
    targets = cal.offset(pairs.select("date", "ticker"), calendar, horizon).where("target IS NOT NULL")
    held = targets.join(spans(prices), "ticker").where("first <= date AND date <= last")
    return _terminal(at_points(prices, held, {"p0": "date", "p1": "target"}), liquidated, "target", to)


def holding_returns(prices: DataFrame, dates: DataFrame, to: str = "ret") -> DataFrame:
    """date, ticker and the return to the next rebalance date, both ends within the price history."""
    pairs = _held(prices, cal.next_dates(dates)).where("next_date <= last").select("ticker", "date", "next_date")
    return _simple(at_points(prices, pairs, {"p0": "date", "p1": "next_date"}), to)


def delisting_aware_holding_returns(prices: DataFrame, dates: DataFrame, liquidated: DataFrame, to: str = "ret") -> DataFrame:
    """Holding returns in which a name that ends within the period gets its terminal return."""
    pairs = _held(prices, cal.next_dates(dates)).where("next_date IS NOT NULL")
    return _terminal(at_points(prices, pairs, {"p0": "date", "p1": "next_date"}), liquidated, "next_date", to)


def event_returns(events: DataFrame, prices: DataFrame, calendar: DataFrame, horizon: int, lag: int = 0, on: str = "date", to: str = "ret") -> DataFrame:
    """``events`` with ``entry`` (the date snapped to a session, plus ``lag``) and the return over ``horizon`` sessions.

    Null if entry or horizon lie outside the calendar, or the name has no price by the entry or
    has stopped trading before it.  Of a name that stops within the horizon, before the calendar's
    last session, the terminal price counts.  Every event of a name with a price comes back, repeated
    ones too; events of names without any price are left out.
    """
    last_session = calendar.agg(F.max("session").alias("last_session"))
    rows = cal.offset(cal.offset(events, calendar, lag, on=on, to="entry"), calendar, horizon, on="entry", to="__target")
    own = spans(prices).join(F.broadcast(last_session), F.col("last") <= F.col("last_session"))  # one row
    held = rows.join(own.select("ticker", "last", "last_price", (F.col("last") < F.col("last_session")).alias("ended")), "ticker", "left")
    found = held.join(prices.select("ticker").distinct(), "ticker", "left_semi")
    found = at_points(prices, found, {"p0": "entry", "p1": "__target"})
    value = F.when(F.col("__target") <= F.col("last"), F.col("p1")).when(F.col("ended") & F.col("__target").isNotNull(), F.col("last_price"))
    known = F.when((F.col("p0") > 0) & (F.col("entry") <= F.col("last")), value / F.col("p0") - 1)
    return found.select(*events.columns, "entry", known.alias(to))


def momentum_12_1(prices: DataFrame, dates: DataFrame, calendar: DataFrame, skip: int = 21, form: int = 252, to: str = "signal") -> DataFrame:
    """date, ticker, adj(t - skip) / adj(t - form) - 1; needs a price at or before the formation date.

    A name that has stopped trading keeps its last signal.
    """
    moved = cal.offset(cal.offset(dates, calendar, -form, to="far"), calendar, -skip, to="near").where("far IS NOT NULL AND near IS NOT NULL")
    own = spans(prices)
    pairs = own.join(cal.small(moved, dates), own["first"] <= moved["far"]).select("ticker", "date", "far", "near")
    found = at_points(prices, pairs, {"p0": "far", "p1": "near"})
    return _simple(found, to)


def excess(rows: DataFrame, sector: DataFrame, x: str = "fwd_ret_raw") -> DataFrame:
    """``rows`` with ``excess_median`` and ``excess_sector``: less the date's, and the date and sector's, median.

    The sector excess of a name without a sector is null.
    """
    known = rows.join(sector, "ticker", "left")
    by_date, by_sector = Window.partitionBy("date"), Window.partitionBy("date", "sector")
    return known.withColumns(
        {
            "excess_median": F.col(x) - F.median(x).over(by_date),
            "excess_sector": F.when(F.col("sector").isNotNull(), F.col(x) - F.median(x).over(by_sector)),
        }
    )


def net_of_costs(rows: DataFrame, x: str, bps: list[float], to: str = "net") -> DataFrame:
    """``rows`` once for each cost: ``x`` less a round trip of ``bps`` each way."""
    each = F.explode(F.array(*(F.lit(float(b)) for b in bps)))
    return rows.withColumn("bps", each).withColumn(to, F.col(x) - 2 * F.col("bps") / 1e4)
