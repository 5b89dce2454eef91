"""Event sequences: clusters of actors, surprises, reconciliation of two sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .segments import last_before


def _days(column: str):
    return F.datediff(F.col(column), F.lit("1970-01-01").cast("date"))


def _by_day(trades: DataFrame, days: int, on: str, flag: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``trades`` with ``__day``, ``__new`` (1 where the member wasn't among the ticker's actors) and ``__flag``,
    and (ticker, day) rows with the actors, the value and the flags that the day begins with.

    A member counts from a trade until ``days`` days have passed without another, so the number of
    actors is a running sum of comings and goings.  Those are first summed by day: what is ordered
    within a ticker has a row a day, however many trades there are.
    """
    own = Window.partitionBy("ticker", "member").orderBy("__day", "seq")
    flagged = F.coalesce(F.col(flag).cast("int"), F.lit(0)) if flag else F.lit(0)
    of = trades.withColumns({"__day": _days(on), "__flag": flagged})
    gap = lambda x: F.coalesce(x, F.lit(days + 1)) > days
    of = of.withColumns({"__new": gap(F.col("__day") - F.lag("__day").over(own)).cast("int"), "__gone": gap(F.lead("__day").over(own) - F.col("__day")).cast("int")})
    came = of.groupBy("ticker", "__day").agg(F.sum("__new").alias("came"), F.sum("value").alias("value"), F.sum("__flag").alias("flags"))
    left = of.groupBy("ticker", (F.col("__day") + days + 1).alias("__day")).agg(F.sum("__gone").alias("left"))
    both = came.unionByName(left, allowMissingColumns=True).groupBy("ticker", "__day").agg(*(F.max(c).alias(c) for c in ("came", "left", "value", "flags")))
    w = Window.partitionBy("ticker").orderBy("__day")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    begun = F.coalesce(F.sum("came").over(before), F.lit(0)) - F.coalesce(F.sum("left").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    near = w.rangeBetween(-days, -1)
    daily = both.select(
        F.col("ticker").alias("__t"), F.col("__day").alias("__d"), begun.alias("__begun"), F.sum("value").over(near).alias("__held"), F.coalesce(F.sum("flags").over(near), F.lit(0)).alias("__flagged"),
        F.col("came").alias("__came"), F.col("value").alias("__value"),
    )
    return of.drop("__gone"), daily


def _with_days(of: DataFrame, daily: DataFrame) -> DataFrame:
    return of.join(daily, F.col("ticker").eqNullSafe(F.col("__t")) & F.col("__day").eqNullSafe(F.col("__d")))


def distinct_actors(trades: DataFrame, days: int, on: str = "filing_date", flag: str | None = None) -> DataFrame:
    """``trades`` (seq, ticker, member, ...) with ``n_actors`` and ``window_value`` of the ticker's last ``days`` days,
    and ``any_<flag>``: whether a trade among them has the (boolean) ``flag``.

    Row-exact: of a day's trades only those up to the row's ``seq`` count.  Trades are ordered
    within their day only, so a ticker with a third of all trades is as many tasks as it has days.
    """
    of, daily = _by_day(trades, days, on, flag)
    upto = Window.partitionBy("ticker", "__day").orderBy("seq").rangeBetween(Window.unboundedPreceding, 0)
    counted = _with_days(of.withColumns({"__own": F.sum("__new").over(upto), "__sum": F.sum("value").over(upto), "__flags": F.sum("__flag").over(upto)}), daily)
    value = F.coalesce(F.col("__held"), F.lit(0.0)) + F.coalesce(F.col("__sum"), F.lit(0.0))
    any_flag = [(F.col("__flagged") + F.col("__flags") > 0).alias(f"any_{flag}")] if flag else []
    return counted.select(*trades.columns, (F.col("__begun") + F.col("__own")).cast("int").alias("n_actors"), value.alias("window_value"), *any_flag)


def distinct_actors_by_day(trades: DataFrame, days: int, on: str = "filing_date") -> DataFrame:
    """As :func:`distinct_actors`, with all of a day's trades counted."""
    counted = _with_days(*_by_day(trades, days, on))
    value = F.coalesce(F.col("__held"), F.lit(0.0)) + F.coalesce(F.col("__value"), F.lit(0.0))
    return counted.select(*trades.columns, (F.col("__begun") + F.col("__came")).cast("int").alias("n_actors"), value.alias("window_value"))


def clusters(counted: DataFrame, least: int, on: str = "filing_date") -> DataFrame:
    """``counted`` with ``active`` (at least ``least`` actors) and ``is_event`` (the first active row of an episode).

    The row before is the day's own, or else the last of an earlier day, carried by days.
    """
    found = last_before(counted, ["ticker"], on, ["seq"], F.col("n_actors"), "__was")
    active = F.col("n_actors") >= least
    return found.withColumns({"active": active, "is_event": active & (F.coalesce("__was", F.lit(0)) < least)}).drop("__was")


def value_clusters(counted: DataFrame, least: int, value: float, on: str = "filing_date") -> DataFrame:
    """One event an episode: its first row whose window is worth ``value``; an episode lasts while there are ``least`` actors.

    A row below ``least`` disarms its ticker, one worth ``value`` fires it, others leave it as it is;
    the last row that did either is carried by days.
    """
    fires = (F.col("n_actors") >= least) & (F.col("window_value") >= value)
    state = F.when(F.col("n_actors") < least, False).when(fires, True)
    found = last_before(counted, ["ticker"], on, ["seq"], state, "__fired")
    return found.where(fires & ~F.coalesce("__fired", F.lit(False))).drop("__fired")


def first_vintage(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")


def surprises(quarterly: DataFrame, lag: int = 4, window: int = 8, least: int = 6, least_quarters: int = 10) -> DataFrame:
    """``quarterly`` (ticker, period, eps) with ``sue``: the change over ``lag`` quarters by its trailing deviation.

    Tickers with fewer than ``least_quarters`` rows go; so do rows without a surprise.
    """
    w = Window.partitionBy("ticker").orderBy("period")
    near = w.rowsBetween(1 - window, 0)
    changed = quarterly.withColumn("change", F.col("eps") - F.lag("eps", lag).over(w)).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("ticker")))
    std = F.when(F.count("change").over(near) >= least, F.stddev_samp("change").over(near))
    return changed.withColumn("sue", F.when(std > 0, F.col("change") / std)).where((F.col("__n") >= least_quarters) & F.col("sue").isNotNull()).drop("__n")


def reconcile(a: DataFrame, b: DataFrame, key: list[str], a_date: str, b_date: str, days: int = 1) -> DataFrame:
    """overlap and the share of common keys whose dates agree within ``days``."""
    join_key = lambda: F.concat_ws("|", *(F.lower(F.trim(F.col(k).cast("string"))) for k in key))
    x = a.select(join_key().alias("key"), F.col(a_date).alias("da")).groupBy("key").agg(F.min("da").alias("da"))
    y = b.select(join_key().alias("key"), F.col(b_date).alias("db")).groupBy("key").agg(F.min("db").alias("db"))
    agree = F.abs(F.datediff("da", "db")) <= days
    return x.join(y, "key").agg(F.count(F.lit(1)).alias("overlap"), F.avg(agree.cast("double")).alias("date_agree"))
