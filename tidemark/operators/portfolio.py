"""Portfolios as tables: weights, returns, drift, turnover and cost for every date at once.

The next period needs only the previous period's target weights, so nothing is iterated: each date
joins its predecessor.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import evalstats


def target_weights(signals: DataFrame, holding: DataFrame, policy: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """date, ticker, weight of ``policy`` at the signal dates that have holding returns."""
    return policy(signals.join(holding.select("date").distinct(), "date", "left_semi"))


def gross_returns(weights: DataFrame, holding: DataFrame) -> DataFrame:
    """date, gross: the weighted returns; a name without a return counts 0."""
    held = weights.join(holding, ["date", "ticker"], "left")
    return held.groupBy("date").agg(F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("gross"))


def drifted(weights: DataFrame, holding: DataFrame, drift: str = "current") -> DataFrame:
    """date, ticker, prior: the previous date's target weights after drift, renormalised to 1 if positive.

    ``drift`` says whose returns move them: ``current`` those of the period from the date on (as in
    the published results), ``previous`` those of the period up to it.
    """
    dates = weights.select("date").distinct()
    after = dates.select(F.col("date").alias("was"), F.lead("date").over(Window.orderBy("date")).alias("date")).where("date IS NOT NULL")
    before = weights.select(F.col("date").alias("was"), "ticker", "weight").join(after, "was")
    moved = before.join(holding, ["date", "ticker"], "left") if drift == "current" else before.join(holding.select(F.col("date").alias("was"), "ticker", "ret"), ["was", "ticker"], "left")
    grown = moved.select("date", "ticker", (F.col("weight") * (1 + F.coalesce("ret", F.lit(0.0)))).alias("w"))
    total = F.sum("w").over(Window.partitionBy("date"))
    return grown.select("date", "ticker", F.when(total > 0, F.col("w") / total).otherwise(F.col("w")).alias("prior"))


def trading(weights: DataFrame, prior: DataFrame, bps: float) -> DataFrame:
    """date, traded (sum of weight changes), turnover (half of it) and cost."""
    both = weights.join(prior, ["date", "ticker"], "full")
    traded = F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("prior", F.lit(0.0))))
    return both.groupBy("date").agg(traded.alias("traded")).select("date", "traded", (F.col("traded") / 2).alias("turnover"), (F.lit(bps) / 1e4 * F.col("traded")).alias("cost"))


def backtest(signals: DataFrame, holding: DataFrame, policy: Callable[[DataFrame], DataFrame], bps: float = 6.0, drift: str = "current") -> DataFrame:
    """date, gross, net, turnover, cost of a policy."""
    weights = target_weights(signals, holding, policy)
    costs = trading(weights, drifted(weights, holding, drift), bps)
    return gross_returns(weights, holding).join(costs, "date").select("date", "gross", (F.col("gross") - F.col("cost")).alias("net"), "turnover", "cost")


def cost_sweep(result: DataFrame, bps: list[float], periods: float = 12.0) -> DataFrame:
    """bps and the performance of a backtest under each cost: the costs are scaled, nothing is run again."""
    each = result.withColumn("bps", F.explode(F.array(*(F.lit(float(b)) for b in bps)))).withColumn("ret", F.col("gross") - F.col("bps") / 1e4 * 2 * F.col("turnover"))
    return evalstats.performance(each, "ret", "bps", periods=periods)


def common_dates(results: DataFrame) -> DataFrame:
    """``results`` (strategy, date ...) at the dates that every strategy has."""
    n = results.select("strategy").distinct().agg(F.count(F.lit(1)).alias("n"))
    shared = results.groupBy("date").agg(F.countDistinct("strategy").alias("k")).join(F.broadcast(n), F.col("k") == F.col("n"))
    return results.join(shared.select("date"), "date", "left_semi")


def compare(results: DataFrame, periods: float = 12.0) -> DataFrame:
    """strategy, kind (gross or net) and the performance over the common dates, average turnover too."""
    own = common_dates(results)
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("ret")) for k in ("gross", "net"))))
    long = own.select("strategy", "date", kinds.alias("k")).select("strategy", "date", "k.*")
    stats = evalstats.performance(long, "ret", "strategy", "kind", periods=periods)
    return stats.join(own.groupBy("strategy").agg(F.avg("turnover").alias("avg_turnover")), "strategy")


def leg_returns(scored: DataFrame, holding: DataFrame, fraction: float = 0.1, signal: str = "signal", periods: float = 12.0) -> tuple[DataFrame, DataFrame]:
    """date, long, short of the top and bottom fractions (missing returns skipped), and the spread's mean and Sharpe."""
    from .crosssec import top_fraction

    def leg(name: str, ascending: bool) -> DataFrame:
        own = top_fraction(scored, fraction, signal, ascending).join(holding, ["date", "ticker"], "left")
        return own.groupBy("date").agg(F.avg("ret").alias(name))

    legs = leg("long", False).join(leg("short", True), "date")
    spread = F.col("long") - F.col("short")
    std = F.stddev_samp(spread)
    return legs, legs.agg(F.avg(spread).alias("mean_spread"), F.when(std > 0, F.avg(spread) / std * F.sqrt(F.lit(periods))).alias("sharpe"))
