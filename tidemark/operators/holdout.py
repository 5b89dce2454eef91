"""One evaluation of a frozen configuration on dates that no choice has seen, as one long table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import crosssec, evalstats, portfolio, walkforward


def frozen_ridge(panel: DataFrame, features: Sequence[str], target: str, picks: DataFrame, train: Column, test: Column) -> DataFrame:
    """alpha, date, ticker, actual, pred at the dates of ``test`` of one ridge fitted on those of ``train``.

    Its penalty is the one picked most often (``picks``: a row a fold, with ``alpha``), the larger of
    equally frequent ones.  Rows whose target is unknown neither train nor come back.
    """
    modal = evalstats.modal_setting(picks, "alpha", F.desc("alpha"))
    dates = panel.select("date").distinct()
    of = lambda cond: dates.where(cond).select(F.lit(0).alias("cell"), "date")
    alphas = sorted(r["alpha"] for r in picks.select("alpha").distinct().collect())  # at most the penalties tried
    weights = walkforward.fit_ridges(panel, features, [target], of(train), alphas).join(F.broadcast(modal.select("alpha")), "alpha", "left_semi")
    return walkforward.predict_ridges(panel, features, [target], of(test), weights).where("actual IS NOT NULL").select("alpha", "date", "ticker", "actual", "pred")


def listed(part: str, rows: DataFrame, *key: str) -> DataFrame:
    """part, name, value: every number of ``rows`` in a row of its own, named by the key's values and the column."""
    named = lambda c: F.concat_ws(" ", *(F.col(k).cast("string") for k in key), F.lit(c))
    each = F.array(*(F.struct(named(c).alias("name"), F.col(c).cast("double").alias("value")) for c in rows.columns if c not in key))
    return rows.select(F.explode(each).alias("e")).select(F.lit(part).alias("part"), "e.*")


def window(dates: DataFrame) -> DataFrame:
    """first, last (as yyyymmdd) and n_dates of a table's dates."""
    whole = lambda c: F.date_format(c, "yyyyMMdd").cast("double")
    return dates.agg(whole(F.min("date")).alias("first"), whole(F.max("date")).alias("last"), F.countDistinct("date").alias("n_dates"))


def report(predicted: DataFrame, exposure: DataFrame, universe: DataFrame, holding: DataFrame, market: DataFrame, bps: float = 6.0, periods: float = 12.0, bins: int = 10, fraction: float = 0.1) -> DataFrame:
    """part, name, value of predictions (date, ticker, actual, pred).

    Parts: ``window``, ``ic`` and ``year`` (rank coefficients, whole and by year), ``decile`` (mean
    label by bin, the spread, monotonicity), ``exposure`` (mean rank correlation with a column
    ``exposure`` by date and ticker), ``legs`` (top and bottom fractions, missing returns skipped) and
    ``backtest``: the top fraction (``model``), all of ``universe`` (``equal``) and the benchmark
    (``market``, held at each of its dates), after costs, over the dates that all three have
    (``common``).  ``holding`` and ``market`` have returns to the next date.
    """
    scored = walkforward.stored(predicted.select("date", "ticker", "actual", "pred"))  # every part reads it
    ics = evalstats.information_coefficients(scored, "pred", "actual")
    by_bin = evalstats.quantile_returns(scored, "pred", "actual", bins)
    along = evalstats.information_coefficients(scored.join(exposure.select("date", "ticker", "exposure"), ["date", "ticker"]), "pred", "exposure", least=1)
    held = walkforward.stored(holding.join(F.broadcast(universe.select("date").distinct()), "date", "left_semi"))  # one short row a date
    legs, spread = portfolio.leg_returns(scored, held, fraction, "pred", periods)
    of_legs = legs.agg(F.avg("long").alias("long_mean"), F.avg("short").alias("short_mean"))
    runs = {
        "model": portfolio.backtest(scored, held, partial(crosssec.top_fraction, fraction=fraction, signal="pred"), bps),
        "equal": portfolio.backtest(universe.select("date", "ticker"), held, crosssec.equal_weights, bps),
        "market": portfolio.backtest(market.select("date", "ticker"), market, crosssec.equal_weights, bps),
    }
    every = walkforward.stored(reduce(DataFrame.unionByName, (rows.withColumn("strategy", F.lit(name)) for name, rows in runs.items())))
    common = portfolio.common_dates(every)
    parts = [
        listed("window", window(scored)), listed("ic", evalstats.ic_summary(ics)), listed("year", evalstats.ic_summary(ics.withColumn("year", F.year("date")), "year"), "year"),
        listed("decile", by_bin, "bin"), listed("decile", evalstats.quantile_summary(by_bin, bins)), listed("exposure", along.agg(F.count("ic").alias("n_dates"), F.avg("ic").alias("mean_corr"))),
        listed("legs", of_legs), listed("legs", spread), listed("backtest", evalstats.backtest_performance(common, "strategy", periods=periods), "strategy"), listed("common", window(common)),
    ]
    return reduce(DataFrame.unionByName, parts)
