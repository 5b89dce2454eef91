"""Rank information coefficients, quantile spreads, performance and event statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X


def information_coefficients(scored: DataFrame, signal: str, target: str, group: Sequence[str] = ("date",), least: int = 5) -> DataFrame:
    """``group`` columns, ``ic`` (Spearman) and ``n`` of every group with ``least`` rows and more than one value on both sides."""
    known = scored.where(F.col(signal).isNotNull() & F.col(target).isNotNull())
    ranked = known.select(*group, X.average_rank(F.col(signal), *group).alias("rs"), X.average_rank(F.col(target), *group).alias("rt"))
    found = ranked.groupBy(*group).agg(
        X.correlation("rs", "rt").alias("ic"), F.count(F.lit(1)).alias("n"), (F.min("rs") < F.max("rs")).alias("s"), (F.min("rt") < F.max("rt")).alias("t")
    )
    return found.where((F.col("n") >= least) & F.col("s") & F.col("t")).select(*group, "ic", "n")


def ic_summary(ics: DataFrame, *group: str) -> DataFrame:
    """n, mean_ic, std_ic, ir, t_stat and positive share; std, ir and t are null for one date.

    A coefficient within rounding of zero isn't positive.
    """
    std = F.stddev_samp("ic")
    of = ics.groupBy(*group) if group else ics
    return of.agg(
        F.count("ic").alias("n_dates"), F.avg("ic").alias("mean_ic"), std.alias("std_ic"),
        F.when(std > 0, F.avg("ic") / std).alias("ir"), F.when(std > 0, F.avg("ic") / (std / F.sqrt(F.count("ic")))).alias("t_stat"),
        F.avg(F.when(F.col("ic") > 1e-12, 1.0).otherwise(0.0)).alias("positive_share"),
    )


def quantile_bins(scored: DataFrame, signal: str, bins: int = 10, group: str = "date") -> DataFrame:
    """``scored`` with ``bin`` by equal quantiles of the first-rank of the signal; groups smaller than ``bins`` go."""
    known = scored.where(F.col(signal).isNotNull())
    place = F.row_number().over(Window.partitionBy(group).orderBy(signal, "ticker"))
    counted = known.withColumns({"__place": place, "__n": F.count(F.lit(1)).over(Window.partitionBy(group))})
    return counted.where(F.col("__n") >= bins).withColumn("bin", X.quantile_bin(F.col("__place"), F.col("__n"), bins)).drop("__place", "__n")


def quantile_returns(scored: DataFrame, signal: str, target: str, bins: int = 10, group: str = "date") -> DataFrame:
    """bin, mean_ret: the mean over groups of each bin's mean target."""
    known = scored.where(F.col(target).isNotNull())
    each = quantile_bins(known, signal, bins, group).groupBy(group, "bin").agg(F.avg(target).alias("m"))
    return each.groupBy("bin").agg(F.avg("m").alias("mean_ret"), F.count("m").alias("n_groups"))


def quantile_summary(by_bin: DataFrame, bins: int = 10) -> DataFrame:
    """top_minus_bottom and monotonicity (Spearman of bin and mean) of a quantile table."""
    ranked = by_bin.withColumn("__all", F.lit(0)).withColumn("r", X.average_rank(F.col("mean_ret"), "__all"))
    at = lambda k: F.max(F.when(F.col("bin") == k, F.col("mean_ret")))
    return ranked.agg((at(bins - 1) - at(0)).alias("top_minus_bottom"), X.correlation(F.col("bin").cast("double"), "r").alias("monotonicity"))


def equity_curve(returns: DataFrame, x: str = "ret", *group: str) -> DataFrame:
    """``returns`` with ``equity`` (growth of 1), ``peak`` and ``drawdown``, in date order within each group."""
    w = Window.partitionBy(*group).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    grown = returns.withColumn("equity", F.product(1 + F.col(x)).over(w))
    return grown.withColumn("peak", F.max("equity").over(w)).withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def performance(returns: DataFrame, x: str = "ret", *group: str, periods: float = 12.0, risk_free: float = 0.0) -> DataFrame:
    """n, cagr, ann_vol, sharpe, sortino, max_drawdown, hit_rate of per-date returns of each group.

    The deviation for Sortino is that of the negative returns alone.
    """
    curve = equity_curve(returns.where(F.col(x).isNotNull()), x, *group)
    r, n = F.col(x), F.count(F.lit(1))
    std, down = F.stddev_samp(r), F.stddev_samp(F.when(r < 0, r))
    mean = F.avg(r) - risk_free / periods
    root = F.sqrt(F.lit(periods))
    of = curve.groupBy(*group) if group else curve
    return of.agg(
        n.alias("n"), (F.pow(F.product(1 + r), F.lit(periods) / n) - 1).alias("cagr"), (std * root).alias("ann_vol"),
        F.when(std > 0, mean / std * root).alias("sharpe"), F.when(down > 0, mean / down * root).alias("sortino"),
        F.min("drawdown").alias("max_drawdown"), F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("hit_rate"),
    )


def backtest_performance(result: DataFrame, *group: str, periods: float = 12.0) -> DataFrame:
    """:func:`performance` of a backtest's net returns with ``avg_turnover`` and ``total_cost_drag``: what costs took of the final growth of 1."""
    known = result.where(F.col("net").isNotNull())
    grown = lambda x: F.product(1 + F.col(x))
    costs = (known.groupBy(*group) if group else known).agg(F.avg("turnover").alias("avg_turnover"), (grown("gross") - grown("net")).alias("total_cost_drag"))
    found = performance(known, "net", *group, periods=periods)
    return found.join(costs, list(group)) if group else found.join(F.broadcast(costs))  # one row each


def event_statistics(rows: DataFrame, x: str, *group: str, least: int = 1) -> DataFrame:
    """n, mean, median and one-sample t (null up to 2 values) of each group with ``least`` values."""
    c, std = F.col(x), F.stddev_samp(x)
    of = rows.where(c.isNotNull())
    of = of.groupBy(*group) if group else of
    t = F.when((F.count(c) > 2) & (std > 0), F.avg(c) / (std / F.sqrt(F.count(c))))
    return of.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.median(c).alias("median"), t.alias("t_stat")).where(F.col("n") >= least)


def coverage(features: DataFrame, panel: DataFrame, names: Sequence[str], targets: Sequence[str], least: int = 5) -> DataFrame:
    """feature, target, coverage, missing_rate and the IC summary of each pair: one unpivot, one pass."""
    joined = panel.select("date", "ticker", *targets).join(features.select("date", "ticker", *names), ["date", "ticker"], "left")
    each_f = F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("x")) for n in names)))
    each_t = F.explode(F.array(*(F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("y")) for t in targets)))
    long = joined.select("date", "ticker", *targets, each_f.alias("f")).select("date", "ticker", "f.*", each_t.alias("t")).select("date", "ticker", "feature", "x", "t.*")
    filled = long.groupBy("feature", "target").agg(F.avg(F.col("x").isNotNull().cast("double")).alias("coverage"), F.avg(F.col("x").isNull().cast("double")).alias("missing_rate"))
    ics = ic_summary(information_coefficients(long, "x", "y", ("feature", "target", "date"), least), "feature", "target")
    return filled.join(ics.select("feature", "target", "n_dates", "mean_ic", "t_stat"), ["feature", "target"], "left")


def names_per_date(rows: DataFrame) -> DataFrame:
    """min, median, max and the first and last date's number of names."""
    n = rows.groupBy("date").agg(F.countDistinct("ticker").alias("n"))
    return n.agg(F.min("n").alias("min_n"), F.median("n").alias("median_n"), F.max("n").alias("max_n"), F.min_by("n", "date").alias("first_n"), F.max_by("n", "date").alias("last_n"))


def jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """date, jaccard of two (date, ticker) tables."""
    both = a.select("date", "ticker").distinct().withColumn("__a", F.lit(1)).join(b.select("date", "ticker").distinct().withColumn("__b", F.lit(1)), ["date", "ticker"], "full")
    common = F.sum(F.when(F.col("__a").isNotNull() & F.col("__b").isNotNull(), 1).otherwise(0))
    return both.groupBy("date").agg((common / F.count(F.lit(1))).alias("jaccard"))


def persistence(rows: DataFrame, first: Column, second: Column, member: str = "member", x: str = "ret", least: int = 25, least_each: int = 10) -> DataFrame:
    """Per-member means in two periods, of members with enough rows in all and enough returns in each period.

    ``n`` counts all rows of a member, with a return or without and of any period; ``n1`` and ``n2`` count returns.
    """
    v = F.col(x)
    own = rows.groupBy(member).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(first, v)).alias("n1"), F.count(F.when(second, v)).alias("n2"), F.avg(F.when(first, v)).alias("p1"), F.avg(F.when(second, v)).alias("p2")
    )
    return own.where((F.col("n") >= least) & (F.col("n1") >= least_each) & (F.col("n2") >= least_each))


def overall_ranks(rows: DataFrame, *columns: str, buckets: int = 256) -> DataFrame:
    """``rows`` with ``<c>_rank`` (ties averaged) and ``<c>_place`` (row number) of each column over the whole table.

    Ranks are taken within ranges of values, whose limits are approximate quantiles (``buckets`` of
    them), and raised by the sizes of the ranges below: no task orders the whole table.
    """
    for c in columns:
        limits = rows.where(F.col(c).isNotNull()).agg(F.percentile_approx(F.col(c).cast("double"), F.array(*(F.lit(k / buckets) for k in range(1, buckets))), 10_000).alias("q")).head()["q"]
        found = F.size(F.filter(F.array(*(F.lit(float(x)) for x in sorted(set(limits or ())))).cast("array<double>"), lambda x: x < F.col(c)))
        own = rows.where(F.col(c).isNotNull()).withColumn("__bucket", found)
        sizes = own.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
        below = sizes.select("__bucket", F.coalesce(F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__below"))
        ranks = {f"{c}_rank": X.average_rank(F.col(c), "__bucket"), f"{c}_place": F.row_number().over(Window.partitionBy("__bucket").orderBy(c))}
        rows = own.withColumns(ranks).join(F.broadcast(below), "__bucket")  # at most ``buckets`` rows
        rows = rows.withColumns({name: F.col(name) + F.col("__below") for name in ranks}).drop("__bucket", "__below")
    return rows


def persistence_summary(members: DataFrame, share: float = 0.8, least: int = 5) -> DataFrame:
    """Only n where there are fewer than ``least`` members; else n, rank correlation of the two periods with its two-sided ``p_value``, and the second period of the
    first period's top fifth (``n_top``, ``top_mean``) against the rest (``rest_mean``, ``top_minus_rest``)."""
    ranked = overall_ranks(members, "p1", "p2")
    size = members.where("p1 IS NOT NULL AND p2 IS NOT NULL").agg(((F.count(F.lit(1)) - 1) * share + 1).alias("__at"))
    near = ranked.join(F.broadcast(size), F.abs(F.col("p1_place") - F.col("__at")) < 1).agg(
        F.sum(F.col("p1") * (1 - F.abs(F.col("p1_place") - F.col("__at")))).alias("cut")
    )  # the quantile lies between its two nearest values
    top = F.col("p1") >= F.col("cut")
    of = lambda cond: F.avg(F.when(cond, F.col("p2")))
    found = ranked.join(F.broadcast(near)).agg(F.count(F.lit(1)).alias("n"), X.correlation("p1_rank", "p2_rank").alias("rho"), F.sum(top.cast("long")).alias("n_top"), of(top).alias("top_mean"), of(~top).alias("rest_mean"))
    t = F.col("rho") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("rho") * F.col("rho")))
    p = F.when((F.col("n") > 2) & (F.abs("rho") < 1), X.t_two_sided(t, F.col("n") - 2))
    own = {"rho": F.col("rho"), "p_value": p, "n_top": F.col("n_top"), "top_mean": F.col("top_mean"), "rest_mean": F.col("rest_mean"), "top_minus_rest": F.col("top_mean") - F.col("rest_mean")}
    return found.select("n", *(F.when(F.col("n") >= least, c).alias(name) for name, c in own.items()))


def fold_summary(ics: DataFrame, *setting: str) -> DataFrame:
    """Of per-date coefficients (fold, ic): n_folds, the mean and IR over folds of each fold's mean, the share of positive folds, and the mean over dates."""
    each = ics.groupBy(*setting, "fold").agg(F.avg("ic").alias("fold_ic"))
    pooled = (ics.groupBy(*setting) if setting else ics).agg(F.avg("ic").alias("mean_ic"))
    std = F.stddev_samp("fold_ic")
    of = (each.groupBy(*setting) if setting else each).agg(
        F.count(F.lit(1)).alias("n_folds"), F.avg("fold_ic").alias("mean_fold_ic"), F.when(std > 0, F.avg("fold_ic") / std).alias("ic_ir"), F.avg((F.col("fold_ic") > 0).cast("double")).alias("positive_folds")
    )
    return of.join(pooled, list(setting)) if setting else of.join(F.broadcast(pooled))  # one row each


def select_model(candidates: DataFrame) -> DataFrame:
    """The best of (model, target, ic_ir, positive_folds, mean_ic), ties to the sector target."""
    tie = F.when(F.col("target").contains("sector"), 1).otherwise(0)
    return candidates.orderBy(F.round("ic_ir", 3).desc(), F.col("positive_folds").desc(), F.round("mean_ic", 4).desc(), tie.desc(), "model").limit(1)


def modal_setting(chosen: DataFrame, key: str, *tie_order: Column) -> DataFrame:
    """The setting chosen most often, ties by ``tie_order``."""
    return chosen.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), *tie_order).limit(1)
