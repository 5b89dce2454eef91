"""Column expressions that operators share: guards, ranks, quantile bins, rolling windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """``x``, or null where it is NaN or infinite."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def ratio(num: Column, den: Column) -> Column:
    """``num / den``, or null unless ``den`` is positive: an undefined ratio is never 0."""
    return F.when(den > 0, num / den)


def growth(new: Column, old: Column) -> Column:
    """``new / old - 1``, or null unless ``old`` is positive."""
    return F.when(old > 0, new / old - 1)


def average_rank(x: Column, *group: str) -> Column:
    """Rank of ``x`` within a group, ties averaged, null for null.

    The first and the last rank of a tie come from one order, so a group is sorted and held once.
    """
    w = Window.partitionBy(*(F.col(g) for g in group), x.isNotNull()).orderBy(x)
    upto = F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return F.when(x.isNotNull(), (F.rank().over(w) + upto) / 2)


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson's correlation as an aggregate; null where a side has one value only."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def t_two_sided(t: Column, dof: Column) -> Column:
    """Two-sided p-value of Student's t with a whole number of degrees of freedom: the finite series for even and odd ones."""
    cos2, sin = dof / (dof + t * t), F.abs(t) / F.sqrt(dof + t * t)
    odd = F.pmod(dof, F.lit(2))

    def series(terms: Column) -> Column:
        """1 + x1 + x1 x2 + ...: the ratio of the j-th term to the one before is cos2 (2j - 1) / 2j, or cos2 2j / (2j + 1)."""
        start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

        def add(a: Column, j: Column) -> Column:
            term = a["term"] * cos2 * (2 * j - 1 + odd) / (2 * j + odd)
            return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

        steps = F.when(terms > 0, F.sequence(F.lit(1).cast("long"), terms)).otherwise(F.array().cast("array<bigint>"))
        return F.aggregate(steps, start, add, lambda a: a["sum"])

    even_inside = sin * series(((dof - 2) / 2).cast("long"))
    tail = F.when(dof > 1, sin * F.sqrt(cos2) * series(((dof - 3) / 2).cast("long"))).otherwise(F.lit(0.0))
    odd_inside = (F.atan(F.abs(t) / F.sqrt(dof)) + tail) * 2 / math.pi
    return F.greatest(F.lit(0.0), 1 - F.when(odd == 0, even_inside).otherwise(odd_inside))


def percent_rank_of(x: Column, *group: str) -> Column:
    """Average rank over the group's non-null values."""
    return average_rank(x, *group) / F.count(x).over(Window.partitionBy(*group))


def quantile_bin(place: Column, n: Column, bins: int) -> Column:
    """Bin 0..bins-1 of the ``place``-th (from 1) of ``n`` ordered values, by equal quantile edges.

    Whole-number arithmetic: the ceiling of (place - 1) * bins / (n - 1), less one, at least 0.
    """
    above = (place - 1) * bins + (n - 1) - 1
    ceiling = (above - F.pmod(above, F.greatest(n - 1, F.lit(1)))) / F.greatest(n - 1, F.lit(1))
    return F.greatest(F.lit(0), ceiling.cast("int") - 1)


def top_size(n: Column, fraction: float) -> Column:
    """How many of ``n`` a top fraction takes: half-even rounding, at least one."""
    return F.greatest(F.lit(1), F.bround(n * F.lit(fraction)).cast("int"))


def trailing(rows: int, *partition: str, order: str = "date") -> WindowSpec:
    """The window of the last ``rows`` rows, the current one included."""
    return Window.partitionBy(*partition).orderBy(order).rowsBetween(1 - rows, 0)


def full(value: Column, counted: Column, rows: int, window: WindowSpec) -> Column:
    """``value`` over ``window`` where ``counted`` has at least ``rows`` non-null values."""
    return F.when(F.count(counted).over(window) >= rows, value)


def rolling_median(x: Column, rows: int, *partition: str) -> Column:
    w = trailing(rows, *partition)
    return full(F.percentile(x, F.lit(0.5)).over(w), x, rows, w)


def rolling_std(x: Column, rows: int, *partition: str, least: int | None = None) -> Column:
    w = trailing(rows, *partition)
    return full(F.stddev_samp(x).over(w), x, rows if least is None else least, w)


def winsorised(x: Column, low: float, high: float, *group: str) -> Column:
    """``x`` held between two exact quantiles of its group."""
    w = Window.partitionBy(*group)
    kept = F.greatest(F.percentile(x, F.lit(low)).over(w), F.least(x, F.percentile(x, F.lit(high)).over(w)))
    return F.when(x.isNotNull(), kept)


def zscore(x: Column, *group: str) -> Column:
    """(x - mean) / standard deviation of the group; 0 where the deviation is 0."""
    w = Window.partitionBy(*group)
    std = F.stddev_samp(x).over(w)
    return F.when(std > 0, (x - F.avg(x).over(w)) / std).otherwise(F.when(x.isNotNull() & (std == 0), F.lit(0.0)))


def median_of(x: Column, *group: str) -> Column:
    return F.median(x).over(Window.partitionBy(*group))

