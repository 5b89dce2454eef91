"""Eligibility, per-date normalisation, portfolio weights, panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from . import intervals
from .asof import market_cap
from .returns import delisting_aware_returns, excess, forward_returns


def eligibility(prices: DataFrame, dates: DataFrame, min_price: float, min_dollar_volume: float, window: int = 20) -> DataFrame:
    """date, ticker, close_raw, dollar_vol and ``eligible`` at each date with a price exactly on it.

    ``dollar_vol`` is the trailing median over ``window`` rows, null before that many; null is not eligible.
    """
    traded = prices.withColumn("__dv", F.col("close_raw") * F.col("volume"))
    rolled = traded.withColumn("dollar_vol", X.rolling_median(F.col("__dv"), window, "ticker"))
    ok = (F.col("close_raw") >= min_price) & (F.col("dollar_vol") >= min_dollar_volume)
    return rolled.join(dates, "date").select("date", "ticker", "close_raw", "dollar_vol", F.coalesce(ok, F.lit(False)).alias("eligible"))


def panel(prices: DataFrame, dates: DataFrame, calendar: DataFrame, sector: DataFrame, horizon: int, min_price: float, min_dollar_volume: float) -> DataFrame:
    """The labelled panel: eligible names with a realised forward return; excess returns among them."""
    ok = eligibility(prices, dates, min_price, min_dollar_volume).where("eligible").select("date", "ticker", "close_raw", "dollar_vol")
    return excess(ok.join(forward_returns(prices, dates, calendar, horizon), ["date", "ticker"]), sector)


def member_panel(prices: DataFrame, members: DataFrame, dates: DataFrame, calendar: DataFrame, sector: DataFrame, liquidated: DataFrame, horizon: int, min_price: float, min_dollar_volume: float) -> DataFrame:
    """The panel of names that were members at the date, with delisting-aware returns."""
    ok = eligibility(prices, dates, min_price, min_dollar_volume).where("eligible").select("date", "ticker", "close_raw", "dollar_vol")
    own = ok.join(members, ["date", "ticker"], "left_semi")
    return excess(own.join(delisting_aware_returns(prices, own, calendar, horizon, liquidated), ["date", "ticker"]), sector)


def cap_band_members(prices: DataFrame, facts: DataFrame, dates: DataFrame, reference: DataFrame, excluded: DataFrame, shares_tag: str, cap_low: float, cap_high: float, min_price: float, min_dollar_volume: float, scale: float = 1.0) -> DataFrame:
    """date, ticker, market_cap of eligible names of ``reference`` in a band of market cap, less members of ``excluded`` (intervals)."""
    own = prices.join(reference.select("ticker").distinct(), "ticker", "left_semi")
    ok = eligibility(own, dates, min_price, min_dollar_volume).where("eligible").select("date", "ticker")
    caps = market_cap(own, facts, dates, shares_tag, scale).where(F.col("market_cap").between(cap_low, cap_high))
    return intervals.not_members(ok.join(caps, ["date", "ticker"]), excluded)


#: A group of fewer values is ordered whole; of a larger one the quantile's share and SLACK beyond it, which an error of 1 / ACCURACY can't use up.
FEW_VALUES, SLACK, ACCURACY = 2_000, 0.004, 1_000


def tail_quantiles(rows: DataFrame, features: Sequence[str], low: float = 0.01, high: float = 0.99, group: str = "date") -> DataFrame:
    """``group``, ``<f>_low`` and ``<f>_high``: the exact quantiles of each feature in the group, null without a value; one row a group.

    An exact quantile as an aggregate holds all distinct values of a group, for all features at once.
    Here approximate ones cut off both tails, and only these are ordered, a feature and tail at a
    time.  ``rows`` is read twice: give it stored.
    """
    cut = lambda f: F.percentile_approx(f, F.array(F.lit(low + SLACK), F.lit(high - SLACK)), F.lit(ACCURACY))
    cuts = rows.groupBy(group).agg(F.array(*(F.struct(F.count(f).alias("n"), cut(f).alias("cut")) for f in features)).alias("__cuts"))
    value = F.array(*(F.col(f).cast("double") for f in features))
    each = rows.join(F.broadcast(cuts), group).select(group, F.posexplode(F.arrays_zip(value.alias("x"), F.col("__cuts").alias("c"))).alias("__f", "__e"))
    long = each.select(group, "__f", "__e.x", F.col("__e.c.n").alias("n"), F.col("__e.c.cut").alias("cut")).where("x IS NOT NULL")
    whole = F.col("n") < FEW_VALUES
    bottom, top = whole | (F.col("x") <= F.col("cut")[0]), whole | (F.col("x") >= F.col("cut")[1])
    tails = long.where(bottom | top).select(group, "__f", "x", "n", F.explode(F.array(F.when(bottom, False), F.when(top, True))).alias("top")).where("top IS NOT NULL")
    own = Window.partitionBy(group, "__f", "top").orderBy(F.when(F.col("top"), -F.col("x")).otherwise(F.col("x")))
    inward = F.row_number().over(own) - 1  # from the outer end
    at = (F.col("n") - 1) * F.when(F.col("top"), F.lit(high)).otherwise(F.lit(low))
    placed = tails.withColumns({"at": at, "place": F.when(F.col("top"), F.col("n") - 1 - inward).otherwise(inward)})
    near = placed.where((F.col("place") == F.floor("at")) | (F.col("place") == F.ceil("at")))
    share = F.when(F.floor("at") == F.ceil("at"), 1.0).otherwise(1 - F.abs(F.col("place") - F.col("at")))
    found = near.groupBy(group, "__f", "top").agg(F.sum(share * F.col("x")).alias("q"), F.sum(share).alias("s"))
    sure = F.when(F.abs(F.col("s") - 1) < 1e-6, F.col("q")).otherwise(F.raise_error(F.lit("a quantile lies outside its tail")).cast("double"))
    named = {f"{f}_{side}": F.max(F.when((F.col("__f") == k) & (F.col("top") == (side == "high")), F.col("q"))) for k, f in enumerate(features) for side in ("low", "high")}
    return found.withColumn("q", sure).groupBy(group).agg(*(c.alias(n) for n, c in named.items()))


def normalise(rows: DataFrame, features: Sequence[str], low: float = 0.01, high: float = 0.99, group: str = "date") -> DataFrame:
    """``<f>_z`` (of the winsorised value) and ``<f>_rank`` (percent rank of the raw value) within each date.

    Nulls stay null.  One partitioning serves all features.
    """
    held = rows.withColumns({f"__w_{f}": X.winsorised(F.col(f), low, high, group) for f in features})
    done = held.withColumns({f"{f}_z": X.zscore(F.col(f"__w_{f}"), group) for f in features} | {f"{f}_rank": X.percent_rank_of(F.col(f), group) for f in features})
    return done.drop(*(f"__w_{f}" for f in features))


def less_sector_median(rows: DataFrame, features: Sequence[str], suffix: str = "_sectrel") -> DataFrame:
    """``<f>_sectrel``: the feature less the median of its date and sector, null without a sector."""
    w = Window.partitionBy("date", "sector")
    return rows.withColumns({f + suffix: F.when(F.col("sector").isNotNull(), F.col(f) - F.median(f).over(w)) for f in features})


def own_history_z(rows: DataFrame, features: Sequence[str], window: int = 60, least: int = 24, suffix: str = "_hist") -> DataFrame:
    """``<f>_hist``: the feature against its ticker's last ``window`` rows; null below ``least`` values or without spread."""
    w = X.trailing(window, "ticker")

    def against(f: str):
        std = F.stddev_samp(f).over(w)
        return F.when((F.count(f).over(w) >= least) & (std > 0), (F.col(f) - F.avg(f).over(w)) / std)

    return rows.withColumns({f + suffix: against(f) for f in features})


def equal_weights(scored: DataFrame) -> DataFrame:
    """date, ticker, weight: 1 / n for each date's rows."""
    return scored.select("date", "ticker", (1 / F.count(F.lit(1)).over(Window.partitionBy("date"))).alias("weight"))


def top_fraction(scored: DataFrame, fraction: float = 0.1, signal: str = "signal", ascending: bool = False) -> DataFrame:
    """date, ticker, weight: equal weights of the top (or bottom) fraction by signal, at least one name a date.

    Ties go by ticker; rows without a signal don't count.
    """
    known = scored.where(F.col(signal).isNotNull())
    order = F.col(signal).asc() if ascending else F.col(signal).desc()
    place = F.row_number().over(Window.partitionBy("date").orderBy(order, "ticker"))
    size = X.top_size(F.count(F.lit(1)).over(Window.partitionBy("date")), fraction)
    ranked = known.select("date", "ticker", place.alias("place"), size.alias("size"))
    return ranked.where("place <= size").select("date", "ticker", (F.lit(1.0) / F.col("size")).alias("weight"))


#: The name of the sector of those that have none.
NO_SECTOR = "Unknown"


def sector_codes(names: DataFrame, sector: DataFrame) -> DataFrame:
    """ticker, sector, sector_id of the tickers of ``names``: 0, 1, ... in order of their sectors' names.

    A missing or empty sector is one of its own, with a name and a code like any other.
    """
    own = names.select("ticker").distinct().join(sector, "ticker", "left")
    own = own.select("ticker", F.coalesce(F.nullif("sector", F.lit("")), F.lit(NO_SECTOR)).alias("sector"))
    codes = own.select("sector").distinct().select("sector", (F.dense_rank().over(Window.orderBy("sector")) - 1).alias("sector_id"))
    return own.join(codes, "sector")


def first_per_group(rows: DataFrame, group: str, order: Sequence[str], per: int, most: int) -> DataFrame:
    """The first ``per`` rows of each group, at most ``most`` in all, in order."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("__place", place).where(F.col("__place") <= per).orderBy(group, *order).limit(most).drop("__place")
