"""Feature families: each a function from contracts to (date, ticker, features)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr as X
from ..session import ship
from . import calendar as cal
from . import rolling
from .asof import at_points, carried, facts_asof, facts_at_offsets, series_asof
from .crosssec import less_sector_median, normalise, own_history_z, sector_codes
from .returns import trailing_return

MOMENTUM = ("ret_1m", "ret_3m", "ret_6m", "ret_12_1", "vol_6m", "vol_12m", "dist_52w_high", "dvol_trend")
VALUATION = ("earnings_yield", "sales_yield", "ev_ebitda", "book_to_price")
QUALITY = ("roe", "roic", "roa", "gross_margin", "op_margin", "net_margin", "ebitda_margin", "debt_to_equity", "current_ratio", "interest_coverage", "fcf_yield", "fcf_margin")
#: Quality levels that are also given relative to the sector.
SECTOR_QUALITY = ("roe", "roic", "roa", "gross_margin", "op_margin", "net_margin", "debt_to_equity", "fcf_yield", "fcf_margin")
GROWTH = ("rev_yoy", "eps_yoy", "gp_yoy", "fcf_yoy", "rev_accel", "eps_accel", "net_margin_trend", "gross_margin_trend")


def momentum_columns(prices: DataFrame, windows: Mapping[str, int] | None = None) -> DataFrame:
    """``prices`` with the eight momentum features of each row, from rows up to it only."""
    n = {"m1": 21, "m3": 63, "m6": 126, "m12": 252} | dict(windows or {})
    lagged = lambda k: F.lag("close_adj", k).over(cal.Window.partitionBy("ticker").orderBy("date"))
    steps = {f"ret_{name}": trailing_return(n[m]) for name, m in (("1m", "m1"), ("3m", "m3"), ("6m", "m6"))} | {"ret_12_1": lagged(n["m1"]) / lagged(n["m12"]) - 1}
    base = prices.withColumns(steps | {"__r": trailing_return(1), "__dv": F.col("close_raw") * F.col("volume")})
    each = rolling.with_trailing(base, [("moments", "__r", n["m6"]), ("moments", "__r", n["m12"]), ("mean", "__dv", n["m1"]), ("mean", "__dv", n["m12"]), ("count", "close_adj", n["m12"]), ("highest", "close_adj", n["m12"])])
    c, near, far = F.col("close_adj"), rolling.mean("__dv", n["m1"]), rolling.mean("__dv", n["m12"])
    full = lambda x, k: rolling.count(x, n[k]) >= n[k]
    found = {
        "vol_6m": F.when(full("__r", "m6"), rolling.deviation("__r", n["m6"])),
        "vol_12m": F.when(full("__r", "m12"), rolling.deviation("__r", n["m12"])),
        "dist_52w_high": F.when(full("close_adj", "m12"), c / rolling.maximum("close_adj", n["m12"]) - 1),
        "dvol_trend": F.when(full("__dv", "m12") & (near > 0) & (far > 0), F.ln(near / far)),
    }
    return each.select(*prices.columns, *steps, *(x.alias(name) for name, x in found.items()))


def momentum(prices: DataFrame, keys: DataFrame, windows: Mapping[str, int] | None = None) -> DataFrame:
    """The momentum family at the (date, ticker) keys."""
    rows = momentum_columns(prices, windows).select("date", "ticker", *MOMENTUM)
    return keys.select("date", "ticker").join(rows, ["date", "ticker"], "left")


def _at_price(prices: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.select("date", "ticker").join(prices.select("date", "ticker", F.col("close_raw").alias("price")), ["date", "ticker"], "left")


Known = Callable[..., Column]


def valuation_levels(v: Known, price: Column) -> dict[str, Column]:
    """Of ``v(name)``, a fact by its name; what isn't known stays unknown: without debt or cash there is no enterprise value."""
    value = price * v("shares") + v("debt") - v("cash")
    return {
        "earnings_yield": F.when((v("eps") > 0) & (price > 0), v("eps") / price), "sales_yield": F.when((v("sps") > 0) & (price > 0), v("sps") / price),
        "ev_ebitda": F.when((v("ebitda") > 0) & (v("shares") > 0), value / v("ebitda")), "book_to_price": F.when((v("bvps") > 0) & (price > 0), v("bvps") / price),
    }


def quality_levels(v: Known, price: Column) -> dict[str, Column]:
    positive = F.when(v("equity") > 0, F.lit(True))
    return {
        "roe": F.when(positive, v("roe")), "roic": v("roic"), "roa": v("roa"), "gross_margin": v("gross_margin"), "op_margin": X.ratio(v("opinc"), v("revenue")),
        "net_margin": v("net_margin"), "ebitda_margin": v("ebitda_margin"), "debt_to_equity": F.when(positive, v("de")), "current_ratio": v("current_ratio"),
        "interest_coverage": X.ratio(v("ebit"), v("intexp")), "fcf_yield": F.when(price > 0, v("fcfps") / price), "fcf_margin": X.ratio(v("fcf"), v("revenue")),
    }


def growth_levels(v: Known) -> dict[str, Column]:
    """Of ``v(name, point)`` at the points now, q (a quarter before), y (a year) and yq (both)."""
    yoy = lambda name: X.growth(v(name, "now"), v(name, "y"))
    before = lambda name: X.growth(v(name, "q"), v(name, "yq"))
    return (
        {f"{n}_yoy": yoy(n) for n in ("rev", "eps", "gp", "fcf")} | {f"{n}_accel": yoy(n) - before(n) for n in ("rev", "eps")}
        | {f"{n}_trend": v(n, "now") - v(n, "y") for n in ("net_margin", "gross_margin")}
    )


def _named(columns: Mapping[str, Column]) -> list[Column]:
    return [c.alias(n) for n, c in columns.items()]


def valuation(prices: DataFrame, facts: DataFrame, keys: DataFrame, sector: DataFrame, tags: Mapping[str, str], window: int = 60, least: int = 24) -> DataFrame:
    """The valuation family; ``tags`` names the fact tags of eps, sps, bvps, shares, debt, cash and ebitda."""
    known = facts_asof(facts, _at_price(prices, keys), sorted(set(tags.values())))
    rows = known.select("date", "ticker", *_named(valuation_levels(lambda name: F.col(f"`{tags[name]}`"), F.col("price"))))
    relative = less_sector_median(rows.join(sector, "ticker", "left"), VALUATION).drop("sector")
    return own_history_z(relative, VALUATION, window, least)


def quality(prices: DataFrame, facts: DataFrame, keys: DataFrame, sector: DataFrame, tags: Mapping[str, str], window: int = 60, least: int = 24) -> DataFrame:
    """The quality family: twelve levels, nine of them also relative to the sector, and margin stability."""
    known = facts_asof(facts, _at_price(prices, keys), sorted(set(tags.values())))
    rows = known.select("date", "ticker", *_named(quality_levels(lambda name: F.col(f"`{tags[name]}`"), F.col("price"))))
    relative = less_sector_median(rows.join(sector, "ticker", "left"), SECTOR_QUALITY).drop("sector")
    return relative.withColumn("net_margin_stability", X.rolling_std(F.col("net_margin"), window, "ticker", least=least))


def growth(facts: DataFrame, keys: DataFrame, calendar: DataFrame, tags: Mapping[str, str], offsets: Mapping[str, int] | None = None) -> DataFrame:
    """The fundamental momentum family: growth over a year, its change over a quarter, margin trends."""
    at = dict(offsets or {"now": 0, "q": -63, "y": -252, "yq": -315})
    known = facts_at_offsets(facts, keys.select("date", "ticker"), sorted(set(tags.values())), calendar, at)
    return known.select("date", "ticker", *_named(growth_levels(lambda name, point: F.col(f"`{tags[name]}_{point}`"))))


def by_ticker(prices: DataFrame, line: DataFrame, keys: DataFrame, sector: DataFrame, tags: Mapping[str, Mapping[str, str]], windows: Mapping[str, int] | None = None, window: int = 60, least: int = 24, kept: Sequence[str] = ()) -> DataFrame:
    """What the four families take from a ticker's own rows, at the keys: all but what is relative to the sector; with the ``kept`` columns of the keys.

    ``line`` is the timeline of facts and keys at all points (columns date and point); ``tags`` has the
    tags of ``valuation``, ``quality`` and ``growth``.  All sides stand by ticker and are joined
    there: over tables in buckets of tickers nothing is exchanged.
    """
    every = sorted({t for names in tags.values() for t in names.values()})
    passed = carried(line, ["ticker"], every)
    points = ("now", "q", "y", "yq")
    known = passed.groupBy("ticker", "date").agg(*(F.max(F.when(F.col("point") == p, F.col(f"`{t}`"))).alias(f"{t}_{p}") for t in every for p in points))
    moved = momentum_columns(prices, windows).select("ticker", "date", F.col("close_raw").alias("price"), *MOMENTUM)
    rows = keys.select("ticker", "date", *kept).join(moved, ["ticker", "date"], "left").join(known, ["ticker", "date"], "left").join(sector, "ticker", "left")

    def of(family: str) -> Known:
        return lambda name, point="now": F.col(f"`{tags[family][name]}_{point}`")

    levels = valuation_levels(of("valuation"), F.col("price")) | quality_levels(of("quality"), F.col("price")) | growth_levels(of("growth"))
    rows = rows.select("ticker", "date", "sector", *kept, *MOMENTUM, *_named(levels))
    rows = own_history_z(rows, VALUATION, window, least)
    return rows.withColumn("net_margin_stability", X.rolling_std(F.col("net_margin"), window, "ticker", least=least))


def by_date(rows: DataFrame) -> DataFrame:
    """The rows of :func:`by_ticker`, dealt by date once, with what is relative to the sector; windows by date add no exchange."""
    return less_sector_median(rows.repartition("date"), (*VALUATION, *SECTOR_QUALITY))


def context(keys: DataFrame, macro: DataFrame, benchmark: DataFrame, calendar: DataFrame, sector: DataFrame, series: Mapping[str, str], lookback: int = 63) -> DataFrame:
    """The context family: sector code, macro values and the trailing benchmark return, the same for all names of a date."""
    of_date = date_context(keys.select("date").distinct(), macro, benchmark, calendar, series, lookback)
    coded = sector_codes(keys, sector).select("ticker", "sector_id")
    rows = keys.select("date", "ticker").join(of_date, "date", "left").join(coded, "ticker", "left")
    return rows.select("date", "ticker", "sector_id", *series, "mkt_ret")


def date_context(dates: DataFrame, macro: DataFrame, benchmark: DataFrame, calendar: DataFrame, series: Mapping[str, str], lookback: int = 63) -> DataFrame:
    """date, the last value of each series, and the benchmark's return over ``lookback`` sessions."""
    levels = series_asof(macro, dates, sorted(set(series.values())))
    levels = levels.select("date", *(F.col(f"`{s}`").alias(n) for n, s in series.items()))
    moved = cal.offset(dates, calendar, -lookback, to="was").withColumn("ticker", F.lit("MKT"))
    ends = at_points(benchmark, moved, {"p1": "date", "p0": "was"}).select("date", F.when(F.col("p0") > 0, F.col("p1") / F.col("p0") - 1).alias("mkt_ret"))
    return dates.join(levels, "date", "left").join(ends, "date", "left")


def build(keys: DataFrame, raw: DataFrame, features: Sequence[str]) -> DataFrame:
    """The family at the panel's keys with ``_z`` and ``_rank`` columns."""
    return normalise(keys.select("date", "ticker").join(raw.select("date", "ticker", *features), ["date", "ticker"], "left"), features)


def _wide(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A column of arrays of ``size`` doubles as a matrix (0 for null), and where it isn't null."""
    flat = column.flatten()
    return np.asarray(flat.fill_null(0.0)).reshape(-1, size), np.asarray(flat.is_valid()).reshape(-1, size)


def _above(days: pa.Array, column: pa.Array, ends: Mapping[object, tuple[np.ndarray, np.ndarray]], size: int) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """How far values, held between their date's ends, lie above the lower one (0 for null), where they are known, the batch's dates, and each row's place among these."""
    (x, known), coded = _wide(column, size), days.dictionary_encode()
    codes, nothing = np.asarray(coded.indices), np.zeros(size)
    low, high = (np.array([ends.get(day, (nothing, nothing))[k] for day in coded.dictionary.to_pylist()]).reshape(-1, size)[codes] for k in (0, 1))
    return np.where(known, np.fmax(low, np.fmin(x, high)) - low, 0.0), known, coded.dictionary, codes  # NaN stands above all


def z_scores(raw: DataFrame, limits: DataFrame, features: Sequence[str], kept: Sequence[str] = ()) -> DataFrame:
    """date, ticker, the ``kept`` columns and each feature's ``_z``: of the value held between its date's ``limits`` (:func:`crosssec.tail_quantiles`).

    Limits, means and deviations have a row a date; they are sent to all tasks, so rows are neither
    dealt nor held by date.  ``raw`` is read twice, all features of a batch at a time, and ``limits``
    at once: give them stored.  Sums are of distances from the lower limit: values that are all equal
    deviate by 0 exactly, and held ones spread over a good part of their range, so that squares lose
    no digits.
    """
    ship(raw.sparkSession)
    size, scores = len(features), [f"{f}_z" for f in features]
    of = lambda row, side: np.array([np.nan if (v := row[f"{f}_{side}"]) is None else v for f in features], float)
    ends = {row["date"]: (of(row, "low"), of(row, "high")) for row in limits.collect()}  # one row a date
    x = F.array(*(F.col(f).cast("double") for f in features)).alias("__x")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            over, known, days, codes = _above(batch.column(0), batch.column(1), ends, size)
            each = [codes == c for c in range(len(days))]
            sums = [pa.array([v[own].sum(axis=0, dtype=float) for own in each], pa.list_(pa.float64())) for v in (known, over, over * over)]
            yield pa.RecordBatch.from_arrays([days, *sums], ["date", "n", "s", "ss"])

    of_batch = raw.where("date IS NOT NULL").select("date", x).mapInArrow(add_up, "date date, n array<double>, s array<double>, ss array<double>")
    total = of_batch.groupBy("date").agg(*(F.array(*(F.sum(F.get(c, F.lit(k))) for k in range(size))).alias(c) for c in ("n", "s", "ss")))
    each = F.arrays_zip("n", "s", "ss")
    mean = F.transform(each, lambda e: F.try_divide(e["s"], e["n"]))
    std = F.transform(each, lambda e: F.when(e["n"] > 1, F.sqrt(F.greatest(e["ss"] - e["s"] * e["s"] / e["n"], F.lit(0.0)) / (e["n"] - 1))))
    of_date = F.broadcast(total.select("date", mean.alias("__mean"), std.alias("__std")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            over, known, _, _ = _above(batch.column(0), batch.column(batch.num_columns - 3), ends, size)
            (mean, _), (std, some) = (_wide(batch.column(batch.num_columns - k), size) for k in (2, 1))
            with np.errstate(divide="ignore", invalid="ignore"):
                z = np.where(std > 0, (over - mean) / std, 0.0)
            lost = ~(known & some)
            found = [pa.array(np.ascontiguousarray(z[:, k]), mask=np.ascontiguousarray(lost[:, k])) for k in range(size)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *found], [*batch.schema.names[:-3], *scores])

    schema = T.StructType([*(raw.schema[c] for c in ("date", "ticker", *kept)), *(T.StructField(c, T.DoubleType()) for c in scores)])
    return raw.join(of_date, "date").select("date", "ticker", *kept, x, "__mean", "__std").mapInArrow(score, schema)


def matrix(keys: DataFrame, families: Sequence[DataFrame], kept: Sequence[Sequence[str]] = ()) -> DataFrame:
    """All families side by side at the keys, with the ``kept`` columns of these; joins on the same keys share one partitioning."""
    own = keys.select("date", "ticker", *(c for names in kept for c in names))
    return reduce(lambda left, right: left.join(right, ["date", "ticker"], "left"), families, own)
