"""As-of joins: the last value known at a date.

Spark has no as-of join.  An equi-join with a range condition would pair every probe with every
earlier row of its key, so histories and probes are unioned instead and one window per key carries
the last non-null value forward: one shuffle, linear work, any number of values at once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import calendar as cal


def timeline(history: DataFrame, probes: DataFrame, key: Sequence[str], values: Sequence[str], history_ts: str, probe_ts: str) -> DataFrame:
    """Histories and probes in one table, by time ``__ts``; a history's row comes before a probe of its time.

    Stored in buckets of its key, it serves any number of as-of passes without an exchange.
    """
    old = history.select(*key, F.col(history_ts).alias("__ts"), F.lit(0).alias("__probe"), *values, *(F.lit(None).cast(f.dataType).alias(f.name) for f in probes.schema if f.name not in key))
    new = probes.select(*key, F.col(probe_ts).alias("__ts"), F.lit(1).alias("__probe"), *(F.lit(None).cast(history.schema[v].dataType).alias(v) for v in values), *(c for c in probes.columns if c not in key))
    return old.unionByName(new).select("__ts", "__probe", *probes.columns, *values)


def carried(line: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The probes of a :func:`timeline` with the last non-null ``values`` up to them."""
    w = Window.partitionBy(*key).orderBy("__ts", "__probe").rowsBetween(Window.unboundedPreceding, 0)
    kept = [c for c in line.columns if c not in ("__ts", "__probe", *values)]
    found = line.select("__probe", *kept, *(F.last(v, ignorenulls=True).over(w).alias(v) for v in values))
    return found.where("__probe = 1").select(*kept, *values)


def last_known(history: DataFrame, probes: DataFrame, key: Sequence[str], values: Sequence[str], history_ts: str, probe_ts: str) -> DataFrame:
    """``probes`` with the last non-null ``values`` of their ``key`` at ``history_ts <= probe_ts``.

    ``history`` has one row for each key and time (aggregate it first where it has more).
    """
    return carried(timeline(history, probes, key, values, history_ts, probe_ts), key, values).select(*probes.columns, *values)


def at_points(history: DataFrame, rows: DataFrame, points: Mapping[str, str], value: str = "close_adj", key: str = "ticker", ts: str = "date") -> DataFrame:
    """``rows`` with a column for each of ``points`` (name -> date column): ``value`` as of that date, null at a null date.

    All points go through one as-of pass.  Every row comes back as often as it is given.
    """
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("point"), F.col(at).alias("at")) for name, at in points.items())))
    probes = rows.select(F.struct(*rows.columns).alias("__row"), F.col(key).alias("__key"), each.alias("__e")).select("__row", "__key", "__e.point", "__e.at")
    past = history.where(F.col(ts).isNotNull()).select(F.col(key).alias("__key"), F.col(ts).alias("__when"), F.col(value).alias("__value"))
    found = last_known(past, probes, ["__key"], ["__value"], "__when", "at")
    wide = found.groupBy("__key", "__row").agg(*(F.max(F.when(F.col("point") == name, F.col("__value"))).alias(name) for name in points), F.count(F.lit(1)).alias("__n"))
    copies = F.explode(F.array_repeat(F.lit(0), (F.col("__n") / len(points)).cast("int")))
    return wide.select("__row", *points, copies.alias("__copy")).select("__row.*", *points)


def facts_wide(facts: DataFrame, tags: Sequence[str]) -> DataFrame:
    """One row for each ticker and filing day, a column for each tag: the vintage of the latest period."""
    latest = [F.max_by("value", F.when(F.col("tag") == t, F.struct("period_end", "value"))).alias(t) for t in tags]
    kept = [F.max(F.when(F.col("tag") == t, F.lit(1))) for t in tags]
    return facts.where(F.col("value").isNotNull()).groupBy("ticker", "filed").agg(*(F.when(k == 1, v).alias(t) for t, v, k in zip(tags, latest, kept, strict=True)))


def facts_asof(facts: DataFrame, probes: DataFrame, tags: Sequence[str], on: str = "date") -> DataFrame:
    """``probes`` (ticker, date ...) with each tag's last value filed on or before the date."""
    return last_known(facts_wide(facts, tags), probes, ["ticker"], list(tags), "filed", on)


def select_asof(facts: DataFrame, probes: DataFrame, calendar: DataFrame, lag: int = 1) -> DataFrame:
    """For each probe (ticker, date) and tag the whole fact row filed latest by ``date`` less ``lag`` sessions.

    Ties in the filing day go to the later period, then the larger value.
    """
    cut = cal.offset(probes, calendar, -lag, to="cutoff").where(F.col("cutoff").isNotNull())
    best = facts.groupBy("ticker", "tag", "filed").agg(F.max(F.struct("period_end", "value")).alias("fact"))
    each = cut.join(best.select("ticker", "tag").distinct(), "ticker")
    history = best.select("ticker", "tag", F.col("filed").alias("known"), F.struct("filed", "fact.period_end", "fact.value").alias("fact"))
    found = last_known(history, each, ["ticker", "tag"], ["fact"], "known", "cutoff")
    return found.where(F.col("fact").isNotNull()).select("ticker", "date", "tag", "fact.filed", "fact.period_end", "fact.value")


def series_asof(series: DataFrame, dates: DataFrame, names: Sequence[str]) -> DataFrame:
    """``dates`` with a column for each series: its last value on or before the date."""
    probes = dates.select("date", F.explode(F.array(*map(F.lit, names))).alias("series_id"))
    past = series.where(F.col("series_id").isin(*names)).select("series_id", F.col("date").alias("known"), "value")
    found = last_known(past, probes, ["series_id"], ["value"], "known", "date")
    return found.groupBy("date").agg(*(F.max(F.when(F.col("series_id") == n, F.col("value"))).alias(n) for n in names))


def facts_at_offsets(facts: DataFrame, probes: DataFrame, tags: Sequence[str], calendar: DataFrame, offsets: Mapping[str, int]) -> DataFrame:
    """``probes`` with ``<tag>_<name>`` as of the date moved by each offset, all in one as-of pass.

    An offset that leaves the calendar gives null.
    """
    moved = reduce(lambda rows, item: cal.offset(rows, calendar, item[1], to=f"__{item[0]}"), offsets.items(), probes)
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("point"), F.col(f"__{n}").alias("at")) for n in offsets)))
    asked = moved.select("ticker", "date", each.alias("e")).select("ticker", "date", "e.point", "e.at").where("at IS NOT NULL")
    found = facts_asof(facts, asked, tags, on="at")
    pick: list[Column] = [F.max(F.when(F.col("point") == n, F.col(f"`{t}`"))).alias(f"{t}_{n}") for t in tags for n in offsets]
    return probes.join(found.groupBy("ticker", "date").agg(*pick), ["ticker", "date"], "left")


def market_cap(prices: DataFrame, facts: DataFrame, dates: DataFrame, shares_tag: str, scale: float = 1.0) -> DataFrame:
    """ticker, date, market_cap: the price exactly at the date times shares as of it."""
    probes = prices.join(dates, "date").select("ticker", "date", "close_raw")
    known = facts_asof(facts, probes, [shares_tag])
    return known.select("ticker", "date", (F.col("close_raw") * F.col(f"`{shares_tag}`") * scale).alias("market_cap")).where(F.col("market_cap").isNotNull())
