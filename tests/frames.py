"""Small frames for tests: rows as text-like tuples, weekday calendars, and results as plain dicts."""

from __future__ import annotations

from datetime import date, timedelta

PRICES = "ticker string, date date, close_raw double, close_adj double, volume double"


def day(text: str) -> date:
    return date.fromisoformat(text)


def weekdays(start: str, n: int) -> list[date]:
    out, at = [], day(start)
    while len(out) < n:
        if at.weekday() < 5:
            out.append(at)
        at += timedelta(1)
    return out


def price_frame(spark, series: dict[str, list[float]], start: str = "2021-01-04", volume: float = 1e6, raw: float | None = None):
    rows = [(t, d, raw if raw is not None else p, p, volume) for t, prices in series.items() for d, p in zip(weekdays(start, len(prices)), prices, strict=True)]
    return spark.createDataFrame([(t, d, float(r), float(p), float(v)) for t, d, r, p, v in rows], PRICES)


def calendar_frame(spark, days: list[date]):
    return spark.createDataFrame([(d, k + 1) for k, d in enumerate(days)], "session date, session_idx int")


def dates_frame(spark, days):
    return spark.createDataFrame([(d,) for d in days], "date date")


def by(df, *keys: str, value: str) -> dict:
    """Rows as {key(s): value}."""
    return {(r[keys[0]] if len(keys) == 1 else tuple(r[k] for k in keys)): r[value] for r in df.collect()}
