"""The hold-out report against plain pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import holdout

from .frames import day

DAYS = [day(x) for x in ("2021-11-30", "2021-12-31", "2022-01-31", "2022-02-28")]
NAMES = [f"T{k:02d}" for k in range(20)]


def spearman(a, b):
    return a.rank().corr(b.rank())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    own = pd.DataFrame([(d, n) for d in DAYS for n in NAMES], columns=["date", "ticker"])
    own["pred"] = rng.normal(size=len(own))
    own["actual"] = own.pred * 0.3 + rng.normal(size=len(own))
    own["exposure"] = np.where(rng.random(len(own)) < 0.8, own.pred + rng.normal(size=len(own)), None)
    own["ret"] = rng.normal(0.01, 0.05, size=len(own))
    return own


@pytest.fixture(scope="module")
def report(spark, rows):
    exposure = [(a, b, None if x is None else float(x)) for a, b, x in rows[["date", "ticker", "exposure"]].itertuples(index=False)]
    keep = rows[~((rows.date == DAYS[1]) & (rows.ticker == "T03")) & (rows.date < DAYS[3])]  # one return missing, and the last date's
    held = spark.createDataFrame([(a, b, float(x)) for a, b, x in keep[["date", "ticker", "ret"]].itertuples(index=False)], "date date, ticker string, ret double")
    scored = spark.createDataFrame([(a, b, float(x), float(y)) for a, b, x, y in rows[["date", "ticker", "actual", "pred"]].itertuples(index=False)], "date date, ticker string, actual double, pred double")
    market = spark.createDataFrame([(day("2021-10-29"), "MKT", 0.02), (DAYS[0], "MKT", -0.01), (DAYS[1], "MKT", 0.03), (DAYS[2], "MKT", 0.01)], "date date, ticker string, ret double")
    found = holdout.report(scored, spark.createDataFrame(exposure, "date date, ticker string, exposure double"), scored, held, market, bps=10.0, bins=5)
    return {(r["part"], r["name"]): r["value"] for r in found.collect()}, keep


def test_coefficients_and_bins(rows, report):
    got, _ = report
    ics = rows.groupby("date")[["pred", "actual"]].apply(lambda g: spearman(g.pred, g.actual))
    assert got["ic", "mean_ic"] == pytest.approx(ics.mean()) and got["ic", "t_stat"] == pytest.approx(ics.mean() / (ics.std() / 2))
    assert got["year", "2021 mean_ic"] == pytest.approx(ics[:2].mean()) and got["year", "2022 n_dates"] == 2
    bins = rows.assign(bin=rows.groupby("date").pred.transform(lambda x: pd.qcut(x.rank(method="first"), 5, labels=False)))
    means = bins.groupby(["date", "bin"]).actual.mean().groupby("bin").mean()
    for k, x in means.items():
        assert got["decile", f"{k} mean_ret"] == pytest.approx(x)
    assert got["decile", "top_minus_bottom"] == pytest.approx(means[4] - means[0])
    known = rows.dropna(subset=["exposure"]).astype({"exposure": float})
    along = known.groupby("date")[["pred", "exposure"]].apply(lambda g: spearman(g.pred, g.exposure))
    assert got["exposure", "mean_corr"] == pytest.approx(along.mean())
    assert (got["window", "first"], got["window", "last"], got["window", "n_dates"]) == (20211130, 20220228, 4)


def test_legs_and_backtests(rows, report):
    got, keep = report
    returns = keep.set_index(["date", "ticker"]).ret
    at = lambda d, names: [returns.get((d, n)) for n in names]
    tops = {d: g.nlargest(2, "pred").ticker.tolist() for d, g in rows.groupby("date")}
    lows = {d: g.nsmallest(2, "pred").ticker.tolist() for d, g in rows.groupby("date")}
    mean = lambda xs: np.mean([x for x in xs if x is not None]) if any(x is not None for x in xs) else np.nan
    long, short = (pd.Series([mean(at(d, side[d])) for d in DAYS]) for side in (tops, lows))
    assert got["legs", "long_mean"] == pytest.approx(long.mean()) and got["legs", "short_mean"] == pytest.approx(short.mean())
    assert got["legs", "sharpe"] == pytest.approx((long - short).mean() / (long - short).std() * np.sqrt(12))

    def run(books):
        was, net, moved = {}, [], []
        for d in DAYS[:3]:
            new, own = {n: 1 / len(books[d]) for n in books[d]}, returns[d]
            grown = {n: w * (1 + own.get(n, 0.0)) for n, w in was.items()}
            prior = {n: w / sum(grown.values()) for n, w in grown.items()}
            traded = sum(abs(new.get(n, 0) - prior.get(n, 0)) for n in {*new, *prior})
            net.append(sum(w * own.get(n, 0.0) for n, w in new.items()) - 10 / 1e4 * traded)
            moved.append(traded / 2)
            was = new
        return np.array(net), moved

    for name, books in (("model", tops), ("equal", dict.fromkeys(DAYS, NAMES))):
        net, moved = run(books)
        assert got["backtest", f"{name} cagr"] == pytest.approx(np.prod(1 + net) ** 4 - 1)
        assert got["backtest", f"{name} avg_turnover"] == pytest.approx(np.mean(moved))
    assert got["backtest", "market cagr"] == pytest.approx((0.99 * 1.03 * 1.01) ** 4 - 1) and got["backtest", "market avg_turnover"] == 0
    assert got["common", "n_dates"] == 3 and got["common", "first"] == 20211130


def test_the_penalty_is_the_modal_one(spark):
    rng = np.random.default_rng(5)
    rows = [(d, n, float(x), float(2 * x)) for d in DAYS for n, x in zip(NAMES, rng.normal(size=20), strict=True)]
    panel = spark.createDataFrame([*rows, (DAYS[3], "none", 1.0, None)], "date date, ticker string, f double, y double")
    early, late = "date < '2022-01-01'", "date >= '2022-01-01'"
    picks = spark.createDataFrame([(1, 1.0), (2, 50.0), (3, 50.0), (4, 1.0), (5, 7.0)], "fold int, alpha double")
    found = holdout.frozen_ridge(panel, ["f"], "y", picks, F.expr(early), F.expr(late)).toPandas()
    assert set(found.alpha) == {50.0} and set(found.date) == set(DAYS[2:]) and "none" not in set(found.ticker)
    x = np.array([r[2] for r in rows if r[0] < DAYS[2]])
    weight = 2 * ((x - x.mean()) ** 2).sum() / (((x - x.mean()) ** 2).sum() + 50)
    want = {(r[0], r[1]): 2 * x.mean() + weight * (r[2] - x.mean()) for r in rows if r[0] >= DAYS[2]}
    assert {(a, b): c for a, b, c in found[["date", "ticker", "pred"]].itertuples(index=False)} == pytest.approx(want)
