"""Steps of the models on the whole matrix: long frames by halves, z scores and predictions a batch at a time."""

import math
import re
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import evalstats, features, rolling, walkforward

from .frames import price_frame


@pytest.mark.parametrize("rows", [5, 26, 52, 63, 126])
def test_frames_by_halves_equal_frames(spark, rows):
    """With nulls, a constant stretch, values far from zero and keys shorter than the frame."""
    x = F.when(F.col("i") % 7 == 3, None).when(F.col("i") > 150, 0.1).otherwise(1e6 + F.xxhash64("i", "k") / 1e18)
    keys = F.explode(F.array(*(F.struct(F.lit(k).alias("ticker"), F.lit(n).alias("size")) for k, n in (("a", 240), ("b", 40), ("c", 1)))))
    every = spark.range(240).select(F.col("id").alias("i"), keys.alias("e")).select("i", "e.*").where("i < size").withColumn("k", F.length("ticker"))
    own = every.select("ticker", F.date_add(F.lit("2020-01-01").cast("date"), F.col("i").cast("int")).alias("date"), x.alias("x"))
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(1 - rows, 0)
    plain = own.withColumns({"n": F.count("x").over(w), "m": F.avg("x").over(w), "s": F.stddev_samp("x").over(w), "h": F.max("x").over(w)})
    both = rolling.with_trailing(plain, [("moments", "x", rows), ("highest", "x", rows)])
    found = both.select("n", "m", "s", "h", rolling.count("x", rows), rolling.mean("x", rows), rolling.deviation("x", rows), rolling.maximum("x", rows)).collect()
    assert len(found) == 281
    for r in found:
        assert r[0] == r[4] and r[3] == r[7]
        assert all((r[k] is None) == (r[k + 4] is None) for k in (1, 2)), r
        assert r[1] is None or r[5] == pytest.approx(r[1], rel=1e-12)
        assert r[2] is None or r[6] == pytest.approx(r[2], rel=1e-9, abs=1e-12)
    flat = both.where("ticker = 'a'").orderBy(F.desc("date")).limit(1).select(rolling.deviation("x", rows)).head()[0]
    assert flat == 0 if rows < 80 else flat > 0


def test_momentum_has_no_long_frames(spark):
    """No row is put together from more than 16 rows; lags read one."""
    prices = price_frame(spark, {"A": [100.0 + k % 9 for k in range(80)]})
    plan = features.momentum_columns(prices, {"m1": 4, "m3": 13, "m6": 26, "m12": 52})._jdf.queryExecution().executedPlan().toString()
    frames = [int(n) for n in re.findall(r"specifiedwindowframe\(RowFrame, -(\d+), currentrow", plan)]
    assert frames and max(frames) < 16


def test_z_scores_by_batches(spark):
    """Held between the limits; equal values give 0, nulls, a single value and a date without any value null."""
    rng, first = np.random.default_rng(3), date(2024, 1, 1)
    rows = [(first + timedelta(d), f"t{k}", "x", float(v), 0.1, None if k % 3 else float(k), None if k else 5.0) for d in range(3) for k, v in enumerate(rng.normal(1e4, 1, 40))]
    rows += [(first + timedelta(9), "t0", "x", None, None, None, None)]
    raw = spark.createDataFrame(rows, "date date, ticker string, sector string, a double, c double, d double, e double").repartition(5)
    ends = [(first + timedelta(d), 9999.0, 10001.0, 0.1, math.nextafter(0.1, 1), 3.0, 30.0, 5.0, 5.0) for d in range(3)]
    limits = spark.createDataFrame(ends, "date date, a_low double, a_high double, c_low double, c_high double, d_low double, d_high double, e_low double, e_high double")
    scored = features.z_scores(raw, limits, ["a", "c", "d", "e"], kept=["sector"])
    assert scored.columns == ["date", "ticker", "sector", "a_z", "c_z", "d_z", "e_z"]
    assert "stddev_samp" not in scored._jdf.queryExecution().executedPlan().toString()
    found = {(r["date"], r["ticker"]): r for r in scored.collect()}
    assert len(found) == 121 and tuple(found[first + timedelta(9), "t0"])[3:] == (None,) * 4
    for d in range(3):
        own = [r for r in rows if r[0] == first + timedelta(d)]
        for at, name, low, high in ((3, "a_z", 9999.0, 10001.0), (5, "d_z", 3.0, 30.0)):
            held = {r[1]: min(max(r[at], low), high) for r in own if r[at] is not None}
            mean, std = np.mean(list(held.values())), np.std(list(held.values()), ddof=1)
            for r in own:
                z = found[r[0], r[1]][name]
                assert z is None if r[at] is None else z == pytest.approx((held[r[1]] - mean) / std, rel=1e-8, abs=1e-8)
        assert all(found[r[0], r[1]]["c_z"] == 0 and found[r[0], r[1]]["e_z"] is None for r in own)


def test_predictions_of_all_fits_at_once(spark):
    """Those of the plain sums, in their order; equal rows get equal ones; the coefficients are those of the predictions."""
    rng, first, names = np.random.default_rng(5), date(2024, 1, 1), [f"f{k}" for k in range(50)]
    x = [None if k % 11 == 0 else float(v) for k, v in enumerate(rng.normal(size=24 * 50))]
    rows = [(first + timedelta(k % 4), f"t{k}", None if k % 9 == 8 else float(k % 5), float(-k), *x[50 * (k % 24) : 50 * (k % 24) + 50]) for k in range(48)]
    panel = spark.createDataFrame(rows, "date date, ticker string, y double, z double, " + ", ".join(f"{n} double" for n in names)).repartition(3)
    tests = spark.createDataFrame([(1, first + timedelta(d)) for d in (0, 1)] + [(2, first + timedelta(d)) for d in (1, 2)], "fold int, date date")
    fits = [(f, t, a, rng.normal(size=51).tolist()) for f in (1, 2, 3) for t in ("y", "z") for a in (1.0, 10.0) if (f, t) != (2, "z")]
    weights = spark.createDataFrame(fits, "fold int, target string, alpha double, weights array<double>")
    predicted = walkforward.predict_ridges(panel, names, ["y", "z"], tests, weights)
    assert "zip_with" not in predicted._jdf.queryExecution().executedPlan().toString()
    found = {(r["fold"], r["target"], r["alpha"], r["ticker"]): (r["date"], r["actual"], r["pred"]) for r in predicted.collect()}
    want = {}
    for fold, target, alpha, w in fits:
        for r in rows:
            if fold < 3 and r[0] in {first + timedelta(d) for d in ((0, 1), (1, 2))[fold - 1]}:
                pred = w[0]
                for value, weight in zip(r[4:], w[1:]):
                    pred += (value or 0.0) * weight
                want[fold, target, alpha, r[1]] = (r[0], r[2 if target == "y" else 3], pred)
    assert found == want
    assert all(found[f, t, a, "t0"][2] == found[f, t, a, "t24"][2] for f, t, a, _ in fits if (f, t, a, "t0") in found)
    scored = {(r["fold"], r["target"], r["alpha"], r["date"]): r["ic"] for r in walkforward.score_ridges(panel, names, ["y", "z"], tests, weights).collect()}
    each = evalstats.information_coefficients(predicted, "pred", "actual", ("fold", "target", "alpha", "date")).collect()
    assert scored and scored == {(r["fold"], r["target"], r["alpha"], r["date"]): pytest.approx(r["ic"], rel=1e-12) for r in each}
