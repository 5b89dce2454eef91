"""Statistics, portfolios, events and walk-forward evaluation: known signals and exact values."""

import math
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import expr
from tidemark.operators import crosssec, evalstats, events, portfolio, returns, walkforward

from .frames import by, calendar_frame, dates_frame, day, price_frame, weekdays

MONTHS = [day(f"{y}-{m:02d}-28") for y in range(2010, 2019) for m in range(1, 13)]


def scored_frame(spark, n_dates, n_names, perfect):
    rng = np.random.default_rng(4)
    rows = []
    for d in MONTHS[:n_dates]:
        target = rng.normal(0, 0.1, n_names)
        signal = target if perfect else rng.normal(0, 1, n_names)
        rows += [(d, f"T{k}", float(signal[k]), float(target[k])) for k in range(n_names)]
    return spark.createDataFrame(rows, "date date, ticker string, signal double, fwd_ret_raw double")


def test_perfect_and_random_signals(spark):
    scored = scored_frame(spark, 6, 50, True)
    found = evalstats.ic_summary(evalstats.information_coefficients(scored, "signal", "fwd_ret_raw")).first()
    assert found["mean_ic"] > 0.999 and found["positive_share"] == 1
    bins = evalstats.quantile_returns(scored, "signal", "fwd_ret_raw")
    means = [r["mean_ret"] for r in bins.orderBy("bin").collect()]
    assert means == sorted(means) and len(means) == 10 and evalstats.quantile_summary(bins).first()["monotonicity"] > 0.999
    noise = evalstats.ic_summary(evalstats.information_coefficients(scored_frame(spark, 12, 60, False), "signal", "fwd_ret_raw")).first()
    assert abs(noise["mean_ic"]) < 0.15 and abs(noise["t_stat"]) < 2.5
    one = evalstats.ic_summary(evalstats.information_coefficients(scored_frame(spark, 1, 50, True), "signal", "fwd_ret_raw")).first()
    assert one["std_ic"] is None and one["t_stat"] is None


def test_performance(spark):
    rows = [(MONTHS[k], x) for k, x in enumerate((0.02, -0.01, 0.03, 0.0, 0.015))]
    found = evalstats.performance(spark.createDataFrame(rows, "date date, ret double")).first()
    assert found["n"] == 5 and found["hit_rate"] == pytest.approx(0.6) and found["max_drawdown"] == pytest.approx(-0.01)


def test_backtest_performance(spark):
    rows = [(MONTHS[k], g, g - 0.001, 0.5) for k, g in enumerate((0.02, -0.01, 0.03))]
    found = evalstats.backtest_performance(spark.createDataFrame(rows, "date date, gross double, net double, turnover double")).first()
    assert found["avg_turnover"] == pytest.approx(0.5) and found["n"] == 3
    assert found["total_cost_drag"] == pytest.approx(1.02 * 0.99 * 1.03 - 1.019 * 0.989 * 1.029)


def test_p_values_of_t(spark):
    """Against the density summed by Simpson's rule."""
    rows = [(t, n) for t in (0.0, 0.3, 1.0, 2.5, 6.0) for n in (1, 2, 3, 4, 7, 30, 31)]
    found = spark.createDataFrame(rows, "t double, n long").select("t", "n", expr.t_two_sided(F.col("t"), F.col("n")).alias("p")).collect()
    for r in found:
        n, x = r["n"], np.linspace(0, r["t"], 20_001)
        y = math.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) / math.sqrt(n * math.pi) * (1 + x * x / n) ** (-(n + 1) / 2)
        inside = (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-2:2].sum()) * (x[1] - x[0]) / 3
        assert r["p"] == pytest.approx(1 - 2 * inside, abs=1e-9)


def test_ranks_over_the_whole_table(spark):
    rng = np.random.default_rng(7)
    values = [None if rng.random() < 0.05 else float(rng.integers(0, 60)) for _ in range(700)]
    table = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id long, x double").repartition(5)
    found = {r["id"]: (r["x_rank"], r["x_place"]) for r in evalstats.overall_ranks(table, "x", buckets=16).collect()}
    known = sorted(v for v in values if v is not None)
    assert sorted(p for _, p in found.values()) == list(range(1, len(known) + 1)) and len(found) == len(known)
    for k, v in enumerate(values):
        if v is not None:
            assert found[k][0] == known.index(v) + (known.count(v) + 1) / 2


def test_persistence_summary(spark):
    rng = np.random.default_rng(2)
    p1 = rng.normal(0, 1, 41)
    p2 = 0.4 * p1 + rng.normal(0, 1, 41)
    found = evalstats.persistence_summary(spark.createDataFrame([(f"m{k}", float(a), float(b)) for k, (a, b) in enumerate(zip(p1, p2, strict=True))], "member string, p1 double, p2 double")).first()
    rho, cut = np.corrcoef(p1.argsort().argsort(), p2.argsort().argsort())[0, 1], np.quantile(p1, 0.8)
    assert found["n"] == 41 and found["rho"] == pytest.approx(rho) and 0 < found["p_value"] < 1 and found["n_top"] == (p1 >= cut).sum()
    assert found["top_minus_rest"] == pytest.approx(p2[p1 >= cut].mean() - p2[p1 < cut].mean())


def test_fold_summary(spark):
    rows = [(1, 0.1), (1, 0.3), (2, -0.2), (3, 0.4), (3, 0.2)]
    found = evalstats.fold_summary(spark.createDataFrame(rows, "fold int, ic double")).first()
    means = np.array([0.2, -0.2, 0.3])
    assert found["n_folds"] == 3 and found["mean_fold_ic"] == pytest.approx(means.mean()) and found["ic_ir"] == pytest.approx(means.mean() / means.std(ddof=1))
    assert found["positive_folds"] == pytest.approx(2 / 3) and found["mean_ic"] == pytest.approx(0.16)


def test_top_size_rounds_half_to_even(spark):
    sizes = spark.range(1, 400).select("id", expr.top_size(F.col("id"), 0.1).alias("k"))
    assert all(r["k"] == max(1, round(r["id"] * 0.1)) for r in sizes.collect())


def test_first_deployment_costs(spark):
    days = weekdays("2021-01-04", 80)
    prices = price_frame(spark, {"A": [100 + 100 * k / 79 for k in range(80)], "B": [100.0] * 80})
    holding = returns.holding_returns(prices, dates_frame(spark, [days[0], days[40], days[79]]))
    signals = spark.createDataFrame([(d, t, s) for d in (days[0], days[40]) for t, s in (("A", 1.0), ("B", 2.0))], "date date, ticker string, signal double")
    first = portfolio.backtest(signals, holding, crosssec.equal_weights, 10).orderBy("date").first()
    assert first["cost"] == pytest.approx(0.001) and first["gross"] - first["net"] == pytest.approx(0.001) and first["turnover"] == pytest.approx(0.5)
    free = portfolio.backtest(signals, holding, lambda s: crosssec.top_fraction(s, 0.5), 0)
    assert all(r["gross"] == r["net"] for r in free.collect())


def trade_rows(spark, rows):
    start = day("2021-01-01")
    return spark.createDataFrame([(k, "T", m, start + timedelta(d), float(v)) for k, (m, d, v) in enumerate(rows)], "seq long, ticker string, member string, filing_date date, value double")


def test_clusters_rearm(spark):
    rows = [("a", 0, 1), ("b", 10, 1), ("c", 20, 1), ("d", 25, 1), ("a", 80, 1), ("b", 85, 1), ("c", 90, 1)]
    found = events.clusters(events.distinct_actors(trade_rows(spark, rows), 30), 3)
    assert [r["filing_date"] for r in found.where("is_event").orderBy("filing_date").collect()] == [day("2021-01-01") + timedelta(k) for k in (20, 90)]


def test_value_clusters_wait_for_the_value(spark):
    rows = [("a", 0, 20_000), ("b", 5, 20_000), ("a", 9, 20_000), ("c", 12, 90_000)]
    found = events.value_clusters(events.distinct_actors(trade_rows(spark, rows), 30), 2, 50_000).collect()
    assert [r["seq"] for r in found] == [2]


@pytest.mark.parametrize("days", [0, 3])
def test_actors_equal_brute_force(spark, days):
    rng = np.random.default_rng(days)
    start = day("2021-01-01")
    rows = [(k, [None, "T", "U"][rng.choice(3, p=[0.1, 0.6, 0.3])], f"m{rng.integers(0, 5)}", start + timedelta(int(rng.integers(0, 25))), float(rng.integers(1, 9))) for k in range(300)]
    table = spark.createDataFrame(rows, "seq long, ticker string, member string, filing_date date, value double")
    exact, by_day = ({r["seq"]: (r["n_actors"], r["window_value"]) for r in f(table, days).collect()} for f in (events.distinct_actors, events.distinct_actors_by_day))
    for seq, ticker, _, at, _ in rows:
        near = [r for r in rows if r[1] == ticker and timedelta(0) <= at - r[3] <= timedelta(days)]
        assert by_day[seq] == (len({r[2] for r in near}), sum(r[4] for r in near))
        upto = [r for r in near if r[3] < at or r[0] <= seq]
        assert exact[seq] == (len({r[2] for r in upto}), sum(r[4] for r in upto))


def test_same_day_trades_count_in_order(spark):
    rows = [("a", 0, 1), ("b", 0, 1), ("c", 0, 1)]
    assert by(events.distinct_actors(trade_rows(spark, rows), 30), "seq", value="n_actors") == {0: 1, 1: 2, 2: 3}
    assert by(events.distinct_actors_by_day(trade_rows(spark, rows), 30), "seq", value="n_actors") == {0: 3, 1: 3, 2: 3}


def test_surprises_need_ten_quarters(spark):
    rows = [(t, day("2010-03-31") + timedelta(91 * k), float(k * k % 17)) for t, n in (("LONG", 16), ("SHORT", 9)) for k in range(n)]
    found = events.surprises(spark.createDataFrame(rows, "ticker string, period date, eps double"))
    assert {r["ticker"] for r in found.collect()} == {"LONG"}


@pytest.fixture(scope="module")
def folds_data(spark):
    rng = np.random.default_rng(8)
    rows = []
    for d in MONTHS:
        target, noise = rng.normal(0, 1, 60), rng.normal(0, 1, 60)
        signal = 0.6 * target + 0.8 * noise
        rows += [(d, f"T{k}", float(target[k]), float(rng.normal()), float(signal[k]), float(target[k])) for k in range(60)]
    panel = spark.createDataFrame(rows, "date date, ticker string, target double, f_noise double, f_signal double, f_peek double").cache()
    sessions = calendar_frame(spark, weekdays("2009-06-01", 2700))
    return panel, sessions, walkforward.folds(panel, sessions, 63, 63, 36, 4)


def test_folds_are_purged(spark, folds_data):
    _, sessions, plan = folds_data
    idx = by(sessions, "session", value="session_idx")
    at = lambda d: min(v for k, v in idx.items() if k >= d)
    rows = plan.collect()
    last_end = None
    for fold in sorted({r["fold"] for r in rows}):
        train, test = ([r["date"] for r in rows if r["fold"] == fold and r["role"] == role] for role in ("train", "test"))
        assert max(at(d) + 63 for d in train) <= at(min(test)) - 63
        assert last_end is None or min(test) > last_end
        last_end = max(test)


@pytest.mark.parametrize(("feature", "low", "high"), [("f_noise", -0.08, 0.08), ("f_signal", 0.2, 0.95), ("f_peek", 0.95, 1.01)])
def test_ridge_finds_signal_and_not_noise(spark, folds_data, feature, low, high):
    panel, _, plan = folds_data
    predicted = walkforward.evaluate_ridge(panel, [feature], "target", plan, 10.0)
    assert low < evalstats.ic_summary(evalstats.information_coefficients(predicted, "pred", "target")).first()["mean_ic"] < high


def test_ridge_solves_its_objective(spark, folds_data):
    panel, _, _ = folds_data
    features = ["f_noise", "f_signal"]
    rows = panel.where(F.col("date") <= MONTHS[11])
    gram = sum(np.array(r["gram"]) for r in walkforward.grams(rows, features, ["target"]).collect())
    model = walkforward.Ridge(gram, 2, 5.0)
    x, y = (np.array(rows.select(*c).collect(), float) for c in (features, ["target"]))
    x, y = x - x.mean(0), y[:, 0] - y.mean()
    assert np.allclose(model.weights, np.linalg.solve(x.T @ x + 5 * np.eye(2), x.T @ y))


def test_nested_ridge_and_trees(spark, folds_data):
    panel, sessions, plan = folds_data
    _, chosen = walkforward.nested_ridge(panel, ["f_signal", "f_noise"], "target", plan, sessions, (1.0, 1000.0), 63, 63, 2, 12)
    assert {r["fold"] for r in chosen.collect()} <= {1, 2, 3, 4} and chosen.count() >= 2
    train, test = (plan.where(F.col("fold") == 4).where(F.col("role") == role) for role in ("train", "test"))
    predicted = walkforward.boosted_trees(panel, ["f_signal"], "target", train, test, trees=5)
    assert evalstats.ic_summary(evalstats.information_coefficients(predicted, "pred", "target")).first()["mean_ic"] > 0.3


def test_nested_ridge_takes_the_first_candidate_where_nothing_tells(spark, folds_data):
    panel, sessions, plan = folds_data
    predicted, chosen = walkforward.nested_ridge(panel, ["f_signal"], "target", plan, sessions, (7.0, 1.0, 100.0), 63, 63, 2, 1200)
    assert {(r["fold"], r["alpha"], r["inner_ic"]) for r in chosen.collect()} == {(k, 7.0, None) for k in {r["fold"] for r in plan.collect()}}
    assert predicted.where("pred IS NULL").count() == 0 and predicted.count() > 0
    # one feature: every penalty ranks alike, so all inner coefficients are equal and the first wins
    _, chosen = walkforward.nested_ridge(panel, ["f_signal"], "target", plan, sessions, (100.0, 7.0), 63, 63, 2, 12)
    assert {r["alpha"] for r in chosen.where("inner_ic IS NOT NULL").collect()} == {100.0}


def test_grids_cover_every_fold_and_setting(spark, folds_data):
    panel, _, plan = folds_data
    features, alphas = ["f_signal", "f_noise"], (1.0, 1000.0)
    given, roles = panel.fillna(0.0, subset=features).toPandas(), plan.toPandas()
    ridges = walkforward.ridge_grid(panel, features, "target", plan, alphas).toPandas()
    trees = walkforward.boosted_grid(panel, features, "target", plan, (2, 3), (1, 50), trees=2).toPandas()
    folds = sorted(roles["fold"].unique())
    assert len(folds) > 1
    for fold in folds:
        train, test = (given[given["date"].isin(roles[(roles["fold"] == fold) & (roles["role"] == role)]["date"])] for role in ("train", "test"))
        train = train[train["target"].notna()]
        x, y = train[features].to_numpy(), train["target"].to_numpy()
        for alpha in alphas:
            w = np.linalg.solve((x - x.mean(0)).T @ (x - x.mean(0)) + alpha * np.eye(2), (x - x.mean(0)).T @ (y - y.mean()))
            want = {(r.date, r.ticker): y.mean() + (np.array([getattr(r, f) for f in features]) - x.mean(0)) @ w for r in test.itertuples()}
            own = ridges[(ridges["fold"] == fold) & (ridges["alpha"] == alpha)]
            assert len(own) == len(want) and np.allclose(own["pred"], [want[r.date, r.ticker] for r in own.itertuples()])
        for depth, least in ((2, 1), (2, 50), (3, 1), (3, 50)):
            own = trees[(trees["fold"] == fold) & (trees["depth"] == depth) & (trees["least"] == least)]
            assert set(zip(own["date"], own["ticker"], strict=True)) == set(zip(test["date"], test["ticker"], strict=True)) and own["pred"].notna().all()
