"""Queries for portfolios (B), features (F) and walk-forward evaluation (M)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import calendar, crosssec, evalstats, features, holdout, portfolio, returns, walkforward
from ..session import scratch
from ..sources import contracts, io
from .base import CONTEXT_SERIES, HORIZON, POINTS, QUARTER, Data, query
from .joins_and_cleaning import WIDE
from .returns_and_windows import FEATURES, TERMINAL, TOP, WINDOWS
from .statistics import SUMMARY, bins_sql, ic_sql, performance_sql

BPS = 6.0
SWEEP = [5.0, 10.0, 20.0]


def drift_sql(weights: str, suffix: str = "", hold: str = "hold") -> dict[str, str]:
    """CTEs of a weights table's gross, drifted, traded and backtest rows, under the holding returns ``hold``."""
    return {
        f"gross{suffix}": f"SELECT date, sum(weight * coalesce(ret, 0)) AS gross FROM {weights} LEFT JOIN {hold} USING (date, ticker) GROUP BY date",
        f"wd{suffix}": f"SELECT date AS was, lead(date) OVER (ORDER BY date) AS date FROM (SELECT DISTINCT date FROM {weights})",
        f"prior{suffix}": f"""SELECT date, ticker, CASE WHEN sum(w) OVER (PARTITION BY date) > 0 THEN w / sum(w) OVER (PARTITION BY date) ELSE w END AS prior FROM (
  SELECT d.date, p.ticker, p.weight * (1 + coalesce(h.ret, 0)) AS w FROM {weights} p JOIN wd{suffix} d ON d.was = p.date AND d.date IS NOT NULL LEFT JOIN {hold} h ON h.date = d.date AND h.ticker = p.ticker)""",
        f"traded{suffix}": f"SELECT date, sum(abs(coalesce(weight, 0) - coalesce(prior, 0))) AS traded FROM {weights} w FULL JOIN prior{suffix} p USING (date, ticker) GROUP BY date",
        f"bt{suffix}": f"SELECT date, gross, gross - {BPS} / 10000 * traded AS net, traded / 2 AS turnover, {BPS} / 10000 * traded AS cost FROM gross{suffix} JOIN traded{suffix} USING (date)",
    }


SIGNAL_DATES = {"top_h": "SELECT * FROM top WHERE date IN (SELECT date FROM hold)", "all_h": "SELECT date, ticker, 1.0 / count(*) OVER (PARTITION BY date) AS weight FROM mom WHERE date IN (SELECT date FROM hold)"}
BOOK = TOP | SIGNAL_DATES | drift_sql("top_h")
BOOKS = BOOK | drift_sql("all_h", "_all") | {
    "strategies": "SELECT 'equal' AS strategy, * FROM bt_all UNION ALL SELECT 'momentum', * FROM bt WHERE date >= DATE '1997-01-01'",
    "common": "SELECT * FROM strategies WHERE date IN (SELECT date FROM strategies GROUP BY date HAVING count(DISTINCT strategy) = 2)",
    "kinds": "SELECT strategy, date, 'gross' AS kind, gross AS ret FROM common UNION ALL SELECT strategy, date, 'net', net FROM common",
}


def top(d: Data) -> DataFrame:
    return portfolio.target_weights(d.momentum, d.holding, crosssec.top_fraction)


def book(d: Data) -> DataFrame:
    return portfolio.backtest(d.momentum, d.holding, crosssec.top_fraction, BPS)


def strategies(d: Data) -> DataFrame:
    """Per-date returns of two strategies, stored once: comparisons read them several times."""
    equal = portfolio.backtest(d.momentum, d.holding, crosssec.equal_weights, BPS).withColumn("strategy", F.lit("equal"))
    both = equal.unionByName(book(d).where(F.col("date") >= F.lit("1997-01-01")).withColumn("strategy", F.lit("momentum")))
    root = scratch(d.spark)
    io.put(both, root, "results", "strategies")
    return io.get(d.spark, root, "results", "strategies")


@query("B1", "SELECT date, ticker, r(weight) AS weight FROM top_h", BOOK)
def b1(d: Data):
    return top(d)


@query("B2", "SELECT date, r(gross) AS gross FROM gross", BOOK)
def b2(d: Data):
    return portfolio.gross_returns(top(d), d.holding)


@query("B3", "SELECT date, ticker, r(prior) AS prior FROM prior", BOOK)
def b3(d: Data):
    return portfolio.drifted(top(d), d.holding)


@query("B3_previous", """SELECT date, ticker, r(CASE WHEN sum(w) OVER (PARTITION BY date) > 0 THEN w / sum(w) OVER (PARTITION BY date) ELSE w END) AS prior FROM (
  SELECT d.date, p.ticker, p.weight * (1 + coalesce(h.ret, 0)) AS w FROM top_h p JOIN wd d ON d.was = p.date AND d.date IS NOT NULL LEFT JOIN hold h ON h.date = d.was AND h.ticker = p.ticker)""", BOOK)
def b3_previous(d: Data):
    return portfolio.drifted(top(d), d.holding, "previous")


@query("B4", "SELECT date, r(gross) AS gross, r(net) AS net, r(turnover) AS turnover, r(cost) AS cost FROM bt", BOOK)
def b4(d: Data):
    return book(d)


@query("A4_costs", f"SELECT p.*, c.avg_turnover, c.log_cost_drag FROM ({performance_sql('booked', 'ret')}) p, (SELECT r(avg(turnover)) AS avg_turnover, r(ln(product(1 + gross) - product(1 + net))) AS log_cost_drag FROM bt) c", BOOK | {"booked": "SELECT date, net AS ret FROM bt"})
def a4_costs(d: Data):
    """The drag as a logarithm: on tables whose prices jump from week to week it has 27 digits."""
    return evalstats.backtest_performance(book(d), periods=12.0).withColumn("log_cost_drag", F.ln("total_cost_drag")).drop("total_cost_drag")


@query("B5", performance_sql("swept", "ret", "bps,"), BOOK | {"swept": "SELECT b.bps::DOUBLE AS bps, date, gross - b.bps / 10000 * 2 * turnover AS ret FROM bt, (VALUES (5.0), (10.0), (20.0)) AS b(bps)"})
def b5(d: Data):
    return portfolio.cost_sweep(book(d), SWEEP)


@query("B6", f"SELECT p.*, a.avg_turnover FROM ({performance_sql('kinds', 'ret', 'strategy, kind,')}) p JOIN (SELECT strategy, r(avg(turnover)) AS avg_turnover FROM common GROUP BY strategy) a USING (strategy)", BOOKS)
def b6(d: Data):
    return portfolio.compare(strategies(d))


@query("J16", "SELECT date, ticker, r(coalesce(weight, 0)) AS weight, r(coalesce(prior, 0)) AS prior FROM top_h FULL JOIN prior USING (date, ticker)", BOOK)
def j16(d: Data):
    own = top(d)
    both = own.join(portfolio.drifted(own, d.holding), ["date", "ticker"], "full")
    return both.select("date", "ticker", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("prior", F.lit(0.0)).alias("prior"))


@query("J18", "SELECT strategy, date, r(net) AS net FROM common", BOOKS)
def j18(d: Data):
    return portfolio.common_dates(strategies(d)).select("strategy", "date", "net")


@query("J20", f"""SELECT kind, r(e.cagr) AS cagr_equal, r(m.cagr) AS cagr_momentum, r(m.cagr - e.cagr) AS gap FROM (SELECT kind, pow(product(1 + ret), 12.0 / count(*)) - 1 AS cagr FROM kinds WHERE strategy = 'equal' GROUP BY kind) e
  JOIN (SELECT kind, pow(product(1 + ret), 12.0 / count(*)) - 1 AS cagr FROM kinds WHERE strategy = 'momentum' GROUP BY kind) m USING (kind)""", BOOKS)
def j20(d: Data):
    rows = portfolio.compare(strategies(d))
    side = lambda s: rows.where(F.col("strategy") == s).select("kind", F.col("cagr").alias(f"cagr_{s}"))
    return side("equal").join(side("momentum"), "kind").withColumn("gap", F.col("cagr_momentum") - F.col("cagr_equal"))


# --- feature families --------------------------------------------------------------------------


def norm_sql(source: str, names: tuple[str, ...]) -> str:
    """The features of ``source`` with z scores of the winsorised values and percent ranks."""
    held = ", ".join(f"CASE WHEN {f} IS NOT NULL THEN greatest(quantile_cont({f}, 0.01) OVER d, least({f}, quantile_cont({f}, 0.99) OVER d)) END AS w_{f}" for f in names)
    out = ", ".join(
        f"r({f}) AS {f}, CASE WHEN stddev_samp(w_{f}) OVER d > 0 THEN r((w_{f} - avg(w_{f}) OVER d) / stddev_samp(w_{f}) OVER d) WHEN {f} IS NOT NULL AND stddev_samp(w_{f}) OVER d = 0 THEN 0.0 END AS {f}_z, "
        f"CASE WHEN {f} IS NOT NULL THEN r((rank() OVER (PARTITION BY date, {f} IS NOT NULL ORDER BY {f}) + (count(*) OVER (PARTITION BY date, {f}) - 1) / 2.0) / count({f}) OVER d) END AS {f}_rank"
        for f in names
    )
    return f"SELECT date, ticker, {out} FROM (SELECT *, {held} FROM {source} WINDOW d AS (PARTITION BY date)) WINDOW d AS (PARTITION BY date)"


FACT = dict(zip(("a", "b", "c", "d", "e"), contracts.TAGS, strict=True))
VALUE_TAGS = {"eps": FACT["a"], "sps": FACT["b"], "bvps": FACT["c"], "shares": FACT["a"], "debt": FACT["d"], "cash": FACT["e"], "ebitda": FACT["b"]}
QUALITY_TAGS = {
    "roe": FACT["a"], "roic": FACT["b"], "roa": FACT["c"], "gross_margin": FACT["d"], "opinc": FACT["e"], "revenue": FACT["a"], "net_margin": FACT["b"], "de": FACT["c"], "current_ratio": FACT["d"],
    "ebit": FACT["e"], "intexp": FACT["b"], "fcfps": FACT["a"], "fcf": FACT["c"], "equity": FACT["d"], "ebitda_margin": FACT["e"],
}
GROWTH_TAGS = {"rev": FACT["a"], "eps": FACT["b"], "gp": FACT["c"], "fcf": FACT["d"], "net_margin": FACT["e"], "gross_margin": FACT["a"]}
_COLUMN = dict(zip(contracts.TAGS, (f"t{k}" for k in range(1, 6)), strict=True))


def _v(tags: dict[str, str], name: str) -> str:
    return _COLUMN[tags[name]]


KEPT = {k: v.replace("FROM probes p", "FROM panel p") for k, v in WIDE.items()}
VALUATION_SQL = KEPT | {
    "val": "SELECT k.date, k.ticker, CASE WHEN t1 > 0 AND p > 0 THEN t1 / p END AS earnings_yield, CASE WHEN t2 > 0 AND p > 0 THEN t2 / p END AS sales_yield, "
    "CASE WHEN t2 > 0 AND t1 > 0 THEN (p * t1 + t4 - t5) / t2 END AS ev_ebitda, CASE WHEN t3 > 0 AND p > 0 THEN t3 / p END AS book_to_price, s.sector "
    "FROM (SELECT k.*, x.close_raw AS p FROM kept k JOIN pw x USING (date, ticker)) k LEFT JOIN sector s USING (ticker)",
    "valf": "SELECT date, ticker, "
    + ", ".join(f"{m}, CASE WHEN sector IS NOT NULL THEN {m} - median({m}) OVER (PARTITION BY date, sector) END AS {m}_sectrel, CASE WHEN count({m}) OVER h >= 24 AND stddev_samp({m}) OVER h > 0 THEN ({m} - avg({m}) OVER h) / stddev_samp({m}) OVER h END AS {m}_hist" for m in features.VALUATION)
    + " FROM val WINDOW h AS (PARTITION BY ticker ORDER BY date ROWS 59 PRECEDING)",
}
VALUE_NAMES = tuple(f"{m}{x}" for m in features.VALUATION for x in ("", "_sectrel", "_hist"))


def _columns_sql(names: tuple[str, ...]) -> str:
    return ", ".join(f"r({n}) AS {n}" for n in names)


@query("F0", norm_sql("momf", features.MOMENTUM[:4]), FEATURES)
def f0(d: Data):
    raw = features.momentum_columns(d.weekly, WINDOWS)
    return features.build(d.panel, raw, features.MOMENTUM[:4])


@query("F1", "SELECT date, ticker, " + _columns_sql(features.MOMENTUM) + " FROM momf", FEATURES)
def f1(d: Data):
    return features.momentum(d.weekly, d.panel, WINDOWS)


@query("F2", "SELECT date, ticker, " + _columns_sql(VALUE_NAMES) + " FROM valf", VALUATION_SQL)
def f2(d: Data):
    return features.valuation(d.weekly, d.facts, d.panel, d.sectors, VALUE_TAGS).select("date", "ticker", *VALUE_NAMES)


def _q(name: str) -> str:
    return _v(QUALITY_TAGS, name)


QUALITY_LEVELS = {
    "roe": f"CASE WHEN {_q('equity')} > 0 THEN {_q('roe')} END", "roic": _q("roic"), "roa": _q("roa"), "gross_margin": _q("gross_margin"),
    "op_margin": f"CASE WHEN {_q('revenue')} > 0 THEN {_q('opinc')} / {_q('revenue')} END", "net_margin": _q("net_margin"), "ebitda_margin": _q("ebitda_margin"),
    "debt_to_equity": f"CASE WHEN {_q('equity')} > 0 THEN {_q('de')} END", "current_ratio": _q("current_ratio"), "interest_coverage": f"CASE WHEN {_q('intexp')} > 0 THEN {_q('ebit')} / {_q('intexp')} END",
    "fcf_yield": f"CASE WHEN p > 0 THEN {_q('fcfps')} / p END", "fcf_margin": f"CASE WHEN {_q('revenue')} > 0 THEN {_q('fcf')} / {_q('revenue')} END",
}
QUALITY_SQL = KEPT | {
    "qual": "SELECT k.date, k.ticker, " + ", ".join(f"{QUALITY_LEVELS[n]} AS {n}" for n in features.QUALITY) + ", s.sector FROM (SELECT k.*, x.close_raw AS p FROM kept k JOIN pw x USING (date, ticker)) k LEFT JOIN sector s USING (ticker)",
    "qualf": "SELECT date, ticker, " + ", ".join(features.QUALITY) + ", " + ", ".join(f"CASE WHEN sector IS NOT NULL THEN {m} - median({m}) OVER (PARTITION BY date, sector) END AS {m}_sectrel" for m in features.SECTOR_QUALITY)
    + ", CASE WHEN count(net_margin) OVER h >= 24 THEN stddev_samp(net_margin) OVER h END AS net_margin_stability FROM qual WINDOW h AS (PARTITION BY ticker ORDER BY date ROWS 59 PRECEDING)",
}
QUALITY_NAMES = (*features.QUALITY, *(f"{m}_sectrel" for m in features.SECTOR_QUALITY), "net_margin_stability")


@query("F3", "SELECT date, ticker, " + _columns_sql(QUALITY_NAMES) + " FROM qualf", QUALITY_SQL)
def f3(d: Data):
    return features.quality(d.weekly, d.facts, d.panel, d.sectors, QUALITY_TAGS).select("date", "ticker", *QUALITY_NAMES)


def _yoy(name: str, new: str, old: str) -> str:
    c = _v(GROWTH_TAGS, name)
    return f"CASE WHEN {c}_{old} > 0 THEN {c}_{new} / {c}_{old} - 1 END"


GROWTH_SQL = {
    "wide": WIDE["wide"],
    "at_points": "SELECT p.date, p.ticker, " + ", ".join(f"s{n}.session AS d_{n}" for n in POINTS) + " FROM panel p JOIN sess s ON s.session = p.date " + " ".join(f"LEFT JOIN sess s{n} ON s{n}.idx = s.idx + ({k})" for n, k in POINTS.items()),
    "growth_in": "SELECT p.date, p.ticker, " + ", ".join(f"x_{c}_{n}.value AS {c}_{n}" for c in _COLUMN.values() for n in POINTS) + " FROM at_points p "
    + " ".join(f"ASOF LEFT JOIN (SELECT ticker, filed, {c} AS value FROM wide WHERE {c} IS NOT NULL) x_{c}_{n} ON x_{c}_{n}.ticker = p.ticker AND x_{c}_{n}.filed <= p.d_{n}" for c in _COLUMN.values() for n in POINTS),
    "growthf": "SELECT date, ticker, " + ", ".join(f"{_yoy(n, 'now', 'y')} AS {n}_yoy" for n in ("rev", "eps", "gp", "fcf")) + ", " + ", ".join(f"{_yoy(n, 'now', 'y')} - {_yoy(n, 'q', 'yq')} AS {n}_accel" for n in ("rev", "eps"))
    + ", " + ", ".join(f"{_v(GROWTH_TAGS, n)}_now - {_v(GROWTH_TAGS, n)}_y AS {n}_trend" for n in ("net_margin", "gross_margin")) + " FROM growth_in",
}


@query("F4", "SELECT date, ticker, " + _columns_sql(features.GROWTH) + " FROM growthf", GROWTH_SQL)
def f4(d: Data):
    return features.growth(d.facts, d.panel, d.calendar, GROWTH_TAGS, POINTS)


CONTEXT_SQL = {
    "ctx": "SELECT p.date, p.ticker, c.sector_id, " + ", ".join(f"m{s}.value AS {n}" for n, s in CONTEXT_SERIES.items()) + ", q.mkt_ret FROM panel p "
    "LEFT JOIN (SELECT ticker, (dense_rank() OVER (ORDER BY coalesce(nullif(sector, ''), 'Unknown')) - 1)::INTEGER AS sector_id FROM (SELECT DISTINCT ticker FROM panel) LEFT JOIN sector USING (ticker)) c USING (ticker) "
    + " ".join(f"ASOF LEFT JOIN (SELECT date AS d2, value FROM macro WHERE series_id = '{s}') m{s} ON m{s}.d2 <= p.date" for s in CONTEXT_SERIES.values())
    + f""" LEFT JOIN (SELECT a.session AS date, q1.close_adj / q0.close_adj - 1 AS mkt_ret FROM sess a JOIN sess b ON b.idx = a.idx - {QUARTER} ASOF JOIN mkt q1 ON q1.date <= a.session ASOF JOIN mkt q0 ON q0.date <= b.session) q ON q.date = p.date""",
}
CONTEXT_NAMES = ("term_spread", "credit_spread", "vix", "mkt_ret")


@query("F5", "SELECT date, ticker, sector_id, " + _columns_sql(CONTEXT_NAMES) + " FROM ctx", CONTEXT_SQL)
def f5(d: Data):
    return features.context(d.panel, d.macro, d.market, d.calendar, d.sectors, CONTEXT_SERIES, QUARTER)


# --- walk-forward ------------------------------------------------------------------------------

MIN_TRAIN, N_FOLDS, EMBARGO = 24, 4, 13
FOLDS = {
    "every": "SELECT DISTINCT date FROM panel",
    "pool": f"SELECT ntile({N_FOLDS}) OVER (ORDER BY date) AS fold, date FROM every WHERE date >= (SELECT (min(date) + INTERVAL {MIN_TRAIN} MONTH)::DATE FROM every)",
    "starts": f"SELECT f.fold, f.start, b.session AS cutoff FROM (SELECT fold, min(date) AS start FROM pool GROUP BY fold) f JOIN sess a ON a.session = f.start LEFT JOIN sess b ON b.idx = a.idx - {EMBARGO}",
    "trainset": f"SELECT s.fold, e.date FROM every e JOIN sess a ON a.session = e.date JOIN sess b ON b.idx = a.idx + {HORIZON} JOIN starts s ON e.date < s.start AND b.session <= s.cutoff",
    "folds": "SELECT fold, date, 'train' AS role FROM trainset UNION ALL SELECT fold, date, 'test' FROM pool WHERE fold IN (SELECT fold FROM trainset)",
}


def plan(d: Data, rows: DataFrame | None = None) -> DataFrame:
    """The folds of the panel's dates; ``rows``: a stored table that has them."""
    return walkforward.folds(d.panel if rows is None else rows, d.calendar, HORIZON, EMBARGO, MIN_TRAIN, N_FOLDS)


@query("M1", "SELECT fold::INTEGER AS fold, date, role FROM folds", FOLDS)
def m1(d: Data):
    return plan(d)


@query("M1_rolling", "SELECT fold::INTEGER AS fold, date, role FROM (SELECT f.* FROM folds f JOIN starts s USING (fold) WHERE role = 'test' AND fold IN (SELECT t.fold FROM trainset t JOIN starts s2 USING (fold) WHERE t.date >= (s2.start - INTERVAL 18 MONTH)::DATE) OR role = 'train' AND f.date >= (s.start - INTERVAL 18 MONTH)::DATE)", FOLDS)
def m1_rolling(d: Data):
    return walkforward.folds(d.panel, d.calendar, HORIZON, EMBARGO, MIN_TRAIN, N_FOLDS, rolling_months=18)


MODEL_FEATURES = ("ret_1m", "ret_3m", "ret_6m", "vol_6m")


@query("M2", "SELECT date, ticker, " + ", ".join(f"r(coalesce({f}, 0)) AS {f}" for f in MODEL_FEATURES) + " FROM momf", FEATURES)
def m2(d: Data):
    return walkforward.imputed(features.momentum(d.weekly, d.panel, WINDOWS), MODEL_FEATURES).select("date", "ticker", *MODEL_FEATURES)


def modelling(d: Data) -> DataFrame:
    """Panel rows with model features, stored once: folds and models read it again and again."""
    rows = d.panel.select("date", "ticker", "excess_median").join(features.momentum(d.weekly, d.panel, WINDOWS), ["date", "ticker"])
    root = scratch(d.spark)
    io.put(rows, root, "features", "matrix")
    return io.get(d.spark, root, "features", "matrix")


# one feature: the ridge slope has a closed form, sum(xy) / (sum(xx) + alpha) of centred sums
RIDGE = FEATURES | FOLDS | {
    "rows_m": "SELECT p.date, p.ticker, p.excess_median AS y, coalesce(m.ret_3m, 0) AS x FROM panel p LEFT JOIN mom_rows m USING (date, ticker)",
    "sums": "SELECT f.fold, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM folds f JOIN rows_m r USING (date) WHERE f.role = 'train' GROUP BY f.fold",
    "fits": "SELECT fold, (sxy - sx * sy / n) / (sxx - sx * sx / n + 10) AS w, sy / n - (sxy - sx * sy / n) / (sxx - sx * sx / n + 10) * sx / n AS b FROM sums",
    "preds": "SELECT f.fold, r.date, r.ticker, r.y, b + w * x AS pred FROM folds f JOIN rows_m r USING (date) JOIN fits USING (fold) WHERE f.role = 'test'",
}


@query("M3", "SELECT fold::INTEGER AS fold, date, ticker, r(y) AS excess_median, r(pred) AS pred FROM preds", RIDGE)
def m3(d: Data):
    rows = modelling(d)
    return walkforward.evaluate_ridge(rows, ["ret_3m"], "excess_median", plan(d, rows), 10.0)


ALPHAS = (1.0, 10.0, 100.0, 1000.0)


def ridge_grid_sql(plan: str) -> dict[str, str]:
    """CTEs up to ``preds_g``: ridges on all model features, by Gauss-Jordan elimination of the centred sums of a plan's folds."""
    k = range(len(MODEL_FEATURES))
    steps = {}
    for at in k:
        rest = [j for j in k if j > at]
        cols = [f"a{at}{j} / a{at}{at} AS a{at}{j}" for j in rest] + [f"b{at} / a{at}{at} AS b{at}"]
        cols += [f"a{i}{j} - a{i}{at} / a{at}{at} * a{at}{j} AS a{i}{j}" for i in k if i != at for j in rest]
        cols += [f"b{i} - a{i}{at} / a{at}{at} * b{at} AS b{i}" for i in k if i != at]
        steps[f"g{at + 1}"] = f"SELECT fold, alpha, n, sy, {', '.join(f's{i}' for i in k)}, {', '.join(cols)} FROM g{at}"
    return {
        "rows_g": "SELECT p.date, p.ticker, p.excess_median AS y, " + ", ".join(f"coalesce(m.{f}, 0) AS x{i}" for i, f in enumerate(MODEL_FEATURES)) + " FROM panel p LEFT JOIN momf m USING (date, ticker)",
        "sums_g": "SELECT f.fold, count(*) AS n, sum(y) AS sy, " + ", ".join(f"sum(x{i}) AS s{i}, sum(x{i} * y) AS p{i}y" for i in k) + ", " + ", ".join(f"sum(x{i} * x{j}) AS p{i}{j}" for i in k for j in k)
                  + f" FROM {plan} f JOIN rows_g r USING (date) WHERE f.role = 'train' AND y IS NOT NULL GROUP BY f.fold",
        "g0": f"SELECT fold, alpha, n, sy, {', '.join(f's{i}' for i in k)}, " + ", ".join(f"p{i}{j} - s{i} * s{j} / n + {'alpha' if i == j else '0'} AS a{i}{j}" for i in k for j in k)
              + ", " + ", ".join(f"p{i}y - s{i} * sy / n AS b{i}" for i in k) + f" FROM sums_g, (SELECT unnest([{', '.join(map(str, ALPHAS))}])::DOUBLE AS alpha)",
        **steps,
        "preds_g": f"SELECT f.fold, g.alpha, r.date, r.ticker, r.y, (sy - {' - '.join(f'b{i} * s{i}' for i in k)}) / n + {' + '.join(f'b{i} * x{i}' for i in k)} AS pred FROM {plan} f JOIN rows_g r USING (date) JOIN g{len(k)} g USING (fold) WHERE f.role = 'test'",
    }


GRID = FEATURES | FOLDS | ridge_grid_sql("folds")


@query("M3_grid", "SELECT fold::INTEGER AS fold, alpha, date, ticker, r(y) AS excess_median, r(pred) AS pred FROM preds_g", GRID)
def m3_grid(d: Data):
    """Ridges on all model features, with each penalty of the grid."""
    rows = modelling(d)
    return walkforward.ridge_grid(rows, MODEL_FEATURES, "excess_median", plan(d, rows), ALPHAS)


@query("M4")
def m4(d: Data):
    """Boosted trees of every fold and setting; the learner is Spark's own, so there is no SQL to match.

    Depths 4 and 5 stand for 15 and 31 leaves.
    """
    rows = modelling(d)
    return walkforward.boosted_grid(rows, MODEL_FEATURES, "excess_median", plan(d, rows), (4, 5), (100, 300))


@query("M5", f"""SELECT fold::INTEGER AS fold, {SUMMARY} FROM gics GROUP BY fold UNION ALL SELECT 0::INTEGER, {SUMMARY} FROM gics""", RIDGE | ic_sql("preds", "fold, date", "pred", "y"))
def m5(d: Data):
    return walkforward.fold_report(m3(d), "excess_median")


@query("M5_grid", f"""SELECT alpha, fold::INTEGER AS fold, {SUMMARY} FROM gics GROUP BY alpha, fold UNION ALL SELECT alpha, 0::INTEGER, {SUMMARY} FROM gics GROUP BY alpha""", GRID | ic_sql("preds_g", "alpha, fold, date", "pred", "y"))
def m5_grid(d: Data):
    return walkforward.fold_report(m3_grid(d), "excess_median", "alpha")


FOLD_ICS = "SELECT {setting} fold, avg(ic) AS fold_ic FROM gics GROUP BY {setting} fold"
FOLD_COLUMNS = "count(*) AS n_folds, r(avg(fold_ic)) AS mean_fold_ic, CASE WHEN stddev_samp(fold_ic) > 0 THEN r(avg(fold_ic) / stddev_samp(fold_ic)) END AS ic_ir, r(avg(CASE WHEN fold_ic > 0 THEN 1.0 ELSE 0.0 END)) AS positive_folds"


@query("M5_folds", f"SELECT alpha, {FOLD_COLUMNS}, r(any_value(mean_ic)) AS mean_ic FROM fold_ics JOIN (SELECT alpha, avg(ic) AS mean_ic FROM gics GROUP BY alpha) USING (alpha) GROUP BY alpha", GRID | ic_sql("preds_g", "alpha, fold, date", "pred", "y") | {"fold_ics": FOLD_ICS.format(setting="alpha,")})
def m5_folds(d: Data):
    """Means over folds and the share of positive ones, for each penalty."""
    ics = evalstats.information_coefficients(m3_grid(d), "pred", "excess_median", ("alpha", "fold", "date"))
    return evalstats.fold_summary(ics, "alpha")


HOLDOUT = RIDGE | {
    "fit_h": "SELECT (sxy - sx * sy / n) / (sxx - sx * sx / n + 10) AS w, sy / n - (sxy - sx * sy / n) / (sxx - sx * sx / n + 10) * sx / n AS b FROM (SELECT count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM rows_m WHERE date <= DATE '1999-06-30')",
    "pred_h": "SELECT date, ticker, y, b + w * x AS pred FROM rows_m, fit_h WHERE date >= DATE '2000-01-01'",
} | ic_sql("pred_h", "date", "pred", "y")


@query("M7", f"SELECT {SUMMARY} FROM gics", HOLDOUT)
def m7(d: Data):
    """One evaluation of a frozen configuration: fitted up to mid-1999, judged from 2000 on."""
    rows = modelling(d)
    predicted = walkforward.evaluate_ridge(rows, ["ret_3m"], "excess_median", hold_out(rows), 10.0)
    return evalstats.ic_summary(evalstats.information_coefficients(predicted, "pred", "excess_median"))


def hold_out(rows: DataFrame) -> DataFrame:
    dates = rows.select("date").distinct()
    role = F.when(F.col("date") <= F.lit("1999-06-30"), "train").when(F.col("date") >= F.lit("2000-01-01"), "test")
    return dates.select(F.lit(1).alias("fold"), "date", role.alias("role")).where("role IS NOT NULL")


HOLDOUT_GRID = FEATURES | {
    "once": "SELECT DISTINCT 1 AS fold, date, CASE WHEN date <= DATE '1999-06-30' THEN 'train' WHEN date >= DATE '2000-01-01' THEN 'test' END AS role FROM panel",
} | ridge_grid_sql("once") | ic_sql("preds_g", "alpha, date", "pred", "y")


@query("M7_grid", f"SELECT alpha, {SUMMARY} FROM gics GROUP BY alpha", HOLDOUT_GRID)
def m7_grid(d: Data):
    """The same hold-out, on all model features and with each penalty."""
    rows = modelling(d)
    predicted = walkforward.ridge_grid(rows, MODEL_FEATURES, "excess_median", hold_out(rows), ALPHAS)
    return evalstats.ic_summary(evalstats.information_coefficients(predicted, "pred", "excess_median", ("alpha", "date")), "alpha")


# the matrix that models use: z columns of four families, and the context of the date
Z_FAMILIES = {"momf": features.MOMENTUM, "valf": VALUE_NAMES, "qualf": QUALITY_NAMES, "growthf": features.GROWTH}
Z_NAMES = tuple(f"{f}_z" for names in Z_FAMILIES.values() for f in names)


def z_sql(source: str, names: tuple[str, ...]) -> str:
    """The z scores alone of :func:`norm_sql`."""
    held = ", ".join(f"CASE WHEN {f} IS NOT NULL THEN greatest(quantile_cont({f}, 0.01) OVER d, least({f}, quantile_cont({f}, 0.99) OVER d)) END AS w_{f}" for f in names)
    out = ", ".join(f"CASE WHEN stddev_samp(w_{f}) OVER d > 0 THEN (w_{f} - avg(w_{f}) OVER d) / stddev_samp(w_{f}) OVER d WHEN {f} IS NOT NULL AND stddev_samp(w_{f}) OVER d = 0 THEN 0.0 END AS {f}_z" for f in names)
    return f"SELECT date, ticker, {out} FROM (SELECT *, {held} FROM {source} WINDOW d AS (PARTITION BY date)) WINDOW d AS (PARTITION BY date)"


MATRIX_SQL = FEATURES | VALUATION_SQL | QUALITY_SQL | GROWTH_SQL | CONTEXT_SQL | {f"z_{source}": z_sql(source, names) for source, names in Z_FAMILIES.items()}


@query("J2_matrix", f"SELECT date, ticker, sector_id, {_columns_sql((*CONTEXT_NAMES, *Z_NAMES))} FROM ctx " + " ".join(f"LEFT JOIN z_{source} USING (date, ticker)" for source in Z_FAMILIES), MATRIX_SQL)
def j2_matrix(d: Data):
    """50 z columns and five of context at the panel's keys."""
    return matrix_rows(d)


MATRIX_TAGS = {"valuation": VALUE_TAGS, "quality": QUALITY_TAGS, "growth": GROWTH_TAGS}
RAW_NAMES = tuple(f for names in Z_FAMILIES.values() for f in names)
TARGETS = ("excess_median", "excess_sector")
LABELS = ("fwd_ret_raw", *TARGETS)


def raw_rows(d: Data) -> DataFrame:
    """The raw features of all families at the panel's keys, with its labels: by ticker over the bucketed contracts, then dealt by date once."""
    return features.by_date(features.by_ticker(d.weekly, d.timeline, d.panel, d.sectors, MATRIX_TAGS, WINDOWS, kept=LABELS))


def matrix_rows(d: Data, kept: tuple[str, ...] = ()) -> DataFrame:
    """z columns by date, then the date's context and the sector's code: two small tables; with some of the labels.

    The raw features and their limits by date are stored: what is winsorised and scored reads them again.
    """
    raw = d._table("raw", lambda: raw_rows(d))
    limits = d._table("limits", lambda: crosssec.tail_quantiles(raw, RAW_NAMES))
    scored = features.z_scores(raw, limits, RAW_NAMES, kept=["sector", *kept])
    codes = crosssec.sector_codes(d.panel, d.sectors).select(F.col("sector").alias("__name"), "sector_id").distinct()
    named = F.coalesce(F.nullif("sector", F.lit("")), F.lit(crosssec.NO_SECTOR))
    known = scored.join(calendar.small(d.date_context), "date", "left").join(calendar.small(codes), named == F.col("__name"), "left")
    return known.select("date", "ticker", "sector_id", *CONTEXT_NAMES, *Z_NAMES, *kept)


# --- models on the whole matrix ----------------------------------------------------------------

INNER_FOLDS, INNER_MONTHS = 2, 6


def model_matrix(d: Data) -> DataFrame:
    """The matrix with both targets, stored once a session: folds and models read it again and again."""
    return d._table("matrix", lambda: matrix_rows(d, LABELS))


NESTED = {
    "otrain": "SELECT fold AS o, date FROM folds WHERE role = 'train' AND fold IN (SELECT fold FROM folds WHERE role = 'train' GROUP BY fold HAVING count(*) > " + f"{INNER_FOLDS})",
    "ipool": f"SELECT o, ntile({INNER_FOLDS}) OVER (PARTITION BY o ORDER BY date) AS k, date FROM otrain JOIN (SELECT o, (min(date) + INTERVAL {INNER_MONTHS} MONTH)::DATE AS low FROM otrain GROUP BY o) USING (o) WHERE date >= low",
    "istarts": f"SELECT f.*, b.session AS cutoff FROM (SELECT o, k, min(date) AS start FROM ipool GROUP BY o, k) f JOIN sess a ON a.session = f.start LEFT JOIN sess b ON b.idx = a.idx - {EMBARGO}",
    "itrain": f"SELECT s.o, s.k, e.date FROM otrain e JOIN sess a ON a.session = e.date JOIN sess b ON b.idx = a.idx + {HORIZON} JOIN istarts s ON s.o = e.o AND e.date < s.start AND b.session <= s.cutoff",
    "cells": """SELECT o, k, date, 'train' AS role FROM itrain UNION ALL SELECT o, k, date, 'test' FROM ipool WHERE (o, k) IN (SELECT (o, k) FROM itrain)
  UNION ALL SELECT fold, 0, date, role FROM folds""",
}


def long_ridge_sql(cells: str, alphas: tuple[float, ...], targets: tuple[str, ...] = TARGETS) -> dict[str, str]:
    """CTEs up to ``lpreds`` (target, o, k, alpha, date, ticker, y, pred): ridges of any number of features, in long form.

    One recursive step eliminates one feature from the centred systems of all cells, targets and penalties.
    """
    size = len(Z_NAMES)
    xs = ", ".join(f"coalesce({z}, 0)" for z in Z_NAMES)
    cell = "target, o, k, alpha"
    return {
        "lrows": " UNION ALL ".join(f"SELECT '{t}' AS target, p.date, p.ticker, p.{t} AS y, [{xs}] AS xs FROM panel p " + " ".join(f"LEFT JOIN z_{x} USING (date, ticker)" for x in Z_FAMILIES) for t in targets),
        "lvec": "SELECT target, date, list_concat([1.0], xs, [y]) AS v FROM lrows WHERE y IS NOT NULL",
        "lgram": f"SELECT target, date, i, j, sum(v[i + 1] * v[j + 1]) AS s FROM lvec, range({size + 2}) a(i), range({size + 2}) b(j) WHERE i <= j GROUP BY ALL",
        "lsums": f"SELECT target, o, k, i, j, sum(s) AS s FROM lgram JOIN {cells} USING (date) WHERE role = 'train' GROUP BY ALL",
        "lfirst": "SELECT target, o, k, j, s, max(CASE WHEN j = 0 THEN s END) OVER (PARTITION BY target, o, k) AS n FROM lsums WHERE i = 0",
        "lpairs": "SELECT * FROM lsums UNION ALL SELECT target, o, k, j, i, s FROM lsums WHERE i <> j",
        "lsystem": f"SELECT p.target, p.o, p.k, alpha, p.i, p.j, p.s - a.s * b.s / a.n + CASE WHEN p.i = p.j THEN alpha ELSE 0 END AS v FROM lpairs p JOIN lfirst a ON (a.target, a.o, a.k, a.j) = (p.target, p.o, p.k, p.i) "
        f"JOIN lfirst b ON (b.target, b.o, b.k, b.j) = (p.target, p.o, p.k, p.j), (SELECT unnest({list(alphas)})::DOUBLE AS alpha) WHERE p.i BETWEEN 1 AND {size} AND p.j > 0",
        "lelim": f"""SELECT {cell}, 0 AS step, i, j, v FROM lsystem UNION ALL
  SELECT {cell}, step + 1, i, j, CASE WHEN i = step + 1 THEN v / corner ELSE v - side / corner * head END FROM (
    SELECT *, max(CASE WHEN i = step + 1 AND j = step + 1 THEN v END) OVER (PARTITION BY {cell}) AS corner, max(CASE WHEN j = step + 1 THEN v END) OVER (PARTITION BY {cell}, i) AS side,
           max(CASE WHEN i = step + 1 THEN v END) OVER (PARTITION BY {cell}, j) AS head FROM lelim WHERE step < {size}) WHERE j > step + 1""",
        "lweights": f"SELECT {cell}, i, v AS w FROM lelim WHERE step = {size}",
        "lbase": f"SELECT w.target, w.o, w.k, w.alpha, any_value(y.s) / any_value(y.n) - sum(w.w * f.s / f.n) AS b, list(w.w ORDER BY w.i) AS ws FROM lweights w JOIN lfirst f ON (f.target, f.o, f.k, f.j) = (w.target, w.o, w.k, w.i) "
        f"JOIN lfirst y ON (y.target, y.o, y.k, y.j) = (w.target, w.o, w.k, {size + 1}) GROUP BY w.target, w.o, w.k, w.alpha",
        "lpreds": f"SELECT {cell}, date, ticker, y, b + list_inner_product(xs, ws) AS pred FROM lrows JOIN (SELECT * FROM {cells} WHERE role = 'test') USING (date) JOIN lbase USING (target, o, k)",
    }


CHOICE = {"tried": "SELECT * FROM lpreds WHERE k > 0"} | ic_sql("tried", "target, o, k, alpha, date", "pred", "y") | {
    "inner_ics": "SELECT target, o, alpha, avg(ic) AS inner_ic FROM gics GROUP BY ALL",
    "chosen": "SELECT DISTINCT ON (target, o) target, o, alpha, inner_ic FROM (SELECT DISTINCT target, o, alpha FROM lbase WHERE k = 0 AND o > 0) LEFT JOIN inner_ics USING (target, o, alpha) ORDER BY target, o, round(inner_ic, 12) DESC NULLS LAST, alpha",
}
M6_SQL = MATRIX_SQL | FOLDS | NESTED | long_ridge_sql("cells", ALPHAS) | CHOICE | {
    "nested": "SELECT target, o AS fold, date, ticker, y, pred FROM lpreds JOIN chosen USING (target, o, alpha) WHERE k = 0",
}


def nested(d: Data) -> tuple[DataFrame, DataFrame]:
    rows = model_matrix(d)
    return walkforward.nested_ridges(rows, Z_NAMES, TARGETS, plan(d, rows), d.calendar, ALPHAS, HORIZON, EMBARGO, INNER_FOLDS, INNER_MONTHS)


@query("M6", "SELECT target, o::INTEGER AS fold, alpha, r(inner_ic) AS inner_ic FROM chosen", M6_SQL)
def m6(d: Data):
    """Nested tuning of ridges on all 50 z columns, for both targets."""
    return nested(d)[1]


def renamed(sqls: dict[str, str], *names: str, suffix: str = "_b") -> dict[str, str]:
    """CTEs with a suffix behind some names, so that two of a kind can stand in one query."""
    return {f"{k}{suffix}" if k in names else k: re.sub(rf"\b({'|'.join(names)})\b", rf"\1{suffix}", v) for k, v in sqls.items()}


@query("M6_folds", f"SELECT target, fold::INTEGER AS fold, {SUMMARY} FROM gics_b GROUP BY target, fold UNION ALL SELECT target, 0::INTEGER, {SUMMARY} FROM gics_b GROUP BY target", M6_SQL | renamed(ic_sql("nested", "target, fold, date", "pred", "y"), "rk", "gics"))
def m6_folds(d: Data):
    """What the nested ridges are worth out of sample, by target and fold."""
    return walkforward.fold_report(nested(d)[0].withColumnRenamed("actual", "y"), "y", "target")


# --- the hold-out report -----------------------------------------------------------------------

DEV_END, HOLD_START = "1999-06-30", "2000-01-01"
FROZEN_TARGET = TARGETS[0]


def listed_sql(part: str, source: str, names: str, key: str = "") -> str:
    """part, name, value of the columns ``names`` of a CTE; ``key`` stands before the column's name."""
    of = lambda n: f"{key} || ' {n}'" if key else f"'{n}'"
    return " UNION ALL ".join(f"SELECT '{part}' AS part, {of(n)} AS name, r({n}) AS value FROM {source}" for n in names.split())


def window_sql(source: str) -> str:
    return f"SELECT strftime(min(date), '%Y%m%d')::DOUBLE AS first, strftime(max(date), '%Y%m%d')::DOUBLE AS last, count(DISTINCT date) AS n_dates FROM {source}"


IC_NAMES = "n_dates mean_ic std_ic ir t_stat positive_share"
PERFORMANCE_NAMES = "n cagr ann_vol sharpe sortino max_drawdown hit_rate"
REPORT_SQL = MATRIX_SQL | TERMINAL | FOLDS | NESTED | {
    "every": f"SELECT DISTINCT date FROM panel WHERE date <= DATE '{DEV_END}'",
    "cells_h": f"""SELECT * FROM cells UNION ALL SELECT -1, 0, date, CASE WHEN date <= DATE '{DEV_END}' THEN 'train' ELSE 'test' END
  FROM (SELECT DISTINCT date FROM panel WHERE date <= DATE '{DEV_END}' OR date >= DATE '{HOLD_START}')""",
} | long_ridge_sql("cells_h", ALPHAS, (FROZEN_TARGET,)) | CHOICE | {
    "modal": "SELECT alpha FROM chosen GROUP BY alpha ORDER BY count(*) DESC, alpha DESC LIMIT 1",
    "pred_h": "SELECT date, ticker, y, pred FROM lpreds WHERE o = -1 AND alpha = (SELECT alpha FROM modal) AND y IS NOT NULL",
    "val_h": "SELECT date, pred, z_valf.earnings_yield_z AS x FROM pred_h JOIN z_valf USING (date, ticker)",
    "sig_h": "SELECT date, ticker, pred AS signal FROM pred_h",
} | renamed({k: v.replace("FROM mom ", "FROM sig_h ") for k, v in TOP.items()}, "sized", "top", "bottom", suffix="_m") | {
    "legs_m": """SELECT date, l.m AS long, s.m AS short FROM (SELECT date, avg(ret) AS m FROM top_m LEFT JOIN term_hold USING (date, ticker) GROUP BY date) l
  JOIN (SELECT date, avg(ret) AS m FROM bottom_m LEFT JOIN term_hold USING (date, ticker) GROUP BY date) s USING (date)""",
    "mkt_hold": "SELECT h.date, 'MKT' AS ticker, q1.close_adj / q0.close_adj - 1 AS ret FROM (SELECT * FROM rebn WHERE next_date IS NOT NULL) h ASOF JOIN mkt q0 ON q0.date <= h.date ASOF JOIN mkt q1 ON q1.date <= h.next_date",
    "w_m": "SELECT * FROM top_m WHERE date IN (SELECT date FROM term_hold)",
    "w_e": f"SELECT date, ticker, 1.0 / count(*) OVER (PARTITION BY date) AS weight FROM panel WHERE date >= DATE '{HOLD_START}' AND date IN (SELECT date FROM term_hold)",
    "w_b": "SELECT date, ticker, 1.0 AS weight FROM mkt_hold",
} | drift_sql("w_m", "_m", "term_hold") | drift_sql("w_e", "_e", "term_hold") | drift_sql("w_b", "_k", "mkt_hold") | {
    "runs": "SELECT 'model' AS strategy, * FROM bt_m UNION ALL SELECT 'equal', * FROM bt_e UNION ALL SELECT 'market', * FROM bt_k",
    "common_r": "SELECT * FROM runs WHERE date IN (SELECT date FROM runs GROUP BY date HAVING count(DISTINCT strategy) = 3)",
    "net_r": "SELECT strategy, date, net AS ret FROM common_r",
    "perf_r": performance_sql("net_r", "ret", "strategy,"),
    "cost_r": """SELECT strategy, avg(turnover) AS avg_turnover, CASE WHEN product(1 + gross) > product(1 + net) THEN ln(greatest(product(1 + gross) - product(1 + net), 1e-300)) END AS log_cost_drag
  FROM common_r GROUP BY strategy""",
    "window_r": window_sql("pred_h"), "common_w": window_sql("common_r"),
} | renamed(ic_sql("pred_h", "date", "pred", "y"), "rk", "gics", suffix="_h") | renamed(ic_sql("val_h", "date", "pred", "x", 1), "rk", "gics", suffix="_v") | bins_sql("pred_h", "pred", "y", "date", 10) | {
    "ic_r": f"SELECT {SUMMARY} FROM gics_h",
    "year_r": f"SELECT year(date) AS year, {SUMMARY} FROM gics_h GROUP BY 1",
    "spread_r": """SELECT max(CASE WHEN bin = 9 THEN mean_ret END) - max(CASE WHEN bin = 0 THEN mean_ret END) AS top_minus_bottom, corr(bin, rk) AS monotonicity
  FROM (SELECT *, rank() OVER (ORDER BY mean_ret) AS rk FROM bymean)""",
    "along_r": "SELECT count(*) AS n_dates, avg(ic) AS mean_corr FROM gics_v",
    "legs_r": "SELECT avg(long) AS long_mean, avg(short) AS short_mean, avg(long - short) AS mean_spread, CASE WHEN stddev_samp(long - short) > 0 THEN avg(long - short) / stddev_samp(long - short) * sqrt(12.0) END AS sharpe FROM legs_m",
}
REPORT = " UNION ALL ".join([
    listed_sql("pick", "chosen", "alpha", "(o::INTEGER)"), listed_sql("frozen", "modal", "alpha"), listed_sql("window", "window_r", "first last n_dates"), listed_sql("ic", "ic_r", IC_NAMES),
    listed_sql("year", "year_r", IC_NAMES, "year"), listed_sql("decile", "bymean", "mean_ret n_groups", "(bin::INTEGER)"), listed_sql("decile", "spread_r", "top_minus_bottom monotonicity"),
    listed_sql("exposure", "along_r", "n_dates mean_corr"), listed_sql("legs", "legs_r", "long_mean short_mean mean_spread sharpe"),
    listed_sql("backtest", "perf_r", PERFORMANCE_NAMES, "strategy"), listed_sql("backtest", "cost_r", "avg_turnover log_cost_drag", "strategy"), listed_sql("common", "common_w", "first last n_dates"),
])


@query("M7_report", REPORT, REPORT_SQL)
def m7_report(d: Data):
    """The whole report on the hold-out, of the ridge on 50 z columns whose penalty the folds up to mid-1999 pick most often.

    What costs took is a logarithm, as in ``A4_costs``.
    """
    rows = model_matrix(d)
    dev, held = F.col("date") <= F.lit(DEV_END), F.col("date") >= F.lit(HOLD_START)
    known = rows.where(dev)
    picks = walkforward.nested_ridges(known, Z_NAMES, [FROZEN_TARGET], plan(d, known), d.calendar, ALPHAS, HORIZON, EMBARGO, INNER_FOLDS, INNER_MONTHS)[1]
    predicted = walkforward.stored(holdout.frozen_ridge(rows, Z_NAMES, FROZEN_TARGET, picks, dev, held))
    holding = returns.delisting_aware_holding_returns(d.weekly, d.rebalances, d.liquidated)
    market = returns.holding_returns(d.market, d.rebalances)
    found = holdout.report(predicted, rows.withColumn("exposure", F.col("earnings_yield_z")), rows.where(held), holding, market, BPS)
    drag = F.col("name").endswith("total_cost_drag")
    found = found.withColumns({"value": F.when(drag, F.when(F.col("value") > 0, F.ln("value"))).otherwise(F.col("value")), "name": F.regexp_replace("name", "total_cost_drag$", "log_cost_drag")})
    chosen = holdout.listed("pick", picks.select("fold", "alpha"), "fold").unionByName(holdout.listed("frozen", predicted.select("alpha").distinct()))
    return chosen.unionByName(found)
