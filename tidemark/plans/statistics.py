"""Queries for statistics (A)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import clean
from ..operators import asof, evalstats, events, features, intervals, portfolio, returns
from ..session import scratch
from ..sources import io
from .base import PERIODS, Data, query
from .returns_and_windows import EVENT_RETURNS, FEATURES, SURPRISES, TOP, WINDOWS, adjusted_event_returns, event_returns, less_market, quarters

SUMMARY = """count(ic) AS n_dates, r(avg(ic)) AS mean_ic, r(stddev_samp(ic)) AS std_ic, CASE WHEN stddev_samp(ic) > 0 THEN r(avg(ic) / stddev_samp(ic)) END AS ir,
  CASE WHEN stddev_samp(ic) > 0 THEN r(avg(ic) / (stddev_samp(ic) / sqrt(count(ic)))) END AS t_stat, r(avg(CASE WHEN ic > 1e-12 THEN 1.0 ELSE 0.0 END)) AS positive_share"""
STAT = "count({x}) AS n, r(avg({x})) AS mean, r(median({x})) AS median, CASE WHEN count({x}) > 2 AND stddev_samp({x}) > 0 THEN r(avg({x}) / (stddev_samp({x}) / sqrt(count({x})))) END AS t_stat"


def ic_sql(source: str, group: str, x: str, y: str, least: int = 5) -> dict[str, str]:
    """CTEs ``rk`` and ``gics``: average ranks and ICs of a source by group columns."""
    return {
        "rk": f"""SELECT {group}, rank() OVER (PARTITION BY {group} ORDER BY {x}) + (count(*) OVER (PARTITION BY {group}, {x}) - 1) / 2.0 AS rs,
  rank() OVER (PARTITION BY {group} ORDER BY {y}) + (count(*) OVER (PARTITION BY {group}, {y}) - 1) / 2.0 AS rt FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL""",
        "gics": f"SELECT {group}, corr(rs, rt) AS ic, count(*) AS n FROM rk GROUP BY {group} HAVING count(*) >= {least} AND min(rs) < max(rs) AND min(rt) < max(rt)",
    }


@query("A1", "SELECT date, r(ic) AS ic, n FROM ics")
def a1(d: Data):
    return evalstats.information_coefficients(d.scored, "signal", "fwd_ret_raw")


@query("A2", f"SELECT {SUMMARY} FROM ics")
def a2(d: Data):
    return evalstats.ic_summary(a1(d))


def bins_sql(source: str, x: str, y: str, group: str, bins: int, order: str = "ticker") -> dict[str, str]:
    return {
        "placed": f"SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {x}, {order}) AS place, count(*) OVER (PARTITION BY {group}) AS n FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL",
        "binned": f"SELECT *, greatest(0, ((place - 1) * {bins} + n - 2) // greatest(n - 1, 1) - 1) AS bin FROM placed WHERE n >= {bins}",
        "bymean": f"SELECT bin, avg(m) AS mean_ret, count(m) AS n_groups FROM (SELECT {group}, bin, avg({y}) AS m FROM binned GROUP BY ALL) GROUP BY bin",
    }


BINS = bins_sql("scored", "signal", "fwd_ret_raw", "date", 10)


@query("A3", "SELECT bin::INTEGER AS bin, r(mean_ret) AS mean_ret, n_groups FROM bymean", BINS)
def a3(d: Data):
    return evalstats.quantile_returns(d.scored, "signal", "fwd_ret_raw")


@query("A3_summary", """SELECT r(max(CASE WHEN bin = 9 THEN mean_ret END) - max(CASE WHEN bin = 0 THEN mean_ret END)) AS top_minus_bottom, r(corr(bin, rk)) AS monotonicity FROM (SELECT *, rank() OVER (ORDER BY mean_ret) AS rk FROM bymean)""", BINS)
def a3_summary(d: Data):
    return evalstats.quantile_summary(a3(d))


def performance_sql(source: str, x: str, group: str = "") -> str:
    """Performance of per-date returns by ``group`` (with a trailing comma if any)."""
    part = f"PARTITION BY {group.rstrip(', ')} " if group else ""
    tail = f"GROUP BY {group.rstrip(', ')}" if group else ""
    return f"""SELECT {group} count(*) AS n, r(pow(product(1 + {x}), {PERIODS} / count(*)) - 1) AS cagr, r(stddev_samp({x}) * sqrt({PERIODS})) AS ann_vol,
  CASE WHEN stddev_samp({x}) > 0 THEN r(avg({x}) / stddev_samp({x}) * sqrt({PERIODS})) END AS sharpe,
  CASE WHEN stddev_samp(CASE WHEN {x} < 0 THEN {x} END) > 0 THEN r(avg({x}) / stddev_samp(CASE WHEN {x} < 0 THEN {x} END) * sqrt({PERIODS})) END AS sortino,
  r(min(drawdown)) AS max_drawdown, r(avg(CASE WHEN {x} > 0 THEN 1.0 ELSE 0.0 END)) AS hit_rate
  FROM (SELECT *, equity / max(equity) OVER ({part}ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM (SELECT *, product(1 + {x}) OVER ({part}ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity FROM {source} WHERE {x} IS NOT NULL)) {tail}"""


@query("A4", performance_sql("hold", "ret", "ticker,"))
def a4(d: Data):
    return evalstats.performance(d.holding, "ret", "ticker", periods=PERIODS)


@query("A5", f"SELECT {STAT.format(x='ret')} FROM adj", EVENT_RETURNS)
def a5(d: Data):
    return evalstats.event_statistics(adjusted_event_returns(d), "ret")


@query("A6", f"SELECT year(date)::INTEGER AS year, {STAT.format(x='ret')} FROM adj GROUP BY 1 HAVING count(ret) >= 30", EVENT_RETURNS)
def a6(d: Data):
    return evalstats.event_statistics(adjusted_event_returns(d).withColumn("year", F.year("date")), "ret", "year", least=30)


# cohorts: surprises by the month in which they were filed, with the adjusted return from that day on
COHORTS = EVENT_RETURNS | SURPRISES | {
    "ev": "SELECT DISTINCT ticker, filed AS date FROM sues",
    "study": "SELECT s.ticker, strftime(s.filed, '%Y-%m') AS cohort, year(s.filed)::INTEGER AS year, s.period, s.sue, a.ret FROM sues s JOIN adj a ON a.ticker = s.ticker AND a.date = s.filed",
}


def study(d: Data):
    sues = events.surprises(quarters(d))
    own = sues.select("ticker", F.col("filed").alias("date")).distinct()
    adjusted = less_market(d, returns.event_returns(own, d.weekly, d.calendar, 13, lag=1)).select("ticker", F.col("date").alias("filed"), "ret")
    return sues.join(adjusted, ["ticker", "filed"]).select("ticker", F.date_format("filed", "yyyy-MM").alias("cohort"), F.year("filed").alias("year"), "period", "sue", "ret")


@query("A7", "SELECT cohort, r(ic) AS ic, n FROM gics", COHORTS | ic_sql("study", "cohort", "sue", "ret", 10))
def a7(d: Data):
    return evalstats.information_coefficients(study(d), "sue", "ret", ("cohort",), 10)


@query("A7_year", "SELECT year, r(ic) AS ic, n FROM gics", COHORTS | ic_sql("study", "year", "sue", "ret", 20))
def a7_year(d: Data):
    return evalstats.information_coefficients(study(d), "sue", "ret", ("year",), 20)


@query("A8", "SELECT bin::INTEGER AS bin, r(mean_ret) AS mean_ret, n_groups FROM bymean", COHORTS | bins_sql("study", "sue", "ret", "year", 10))
def a8(d: Data):
    return evalstats.quantile_returns(study(d), "sue", "ret", 10, "year")


@query("A9", "SELECT bps::DOUBLE AS bps, count(*) AS n, r(avg(ret - 2 * bps / 10000)) AS mean_net FROM adj, (VALUES (25.0), (30.0), (50.0), (100.0)) AS b(bps) GROUP BY bps", EVENT_RETURNS)
def a9(d: Data):
    return returns.net_of_costs(adjusted_event_returns(d), "ret", [25, 30, 50, 100]).groupBy("bps").agg(F.count("*").alias("n"), F.avg("net").alias("mean_net"))


A10_NAMES, A10_TARGETS = features.MOMENTUM, ("fwd_ret_raw", "excess_median", "excess_sector")
REPORT = FEATURES | {
    "wide_f": f"SELECT p.date, p.ticker, {', '.join((*A10_TARGETS, *A10_NAMES))} FROM panel p LEFT JOIN mom_rows m USING (date, ticker)",
    "long_f": " UNION ALL ".join(f"SELECT date, ticker, '{f}' AS feature, '{t}' AS target, {f} AS x, {t} AS y FROM wide_f" for f in A10_NAMES for t in A10_TARGETS),
} | ic_sql("long_f", "feature, target, date", "x", "y")


@query("A10", """SELECT feature, target, r(avg(CASE WHEN x IS NOT NULL THEN 1.0 ELSE 0.0 END)) AS coverage, r(avg(CASE WHEN x IS NULL THEN 1.0 ELSE 0.0 END)) AS missing_rate, any_value(s.n_dates) AS n_dates, any_value(s.mean_ic) AS mean_ic, any_value(s.t_stat) AS t_stat
  FROM long_f LEFT JOIN (SELECT feature, target, """ + SUMMARY + " FROM gics GROUP BY feature, target) s USING (feature, target) GROUP BY feature, target", REPORT)
def a10(d: Data):
    return evalstats.coverage(features.momentum_columns(d.weekly, WINDOWS), d.panel, A10_NAMES, A10_TARGETS)


IN = '(m.start IS NULL OR m.start <= r.date) AND (m."end" IS NULL OR r.date < m."end")'
SNAP = {"memb": f"SELECT r.date, m.ticker FROM reb r JOIN members m ON {IN}"}


@query("A11", "SELECT date, r(sum(CASE WHEN a.ticker IS NOT NULL AND b.ticker IS NOT NULL THEN 1 ELSE 0 END) / count(*)) AS jaccard FROM memb a FULL JOIN probes b USING (date, ticker) GROUP BY date", SNAP)
def a11(d: Data):
    return evalstats.jaccard(intervals.members_on(d.members, d.rebalances), d.probes)


@query("A12", "SELECT count(*) AS n_leaks FROM panel p WHERE NOT EXISTS (SELECT 1 FROM memb m WHERE m.date = p.date AND m.ticker = p.ticker)", SNAP)
def a12(d: Data):
    return intervals.not_members(d.panel.select("date", "ticker"), d.members).agg(F.count("*").alias("n_leaks"))


@query("A13", "SELECT min(n) AS min_n, r(median(n)) AS median_n, max(n) AS max_n, arg_min(n, date) AS first_n, arg_max(n, date) AS last_n FROM (SELECT date, count(DISTINCT ticker) AS n FROM panel GROUP BY date)")
def a13(d: Data):
    return evalstats.names_per_date(d.panel)


@query("A14", "SELECT ticker, count(DISTINCT member) AS n_entities FROM trades GROUP BY ticker HAVING count(DISTINCT member) > 1")
def a14(d: Data):
    return d.trades.groupBy("ticker").agg(F.countDistinct("member").alias("n_entities")).where("n_entities > 1")


@query("A15", "SELECT date, count(*) AS n, r(avg(CASE WHEN f.value IS NOT NULL THEN 1.0 ELSE 0.0 END)) AS coverage FROM probes p ASOF LEFT JOIN (SELECT ticker, filed, arg_max(value, (period_end, value)) AS value FROM facts WHERE tag = '1-URGENT' GROUP BY ALL) f ON f.ticker = p.ticker AND f.filed <= p.date GROUP BY date")
def a15(d: Data):
    known = asof.facts_asof(d.facts_of("1-URGENT"), d.probes, ["1-URGENT"])
    return known.groupBy("date").agg(F.count("*").alias("n"), F.avg(F.col("1-URGENT").isNotNull().cast("double")).alias("coverage"))


@query("A16", "SELECT p_type, " + ", ".join(f"r(quantile_cont(p_retailprice, {q})) AS q{int(q * 100)}" for q in (0.0, 0.25, 0.5, 0.75, 1.0)) + " FROM part GROUP BY p_type")
def a16(d: Data):
    q = F.percentile("p_retailprice", F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0))))
    return d.table("part").groupBy("p_type").agg(q.alias("q")).select("p_type", *(F.col("q")[k].alias(f"q{25 * k}") for k in range(5)))


EXPOSED = {"exposed": "SELECT m.date, m.ticker, m.signal, ln(e.close_raw) AS size FROM mom m JOIN pw e USING (date, ticker)"} | ic_sql("exposed", "date", "signal", "size", 1)


@query("A17", "SELECT count(*) AS n_dates, r(avg(ic)) AS avg_corr FROM gics", EXPOSED)
def a17(d: Data):
    rows = d.momentum.join(d.weekly, ["date", "ticker"]).select("date", "ticker", "signal", F.ln("close_raw").alias("size"))
    return evalstats.information_coefficients(rows, "signal", "size", least=1).agg(F.count("*").alias("n_dates"), F.avg("ic").alias("avg_corr"))


PERIOD = "CASE WHEN year(date) BETWEEN 1995 AND 1997 THEN 'P1' WHEN year(date) BETWEEN 1998 AND 1999 THEN 'P2' ELSE 'other' END"


@query("A18", f"SELECT {PERIOD} AS period, {SUMMARY} FROM ics GROUP BY 1")
def a18(d: Data):
    return evalstats.ic_summary(a1(d).withColumn("period", clean.period(F.year("date"), [("P1", 1995, 1997), ("P2", 1998, 1999)])), "period")


LEGS = TOP | {
    "legs": """SELECT date, l.m AS long, s.m AS short FROM (SELECT date, avg(ret) AS m FROM top LEFT JOIN hold USING (date, ticker) GROUP BY date) l JOIN (SELECT date, avg(ret) AS m FROM bottom LEFT JOIN hold USING (date, ticker) GROUP BY date) s USING (date)""",
}


@query("A19", "SELECT date, r(long) AS long, r(short) AS short FROM legs", LEGS)
def a19(d: Data):
    return portfolio.leg_returns(d.momentum, d.holding)[0]


@query("A19_summary", "SELECT r(avg(long - short)) AS mean_spread, r(avg(long - short) / stddev_samp(long - short) * sqrt(12.0)) AS sharpe FROM legs", LEGS)
def a19_summary(d: Data):
    return portfolio.leg_returns(d.momentum, d.holding)[1]


PERSIST = EVENT_RETURNS | {
    "pers": """SELECT ticker AS member, count(*) AS n, count(CASE WHEN year(date) <= 1997 THEN ret END) AS n1, count(CASE WHEN year(date) >= 1998 THEN ret END) AS n2,
  avg(CASE WHEN year(date) <= 1997 THEN ret END) AS p1, avg(CASE WHEN year(date) >= 1998 THEN ret END) AS p2 FROM (SELECT e.ticker, e.date, a.ret FROM evret e LEFT JOIN adj a USING (ticker, date)) GROUP BY ticker HAVING n >= 25 AND n1 >= 10 AND n2 >= 10""",
}


def persistence(d: Data):
    every = event_returns(d).select("ticker", "date")
    rows = every.join(adjusted_event_returns(d), ["ticker", "date"], "left").withColumnRenamed("ticker", "member")
    return evalstats.persistence(rows, F.year("date") <= 1997, F.year("date") >= 1998)


@query("A20", "SELECT member, n, n1, n2, r(p1) AS p1, r(p2) AS p2 FROM pers", PERSIST)
def a20(d: Data):
    return persistence(d)


# Student's t with a whole number of degrees of freedom: the finite series, its terms by the gamma function
P_VALUE = """CASE WHEN n > 2 AND abs(rho) < 1 THEN r(greatest(0.0, 1 - CASE WHEN n % 2 = 0 THEN
    sqrt(1 - c) * list_sum([pow(c, j) * exp(lgamma(j + 0.5) - lgamma(j + 1)) / sqrt(pi()) for j in range(0, n // 2 - 1)])
  ELSE 2 / pi() * (atan(sqrt((1 - c) / c)) + CASE WHEN n > 3 THEN sqrt(c * (1 - c)) * list_sum([pow(c, j) * exp(lgamma(j + 1) - lgamma(j + 1.5)) * sqrt(pi()) / 2 for j in range(0, (n - 3) // 2)]) ELSE 0 END) END)) END"""


@query("A20_summary", f"""SELECT n, CASE WHEN n >= 5 THEN r(rho) END AS rho, CASE WHEN n >= 5 THEN {P_VALUE} END AS p_value, CASE WHEN n >= 5 THEN n_top::BIGINT END AS n_top,
  CASE WHEN n >= 5 THEN r(top) END AS top_mean, CASE WHEN n >= 5 THEN r(rest) END AS rest_mean, CASE WHEN n >= 5 THEN r(top - rest) END AS top_minus_rest FROM (
  SELECT count(*) AS n, corr(r1, r2) AS rho, 1 - pow(corr(r1, r2), 2) AS c, count(CASE WHEN p1 >= cut THEN 1 END) AS n_top, avg(CASE WHEN p1 >= cut THEN p2 END) AS top, avg(CASE WHEN p1 < cut THEN p2 END) AS rest FROM (
  SELECT *, rank() OVER (ORDER BY p1) AS r1, rank() OVER (ORDER BY p2) AS r2, (SELECT quantile_cont(p1, 0.8) FROM pers) AS cut FROM pers))""", PERSIST)
def a20_summary(d: Data):
    """Members are stored once: limits, ranks and the summary read them again."""
    root = scratch(d.spark)
    io.put(persistence(d), root, "results", "members")
    return evalstats.persistence_summary(io.get(d.spark, root, "results", "members"))


DELAYED = EVENT_RETURNS | {
    "ev": "SELECT DISTINCT ticker, filed AS date FROM facts WHERE tag = '1-URGENT' UNION SELECT ticker, (filed + 28)::DATE FROM facts WHERE tag = '1-URGENT'",
    "pairs": "SELECT a.ticker, a.date, a.ret AS at_trade, b.ret AS at_filing FROM evret a JOIN evret b ON b.ticker = a.ticker AND b.date = a.date + 28 WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL AND EXISTS (SELECT 1 FROM facts f WHERE f.tag = '1-URGENT' AND f.ticker = a.ticker AND f.filed = a.date)",
}


@query("A21", "SELECT count(*) AS n, r(avg(at_trade)) AS mean_trade, r(avg(at_filing)) AS mean_filing, r(avg(at_filing) / avg(at_trade)) AS retained FROM pairs", DELAYED)
def a21(d: Data):
    own = d.facts_of("1-URGENT").select("ticker", F.col("filed").alias("date"), F.date_add("filed", 28).alias("disclosed")).distinct()
    held = returns.event_returns(own, d.weekly, d.calendar, 13, lag=1, on="date", to="at_trade").drop("entry")
    both = returns.event_returns(held, d.weekly, d.calendar, 13, lag=1, on="disclosed", to="at_filing").where("at_trade IS NOT NULL AND at_filing IS NOT NULL")
    return both.agg(F.count("*").alias("n"), F.avg("at_trade").alias("mean_trade"), F.avg("at_filing").alias("mean_filing"), (F.avg("at_filing") / F.avg("at_trade")).alias("retained"))


@query("A22", """SELECT o_orderpriority, r(avg(lag)) AS mean_lag, r(median(lag)) AS median_lag, r(quantile_cont(lag, 0.9)) AS p90_lag, r(avg(CASE WHEN lag > 45 THEN 1.0 ELSE 0.0 END)) AS late_share FROM (
  SELECT o_orderpriority, (l_shipdate::DATE - o_orderdate::DATE) AS lag FROM orders JOIN lineitem ON o_orderkey = l_orderkey) GROUP BY 1""")
def a22(d: Data):
    rows = d.table("orders").join(d.table("lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderpriority", F.datediff("l_shipdate", "o_orderdate").alias("lag"))
    return rows.groupBy("o_orderpriority").agg(F.avg("lag").alias("mean_lag"), F.median("lag").alias("median_lag"), F.percentile("lag", F.lit(0.9)).alias("p90_lag"), F.avg((F.col("lag") > 45).cast("double")).alias("late_share"))


@query("A23", "SELECT ticker, count(*) AS n FROM trades GROUP BY ticker ORDER BY n DESC, ticker LIMIT 10")
def a23(d: Data):
    return d.trades.groupBy("ticker").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ticker").limit(10)


@query("A24", "SELECT ticker, tag, period_end, filed, r(value) AS value FROM (SELECT *, row_number() OVER (PARTITION BY ticker, tag, period_end ORDER BY filed) AS place FROM facts) WHERE place = 1")
def a24(d: Data):
    return events.first_vintage(d.facts, ["ticker", "tag", "period_end"], ["filed"]).select("ticker", "tag", "period_end", "filed", "value")


@query("A25", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events WHERE event_type <> 'view') WHERE place = 1")
def a25(d: Data):
    return clean.latest_reference(d.table("events").where("event_type <> 'view'"), "user_id", [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("A26", "SELECT sector, count(DISTINCT ticker) AS n_names, r(count(DISTINCT ticker) / (SELECT count(DISTINCT ticker) FROM panel)) AS share FROM panel GROUP BY sector")
def a26(d: Data):
    by = d.panel.groupBy("sector").agg(F.countDistinct("ticker").alias("n_names"))
    return by.withColumn("share", F.col("n_names") / F.sum("n_names").over(Window.partitionBy(F.lit(0))))


@query("A27", "SELECT r(max(abs(m))) AS max_abs_median FROM (SELECT date, median(excess_median) AS m FROM panel GROUP BY date)")
def a27(d: Data):
    return d.panel.groupBy("date").agg(F.median("excess_median").alias("m")).agg(F.max(F.abs("m")).alias("max_abs_median"))


@query("A27_summary", "SELECT count(fwd_ret_raw) AS n, r(avg(fwd_ret_raw)) AS mean, r(stddev_samp(fwd_ret_raw)) AS std, r(min(fwd_ret_raw)) AS low, r(quantile_cont(fwd_ret_raw, 0.5)) AS middle, r(max(fwd_ret_raw)) AS high FROM panel")
def a27_summary(d: Data):
    x = F.col("fwd_ret_raw")
    return d.panel.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("low"), F.percentile(x, F.lit(0.5)).alias("middle"), F.max(x).alias("high"))


A28 = {
    "vol_m": "SELECT m.date, m.ticker, x.vol_12m AS signal, f.fwd_ret_raw FROM mom m JOIN mom_rows x USING (date, ticker) JOIN fwd f USING (date, ticker)",
    "cand": " UNION ALL ".join(f"SELECT '{name}' AS model, p.date, s.ticker, s.signal, p.{t} AS y, '{t}' AS target FROM {src} s JOIN panel p USING (date, ticker)" for name, src in (("momentum", "scored"), ("volatility", "vol_m")) for t in ("excess_median", "excess_sector")),
} | ic_sql("cand", "model, target, date", "signal", "y") | FEATURES


def candidates(d: Data):
    vol = features.momentum_columns(d.weekly, WINDOWS).select("date", "ticker", F.col("vol_12m").alias("volatility"))
    rows = d.scored.select("date", "ticker", F.col("signal").alias("momentum")).join(vol, ["date", "ticker"]).join(d.panel.select("date", "ticker", "excess_median", "excess_sector"), ["date", "ticker"])
    models = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).alias("x")) for m in ("momentum", "volatility"))))
    goals = F.explode(F.array(*(F.struct(F.lit(t).alias("target"), F.col(t).alias("y")) for t in ("excess_median", "excess_sector"))))
    long = rows.select("date", "excess_median", "excess_sector", models.alias("m")).select("date", "m.*", goals.alias("g")).select("date", "model", "x", "g.*")
    return evalstats.information_coefficients(long, "x", "y", ("model", "target", "date"))


# the dates after two years, in four blocks: what a candidate is judged by
A28 |= {
    "judged": "SELECT ntile(4) OVER (ORDER BY date) AS fold, date FROM (SELECT DISTINCT date FROM panel) WHERE date >= (SELECT (min(date) + INTERVAL 24 MONTH)::DATE FROM panel)",
    "by_fold": "SELECT model, target, fold, avg(ic) AS fold_ic FROM gics JOIN judged USING (date) GROUP BY ALL",
    "pooled": "SELECT model, target, avg(ic) AS mean_ic FROM gics JOIN judged USING (date) GROUP BY ALL",
}


@query("A28", """SELECT model, target, r(ir) AS ic_ir, r(positive) AS positive_folds, r(mean_ic) AS mean_ic FROM (SELECT model, target, avg(fold_ic) / stddev_samp(fold_ic) AS ir, avg(CASE WHEN fold_ic > 0 THEN 1.0 ELSE 0.0 END) AS positive FROM by_fold GROUP BY model, target) JOIN pooled USING (model, target)
  ORDER BY round(ir, 3) DESC, positive DESC, round(mean_ic, 4) DESC, CASE WHEN target LIKE '%sector%' THEN 1 ELSE 0 END DESC, model LIMIT 1""", A28)
def a28(d: Data):
    """The choice among candidates by their folds: IR over folds, share of positive folds, mean over dates."""
    dates = d.panel.select("date").distinct()
    start = dates.agg(F.add_months(F.min("date"), 24).alias("start"))
    blocks = dates.join(F.broadcast(start), F.col("date") >= F.col("start")).select("date", F.ntile(4).over(Window.orderBy("date")).alias("fold"))  # a row a date
    found = evalstats.fold_summary(candidates(d).join(blocks, "date"), "model", "target")
    return evalstats.select_model(found.select("model", "target", "ic_ir", "positive_folds", "mean_ic"))


@query("A29", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 1")
def a29(d: Data):
    return evalstats.modal_setting(d.table("events"), "event_type", F.asc("event_type"))


NEAR = '(m2.start IS NULL OR m2.start <= {d}) AND (m2."end" IS NULL OR {d} < m2."end")'


@query("A30", f"""SELECT ticker, "end", EXISTS (SELECT 1 FROM members m2 WHERE m2.ticker = m.ticker AND {NEAR.format(d="(m.end - INTERVAL 1 YEAR)::DATE")}) AS year_before,
  EXISTS (SELECT 1 FROM members m2 WHERE m2.ticker = m.ticker AND {NEAR.format(d="(m.end + INTERVAL 1 YEAR)::DATE")}) AS year_after FROM members m WHERE "end" IS NOT NULL ORDER BY "end" DESC, ticker LIMIT 8""")
def a30(d: Data):
    gone = d.members.where("end IS NOT NULL").orderBy(F.desc("end"), "ticker").limit(8).select("ticker", "end")
    own = d.members.select("ticker", F.col("start").alias("s"), F.col("end").alias("e"))
    at = lambda months: F.max(intervals.inside(F.add_months("end", months), F.col("s"), F.col("e")))
    return gone.join(own, "ticker").groupBy("ticker", "end").agg(at(-12).alias("year_before"), at(12).alias("year_after"))


@query("A31", f"""SELECT r(e.cagr - m.cagr) AS drift FROM (SELECT pow(product(1 + x), {PERIODS} / count(*)) - 1 AS cagr FROM (SELECT date, avg(ret) AS x FROM hold GROUP BY date)) e,
  (SELECT pow(product(1 + x), {PERIODS} / count(*)) - 1 AS cagr FROM (SELECT h.date, q1.close_adj / q0.close_adj - 1 AS x FROM (SELECT * FROM rebn WHERE next_date IS NOT NULL) h ASOF JOIN mkt q0 ON q0.date <= h.date ASOF JOIN mkt q1 ON q1.date <= h.next_date)) m""")
def a31(d: Data):
    equal = d.holding.groupBy("date").agg(F.avg("ret").alias("ret")).withColumn("strategy", F.lit("equal"))
    market = returns.holding_returns(d.market, d.rebalances).select("date", "ret").withColumn("strategy", F.lit("market"))
    both = evalstats.performance(equal.unionByName(market), "ret", "strategy", periods=PERIODS)
    at = lambda s: F.max(F.when(F.col("strategy") == s, F.col("cagr")))
    return both.agg((at("equal") - at("market")).alias("drift"))


