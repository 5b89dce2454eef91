"""Queries for returns (R), windows (W), limits (L) and panels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import asof, calendar, crosssec, evalstats, events, features, intervals, returns
from .base import HORIZON, MIN_DOLLAR_VOLUME, MIN_PRICE, MONTH, QUARTER, WINDOW, YEAR, Data, query

PANEL_COLUMNS = ["date", "ticker", "close_raw", "dollar_vol", "fwd_ret_raw", "sector", "excess_median", "excess_sector"]
PANEL_SQL = "SELECT date, ticker, r(close_raw) AS close_raw, r(dollar_vol) AS dollar_vol, r(fwd_ret_raw) AS fwd_ret_raw, sector, r(excess_median) AS excess_median, r(excess_sector) AS excess_sector FROM "


@query("R1", "SELECT date, ticker, r(fwd_ret_raw) AS fwd_ret_raw FROM fwd")
def r1(d: Data):
    return d.forward


@query("R2", f"SELECT ticker, date, r(lead(close_adj, {HORIZON}) OVER (PARTITION BY ticker ORDER BY date) / close_adj - 1) AS fwd_ret FROM pd")
def r2(d: Data):
    return returns.lead_return(d.daily, HORIZON).select("ticker", "date", "fwd_ret")


@query("R3", f"SELECT ticker, date, r(close_adj / lag(close_adj, {MONTH}) OVER (PARTITION BY ticker ORDER BY date) - 1) AS trail_ret FROM pd")
def r3(d: Data):
    return d.daily.select("ticker", "date", returns.trailing_return(MONTH).alias("trail_ret"))


# forward returns of all (date, ticker) probes with a target in the calendar, terminal rules applied
TERMINAL = {
    "tgt": f"SELECT a.session AS date, b.session AS target FROM sess a JOIN sess b ON b.idx = a.idx + {HORIZON}",
    "term": """SELECT t.date, p.ticker, CASE WHEN t.target <= s.last THEN p1.close_adj / p0.close_adj - 1 WHEN q.ticker IS NOT NULL THEN -1.0 ELSE s.last_price / p0.close_adj - 1 END AS fwd_ret_raw
  FROM probes p JOIN tgt t USING (date) JOIN spans s ON s.ticker = p.ticker LEFT JOIN liq q ON q.ticker = p.ticker
  ASOF JOIN pw p0 ON p0.ticker = p.ticker AND p0.date <= t.date ASOF JOIN pw p1 ON p1.ticker = p.ticker AND p1.date <= t.target WHERE p0.close_adj > 0""",
    "term_hold": """SELECT t.date, s.ticker, CASE WHEN t.next_date <= s.last THEN p1.close_adj / p0.close_adj - 1 WHEN q.ticker IS NOT NULL THEN -1.0 ELSE s.last_price / p0.close_adj - 1 END AS ret
  FROM spans s JOIN rebn t ON s.first <= t.date AND t.date <= s.last AND t.next_date IS NOT NULL LEFT JOIN liq q ON q.ticker = s.ticker
  ASOF JOIN pw p0 ON p0.ticker = s.ticker AND p0.date <= t.date ASOF JOIN pw p1 ON p1.ticker = s.ticker AND p1.date <= t.next_date WHERE p0.close_adj > 0""",
    "own": """SELECT e.date, e.ticker, e.close_raw, e.dollar_vol FROM elig e WHERE eligible AND EXISTS (SELECT 1 FROM members m WHERE m.ticker = e.ticker AND (m.start IS NULL OR m.start <= e.date) AND (m."end" IS NULL OR e.date < m."end"))""",
    "mpanel": """SELECT *, fwd_ret_raw - median(fwd_ret_raw) OVER (PARTITION BY date) AS excess_median,
  CASE WHEN sector IS NOT NULL THEN fwd_ret_raw - median(fwd_ret_raw) OVER (PARTITION BY date, sector) END AS excess_sector
  FROM (SELECT date, ticker, close_raw, dollar_vol, fwd_ret_raw, sector FROM own JOIN term USING (date, ticker) LEFT JOIN sector USING (ticker))""",
}


@query("R4", "SELECT date, ticker, r(fwd_ret_raw) AS fwd_ret_raw FROM term", TERMINAL)
def r4(d: Data):
    return returns.delisting_aware_returns(d.weekly, d.probes, d.calendar, HORIZON, d.liquidated)


@query("R5", "SELECT date, ticker, r(fwd_ret_raw) AS fwd_ret_raw FROM term", TERMINAL)
def r5(d: Data):
    return returns.delisting_aware_returns(d.weekly, d.probes, d.calendar, HORIZON, d.liquidated)


@query("R6", "SELECT date, ticker, r(ret) AS ret FROM hold")
def r6(d: Data):
    return d.holding


@query("R7", "SELECT date, ticker, r(ret) AS ret FROM term_hold", TERMINAL)
def r7(d: Data):
    return returns.delisting_aware_holding_returns(d.weekly, d.rebalances, d.liquidated)


# events of R8: order days of each supplier, snapped to the weekly calendar, held for a quarter
EVENT_RETURNS = {
    "ev": "SELECT DISTINCT ticker, filed AS date FROM facts WHERE tag = '1-URGENT'",
    "entries": "SELECT e.ticker, e.date, s.idx + 1 AS idx FROM ev e ASOF LEFT JOIN sess s ON e.date <= s.session",
    "evret": f"""SELECT e.ticker, e.date, a.session AS entry, CASE WHEN a.session <= s.last AND p0.close_adj > 0 AND t.session IS NOT NULL THEN
    (CASE WHEN t.session <= s.last THEN p1.close_adj WHEN s.last < (SELECT max(session) FROM sess) THEN s.last_price END) / p0.close_adj - 1 END AS ret
  FROM entries e LEFT JOIN sess a ON a.idx = e.idx LEFT JOIN sess t ON t.idx = e.idx + {QUARTER} JOIN spans s ON s.ticker = e.ticker
  ASOF LEFT JOIN pw p0 ON p0.ticker = e.ticker AND p0.date <= a.session ASOF LEFT JOIN pw p1 ON p1.ticker = e.ticker AND p1.date <= t.session""",
    "mktret": f"""SELECT a.session AS entry, q1.close_adj / q0.close_adj - 1 AS mkt FROM sess a JOIN sess t ON t.idx = a.idx + {QUARTER}
  ASOF JOIN mkt q0 ON q0.date <= a.session ASOF JOIN mkt q1 ON q1.date <= t.session""",
    "adj": "SELECT ticker, date, entry, ret - mkt AS ret FROM evret JOIN mktret USING (entry) WHERE ret IS NOT NULL",
}


def event_table(d: Data):
    return d.facts_of("1-URGENT").select("ticker", F.col("filed").alias("date")).distinct()


def event_returns(d: Data):
    return returns.event_returns(event_table(d), d.weekly, d.calendar, QUARTER, lag=1)


def less_market(d: Data, own):
    """Event returns over a quarter less the benchmark's from the same entry, which is computed for each session of the calendar, not from the events."""
    sessions = d.calendar.select(F.col("session").alias("date"), F.lit("MKT").alias("ticker"))
    market = returns.event_returns(sessions, d.market, d.calendar, QUARTER, to="mkt").where("mkt IS NOT NULL").select(F.col("date").alias("entry"), "mkt")
    return own.where("ret IS NOT NULL").join(calendar.small(market, d.calendar), "entry").select("ticker", "date", "entry", (F.col("ret") - F.col("mkt")).alias("ret"))


def adjusted_event_returns(d: Data):
    """Event returns less the benchmark's over the same sessions."""
    return less_market(d, event_returns(d))


@query("R8", "SELECT ticker, date, entry, r(ret) AS ret FROM evret", EVENT_RETURNS)
def r8(d: Data):
    return event_returns(d)


@query("R9", """SELECT date, ticker, r(fwd_ret_raw) AS fwd_ret_raw, sector, r(fwd_ret_raw - median(fwd_ret_raw) OVER (PARTITION BY date)) AS excess_median,
  CASE WHEN sector IS NOT NULL THEN r(fwd_ret_raw - median(fwd_ret_raw) OVER (PARTITION BY date, sector)) END AS excess_sector FROM fwd LEFT JOIN sector USING (ticker)""")
def r9(d: Data):
    return returns.excess(d.forward, d.sectors)


@query("R10", "SELECT date, ticker, r(signal) AS signal FROM mom")
def r10(d: Data):
    return d.momentum


@query("R11", PANEL_SQL + "panel")
def r11(d: Data):
    return d.panel.select(PANEL_COLUMNS)


@query("R12", PANEL_SQL + "mpanel", TERMINAL)
def r12(d: Data):
    members = intervals.members_on(d.members, d.rebalances)
    return crosssec.member_panel(d.weekly, members, d.rebalances, d.calendar, d.sectors, d.liquidated, HORIZON, MIN_PRICE, MIN_DOLLAR_VOLUME).select(PANEL_COLUMNS)


CAP_LOW, CAP_HIGH = 5e7, 5e9
CAPS = {
    "shares": "SELECT ticker, filed, arg_max(value, (period_end, value)) AS value FROM facts WHERE tag = '1-URGENT' GROUP BY ticker, filed",
    "caps": "SELECT p.ticker, p.date, p.close_raw * s.value AS market_cap FROM pw p JOIN reb USING (date) ASOF JOIN shares s ON s.ticker = p.ticker AND s.filed <= p.date",
}


@query("R13", f"""SELECT date, ticker, r(market_cap) AS market_cap FROM elig JOIN caps USING (date, ticker) WHERE eligible AND ticker::BIGINT % 5 <> 0 AND market_cap BETWEEN {CAP_LOW} AND {CAP_HIGH}
  AND NOT EXISTS (SELECT 1 FROM members m WHERE m.ticker = elig.ticker AND (m.start IS NULL OR m.start <= elig.date) AND (m."end" IS NULL OR elig.date < m."end"))""", CAPS)
def r13(d: Data):
    common = d.table("supplier").where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").cast("string").alias("ticker"))
    return crosssec.cap_band_members(d.weekly, d.facts_of("1-URGENT"), d.rebalances, common, d.members, "1-URGENT", CAP_LOW, CAP_HIGH, MIN_PRICE, MIN_DOLLAR_VOLUME)


@query("W1", "SELECT date, ticker, r(close_raw) AS close_raw, r(dollar_vol) AS dollar_vol, eligible FROM elig")
def w1(d: Data):
    return crosssec.eligibility(d.weekly, d.rebalances, MIN_PRICE, MIN_DOLLAR_VOLUME, WINDOW)


WINDOWS = {"m1": MONTH, "m3": QUARTER, "m6": 26, "m12": YEAR}
FEATURES = {
    "mom_rows": f"""SELECT ticker, date, close_adj / lag(close_adj, {MONTH}) OVER o - 1 AS ret_1m, close_adj / lag(close_adj, {QUARTER}) OVER o - 1 AS ret_3m, close_adj / lag(close_adj, 26) OVER o - 1 AS ret_6m,
  lag(close_adj, {MONTH}) OVER o / lag(close_adj, {YEAR}) OVER o - 1 AS ret_12_1,
  CASE WHEN count(ret) OVER w6 >= 26 THEN stddev_samp(ret) OVER w6 END AS vol_6m, CASE WHEN count(ret) OVER w12 >= {YEAR} THEN stddev_samp(ret) OVER w12 END AS vol_12m,
  CASE WHEN count(close_adj) OVER w12 >= {YEAR} THEN close_adj / max(close_adj) OVER w12 - 1 END AS dist_52w_high,
  CASE WHEN count(dv) OVER w12 >= {YEAR} AND avg(dv) OVER w1 > 0 AND avg(dv) OVER w12 > 0 THEN ln(avg(dv) OVER w1 / avg(dv) OVER w12) END AS dvol_trend
  FROM (SELECT *, close_adj / lag(close_adj, 1) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret, close_raw * volume AS dv FROM pw)
  WINDOW o AS (PARTITION BY ticker ORDER BY date), w1 AS (PARTITION BY ticker ORDER BY date ROWS {MONTH - 1} PRECEDING), w6 AS (PARTITION BY ticker ORDER BY date ROWS 25 PRECEDING), w12 AS (PARTITION BY ticker ORDER BY date ROWS {YEAR - 1} PRECEDING)""",
    "momf": f"SELECT p.date, p.ticker, {', '.join(features.MOMENTUM)} FROM panel p LEFT JOIN mom_rows m USING (date, ticker)",
}


def momentum_features(d: Data, *names: str):
    return features.momentum_columns(d.weekly, WINDOWS).select("ticker", "date", *names)


def _momentum_sql(*names: str) -> str:
    return f"SELECT ticker, date, {', '.join(f'r({n}) AS {n}' for n in names)} FROM mom_rows"


@query("W2", _momentum_sql("ret_1m", "ret_3m", "ret_6m", "ret_12_1"), FEATURES)
def w2(d: Data):
    return momentum_features(d, "ret_1m", "ret_3m", "ret_6m", "ret_12_1")


@query("W3", _momentum_sql("vol_6m", "vol_12m"), FEATURES)
def w3(d: Data):
    return momentum_features(d, "vol_6m", "vol_12m")


@query("W4", _momentum_sql("dist_52w_high"), FEATURES)
def w4(d: Data):
    return momentum_features(d, "dist_52w_high")


@query("W5", _momentum_sql("dvol_trend"), FEATURES)
def w5(d: Data):
    return momentum_features(d, "dvol_trend")


@query("W6", """SELECT date, ticker, CASE WHEN count(signal) OVER w >= 12 AND stddev_samp(signal) OVER w > 0 THEN r((signal - avg(signal) OVER w) / stddev_samp(signal) OVER w) END AS signal_hist
  FROM mom WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 23 PRECEDING)""")
def w6(d: Data):
    return crosssec.own_history_z(d.momentum, ["signal"], 24, 12).select("date", "ticker", "signal_hist")


@query("W7", "SELECT date, ticker, CASE WHEN count(signal) OVER w >= 12 THEN r(stddev_samp(signal) OVER w) END AS stability FROM mom WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 23 PRECEDING)")
def w7(d: Data):
    return d.momentum.select("date", "ticker", X.rolling_std(F.col("signal"), 24, "ticker", least=12).alias("stability"))


NORMAL = {
    "wins": """SELECT *, CASE WHEN signal IS NOT NULL THEN greatest(quantile_cont(signal, 0.01) OVER (PARTITION BY date), least(signal, quantile_cont(signal, 0.99) OVER (PARTITION BY date))) END AS w,
  (rank() OVER (PARTITION BY date ORDER BY signal) + (count(*) OVER (PARTITION BY date, signal) - 1) / 2.0) / count(*) OVER (PARTITION BY date) AS signal_rank FROM mom""",
}


@query("W8", """SELECT date, ticker, r(signal) AS signal, CASE WHEN stddev_samp(w) OVER (PARTITION BY date) > 0 THEN r((w - avg(w) OVER (PARTITION BY date)) / stddev_samp(w) OVER (PARTITION BY date))
  WHEN stddev_samp(w) OVER (PARTITION BY date) = 0 THEN 0.0 END AS signal_z, r(signal_rank) AS signal_rank FROM wins""", NORMAL)
def w8(d: Data):
    return crosssec.normalise(d.momentum, ["signal"])


@query("W9", "SELECT date, ticker, CASE WHEN sector IS NOT NULL THEN r(signal - median(signal) OVER (PARTITION BY date, sector)) END AS signal_sectrel FROM mom LEFT JOIN sector USING (ticker)")
def w9(d: Data):
    return crosssec.less_sector_median(d.momentum.join(d.sectors, "ticker", "left"), ["signal"]).select("date", "ticker", "signal_sectrel")


@query("W10", """SELECT date, ticker, r(signal_rank) AS pct, signal_rank >= 0.9 AS is_top FROM wins""", NORMAL)
def w10(d: Data):
    ranked = d.momentum.select("date", "ticker", X.percent_rank_of(F.col("signal"), "date").alias("pct"))
    return ranked.withColumn("is_top", F.col("pct") >= 0.9)


TOP = {
    "sized": "SELECT *, row_number() OVER (PARTITION BY date ORDER BY signal DESC, ticker) AS place, row_number() OVER (PARTITION BY date ORDER BY signal, ticker) AS place_low, greatest(1, round_even(count(*) OVER (PARTITION BY date) * 0.1, 0)::INTEGER) AS size FROM mom WHERE signal IS NOT NULL",
    "top": "SELECT date, ticker, 1.0 / size AS weight FROM sized WHERE place <= size",
    "bottom": "SELECT date, ticker, 1.0 / size AS weight FROM sized WHERE place_low <= size",
}


@query("W11", "SELECT date, ticker, r(weight) AS weight FROM top", TOP)
def w11(d: Data):
    return crosssec.top_fraction(d.momentum, 0.1)


@query("W12", "SELECT date, ticker, r(1.0 / count(*) OVER (PARTITION BY date)) AS weight FROM mom")
def w12(d: Data):
    return crosssec.equal_weights(d.momentum)


@query("W13", """SELECT ticker, date, r(equity) AS equity, r(max(equity) OVER w) AS peak, r(equity / max(equity) OVER w - 1) AS drawdown
  FROM (SELECT ticker, date, product(1 + ret) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity FROM hold) WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)""")
def w13(d: Data):
    return evalstats.equity_curve(d.holding, "ret", "ticker").select("ticker", "date", "equity", "peak", "drawdown")


@query("W14", 'SELECT ticker, start, "end" FROM intervals')
def w14(d: Data):
    return d.intervals


CLUSTERS = {
    "seen": """SELECT t.seq, t.ticker, t.member, t.filing_date, count(DISTINCT o.member) AS n_actors, sum(o.value) AS window_value, bool_or(o.officer) AS any_officer FROM trades t
  JOIN trades o ON o.ticker = t.ticker AND o.filing_date >= t.filing_date - 3 AND (o.filing_date < t.filing_date OR o.filing_date = t.filing_date AND o.seq <= t.seq) GROUP BY ALL""",
    "flagged": "SELECT *, n_actors >= 3 AS active, n_actors >= 3 AND coalesce(lag(n_actors) OVER (PARTITION BY ticker ORDER BY filing_date, seq), 0) < 3 AS is_event FROM seen",
    "episodes": "SELECT *, sum(CASE WHEN n_actors < 2 THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY filing_date, seq ROWS UNBOUNDED PRECEDING) AS episode FROM seen",
}


@query("W15", "SELECT seq, ticker, member, filing_date, n_actors::INTEGER AS n_actors, active, is_event FROM flagged", CLUSTERS)
def w15(d: Data):
    return events.clusters(events.distinct_actors(d.trades, 3), 3).select("seq", "ticker", "member", "filing_date", "n_actors", "active", "is_event")


@query("W15_by_day", """SELECT t.seq, t.ticker, count(DISTINCT o.member)::INTEGER AS n_actors FROM trades t
  JOIN trades o ON o.ticker = t.ticker AND o.filing_date BETWEEN t.filing_date - 3 AND t.filing_date GROUP BY ALL""")
def w15_by_day(d: Data):
    return events.distinct_actors_by_day(d.trades, 3).select("seq", "ticker", "n_actors")


@query("W16", """SELECT seq, ticker, member, filing_date, n_actors::INTEGER AS n_actors, r(window_value) AS window_value, any_officer FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker, episode ORDER BY filing_date, seq) AS place FROM episodes WHERE n_actors >= 2 AND round(window_value, 6) >= 100) WHERE place = 1""", CLUSTERS)
def w16(d: Data):
    counted = events.distinct_actors(d.trades, 3, flag="officer").withColumn("window_value", F.round("window_value", 6))
    return events.value_clusters(counted, 2, 100.0).select("seq", "ticker", "member", "filing_date", "n_actors", "window_value", "any_officer")


SURPRISES = {
    "quarters": "SELECT ticker, period_end AS period, max(filed) AS filed, arg_min(value, filed) AS eps FROM facts WHERE tag = '2-HIGH' GROUP BY ticker, period_end",
    "changes": "SELECT *, eps - lag(eps, 4) OVER (PARTITION BY ticker ORDER BY period) AS change, count(*) OVER (PARTITION BY ticker) AS n FROM quarters",
    "sues": """SELECT ticker, period, filed, sue FROM (SELECT *, CASE WHEN count(change) OVER w >= 6 AND stddev_samp(change) OVER w > 0 THEN change / stddev_samp(change) OVER w END AS sue
  FROM changes WINDOW w AS (PARTITION BY ticker ORDER BY period ROWS 7 PRECEDING)) WHERE n >= 10 AND sue IS NOT NULL""",
}


def quarters(d: Data):
    """ticker, period, filed (the last vintage's day) and eps (the first vintage's value)."""
    own = d.facts_of("2-HIGH").groupBy("ticker", F.col("period_end").alias("period"))
    return own.agg(F.max("filed").alias("filed"), F.min_by("value", "filed").alias("eps"))


@query("W17", "SELECT ticker, period, r(sue) AS sue FROM sues", SURPRISES)
def w17(d: Data):
    return events.surprises(quarters(d)).select("ticker", "period", "sue")


@query("W18", "SELECT date, (SELECT count(*) FROM sess WHERE session <= date) AS session_idx FROM reb")
def w18(d: Data):
    return d.rebalances.join(d.calendar, F.col("date") == F.col("session")).select("date", F.col("session_idx").cast("long").alias("session_idx"))


@query("W19", "SELECT p.ticker, p.date, r(f.value) AS value FROM probes p ASOF LEFT JOIN (SELECT ticker, filed, arg_max(value, (period_end, value)) AS value FROM facts WHERE tag = '1-URGENT' GROUP BY ALL) f ON f.ticker = p.ticker AND f.filed <= p.date")
def w19(d: Data):
    known = asof.facts_asof(d.facts_of("1-URGENT"), d.probes, ["1-URGENT"])
    return known.select("ticker", "date", F.col("1-URGENT").alias("value"))


@query("W20", f"""SELECT a.session AS date, r(q1.close_adj / q0.close_adj - 1) AS mkt_ret FROM sess a JOIN sess b ON b.idx = a.idx - {QUARTER}
  ASOF JOIN mkt q1 ON q1.date <= a.session ASOF JOIN mkt q0 ON q0.date <= b.session WHERE a.session IN (SELECT date FROM reb)""")
def w20(d: Data):
    moved = calendar.offset(d.rebalances, d.calendar, -QUARTER, to="was").where("was IS NOT NULL").withColumn("ticker", F.lit("MKT"))
    return asof.at_points(d.market, moved, {"p1": "date", "p0": "was"}).select("date", (F.col("p1") / F.col("p0") - 1).alias("mkt_ret"))


@query("L1", "SELECT date, ticker, r(signal) AS signal FROM mom")
def l1(d: Data):
    return d.momentum.orderBy("date", "ticker")


@query("L2", """SELECT date, ticker, side, place::INTEGER AS place FROM (SELECT date, ticker, 'high' AS side, place FROM sized WHERE place <= 3 UNION ALL SELECT date, ticker, 'low', place_low FROM sized WHERE place_low <= 3)""", TOP)
def l2(d: Data):
    places = lambda side, order: d.momentum.select("date", "ticker", F.lit(side).alias("side"), F.row_number().over(Window.partitionBy("date").orderBy(order, "ticker")).alias("place")).where("place <= 3")
    return places("high", F.desc("signal")).union(places("low", F.asc("signal")))


@query("L3", "SELECT ticker, date, r(close_adj) AS close_adj FROM pw ORDER BY close_adj DESC, ticker, date LIMIT 8")
def l3(d: Data):
    return d.weekly.select("ticker", "date", "close_adj").orderBy(F.desc("close_adj"), "ticker", "date").limit(8)


@query("L4", "SELECT sector, ticker FROM (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY ticker) AS place FROM sector) WHERE place <= 4 ORDER BY sector, ticker LIMIT 18")
def l4(d: Data):
    return crosssec.first_per_group(d.sectors, "sector", ["ticker"], 4, 18).select("sector", "ticker")


@query("C1", """SELECT ticker, (dense_rank() OVER (ORDER BY CASE WHEN sector IS NULL OR sector = '' THEN 'Unknown' ELSE sector END) - 1)::INTEGER AS sector_id
  FROM (SELECT DISTINCT ticker FROM probes) LEFT JOIN (SELECT ticker, CASE WHEN ticker::BIGINT % 7 = 0 THEN '' ELSE sector END AS sector FROM sector WHERE ticker::BIGINT % 5 <> 0) USING (ticker)""")
def c1(d: Data):
    """Every fifth name without a sector, every seventh with an empty one."""
    key = F.col("ticker").cast("long")
    known = d.sectors.where(key % 5 != 0).withColumn("sector", F.when(key % 7 == 0, "").otherwise(F.col("sector")))
    return crosssec.sector_codes(d.probes, known).select("ticker", "sector_id")
