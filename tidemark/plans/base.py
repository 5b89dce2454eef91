"""Registering queries: the driver's tables as contracts, and the SQL that the same contracts mean.

Sessions of the weekly price table are weeks, so a year is 52 sessions and a quarter 13.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof, calendar, crosssec, features, intervals, returns
from ..session import scratch
from ..sources import contracts, io

HORIZON, YEAR, QUARTER, MONTH = 13, 52, 13, 4
MIN_PRICE, MIN_DOLLAR_VOLUME, WINDOW = 1_000.0, 75_000.0, 20
PERIODS = 12.0
CONTEXT_SERIES = {"term_spread": "F", "credit_spread": "O", "vix": "P"}
#: Points at which facts are read, in sessions from a date.
POINTS = {"now": 0, "q": -QUARTER, "y": -YEAR, "yq": -YEAR - QUARTER}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def r(x: Column) -> Column:
    """Rounded to six digits in the steps that the SQL side takes; never -0."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def rounded(df: DataFrame) -> DataFrame:
    """All doubles rounded."""
    return df.select(*(r(F.col(f"`{n}`")).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes))


#: (application, folder, contract) -> where its table is staged: the folder, and the catalog's name of a bucketed one.
_staged: dict[tuple[str, str, str], tuple[str, str | None]] = {}
#: Line items that a partition or bucket is meant for: what a task holds doesn't grow with the tables.
ROWS_A_PART = 500_000
INITIAL_PARTS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
#: (application, folder) -> rows of its line items; application -> the INITIAL_PARTS that was set here.
_rows: dict[tuple[str, str], int] = {}
_initial: dict[str, str] = {}


def parts(spark: SparkSession, sf_dir: str) -> int:
    """Partitions for a folder's tables: as many as the session's shuffles have, more where the line items are many."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _rows:
        path = f"{sf_dir}/lineitem.parquet"
        _rows[key] = spark.read.parquet(path).count() if io.exists(spark, path) else 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-_rows[key] // ROWS_A_PART))


def spread(spark: SparkSession, n: int) -> None:
    """Shuffles begin with ``n`` partitions, which Spark coalesces where they are small; a number that the session was given stays."""
    app, was = spark.sparkContext.applicationId, spark.conf.get(INITIAL_PARTS, None)
    if was is None or was == _initial.get(app):
        _initial[app] = str(n)
        spark.conf.set(INITIAL_PARTS, str(n))


def forget(spark: SparkSession) -> None:
    """Drops this session's bucketed contracts from the catalog."""
    for key in [k for k in _staged if k[0] == spark.sparkContext.applicationId]:
        name = _staged.pop(key)[1]
        if name is not None:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


class Data:
    """The contracts over one folder of tables.

    Prices, the calendar, facts and the panel are read many times by most queries, so each is built
    once a session, as a table in the shared folder, and read from there.  Those with a ticker are
    in buckets of it, so windows by ticker and joins by ticker (and date) take no exchange.  The
    joins need Spark to accept one of two join keys as a partitioning, which is set here.  Buckets,
    and the partitions that shuffles begin with, grow with the tables.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.parts = parts(spark, sf_dir)
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        spread(spark, self.parts)

    def table(self, name: str) -> DataFrame:
        return contracts.table(self.spark, self.dir, name)

    def _is_staged(self, name: str) -> bool:
        key = (self.spark.sparkContext.applicationId, self.dir, name)
        return key in _staged and io.exists(self.spark, _staged[key][0])

    def _table(self, name: str, build: Callable[[], DataFrame], by: str | None = None, dealt: bool = False) -> DataFrame:
        """A contract, staged on first use; in buckets of ``by``, more of them for larger tables (``dealt``: it is built in as many partitions by it)."""
        key = (self.spark.sparkContext.applicationId, self.dir, name)
        if not self._is_staged(name):
            rows, root = build(), scratch(self.spark)
            if by is None:
                _staged[key] = io.put(rows, root, "contracts", name), None
            else:
                table = io.put_bucketed(rows, root, "contracts", name, by, self.parts, dealt)
                _staged[key] = f"{root}/contracts/{name}", table
        path, table = _staged[key]
        return self.spark.read.parquet(path) if table is None else self.spark.table(table)

    @cached_property
    def weekly(self) -> DataFrame:
        return self._table("weekly", lambda: contracts.prices(self.spark, self.dir, parts=self.parts), "ticker", dealt=True)

    @cached_property
    def daily(self) -> DataFrame:
        return contracts.prices(self.spark, self.dir, weekly=False)

    @cached_property
    def market(self) -> DataFrame:
        return self._table("market", lambda: contracts.benchmark(self.spark, self.dir))

    @cached_property
    def calendar(self) -> DataFrame:
        return self._table("calendar", lambda: calendar.sessions(self.weekly))

    @cached_property
    def rebalances(self) -> DataFrame:
        return self._table("rebalances", lambda: calendar.month_ends(self.calendar))

    @cached_property
    def sectors(self) -> DataFrame:
        return self._table("sectors", lambda: contracts.sectors(self.spark, self.dir), "ticker")

    @cached_property
    def facts(self) -> DataFrame:
        return self._table("facts", lambda: contracts.facts(self.spark, self.dir, self.parts), "ticker", dealt=True)

    def facts_of(self, *tags: str) -> DataFrame:
        """Facts of some tags alone: staged by themselves, so that others aren't exchanged, unless all facts are staged."""
        if self._is_staged("facts"):
            return self.facts.where(F.col("tag").isin(*tags))
        name = "_".join(["facts", *(str(contracts.TAGS.index(t)) for t in sorted(tags))])
        return self._table(name, lambda: contracts.facts(self.spark, self.dir, self.parts, tags), "ticker", dealt=True)

    @cached_property
    def log(self) -> DataFrame:
        return contracts.membership_log(self.spark, self.dir)

    @cached_property
    def intervals(self) -> DataFrame:
        return intervals.membership_intervals(self.log)

    @cached_property
    def trades(self) -> DataFrame:
        return contracts.trades(self.spark, self.dir)

    @cached_property
    def announcements(self) -> DataFrame:
        return contracts.announcements(self.spark, self.dir)

    @cached_property
    def macro(self) -> DataFrame:
        return contracts.macro(self.spark, self.dir)

    @cached_property
    def panel(self) -> DataFrame:
        """Its first join decides by what the labels are dealt; it is staged in buckets of tickers."""
        build = lambda: crosssec.panel(self.weekly, self.rebalances, self.calendar, self.sectors, HORIZON, MIN_PRICE, MIN_DOLLAR_VOLUME)
        return self._table("panel", build, "ticker")

    @cached_property
    def points(self) -> DataFrame:
        """date, point, at: each rebalance date, and a quarter, a year, and both before it."""
        moved = self.rebalances
        for name, n in POINTS.items():
            moved = calendar.offset(moved, self.calendar, n, to=name)
        return self._table("points", lambda: moved.unpivot("date", list(POINTS), "point", "at").where("at IS NOT NULL"))

    @cached_property
    def timeline(self) -> DataFrame:
        """Facts by filing day and the panel's keys at all points, in order: what as-of passes over the panel read."""
        asked = self.panel.select("ticker", "date").join(calendar.small(self.points), "date")
        build = lambda: asof.timeline(asof.facts_wide(self.facts, contracts.TAGS), asked, ["ticker"], list(contracts.TAGS), "filed", "at")
        return self._table("timeline", build, "ticker")

    @cached_property
    def date_context(self) -> DataFrame:
        dates = self.panel.select("date").distinct()
        return self._table("context", lambda: features.date_context(dates, self.macro, self.market, self.calendar, CONTEXT_SERIES, QUARTER))

    @cached_property
    def momentum(self) -> DataFrame:
        return returns.momentum_12_1(self.weekly, self.rebalances, self.calendar, MONTH, YEAR)

    @cached_property
    def forward(self) -> DataFrame:
        return returns.forward_returns(self.weekly, self.rebalances, self.calendar, HORIZON)

    @cached_property
    def scored(self) -> DataFrame:
        return self.momentum.join(self.forward, ["date", "ticker"])

    @cached_property
    def holding(self) -> DataFrame:
        return returns.holding_returns(self.weekly, self.rebalances)

    @cached_property
    def liquidated(self) -> DataFrame:
        """Every seventh supplier, standing for liquidated names."""
        return self.table("supplier").where(F.col("s_suppkey") % 7 == 0).select(F.col("s_suppkey").cast("string").alias("ticker"))

    @cached_property
    def members(self) -> DataFrame:
        """Suppliers by intervals: members from the start until a day that depends on the supplier."""
        key = F.col("s_suppkey")
        start = F.when(key % 3 == 0, F.date_add(F.lit("1995-06-01").cast("date"), (key % 50 * 20).cast("int")))
        end = F.when(key % 4 == 0, F.date_add(F.lit("1998-01-01").cast("date"), (key % 60 * 15).cast("int")))
        return self.table("supplier").select(key.cast("string").alias("ticker"), start.alias("start"), end.alias("end"))

    @cached_property
    def probes(self) -> DataFrame:
        """Every supplier at every rebalance date."""
        return returns._held(self.weekly, self.rebalances).select("ticker", "date")


BARS = """SELECT {ticker} AS ticker, {date} AS date,
  sum(l_extendedprice::DECIMAL(15,2))::DOUBLE / sum(l_quantity) AS close_raw,
  sum(l_extendedprice::DECIMAL(15,2) * (1 - l_discount::DECIMAL(4,2)))::DOUBLE / sum(l_quantity) AS close_adj,
  sum(l_quantity) AS volume FROM lineitem GROUP BY ALL"""
WEEK, DAY = "date_trunc('week', l_shipdate)::DATE", "l_shipdate::DATE"

CTES = {
    "pw": BARS.format(ticker="l_suppkey::VARCHAR", date=WEEK),
    "pd": BARS.format(ticker="l_suppkey::VARCHAR", date=DAY),
    "mkt": BARS.format(ticker="'MKT'", date=WEEK),
    "sess": "SELECT date AS session, row_number() OVER (ORDER BY date) AS idx FROM (SELECT DISTINCT date FROM pw)",
    "reb": "SELECT max(session) AS date FROM sess GROUP BY date_trunc('month', session)",
    "rebn": "SELECT date, lead(date) OVER (ORDER BY date) AS next_date FROM reb",
    "sector": "SELECT s_suppkey::VARCHAR AS ticker, r_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "spans": "SELECT ticker, min(date) AS first, max(date) AS last, arg_max(close_adj, date) AS last_price FROM pw GROUP BY ticker",
    "facts": """SELECT l_suppkey::VARCHAR AS ticker, o_orderpriority AS tag, (date_trunc('quarter', o_orderdate) - INTERVAL 1 DAY)::DATE AS period_end, o_orderdate::DATE AS filed,
  sum(l_extendedprice::DECIMAL(15,2))::DOUBLE AS value FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL""",
    "log": """SELECT user_id::VARCHAR AS ticker, ts, event_id AS seq, ts::DATE AS date,
  CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'removed' WHEN 'click' THEN 'current' END AS action FROM events WHERE event_type IN ('signup', 'error', 'click')""",
    "intervals": """SELECT ticker, min(CASE WHEN action = 'added' THEN date END) AS start, min(CASE WHEN action = 'removed' THEN date END) AS "end" FROM (
  SELECT *, coalesce(sum(CASE WHEN action = 'removed' THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island
  FROM log WHERE action <> 'current') GROUP BY ticker, island""",
    "trades": "SELECT event_id AS seq, json_extract_string(props, '$.k') AS ticker, user_id::VARCHAR AS member, ts::DATE AS filing_date, value, user_id % 4 = 0 AS officer FROM events WHERE event_type = 'purchase'",
    "ann": "SELECT json_extract_string(props, '$.k') AS ticker, ts::DATE AS date, array_to_string(regexp_extract_all(user_id::VARCHAR, '[0-9]'), '|') AS eventcodes FROM events WHERE event_type = 'view'",
    "macro": "SELECT o_orderstatus AS series_id, o_orderdate::DATE AS date, sum(o_totalprice::DECIMAL(15,2))::DOUBLE / count(*) AS value, o_orderstatus <> 'F' AS is_realtime FROM orders GROUP BY ALL",
    "elig": f"""SELECT date, ticker, close_raw, dollar_vol, coalesce(close_raw >= {MIN_PRICE} AND dollar_vol >= {MIN_DOLLAR_VOLUME}, false) AS eligible FROM (
  SELECT *, CASE WHEN count(*) OVER w >= {WINDOW} THEN quantile_cont(close_raw * volume, 0.5) OVER w END AS dollar_vol FROM pw
  WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW)) JOIN reb USING (date)""",
    "fwd": f"""SELECT t.date, s.ticker, p1.close_adj / p0.close_adj - 1 AS fwd_ret_raw
  FROM spans s JOIN (SELECT a.session AS date, b.session AS target FROM sess a JOIN sess b ON b.idx = a.idx + {HORIZON} WHERE a.session IN (SELECT date FROM reb)) t ON s.first <= t.date AND t.target <= s.last
  ASOF JOIN pw p0 ON p0.ticker = s.ticker AND p0.date <= t.date ASOF JOIN pw p1 ON p1.ticker = s.ticker AND p1.date <= t.target WHERE p0.close_adj > 0""",
    "panel": """SELECT *, fwd_ret_raw - median(fwd_ret_raw) OVER (PARTITION BY date) AS excess_median,
  CASE WHEN sector IS NOT NULL THEN fwd_ret_raw - median(fwd_ret_raw) OVER (PARTITION BY date, sector) END AS excess_sector
  FROM (SELECT date, ticker, close_raw, dollar_vol, fwd_ret_raw, sector FROM elig JOIN fwd USING (date, ticker) LEFT JOIN sector USING (ticker) WHERE eligible)""",
    "mom": f"""SELECT t.date, s.ticker, p1.close_adj / p0.close_adj - 1 AS signal
  FROM spans s JOIN (SELECT a.session AS date, f.session AS far, n.session AS near FROM sess a JOIN sess f ON f.idx = a.idx - {YEAR} JOIN sess n ON n.idx = a.idx - {MONTH} WHERE a.session IN (SELECT date FROM reb)) t ON s.first <= t.far
  ASOF JOIN pw p0 ON p0.ticker = s.ticker AND p0.date <= t.far ASOF JOIN pw p1 ON p1.ticker = s.ticker AND p1.date <= t.near WHERE p0.close_adj > 0""",
    "scored": "SELECT date, ticker, signal, fwd_ret_raw FROM mom JOIN fwd USING (date, ticker)",
    "hold": """SELECT t.date, s.ticker, p1.close_adj / p0.close_adj - 1 AS ret FROM spans s JOIN rebn t ON s.first <= t.date AND t.next_date <= s.last
  ASOF JOIN pw p0 ON p0.ticker = s.ticker AND p0.date <= t.date ASOF JOIN pw p1 ON p1.ticker = s.ticker AND p1.date <= t.next_date WHERE p0.close_adj > 0""",
    "liq": "SELECT s_suppkey::VARCHAR AS ticker FROM supplier WHERE s_suppkey % 7 = 0",
    "members": """SELECT s_suppkey::VARCHAR AS ticker, CASE WHEN s_suppkey % 3 = 0 THEN (DATE '1995-06-01' + (s_suppkey % 50 * 20)::INTEGER)::DATE END AS start,
  CASE WHEN s_suppkey % 4 = 0 THEN (DATE '1998-01-01' + (s_suppkey % 60 * 15)::INTEGER)::DATE END AS "end" FROM supplier""",
    "probes": "SELECT s.ticker, r.date FROM spans s JOIN reb r ON s.first <= r.date AND r.date <= s.last",
    # average ranks of signal and target, per date
    "ranked": """SELECT date, ticker, rank() OVER (PARTITION BY date ORDER BY signal) + (count(*) OVER (PARTITION BY date, signal) - 1) / 2.0 AS rs,
  rank() OVER (PARTITION BY date ORDER BY fwd_ret_raw) + (count(*) OVER (PARTITION BY date, fwd_ret_raw) - 1) / 2.0 AS rt FROM scored""",
    "ics": "SELECT date, corr(rs, rt) AS ic, count(*) AS n FROM ranked GROUP BY date HAVING count(*) >= 5 AND min(rs) < max(rs) AND min(rt) < max(rt)",
}


def sql(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` with every named table it needs, directly or through others, as WITH clauses."""
    known, order, open_ = {**CTES, **(extra or {})}, [], set()

    def need(text: str) -> None:
        for name in known:
            if name not in order and name not in open_ and re.search(rf"\b(?:FROM|JOIN|,)\s+\(?\s*{name}\b", text):
                open_.add(name)  # a recursive one names itself
                need(known[name])
                if name not in order:
                    order.append(name)

    need(body)
    return ("WITH RECURSIVE " + ",\n".join(f"{n} AS ({known[n]})" for n in order) + "\n" if order else "") + body


def query(key: str, oracle: str | None = None, extra: dict[str, str] | None = None):
    """Registers a function of :class:`Data` and its SQL; the function's doubles are rounded, as ``r(...)`` does in the SQL."""

    def register(f: Callable[[Data], DataFrame]) -> Callable[[Data], DataFrame]:
        QUERIES[key] = lambda spark, sf_dir: rounded(f(Data(spark, sf_dir)))
        if oracle is not None:
            ORACLE_SQL[key] = _with_rounding(sql(oracle, extra))
        return f

    return register


def _with_rounding(text: str) -> str:
    """``r(x)`` written out as a rounding that gives no -0."""
    while (m := re.search(r"\br\(", text)) is not None:
        depth, at = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(text[at], 0)
            at += 1
        text = f"{text[: m.start()]}(floor(({text[m.end() : at - 1]})::DOUBLE * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE){text[at:]}"
    return text
