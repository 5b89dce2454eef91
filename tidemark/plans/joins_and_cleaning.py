"""Queries for sources (S), cleaning (P), joins (J) and set operations (U)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clean
from ..operators import asof, calendar, crosssec, evalstats, events, intervals
from ..session import scratch
from ..sources import contracts, io
from .base import QUARTER, YEAR, Data, query
from .returns_and_windows import EVENT_RETURNS, adjusted_event_returns

TAG_COLUMNS = [f"t{k}" for k in range(1, 6)]


def _named(df: DataFrame) -> DataFrame:
    """Tags as plain column names."""
    return df.select(*(c for c in df.columns if c not in contracts.TAGS), *(F.col(f"`{t}`").alias(n) for t, n in zip(contracts.TAGS, TAG_COLUMNS, strict=True)))


# --- sources and sinks -------------------------------------------------------------------------


@query("S1", "SELECT ticker, date, r(close_raw) AS close_raw, r(close_adj) AS close_adj, volume FROM pw")
def s1(d: Data):
    root = scratch(d.spark)
    io.put(d.weekly, root, "prices", "weekly")
    assert io.has(d.spark, root, "prices", "weekly") and not io.has(d.spark, root, "prices", "none")
    return io.get(d.spark, root, "prices", "weekly")


@query("S2", "SELECT ticker, date, r(close_adj) AS close_adj FROM pd WHERE date >= DATE '1999-01-01' AND ticker IN (SELECT ticker FROM liq)")
def s2(d: Data):
    return io.scan_prices(d.daily, d.liquidated, "1999-01-01", ["ticker", "date", "close_adj"])


@query("S3", "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def s3(d: Data):
    root = scratch(d.spark)
    part = d.table("part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    part.write.csv(f"{root}/part.csv", header=True)
    return io.csv_to_parquet(d.spark, f"{root}/part.csv", f"{root}/part.parquet", part.schema)


@query("S3_untyped", "SELECT event_id::VARCHAR AS event_id, event_type AS value FROM events")
def s3_untyped(d: Data):
    """The fallback: a column that doesn't fit its type makes the whole table strings."""
    root = scratch(d.spark)
    d.table("events").select("event_id", F.col("event_type").alias("value")).write.csv(f"{root}/events.csv", header=True)
    return io.csv_to_parquet(d.spark, f"{root}/events.csv", f"{root}/events.parquet", T.StructType().add("event_id", "long").add("value", "double"))


@query("S3_rejects", """SELECT p_partkey, p_brand, p_size, NULL::VARCHAR AS line FROM part WHERE p_partkey % 10 > 1
  UNION ALL SELECT NULL, NULL, NULL, p_partkey || ',' || p_brand || ',' || CASE WHEN p_partkey % 10 = 0 THEN 'about ' || p_size ELSE '"' || p_size || ',' || p_size || '"' END FROM part WHERE p_partkey % 10 <= 1""")
def s3_rejects(d: Data):
    """Typed rows beside the lines that don't fit: here a fifth, with a size in words or two sizes in one."""
    root, part = scratch(d.spark), d.table("part").select("p_partkey", "p_brand", "p_size")
    kind, size = F.col("p_partkey") % 10, F.col("p_size").cast("string")
    told = F.when(kind == 0, F.concat(F.lit("about "), size)).when(kind == 1, F.concat_ws(",", size, size)).otherwise(size)
    part.select("p_partkey", "p_brand", told.alias("p_size")).write.csv(f"{root}/part.csv", header=True)
    rows, rejects = io.csv_and_rejects(d.spark, f"{root}/part.csv", f"{root}/part", part.schema)
    return rows.withColumn("line", F.lit(None).cast("string")).unionByName(rejects, allowMissingColumns=True)


@query("S4", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def s4(d: Data):
    root, own = scratch(d.spark), d.table("supplier").select("s_suppkey", "s_name", "s_acctbal")
    own.write.csv(f"{root}/supplier.csv", header=True)
    return d.spark.read.schema(own.schema).csv(f"{root}/supplier.csv", header=True)


@query("S5", "SELECT ticker, ticker::BIGINT AS cik, tag, r(value) AS value, period_end, filed, 'SO' AS form, year(filed)::INTEGER AS fy, 'FY' AS fp, 'USD' AS unit FROM facts")
def s5(d: Data):
    """Facts as nested documents, one a ticker and year of filing, written as JSON and read back into long rows."""
    entry = F.struct(
        F.col("period_end").cast("string").alias("end"), F.col("value").alias("val"), F.lit(None).cast("string").alias("accn"), F.year("filed").alias("fy"),
        F.lit("FY").alias("fp"), F.lit("SO").alias("form"), F.col("filed").cast("string").alias("filed"),
    )
    year = F.year("filed").alias("year")
    tags = d.facts.groupBy("ticker", year, "tag").agg(F.create_map(F.lit("USD"), F.collect_list(entry)).alias("units"))
    body = tags.select("ticker", "year", "tag", F.struct(F.col("tag").alias("label"), "units").alias("body"))
    docs = body.groupBy("ticker", "year").agg(F.create_map(F.lit("own"), F.map_from_entries(F.collect_list(F.struct("tag", "body")))).alias("facts"))
    path = f"{scratch(d.spark)}/facts.json"
    docs.select(F.col("ticker").cast("long").alias("cik"), "ticker", "facts").write.json(path)
    return io.facts_json(d.spark.read.schema(io.FACTS_JSON).json(path))


def _filer_documents(d: Data) -> DataFrame:
    """A document a filer and year of filing."""
    trade = F.struct(F.col("seq").alias("id"), "ticker", "filing_date", "value")
    each = d.trades.groupBy(F.struct(F.col("member").alias("name")).alias("filer"), F.year("filing_date").alias("year")).agg(F.collect_list(trade).alias("trades"))
    return each.drop("year")


@query("S6", "SELECT member AS filer_name, seq AS id, ticker, filing_date::VARCHAR AS filing_date, r(value) AS value FROM trades")
def s6(d: Data):
    path = f"{scratch(d.spark)}/filers.json"
    own = _filer_documents(d)
    own.unionByName(own).write.json(path)  # every document twice: rows are kept once an id
    schema = "filer struct<name:string>, trades array<struct<id:long,ticker:string,filing_date:string,value:double>>"
    return io.filer_trades(d.spark.read.schema(schema).json(path), ["id", "ticker", "filing_date", "value"], ["name"])


@query("S7", "SELECT count(*) AS n, r(avg(CASE WHEN regexp_matches(ticker, '^[0-9]+$') THEN 1.0 ELSE 0.0 END)) AS parse_rate FROM trades")
def s7(d: Data):
    path = f"{scratch(d.spark)}/trades.json"
    d.trades.select(F.to_json(F.array(F.struct("seq", "ticker"))).alias("value")).write.text(path)
    rows = d.spark.read.schema("value string").text(path).select(F.explode(F.from_json("value", "array<struct<seq:long,ticker:string>>")).alias("t")).select("t.*")
    return rows.agg(F.count("*").alias("n"), F.avg(F.expr("try_cast(ticker AS long)").isNotNull().cast("double")).alias("parse_rate"))


@query("S8", "SELECT series_id, date, r(value) AS value, is_realtime FROM macro WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'")
def s8(d: Data):
    root, frames = scratch(d.spark), []
    for s in ("F", "O", "P"):
        d.macro.where(F.col("series_id") == s).select("date", "value").write.csv(f"{root}/{s}.csv", header=True)
        raw = d.spark.read.schema("date string, value string").csv(f"{root}/{s}.csv", header=True)
        frames.append(io.macro_csv(raw, s, ("O", "P"), "1996-01-01", "1999-12-31"))
    return reduce(DataFrame.unionByName, frames)


@query("S9", "SELECT ticker, date, r(close_raw) AS close_raw, r(close_adj) AS close_adj, volume FROM pd WHERE volume >= 10")
def s9(d: Data):
    raw = d.daily.select(F.col("ticker").alias("sym"), F.col("date").cast("string").alias("day"), F.col("close_raw").cast("string").alias("close"),
                         F.when(F.col("volume") >= 10, F.col("close_adj").cast("string")).otherwise("n/a").alias("closeadj"), F.col("volume").cast("string").alias("vol"))
    return io.price_contract(raw, {"ticker": "sym", "date": "day", "close_raw": "close", "close_adj": "closeadj", "volume": "vol"})


@query("S10", "SELECT ticker, date, r(close_adj) AS close_adj FROM pw WHERE ticker IN ('3', '5', '7') AND date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'")
def s10(d: Data):
    root = scratch(d.spark)
    paths = [io.put(d.weekly.where(F.col("ticker") == t), root, "prices", t) for t in ("3", "5", "7")]
    return d.spark.read.parquet(*paths).where(F.col("date").between("1997-01-01", "1998-12-31")).select("ticker", "date", "close_adj")


@query("S11", """SELECT * FROM (SELECT ticker, date, 2.0::DOUBLE AS split_ratio, NULL::DOUBLE AS dividend FROM pw WHERE volume >= 150
  UNION ALL SELECT ticker, date, NULL::DOUBLE, r(close_adj / 100) FROM pw WHERE volume <= 5) WHERE date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""")
def s11(d: Data):
    splits = d.weekly.where("volume >= 150").select("ticker", "date", F.lit(2.0).alias("split_ratio"))
    dividends = d.weekly.where("volume <= 5").select("ticker", "date", (F.col("close_adj") / 100).alias("dividend"))
    return io.actions(splits, dividends, "1996-01-01", "2000-12-31")


@query("S12", "SELECT upper(trim(replace(s_name, '#', '.')))::VARCHAR AS raw, replace(upper(trim(replace(s_name, '#', '.'))), '.', '-') AS ticker, r_name AS sector, n_name AS sub_industry FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def s12(d: Data):
    joined = d.table("supplier").join(d.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(d.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    name = F.replace("s_name", F.lit("#"), F.lit("."))
    return joined.select(F.upper(F.trim(name)).alias("raw"), clean.symbol(name).alias("ticker"), F.col("r_name").alias("sector"), F.col("n_name").alias("sub_industry")).dropDuplicates(["ticker"])


@query("S13", """SELECT 'momentum' AS family, count(*) AS n_rows, 'signal' AS feature_columns, 'signal_z,signal_rank' AS normalized_columns, 'signal: price a month ago over a year ago, less 1; missing: no row' AS specs,
  (SELECT count(*) FROM panel) AS panel_rows, (SELECT count(DISTINCT ticker) FROM panel) AS panel_names, true AS dated FROM mom""")
def s13(d: Data):
    root = scratch(d.spark)
    io.put(d.momentum, root, "features", "momentum")
    record = io.feature_record(io.get(d.spark, root, "features", "momentum"), "momentum", {"signal": "price a month ago over a year ago, less 1; missing: no row"}, d.panel, "panel")
    io.put(record, root, "features", "momentum_meta")
    stored = io.get(d.spark, root, "features", "momentum_meta")
    dated = F.abs(F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("built")) < 86_400  # the time itself differs from run to run
    return stored.select("family", "n_rows", "feature_columns", "normalized_columns", "specs", "panel_rows", "panel_names", dated.alias("dated"))


@query("S14", f"""SELECT 'returns' AS part, 'equal' AS name, date, r(ret) AS value FROM (SELECT date, avg(ret) AS ret FROM hold GROUP BY date) UNION ALL SELECT 'returns', 'median', date, r(median(ret)) FROM hold GROUP BY date
  UNION ALL SELECT 'ic', 'momentum', date, r(ic) FROM ics UNION ALL SELECT 'summary', 'mean_ic', NULL, r(avg(ic)) FROM ics UNION ALL SELECT 'meta', 'panel_rows', NULL, count(*) FROM panel UNION ALL SELECT 'meta', 'panel_names', NULL, count(DISTINCT ticker) FROM panel""")
def s14(d: Data):
    by = lambda name, f: d.holding.groupBy("date").agg(f.alias("value")).select(F.lit(name).alias("name"), "date", "value")
    ics = evalstats.information_coefficients(d.scored, "signal", "fwd_ret_raw")
    metas = d.panel.agg(F.count(F.lit(1)).cast("double").alias("panel_rows"), F.countDistinct("ticker").cast("double").alias("panel_names"))
    none = F.lit(None).cast("date")
    parts = {
        "returns": by("equal", F.avg("ret")).unionByName(by("median", F.median("ret"))),
        "ic": ics.select(F.lit("momentum").alias("name"), "date", F.col("ic").alias("value")),
        "summary": evalstats.ic_summary(ics).select(F.lit("mean_ic").alias("name"), none.alias("date"), F.col("mean_ic").alias("value")),
        "meta": metas.unpivot([], ["panel_rows", "panel_names"], "name", "value").select("name", none.alias("date"), "value"),
    }
    return io.put_results(d.spark, scratch(d.spark), parts, "name string, date date, value double").select("part", "name", "date", "value")


@query("S15", "SELECT 'hold' AS name, count(*) + 1 AS n_rows, count(*) AS n_now FROM hold")
def s15(d: Data):
    actual = io.provenance(d.momentum, "mom").unionByName(io.provenance(d.holding, "hold"))
    recorded = actual.withColumn("n_rows", F.col("n_rows") + F.when(F.col("name") == "hold", 1).otherwise(0))
    return io.provenance_mismatch(recorded, actual)


@query("S17", """SELECT 'lineitem' AS name, count(*) AS n_rows, min(l_shipdate)::DATE AS first, max(l_shipdate)::DATE AS last, count(DISTINCT l_suppkey) AS n_keys FROM lineitem
  UNION ALL SELECT 'orders', count(*), min(o_orderdate)::DATE, max(o_orderdate)::DATE, count(DISTINCT o_custkey) FROM orders
  UNION ALL SELECT 'events', count(*), min(ts)::DATE, max(ts)::DATE, count(DISTINCT user_id) FROM events""")
def s17(d: Data):
    return reduce(DataFrame.unionByName, (io.profile(d.table(t), t, day, key) for t, day, key in (("lineitem", "l_shipdate", "l_suppkey"), ("orders", "o_orderdate", "o_custkey"), ("events", "ts", "user_id"))))


@query("S18", "SELECT ticker, date, r(close_raw) AS close_raw FROM pd WHERE ticker = '7' AND date BETWEEN DATE '1998-03-01' AND DATE '1998-03-31'")
def s18(d: Data):
    return d.daily.where(F.col("ticker") == "7").where(F.col("date").between("1998-03-01", "1998-03-31")).select("ticker", "date", "close_raw")


# --- projections, filters, cleaning ------------------------------------------------------------


@query("P1", "SELECT ticker, tag, period_end, filed, r(value) AS value FROM facts WHERE tag IN ('1-URGENT', '2-HIGH') AND filed BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'")
def p1(d: Data):
    return clean.available(d.facts_of("1-URGENT", "2-HIGH"), ["1-URGENT", "2-HIGH"], "1996-01-01", "1998-12-31").select("ticker", "tag", "period_end", "filed", "value")


@query("P2", """SELECT o_orderkey, tag, r(value) AS value FROM (SELECT o_orderkey, 'o_totalprice' AS tag, o_totalprice AS value, o_orderkey % 3 AS k FROM orders
  UNION ALL SELECT o_orderkey, 'discounted', CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice / 2 END, o_orderkey % 3 FROM orders) WHERE k = 0 AND value IS NOT NULL""")
def p2(d: Data):
    dimension = F.element_at(F.array(F.lit("ARQ"), F.lit("ART"), F.lit("MRQ")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    wide = d.table("orders").select("o_orderkey", dimension.alias("dimension"), "o_totalprice", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice") / 2).alias("discounted"))
    return clean.unpivot_facts(wide, "ARQ", ["o_totalprice", "discounted"], ["o_orderkey"])


@query("P3", "SELECT DISTINCT p_brand AS ticker FROM part WHERE p_type IN ('ECONOMY', 'PROMO') ORDER BY 1")
def p3(d: Data):
    return d.table("part").where(F.col("p_type").isin("ECONOMY", "PROMO")).select(F.col("p_brand").alias("ticker")).distinct().orderBy("ticker")


@query("P4", "SELECT series_id, date, r(value) AS value FROM macro WHERE is_realtime")
def p4(d: Data):
    return d.macro.where("is_realtime").select("series_id", "date", "value")


@query("P5", "SELECT date, count(*) AS n, sum(CASE WHEN eligible THEN 1 ELSE 0 END)::BIGINT AS n_eligible FROM elig GROUP BY date")
def p5(d: Data):
    ok = crosssec.eligibility(d.weekly, d.rebalances, 1_000.0, 75_000.0)
    return ok.groupBy("date").agg(F.count("*").alias("n"), F.sum(F.col("eligible").cast("long")).alias("n_eligible"))


@query("P6", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice BETWEEN 920 AND 950")
def p6(d: Data):
    return d.table("part").where(F.col("p_retailprice").between(920, 950)).select("p_partkey", "p_retailprice")


@query("P7", "SELECT s_suppkey, CASE WHEN s_acctbal > 5000 THEN r(1000 / (s_acctbal - 5000)) END AS ratio, CASE WHEN s_acctbal > 5000 THEN r(s_suppkey / (s_acctbal - 5000) - 1) END AS growth FROM supplier")
def p7(d: Data):
    from ..functions import expr as X

    base = F.col("s_acctbal") - 5000
    return d.table("supplier").select("s_suppkey", X.ratio(F.lit(1000), base).alias("ratio"), X.growth(F.col("s_suppkey"), base).alias("growth"))


@query("P8", "SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'buy' WHEN event_type = 'error' THEN 'sell' ELSE 'other' END AS side FROM events")
def p8(d: Data):
    kind = F.when(F.col("event_type") == "purchase", "Purchase").when(F.col("event_type") == "error", "Sale (Partial)").otherwise(F.col("event_type"))
    return d.table("events").select("event_id", clean.trade_side(kind).alias("side"))


OWNERS = ("SP", " spouse ", "DC", "Dependent Child", "JT", "joint", "self", "--", "", "unknown", "Depend.")


@query("P9", "SELECT event_id, list_value('spouse', 'spouse', 'dependent', 'dependent', 'joint', 'joint', 'self', 'self', 'self', 'self', 'dependent')[event_id % 11 + 1] AS owner FROM events")
def p9(d: Data):
    raw = F.element_at(F.array(*map(F.lit, OWNERS)), (F.col("event_id") % 11 + 1).cast("int"))
    return d.table("events").select("event_id", clean.owner_class(raw).alias("owner"))


@query("P10", """SELECT p_partkey, replace(upper(trim(p_name)), '.', '-') AS symbol, upper(p_name[1]) || substr(p_name, 2, instr(p_name, ' ') - 1) || upper(p_name[instr(p_name, ' ') + 1]) || substr(p_name, instr(p_name, ' ') + 2) AS person,
  string_split(p_name, ' ')[1] AS first FROM part""")
def p10(d: Data):
    name = F.col("p_name")
    titled = F.concat(F.lit("Hon. "), F.replace(name, F.lit(" "), F.lit("_")))
    return d.table("part").select("p_partkey", clean.symbol(name).alias("symbol"), clean.person_name(titled).alias("person"), F.split(name, " ")[0].alias("first"))


DISCLOSED = "SELECT event_id AS seq, CASE WHEN event_id % 11 = 0 THEN ' -- ' ELSE json_extract_string(props, '$.k') END AS ticker, CASE WHEN event_id % 13 <> 0 THEN (ts::DATE - (event_id % 800 - 20)::INTEGER)::DATE END AS td, ts::DATE AS fd FROM events"


def disclosed(d: Data) -> DataFrame:
    key = F.col("event_id")
    return d.table("events").select(
        key.alias("seq"), F.when(key % 11 == 0, " -- ").otherwise(F.get_json_object("props", "$.k")).alias("ticker"),
        F.when(key % 13 != 0, F.date_sub(F.col("ts").cast("date"), (key % 800 - 20).cast("int")).cast("string")).otherwise("n/a").alias("transaction_date"), F.col("ts").cast("date").cast("string").alias("filing_date"),
    )


COMMON = "SELECT s_suppkey::VARCHAR AS ticker FROM supplier WHERE s_suppkey % 3 > 0"


@query("P11", """SELECT count(*) AS n_in, count_if(td IS NULL)::BIGINT AS no_date, count_if(blank)::BIGINT AS no_symbol, count_if(NOT blank AND NOT common)::BIGINT AS not_common,
  count_if(NOT blank AND common AND td IS NOT NULL AND fd - td NOT BETWEEN 0 AND 730)::BIGINT AS bad_lag, count_if(NOT blank AND common AND td IS NOT NULL AND fd - td BETWEEN 0 AND 730)::BIGINT AS n_out
  FROM (SELECT *, trim(ticker) = '--' AS blank, ticker IN (SELECT ticker FROM common) AS common FROM disclosed)""", {"disclosed": DISCLOSED, "common": COMMON})
def p11(d: Data):
    """Two suppliers of three stand for common equities."""
    common = d.table("supplier").where(F.col("s_suppkey") % 3 > 0).select(F.col("s_suppkey").cast("string").alias("ticker"))
    return clean.clean_disclosures(disclosed(d), common)[1]


@query("P12", "SELECT ticker, date, eventcodes FROM ann WHERE list_contains(string_split(eventcodes, '|'), '2')")
def p12(d: Data):
    return d.announcements.where(clean.has_code(F.col("eventcodes"), "2"))


@query("P13", "SELECT seq, (fd - td)::INTEGER AS lag FROM disclosed WHERE fd - td BETWEEN 0 AND 60", {"disclosed": DISCLOSED})
def p13(d: Data):
    own = disclosed(d).withColumns({c: F.try_to_date(c) for c in ("transaction_date", "filing_date")})
    return own.select("seq", clean.lag_days("filing_date", "transaction_date").alias("lag")).where(F.col("lag").between(0, 60))


@query("P14", "SELECT date <= DATE '1999-12-31' AS is_dev, count(*) AS n FROM panel GROUP BY 1")
def p14(d: Data):
    return d.panel.groupBy((F.col("date") <= F.lit("1999-12-31")).alias("is_dev")).agg(F.count("*").alias("n"))


@query("P15", "SELECT CASE WHEN year(date) BETWEEN 1995 AND 1997 THEN 'P1' WHEN year(date) BETWEEN 1998 AND 1999 THEN 'P2' ELSE 'other' END AS period, count(*) AS n FROM hold GROUP BY 1")
def p15(d: Data):
    return d.holding.groupBy(clean.period(F.year("date"), [("P1", 1995, 1997), ("P2", 1998, 1999)]).alias("period")).agg(F.count("*").alias("n"))


@query("P16", "SELECT DISTINCT ticker FROM log WHERE action = 'removed' AND date >= DATE '2024-01-28'")
def p16(d: Data):
    return d.log.where((F.col("action") == "removed") & (F.col("date") >= F.lit("2024-01-28"))).select("ticker").distinct()


@query("P17", "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN r(value / (event_id % 5)) END AS safe FROM events")
def p17(d: Data):
    from ..functions import expr as X

    value, k = F.col("value"), (F.col("event_id") % 5).cast("double")
    return d.table("events").select("event_id", X.finite(F.when(k != 0, value / k).otherwise(F.lit(float("inf")))).alias("safe"))


@query("P18", "SELECT event_id, abs(value) AS value FROM events WHERE event_type = 'purchase' AND user_id % 9 <> 0")
def p18(d: Data):
    raw = d.table("events").select(
        "event_id", F.get_json_object("props", "$.k").alias("ticker"), F.col("ts").cast("date").alias("filingdate"), F.when(F.col("user_id") % 9 != 0, F.col("user_id").cast("string")).alias("ownername"),
        F.when(F.col("event_type") == "purchase", "P").otherwise("S").alias("transactioncode"), (-F.col("value")).alias("transactionvalue"),
    )
    return clean.open_market_purchases(raw).select("event_id", "value")


# --- joins -------------------------------------------------------------------------------------

WIDE = {
    "wide": "SELECT ticker, filed, " + ", ".join(f"arg_max(value, (period_end, value)) FILTER (WHERE tag = '{t}') AS {n}" for t, n in zip(contracts.TAGS, TAG_COLUMNS, strict=True)) + " FROM facts GROUP BY ticker, filed",
    "kept": "SELECT p.ticker, p.date, "
    + ", ".join(f"{n}.value AS {n}" for n in TAG_COLUMNS)
    + " FROM probes p "
    + " ".join(f"ASOF LEFT JOIN (SELECT ticker, filed, {n} AS value FROM wide WHERE {n} IS NOT NULL) {n} ON {n}.ticker = p.ticker AND {n}.filed <= p.date" for n in TAG_COLUMNS),
}


@query("J1", "SELECT date, ticker, r(signal) AS signal, r(fwd_ret_raw) AS fwd_ret_raw FROM scored")
def j1(d: Data):
    return d.scored


@query("J2", "SELECT date, ticker, r(fwd_ret_raw) AS fwd_ret_raw, r(signal) AS signal, r(ret) AS ret FROM panel LEFT JOIN mom USING (date, ticker) LEFT JOIN hold USING (date, ticker)")
def j2(d: Data):
    return d.panel.select("date", "ticker", "fwd_ret_raw").join(d.momentum, ["date", "ticker"], "left").join(d.holding, ["date", "ticker"], "left")


@query("J3", "SELECT date, m.ticker, s.sector FROM mom m LEFT JOIN (SELECT * FROM sector WHERE ticker::BIGINT % 10 <> 0) s USING (ticker)")
def j3(d: Data):
    return d.momentum.select("date", "ticker").join(d.sectors.where("cast(ticker AS long) % 10 <> 0"), "ticker", "left").select("date", "ticker", "sector")


@query("J4", "SELECT ticker, date, " + ", ".join(f"r({n}) AS {n}" for n in TAG_COLUMNS) + " FROM kept", WIDE)
def j4(d: Data):
    return _named(asof.facts_asof(d.facts, d.probes, contracts.TAGS))


@query("J5", """SELECT p.ticker, p.date, f.tag, arg_max(f.filed, (f.filed, f.period_end, f.value)) AS filed, arg_max(f.period_end, (f.filed, f.period_end, f.value)) AS period_end, r(arg_max(f.value, (f.filed, f.period_end, f.value))) AS value
  FROM probes p JOIN (SELECT a.session AS date, b.session AS cutoff FROM sess a JOIN sess b ON b.idx = a.idx - 1) c USING (date) JOIN facts f ON f.ticker = p.ticker AND f.filed <= c.cutoff GROUP BY p.ticker, p.date, f.tag""")
def j5(d: Data):
    return asof.select_asof(d.facts, d.probes, d.calendar, 1)


@query("J6", "SELECT p.ticker, p.date, r(x.close_adj) AS close_adj FROM probes p ASOF JOIN pd x ON x.ticker = p.ticker AND x.date <= p.date")
def j6(d: Data):
    return asof.last_known(d.daily.select("ticker", F.col("date").alias("known"), "close_adj"), d.probes, ["ticker"], ["close_adj"], "known", "date").where("close_adj IS NOT NULL")


@query("J7", """SELECT m.date, m.ticker, r(o.value) AS "O", r(p.value) AS "P" FROM mom m ASOF LEFT JOIN (SELECT * FROM macro WHERE series_id = 'O') o ON o.date <= m.date ASOF LEFT JOIN (SELECT * FROM macro WHERE series_id = 'P') p ON p.date <= m.date""")
def j7(d: Data):
    return d.momentum.select("date", "ticker").join(asof.series_asof(d.macro, d.rebalances, ["O", "P"]), "date")


MEMBER = '(m.start IS NULL OR m.start <= {d}) AND (m."end" IS NULL OR {d} < m."end")'


@query("J8", f"SELECT r.date, m.ticker FROM reb r JOIN members m ON {MEMBER.format(d='r.date')}")
def j8(d: Data):
    return intervals.members_on(d.members, d.rebalances)


@query("J8_log", f"SELECT DISTINCT r.date, m.ticker FROM (SELECT DISTINCT date FROM log) r JOIN intervals m ON {MEMBER.format(d='r.date')}")
def j8_log(d: Data):
    return intervals.members_on(d.intervals, d.log.select("date").distinct())


@query("J9", f"SELECT p.ticker, p.date FROM probes p WHERE NOT EXISTS (SELECT 1 FROM members m WHERE m.ticker = p.ticker AND {MEMBER.format(d='p.date')})")
def j9(d: Data):
    return intervals.not_members(d.probes, d.members)


@query("J10", """SELECT e.ticker, e.date FROM (SELECT DISTINCT ticker, filed AS date FROM facts WHERE tag = '1-URGENT') e ASOF JOIN (SELECT DISTINCT date AS u FROM elig WHERE eligible) r ON r.u <= e.date
  WHERE EXISTS (SELECT 1 FROM elig x WHERE x.eligible AND x.date = r.u AND x.ticker = e.ticker)""")
def j10(d: Data):
    universe = crosssec.eligibility(d.weekly, d.rebalances, 1_000.0, 75_000.0).where("eligible").select("date", "ticker")
    own = d.facts_of("1-URGENT").select("ticker", F.col("filed").alias("date")).distinct()
    return intervals.in_universe_at(own, universe).select("ticker", "date")


@query("J11", """SELECT t.seq, t.ticker, t.filing_date, min(a.date) AS matched FROM trades t JOIN (SELECT ticker, date FROM ann) a ON a.ticker = t.ticker AND a.date > t.filing_date AND a.date <= t.filing_date + 3 GROUP BY ALL""")
def j11(d: Data):
    own = d.trades.select("seq", "ticker", "filing_date")
    return intervals.first_in_range(own, d.announcements, F.col("filing_date"), F.date_add("filing_date", 3))


@query("J12", """SELECT o.date, a.session AS snapped, b.session AS plus5, c.session AS minus5 FROM (SELECT DISTINCT o_orderdate::DATE AS date FROM orders) o ASOF LEFT JOIN sess a ON o.date <= a.session
  LEFT JOIN sess b ON b.idx = a.idx + 5 LEFT JOIN sess c ON c.idx = a.idx - 5""")
def j12(d: Data):
    days = d.table("orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    moved = reduce(lambda df, x: calendar.offset(df, d.calendar, x[1], to=x[0]), (("snapped", 0), ("plus5", 5), ("minus5", -5)), days)
    return moved.select("date", "snapped", "plus5", "minus5")


@query("J13", "SELECT ticker, date, entry, r(ret) AS ret FROM adj", EVENT_RETURNS)
def j13(d: Data):
    return adjusted_event_returns(d)


@query("J14", "SELECT count(*) AS n, r(avg(CASE WHEN m.ticker IS NOT NULL THEN 1.0 ELSE 0.0 END)) AS match_rate FROM (SELECT DISTINCT ticker FROM trades) t LEFT JOIN (SELECT DISTINCT ticker FROM liq) m USING (ticker)")
def j14(d: Data):
    known = d.liquidated.distinct().withColumn("known", F.lit(True))
    return d.trades.select("ticker").distinct().join(known, "ticker", "left").agg(F.count("*").alias("n"), F.avg(F.col("known").isNotNull().cast("double")).alias("match_rate"))


@query("J15", """SELECT count(*) AS overlap, r(avg(CASE WHEN abs(da - db) <= 1 THEN 1.0 ELSE 0.0 END)) AS date_agree FROM (SELECT member, ticker, min(filing_date) AS da FROM trades GROUP BY ALL)
  JOIN (SELECT user_id::VARCHAR AS member, json_extract_string(props, '$.k') AS ticker, min(ts::DATE) AS db FROM events WHERE event_type = 'view' GROUP BY ALL) USING (member, ticker)""")
def j15(d: Data):
    other = d.table("events").where("event_type = 'view'").select(F.concat(F.lit(" "), F.col("user_id").cast("string")).alias("member"), F.get_json_object("props", "$.k").alias("ticker"), F.col("ts").cast("date").alias("day"))
    return events.reconcile(d.trades, other, ["member", "ticker"], "filing_date", "day")


@query("J17", """SELECT p.ticker, p.date, r(a.value) AS v_now, r(b.value) AS v_q, r(c.value) AS v_y, r(e.value) AS v_yq FROM probes p JOIN sess s ON s.session = p.date
  """ + " ".join(f"LEFT JOIN sess s{n} ON s{n}.idx = s.idx - {k} ASOF LEFT JOIN one {n} ON {n}.ticker = p.ticker AND {n}.filed <= s{n}.session" for n, k in (("a", 0), ("b", QUARTER), ("c", YEAR), ("e", YEAR + QUARTER))),
       {"one": "SELECT ticker, filed, arg_max(value, (period_end, value)) AS value FROM facts WHERE tag = '3-MEDIUM' GROUP BY ALL"})
def j17(d: Data):
    found = asof.facts_at_offsets(d.facts_of("3-MEDIUM"), d.probes, ["3-MEDIUM"], d.calendar, {"now": 0, "q": -QUARTER, "y": -YEAR, "yq": -YEAR - QUARTER})
    return found.select("ticker", "date", *(F.col(f"`3-MEDIUM_{n}`").alias(f"v_{n}") for n in ("now", "q", "y", "yq")))


@query("J19", "SELECT ticker, date, r(p.close_raw * s.value) AS market_cap FROM (SELECT * FROM pw JOIN reb USING (date)) p ASOF JOIN (SELECT ticker AS t2, filed, arg_max(value, (period_end, value)) AS value FROM facts WHERE tag = '1-URGENT' GROUP BY ALL) s ON s.t2 = p.ticker AND s.filed <= p.date")
def j19(d: Data):
    return asof.market_cap(d.weekly, d.facts_of("1-URGENT"), d.rebalances, "1-URGENT")


@query("J21", """SELECT t.seq, e.ticker IS NOT NULL AS associated FROM trades t LEFT JOIN (SELECT DISTINCT ticker, filing_date, member FROM flagged WHERE active) e USING (ticker, filing_date, member)""",
       {"seen": """SELECT t.seq, t.ticker, t.member, t.filing_date, count(DISTINCT o.member) AS n_actors FROM trades t
  JOIN trades o ON o.ticker = t.ticker AND o.filing_date >= t.filing_date - 3 AND (o.filing_date < t.filing_date OR o.filing_date = t.filing_date AND o.seq <= t.seq) GROUP BY ALL""",
        "flagged": "SELECT *, n_actors >= 3 AS active FROM seen"})
def j21(d: Data):
    active = events.clusters(events.distinct_actors(d.trades, 3), 3).where("active").select("ticker", "filing_date", "member").distinct().withColumn("associated", F.lit(True))
    return d.trades.join(active, ["ticker", "filing_date", "member"], "left").select("seq", F.coalesce("associated", F.lit(False)).alias("associated"))


# --- set operations ----------------------------------------------------------------------------


@query("U1", "SELECT ticker, date, r(close_adj) AS close_adj, NULL::VARCHAR AS note FROM mkt UNION ALL SELECT ticker, date, NULL::DOUBLE, 'member' FROM probes")
def u1(d: Data):
    return d.market.select("ticker", "date", "close_adj").unionByName(d.probes.withColumn("note", F.lit("member")), allowMissingColumns=True)


@query("U2", "SELECT ticker, filed AS date FROM facts UNION SELECT ticker, date FROM probes")
def u2(d: Data):
    return d.facts.select("ticker", F.col("filed").alias("date")).union(d.probes.select("ticker", "date")).distinct()


@query("U3", "SELECT date FROM mom INTERSECT SELECT date FROM hold")
def u3(d: Data):
    return d.momentum.select("date").intersect(d.holding.select("date"))


@query("U4", "SELECT DISTINCT ticker FROM sector EXCEPT SELECT ticker FROM liq")
def u4(d: Data):
    return d.sectors.select("ticker").subtract(d.liquidated)


@query("U5", "SELECT ticker, member, arg_min(seq, (filing_date, seq)) AS first_seq, arg_max(seq, (filing_date, seq)) AS last_seq FROM trades GROUP BY ticker, member")
def u5(d: Data):
    first = events.first_vintage(d.trades, ["ticker", "member"], ["filing_date", "seq"]).select("ticker", "member", F.col("seq").alias("first_seq"))
    last = d.trades.groupBy("ticker", "member").agg(F.max_by("seq", F.struct("filing_date", "seq")).alias("last_seq"))
    return first.join(last, ["ticker", "member"])


