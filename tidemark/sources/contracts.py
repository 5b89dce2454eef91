"""The driver's relational tables as the contracts that operators read.

A supplier is a ticker, its weekly (or daily) line items are price bars; orders are filed facts,
events are a membership log, actor trades and announcements.  Sums go through decimals, so they do
not depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Order priorities, the tags of the fact table.
TAGS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bars(items: DataFrame, *keys) -> DataFrame:
    price, discount = F.col("l_extendedprice").cast("decimal(15,2)"), F.col("l_discount").cast("decimal(4,2)")
    sums = items.groupBy(*keys).agg(
        F.sum(price).cast("double").alias("raw"), F.sum(price * (1 - discount)).cast("double").alias("adj"), F.sum("l_quantity").alias("volume")
    )
    return sums.select(*sums.columns[: len(keys)], (F.col("raw") / F.col("volume")).alias("close_raw"), (F.col("adj") / F.col("volume")).alias("close_adj"), "volume")


def _day(weekly: bool):
    return (F.date_trunc("week", "l_shipdate") if weekly else F.col("l_shipdate")).cast("date").alias("date")


def _dealt(rows: DataFrame, keys: Sequence[str], n: int | None) -> DataFrame:
    return rows.repartition(*keys) if n is None else rows.repartition(n, *keys)


def prices(spark: SparkSession, sf_dir: str, weekly: bool = True, parts: int | None = None) -> DataFrame:
    """ticker, date, close_raw, close_adj, volume.

    Few items of a scanned split share a bar, so items are dealt by ticker (to ``parts`` partitions) before
    they are summed: sums of a whole split would hold almost every item of it in memory.  Bars then are
    where windows and buckets by ticker need them, so an item is exchanged once.
    """
    cents = [F.col("l_extendedprice").cast("decimal(15,2)").alias("l_extendedprice"), F.col("l_discount").cast("decimal(4,2)").alias("l_discount")]  # packs better than doubles
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("ticker"), _day(weekly), *cents, "l_quantity")
    return _bars(_dealt(items, ["ticker"], parts), "ticker", "date")


def benchmark(spark: SparkSession, sf_dir: str, weekly: bool = True) -> DataFrame:
    """The price bars of all suppliers together, as ticker MKT."""
    return _bars(table(spark, sf_dir, "lineitem"), F.lit("MKT").alias("ticker"), _day(weekly))


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, sector."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return (
        table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_suppkey").cast("string").alias("ticker"), F.col("r_name").alias("sector"))
    )


def facts(spark: SparkSession, sf_dir: str, parts: int | None = None, tags: Sequence[str] | None = None) -> DataFrame:
    """ticker, tag, value, period_end, filed: one vintage for each supplier, priority (of ``tags``, if given) and order day.

    Items are dealt by ticker before they are summed, as in :func:`prices`.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("tag"), F.col("o_orderdate").cast("date").alias("filed"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_extendedprice").cast("decimal(15,2)").alias("price"))
    joined = (orders if tags is None else orders.where(F.col("tag").isin(*tags))).join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    rows = joined.select(F.col("l_suppkey").cast("string").alias("ticker"), "tag", "filed", "price")
    sums = _dealt(rows, ["ticker"], parts).groupBy("ticker", "tag", "filed").agg(F.sum("price").cast("double").alias("value"))
    return sums.select("ticker", "tag", F.date_sub(F.date_trunc("quarter", "filed").cast("date"), 1).alias("period_end"), "filed", "value")


def membership_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, ts, seq, date, action (added, removed or current)."""
    action = F.when(F.col("event_type") == "signup", "added").when(F.col("event_type") == "error", "removed").when(F.col("event_type") == "click", "current")
    return (
        table(spark, sf_dir, "events")
        .select(F.col("user_id").cast("string").alias("ticker"), "ts", F.col("event_id").alias("seq"), F.col("ts").cast("date").alias("date"), action.alias("action"))
        .where(F.col("action").isNotNull())
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, ticker, member, filing_date, value, officer: purchases of an item by a user; every fourth user is an officer."""
    return (
        table(spark, sf_dir, "events")
        .where(F.col("event_type") == "purchase")
        .select(
            F.col("event_id").alias("seq"), F.get_json_object("props", "$.k").alias("ticker"), F.col("user_id").cast("string").alias("member"),
            F.col("ts").cast("date").alias("filing_date"), "value", (F.col("user_id") % 4 == 0).alias("officer"),
        )
    )


def announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, date, eventcodes: views of an item; the codes are the user's digits, pipe-separated."""
    codes = F.array_join(F.regexp_extract_all(F.col("user_id").cast("string"), F.lit("[0-9]"), F.lit(0)), "|")
    return table(spark, sf_dir, "events").where(F.col("event_type") == "view").select(F.get_json_object("props", "$.k").alias("ticker"), F.col("ts").cast("date").alias("date"), codes.alias("eventcodes"))


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, date, value, is_realtime: the day's mean order value for each status; F is a revised series."""
    day = F.col("o_orderdate").cast("date")
    sums = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("series_id"), day.alias("date")).agg(F.sum(F.col("o_totalprice").cast("decimal(15,2)")).cast("double").alias("s"), F.count("*").alias("n"))
    return sums.select("series_id", "date", (F.col("s") / F.col("n")).alias("value"), (F.col("series_id") != "F").alias("is_realtime"))
