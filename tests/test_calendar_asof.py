"""Sessions, offsets, as-of joins, intervals: the fixtures' expected values."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, calendar, intervals

from .frames import by, calendar_frame, dates_frame, day, price_frame, weekdays

FACTS = "ticker string, tag string, value double, period_end date, filed date"
ACME = [("ACME", "Revenues", 100.0, day("2020-12-31"), day("2021-02-15")), ("ACME", "Revenues", 110.0, day("2020-12-31"), day("2021-08-01")), ("ACME", "Revenues", 30.0, day("2021-03-31"), day("2021-11-01"))]


@pytest.fixture(scope="module")
def sessions(spark):
    return calendar_frame(spark, [d for d in weekdays("2020-12-01", 420) if d != day("2021-12-24") and d != day("2021-01-01")])


def test_offsets_snap_forward_first(spark, sessions):
    rows = dates_frame(spark, [day("2021-01-04"), day("2021-01-09"), day("2021-12-24"), day("2030-01-01")])
    plus5 = by(calendar.offset(rows, sessions, 5), "date", value="target")
    assert plus5[day("2021-01-04")] == day("2021-01-11") and plus5[day("2030-01-01")] is None
    assert by(calendar.offset(rows, sessions, 1), "date", value="target")[day("2021-01-09")] == day("2021-01-12")
    assert by(calendar.offset(rows, sessions, 0), "date", value="target")[day("2021-12-24")] == day("2021-12-27")
    back = by(calendar.offset(dates_frame(spark, [day("2021-01-11")]), sessions, -5), "date", value="target")
    assert back[day("2021-01-11")] == day("2021-01-04")


def test_month_ends(spark, sessions):
    ends = {r["date"] for r in calendar.month_ends(sessions).collect()}
    assert {day("2021-01-29"), day("2021-02-26"), day("2021-03-31")} <= ends


@pytest.mark.parametrize(("at", "lag", "want"), [("2021-03-01", 0, 100.0), ("2021-07-01", 0, 100.0), ("2021-09-01", 0, 110.0), ("2021-12-01", 0, 30.0), ("2021-02-15", 1, None), ("2021-02-17", 1, 100.0)])
def test_selector_sees_only_what_was_filed(spark, sessions, at, lag, want):
    facts = spark.createDataFrame(ACME, FACTS)
    probes = spark.createDataFrame([("ACME", day(at))], "ticker string, date date")
    found = asof.select_asof(facts, probes, sessions, lag).collect()
    assert [r["value"] for r in found] == ([] if want is None else [want])


def test_wide_asof_carries_each_tag(spark):
    facts = spark.createDataFrame([*ACME, ("ACME", "Eps", 2.0, day("2020-12-31"), day("2021-03-01")), ("B", "Eps", None, day("2020-12-31"), day("2021-03-01"))], FACTS)
    probes = spark.createDataFrame([("ACME", day("2021-02-20")), ("ACME", day("2021-09-01")), ("B", day("2021-09-01"))], "ticker string, date date")
    found = {(r["ticker"], r["date"]): (r["Revenues"], r["Eps"]) for r in asof.facts_asof(facts, probes, ["Revenues", "Eps"]).collect()}
    assert found == {("ACME", day("2021-02-20")): (100.0, None), ("ACME", day("2021-09-01")): (110.0, 2.0), ("B", day("2021-09-01")): (None, None)}


def test_future_rows_change_nothing(spark):
    """Metamorphic: what is filed or priced after a date can't move the value known at it."""
    prices = price_frame(spark, {"A": [100.0 + k for k in range(30)]})
    at = weekdays("2021-01-04", 30)[15]
    probes = spark.createDataFrame([("A", at)], "ticker string, date date")
    spiked = prices.withColumn("close_adj", F.when(F.col("date") > at, F.col("close_adj") * 10).otherwise(F.col("close_adj")))
    for table in (prices, spiked):
        found = asof.last_known(table.select("ticker", F.col("date").alias("known"), "close_adj"), probes, ["ticker"], ["close_adj"], "known", "date")
        assert found.first()["close_adj"] == 115.0


LOG = [("AAA", "2010-01-04", "added"), ("AAA", "2015-06-30", "removed"), ("AAA", "2018-03-01", "added"), ("BBB", "2012-09-30", "removed"), ("AAA", "2019-01-01", "added"), ("AAA", "2019-02-01", "current")]


def membership(spark):
    rows = [(t, day(d), k, day(d), a) for k, (t, d, a) in enumerate(LOG)]
    return intervals.membership_intervals(spark.createDataFrame(rows, "ticker string, ts date, seq int, date date, action string"))


def test_intervals_and_members(spark):
    own = membership(spark)
    assert {tuple(r) for r in own.collect()} == {("AAA", day("2010-01-04"), day("2015-06-30")), ("AAA", day("2018-03-01"), None), ("BBB", None, day("2012-09-30"))}
    dates = [day(d) for d in ("2009-12-31", "2011-01-01", "2012-01-01", "2013-01-01", "2015-06-30", "2016-01-01", "2020-01-01")]
    found = {(str(r["date"]), r["ticker"]) for r in intervals.members_on(own, dates_frame(spark, dates)).collect()}
    assert found == {("2009-12-31", "BBB"), ("2011-01-01", "AAA"), ("2011-01-01", "BBB"), ("2012-01-01", "AAA"), ("2012-01-01", "BBB"), ("2013-01-01", "AAA"), ("2020-01-01", "AAA")}
    rows = spark.createDataFrame([(d, t) for d in dates for t in ("AAA", "BBB", "CCC")], "date date, ticker string")
    assert intervals.not_members(rows, own).count() == len(dates) * 3 - len(found)


def test_first_in_range_bounds(spark):
    lo = day("2021-03-01")
    events = spark.createDataFrame([("A", lo)], "ticker string, date date")
    for offsets, want in (((0, 1, 10), 1), ((0, 10, 11), 10), ((0, 11), None)):
        marks = spark.createDataFrame([("A", lo + timedelta(k)) for k in offsets], "ticker string, date date")
        found = intervals.first_in_range(events.withColumnRenamed("date", "low"), marks, F.col("low"), F.date_add("low", 10)).collect()
        assert [r["matched"] for r in found] == ([] if want is None else [lo + timedelta(want)])


def test_in_universe_at_event_time(spark):
    universe = spark.createDataFrame([(day("2021-01-29"), "A"), (day("2021-02-26"), "B")], "date date, ticker string")
    events = spark.createDataFrame([("A", day("2021-01-28")), ("A", day("2021-01-29")), ("A", day("2021-02-25")), ("A", day("2021-02-26")), ("B", day("2021-06-01"))], "ticker string, date date")
    assert {(r["ticker"], str(r["date"])) for r in intervals.in_universe_at(events, universe).collect()} == {("A", "2021-01-29"), ("A", "2021-02-25"), ("B", "2021-06-01")}
