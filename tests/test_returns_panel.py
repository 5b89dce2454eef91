"""Returns, eligibility, panels, features: the fixtures' expected values."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import clean
from tidemark.operators import crosssec, features, returns

from .frames import PRICES, by, calendar_frame, dates_frame, day, price_frame, weekdays


def test_volume_spike_after_the_date_is_not_seen(spark):
    days = weekdays("2021-01-01", 40)
    rows = [("A", d, 50.0, 50.0, 1_000.0 if k <= 25 else 1e7) for k, d in enumerate(days)]
    found = crosssec.eligibility(spark.createDataFrame(rows, PRICES), dates_frame(spark, [days[25], days[10]]), 5, 5e6)
    got = {r["date"]: (r["dollar_vol"], r["eligible"]) for r in found.collect()}
    assert got == {days[25]: (50_000.0, False), days[10]: (None, False)}


def test_penny_stock_is_not_eligible(spark):
    days = weekdays("2021-01-01", 30)
    found = crosssec.eligibility(spark.createDataFrame([("A", d, 2.0, 2.0, 1e7) for d in days], PRICES), dates_frame(spark, days[-1:]), 5, 5e6)
    assert not found.first()["eligible"]


def test_forward_return(spark):
    adj = [100.0, 101, 102, 103, 104, 110, 106, 107, 108, 109]
    prices, days = price_frame(spark, {"A": adj}), weekdays("2021-01-04", 10)
    cal = calendar_frame(spark, days)
    assert returns.forward_returns(prices, dates_frame(spark, days[:1]), cal, 5).first()["fwd_ret_raw"] == pytest.approx(0.10)
    short = price_frame(spark, {"A": [100.0] * 6})
    assert returns.forward_returns(short, dates_frame(spark, days[:1]), calendar_frame(spark, weekdays("2021-01-04", 30)), 10).count() == 0


def test_lead_returns(spark):
    prices = price_frame(spark, {"A": [100.0, 110, 121, 133.1], "B": [100.0, 50]})
    found = [r["fwd_ret"] for r in returns.lead_return(prices, 1).orderBy("ticker", "date").collect()]
    assert found[:3] == pytest.approx([0.1] * 3) and found[3] is None and found[4] == -0.5 and found[5] is None
    assert {r["fwd_ret"] for r in returns.lead_return(prices, 5).collect()} == {None}


@pytest.mark.parametrize(("prices", "target", "liquidated", "want"), [([100, 101, 102, 103, 110, 106], 4, False, 0.10), ([100, 101, 102, 120], 12, False, 0.20), ([100, 80, 5], 12, True, -1.0)])
def test_terminal_returns(spark, prices, target, liquidated, want):
    days = weekdays("2021-01-04", 40)
    pairs = spark.createDataFrame([("A", days[0])], "ticker string, date date")
    gone = spark.createDataFrame([("A",)] if liquidated else [], "ticker string")
    found = returns.delisting_aware_returns(price_frame(spark, {"A": list(map(float, prices))}), pairs, calendar_frame(spark, days), target, gone)
    assert found.first()["fwd_ret_raw"] == pytest.approx(want)


def test_no_return_when_not_trading(spark):
    days = weekdays("2021-01-04", 40)
    pairs = spark.createDataFrame([("A", days[8])], "ticker string, date date")
    assert returns.delisting_aware_returns(price_frame(spark, {"A": [100.0, 101, 102]}), pairs, calendar_frame(spark, days), 5, spark.createDataFrame([], "ticker string")).count() == 0


def test_holding_returns(spark):
    days = weekdays("2021-01-04", 80)
    prices = price_frame(spark, {"A": [100 + 100 * k / 79 for k in range(80)], "B": [100.0] * 80})
    found = by(returns.holding_returns(prices, dates_frame(spark, [days[0], days[40], days[79]])), "ticker", "date", value="ret")
    assert {k[1] for k in found} == {days[0], days[40]} and found["B", days[0]] == 0
    dead = price_frame(spark, {"GOOD": [100.0] * 60, "DEAD": [100.0 - 2 * k for k in range(35)]})
    dates = dates_frame(spark, [days[0], days[30], days[59]])
    liq = spark.createDataFrame([("DEAD",)], "ticker string")
    assert by(returns.delisting_aware_holding_returns(dead, dates, liq), "ticker", "date", value="ret")["DEAD", days[30]] == -1.0
    assert -1 < by(returns.delisting_aware_holding_returns(dead, dates, liq.limit(0)), "ticker", "date", value="ret")["DEAD", days[30]] < 0


def test_event_returns(spark):
    days = weekdays("2021-01-04", 30)
    prices = price_frame(spark, {"A": [100.0 + k for k in range(30)], "DEAD": [100.0 + k for k in range(12)]})
    events = spark.createDataFrame([("A", day("2021-01-09")), ("A", days[28]), ("DEAD", days[5]), ("DEAD", days[20]), ("NONE", days[1])], "ticker string, date date")
    found = by(returns.event_returns(events, prices, calendar_frame(spark, days), 10, lag=1), "ticker", "date", value="ret")
    assert found["A", day("2021-01-09")] == pytest.approx(116 / 106 - 1)  # a Saturday enters on Tuesday
    assert found["A", days[28]] is None and found["DEAD", days[20]] is None
    assert found["DEAD", days[5]] == pytest.approx(111 / 106 - 1)


def test_every_event_and_pair_comes_back(spark):
    days = weekdays("2021-01-04", 30)
    prices, cal = price_frame(spark, {"A": [100.0 + k for k in range(30)]}), calendar_frame(spark, days)
    rows = [("A", days[3]), ("A", days[3]), ("A", day("2030-01-01")), ("A", day("2030-01-01")), ("A", None)]
    found = returns.event_returns(spark.createDataFrame(rows, "ticker string, date date"), prices, cal, 10).collect()
    assert sorted(str((r["date"], r["ret"] is None)) for r in found) == sorted(str((d, d != days[3])) for _, d in rows)
    pairs = spark.createDataFrame([(days[2], "A"), (days[2], "A")], "date date, ticker string")
    assert returns.delisting_aware_returns(prices, pairs, cal, 5, pairs.limit(0)).count() == 2


def test_excess_returns(spark):
    a, b = day("2021-01-29"), day("2021-02-26")
    rows = spark.createDataFrame([(a, "A", 0.10), (a, "B", 0.0), (a, "C", -0.10), (b, "A", 0.20), (b, "B", 0.10), (b, "C", 0.0)], "date date, ticker string, fwd_ret_raw double")
    found = by(returns.excess(rows, spark.createDataFrame([("A", "Tech"), ("B", "Tech")], "ticker string, sector string")), "date", "ticker", value="excess_median")
    assert found[a, "A"] == pytest.approx(0.10) and found[a, "C"] == pytest.approx(-0.10) and found[b, "A"] == pytest.approx(0.10)
    one = spark.createDataFrame([(a, "A", 0.10), (a, "B", 0.20), (a, "C", 0.05), (a, "D", 0.3)], "date date, ticker string, fwd_ret_raw double")
    sector = spark.createDataFrame([("A", "Tech"), ("B", "Tech"), ("C", "Energy")], "ticker string, sector string")
    found = by(returns.excess(one, sector), "ticker", value="excess_sector")
    assert found["A"] == pytest.approx(-0.05) and found["B"] == pytest.approx(0.05) and found["C"] == 0 and found["D"] is None


def test_two_name_panel(spark):
    days = weekdays("2021-01-04", 40)
    rows = [("A", d, 50 + 10 * k / 39, 50 + 10 * k / 39, 1e6) for k, d in enumerate(days)] + [("B", d, 50.0, 50.0, 10.0) for d in days]
    sector = spark.createDataFrame([("A", "Tech"), ("B", "Tech")], "ticker string, sector string")
    found = crosssec.panel(spark.createDataFrame(rows, PRICES), dates_frame(spark, [days[25]]), calendar_frame(spark, days), sector, 5, 5, 1e6)
    assert [r["ticker"] for r in found.collect()] == ["A"]


def test_normalise(spark):
    a, b = day("2021-01-29"), day("2021-02-26")
    rows = spark.createDataFrame([(d, t, x * k) for d, k in ((a, 1.0), (b, 1000.0)) for t, x in (("A", 0.01), ("B", 0.02), ("C", 0.03))] + [(a, "D", None)], "date date, ticker string, f double")
    found = {(r["date"], r["ticker"]): (r["f_z"], r["f_rank"]) for r in crosssec.normalise(rows, ["f"]).collect()}
    assert found[a, "C"][0] == pytest.approx(found[b, "C"][0]) and found[a, "B"][0] == pytest.approx(0, abs=1e-12)
    assert found[a, "D"] == (None, None) and found[a, "C"][1] == 1


def test_momentum_ignores_the_future_and_needs_history(spark):
    days = weekdays("2019-01-01", 400)
    walk = [100 * 1.001 ** (k + (k * 7919) % 13) for k in range(400)]
    prices = price_frame(spark, {"A": walk}, "2019-01-01")
    keys = spark.createDataFrame([("A", days[300])], "ticker string, date date")
    spiked = prices.withColumns({c: F.when(F.col("date") > days[300], F.col(c) * 10).otherwise(F.col(c)) for c in ("close_raw", "close_adj")})
    assert features.momentum(prices, keys).collect() == features.momentum(spiked, keys).collect()
    short = features.momentum(price_frame(spark, {"A": walk[:100]}, "2019-01-01"), spark.createDataFrame([("A", days[99])], "ticker string, date date")).first()
    assert short["ret_12_1"] is short["vol_12m"] is short["dist_52w_high"] is short["dvol_trend"] is None and short["ret_1m"] is not None


def test_growth_and_guards(spark):
    days = weekdays("2018-06-01", 560)
    facts = spark.createDataFrame([("AAA", "revenue", 100.0, day("2018-12-31"), day("2019-02-15")), ("AAA", "revenue", 120.0, day("2019-12-31"), day("2020-02-14")), ("AAA", "revenue", 150.0, day("2020-06-30"), day("2020-09-01")),
                                   ("AAA", "eps", -2.0, day("2018-12-31"), day("2019-02-15")), ("AAA", "eps", 3.0, day("2019-12-31"), day("2020-02-14"))], "ticker string, tag string, value double, period_end date, filed date")
    keys = spark.createDataFrame([("AAA", day("2020-06-30"))], "ticker string, date date")
    tags = {"rev": "revenue", "eps": "eps", "gp": "revenue", "fcf": "eps", "net_margin": "eps", "gross_margin": "revenue"}
    row = features.growth(facts, keys, calendar_frame(spark, days), tags).first()
    assert row["rev_yoy"] == pytest.approx(0.20) and row["eps_yoy"] is None


def test_restated_dimensions_are_refused(spark):
    wide = spark.createDataFrame([("ACME", "ARQ", day("2021-02-15"), 4.0, 20.0), ("ACME", "ARQ", day("2021-08-01"), 3.1, None), ("ACME", "MRQ", day("2021-02-15"), 3.1, 19.0)], "ticker string, dimension string, filed date, eps double, sps double")
    with pytest.raises(ValueError, match="restated"):
        clean.unpivot_facts(wide, "MRQ", ["eps"], ["ticker", "filed"])
    found = clean.unpivot_facts(wide, "ARQ", ["eps", "sps"], ["ticker", "filed"]).collect()
    assert sorted((r["tag"], r["value"]) for r in found) == [("eps", 3.1), ("eps", 4.0), ("sps", 20.0)]


def test_cap_band_is_point_in_time(spark):
    days = weekdays("2020-06-01", 500)
    rows = [("SML", d, 4.0 if k < 250 else 20.0, 4.0 if k < 250 else 20.0, 1e3 if k < 250 else 2e6) for k, d in enumerate(days)]
    facts = lambda n: spark.createDataFrame([("SML", "shares", n, day("2019-12-31"), day("2020-02-15"))], "ticker string, tag string, value double, period_end date, filed date")
    dates, ref = dates_frame(spark, [day("2021-01-29"), day("2021-11-30")]), spark.createDataFrame([("SML",)], "ticker string")
    none = spark.createDataFrame([], "ticker string, start date, end date")
    args = (ref, none, "shares", 300e6, 5e9, 5.0, 1e6)
    found = crosssec.cap_band_members(spark.createDataFrame(rows, PRICES), facts(50e6), dates, *args)
    assert [r["date"] for r in found.collect()] == [day("2021-11-30")]
    assert crosssec.cap_band_members(spark.createDataFrame(rows, PRICES), facts(2e9), dates, *args).count() == 0
