"""Values worked out by hand from the published definitions, not from the queries' SQL."""

from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.frames import day
from tidemark.functions import clean
from tidemark.operators import crosssec, evalstats, events, features, segments

DAY = day("2021-06-30")
FACTS = "ticker string, tag string, value double, period_end date, filed date"


def facts(spark, rows):
    return spark.createDataFrame([(t, tag, float(v), day("2021-03-31"), day("2021-05-01")) for t, tag, v in rows], FACTS)


def names(spark, prices):
    table = spark.createDataFrame([(DAY, t, float(p), float(p), 1.0) for t, p in prices.items()], "date date, ticker string, close_raw double, close_adj double, volume double")
    return table, table.select("date", "ticker")


def test_enterprise_value_needs_debt_and_cash(spark):
    prices, keys = names(spark, {"A": 10, "B": 10, "C": 10})
    rows = [(t, tag, v) for t in "ABC" for tag, v in (("eps", 2), ("sps", 5), ("bvps", 4), ("shares", 3), ("ebitda", 8))]
    rows += [("A", "debt", 20), ("A", "cash", 6), ("B", "debt", 20), ("C", "cash", 6)]
    tags = {n: n for n in ("eps", "sps", "bvps", "shares", "debt", "cash", "ebitda")}
    sector = spark.createDataFrame([(t, "S") for t in "ABC"], "ticker string, sector string")
    found = {r["ticker"]: r for r in features.valuation(prices, facts(spark, rows), keys, sector, tags).collect()}
    assert found["A"]["ev_ebitda"] == pytest.approx((10 * 3 + 20 - 6) / 8) and found["B"]["ev_ebitda"] is None and found["C"]["ev_ebitda"] is None
    assert found["B"]["earnings_yield"] == pytest.approx(0.2) and found["A"]["ev_ebitda_sectrel"] == 0


def test_quality_levels_and_those_relative_to_the_sector(spark):
    prices, keys = names(spark, {"A": 10, "B": 20})
    base = {"roe": 0.2, "roic": 0.1, "roa": 0.05, "gross_margin": 0.4, "opinc": 30, "revenue": 100, "net_margin": 0.1, "de": 1.5, "current_ratio": 2, "ebit": 20, "intexp": 5, "fcfps": 1, "fcf": 25, "equity": 50, "ebitda_margin": 0.3}
    other = base | {"roe": 0.4, "fcfps": 4, "fcf": 45, "ebitda_margin": 0.5, "current_ratio": 4}
    rows = [("A", k, v) for k, v in base.items()] + [("B", k, v) for k, v in other.items()]
    sector = spark.createDataFrame([("A", "S"), ("B", "S")], "ticker string, sector string")
    table = features.quality(prices, facts(spark, rows), keys, sector, {k: k for k in base})
    assert {c for c in table.columns if c.endswith("_sectrel")} == {f"{c}_sectrel" for c in ("roe", "roic", "roa", "gross_margin", "op_margin", "net_margin", "debt_to_equity", "fcf_yield", "fcf_margin")}
    a = table.where("ticker = 'A'").first()
    want = {"op_margin": 0.3, "interest_coverage": 4, "fcf_yield": 0.1, "fcf_margin": 0.25, "roe_sectrel": -0.1, "fcf_yield_sectrel": -0.05, "fcf_margin_sectrel": -0.1, "op_margin_sectrel": 0}
    assert {k: a[k] for k in want} == pytest.approx(want)


def test_owner_classes(spark):
    given = {"SP": "spouse", "his Spouse": "spouse", "DC": "dependent", "Depend.": "dependent", "child": "dependent", "JT": "joint", "Joint acct": "joint", None: "self", "": "self", "--": "self", "Self": "self", "x": "self"}
    found = spark.createDataFrame([(k,) for k in given], "o string").select("o", clean.owner_class(F.col("o")).alias("c")).collect()
    assert {r["o"]: r["c"] for r in found} == given


def test_each_reason_to_drop_counts_on_its_own(spark):
    rows = [(" aa ", "2021-01-01", "2021-01-05"), ("AA", "n/a", "2021-01-05"), ("--", "n/a", "2021-01-05"), (None, "2021-01-01", "2021-01-02"), ("ZZ", None, "2021-01-02"), ("ZZ", "2021-01-01", "2021-01-02"), ("AA", "2021-01-05", "2021-01-01"), ("AA", "2018-01-01", "2021-01-01"), ("b.b", "2021-01-01", "2021-01-01")]
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "seq int, ticker string, transaction_date string, filing_date string")
    kept, counts = clean.clean_disclosures(table, spark.createDataFrame([("aa",), ("AA",), ("B-B",)], "ticker string"))
    assert counts.first().asDict() == {"n_in": 9, "no_date": 3, "no_symbol": 2, "not_common": 2, "bad_lag": 2, "n_out": 2}
    assert sorted((r["seq"], r["ticker"]) for r in kept.collect()) == [(0, "AA"), (8, "B-B")] and kept.columns == table.columns


def test_persistence_counts_rows_without_return_in_the_total_only(spark):
    def rows(member, first, second, missing, other):
        return [(member, 1, 1.0)] * first + [(member, 2, 2.0)] * second + [(member, 1, None)] * missing + [(member, 3, 5.0)] * other

    given = rows("in", 10, 10, 5, 0) + rows("in too", 10, 10, 0, 5) + rows("short", 10, 10, 4, 0) + rows("lacks returns", 9, 10, 6, 0)
    table = spark.createDataFrame(given, "member string, p int, ret double")
    found = evalstats.persistence(table, F.col("p") == 1, F.col("p") == 2)
    assert sorted(tuple(r) for r in found.select("member", "n", "n1", "n2", "p1", "p2").collect()) == [("in", 25, 10, 10, 1.0, 2.0), ("in too", 25, 10, 10, 1.0, 2.0)]


def test_four_members_have_no_rank_correlation(spark):
    members = lambda n: spark.createDataFrame([(f"m{k}", float(k), float(k * k % 7)) for k in range(n)], "member string, p1 double, p2 double")
    few, enough = (evalstats.persistence_summary(members(n)).first() for n in (4, 5))
    assert few["n"] == 4 and all(few[c] is None for c in few.asDict() if c != "n") and enough["rho"] is not None


def test_a_missing_sector_has_a_code_of_its_own(spark):
    keys = spark.createDataFrame([(t,) for t in "ABCDE"], "ticker string")
    sector = spark.createDataFrame([("A", "Tech"), ("B", ""), ("C", None), ("D", "Zinc"), ("X", "Airlines")], "ticker string, sector string")
    found = {r["ticker"]: (r["sector"], r["sector_id"]) for r in crosssec.sector_codes(keys, sector).collect()}
    assert found == {"A": ("Tech", 0), "B": ("Unknown", 1), "C": ("Unknown", 1), "E": ("Unknown", 1), "D": ("Zinc", 2)}


def test_segmented_scans_equal_plain_ones(spark):
    rng = np.random.default_rng(3)
    rows = [([None, "a", "b"][rng.choice(3, p=[0.2, 0.6, 0.2])], int(rng.integers(0, 12)), k, None if rng.random() < 0.7 else int(rng.integers(0, 2))) for k in range(400)]
    table = spark.createDataFrame(rows, "k string, day int, seq int, v int").repartition(5)
    last = {r["seq"]: r["x"] for r in segments.last_before(table, ["k"], "day", ["seq"], F.col("v"), "x").collect()}
    total = {r["seq"]: r["x"] for r in segments.sum_before(table, ["k"], "day", ["seq"], F.coalesce("v", F.lit(1)), "x").collect()}
    for k, d, seq, _ in rows:
        before = sorted((r for r in rows if r[0] == k and (r[1], r[2]) < (d, seq)), key=lambda r: r[1:3])
        assert last[seq] == next((r[3] for r in reversed(before) if r[3] is not None), None)
        assert total[seq] == sum(1 if r[3] is None else r[3] for r in before)


def test_events_of_a_hot_ticker_equal_the_plain_scan(spark):
    rng = np.random.default_rng(9)
    rows = [(k, "T" if rng.random() < 0.7 else None, f"m{rng.integers(0, 6)}", day("2021-01-01") + timedelta(int(rng.integers(0, 60))), float(rng.integers(1, 9)), bool(rng.random() < 0.1)) for k in range(300)]
    table = spark.createDataFrame(rows, "seq long, ticker string, member string, filing_date date, value double, officer boolean").repartition(4)
    counted = events.distinct_actors(table, 4, flag="officer")
    value = {r["seq"]: r["any_officer"] for r in events.value_clusters(counted, 3, 20.0).collect()}
    plain = {r["seq"] for r in events.clusters(counted, 3).where("is_event").collect()}
    want_value, want_plain = {}, set()
    for ticker in ("T", None):
        fired, was = False, 0
        own = sorted((r for r in rows if r[1] == ticker), key=lambda r: (r[3], r[0]))
        for at, r in enumerate(own):
            near = [o for o in own[: at + 1] if (r[3] - o[3]).days <= 4]
            n, worth = len({o[2] for o in near}), sum(o[4] for o in near)
            if n >= 3 and worth >= 20 and not fired:
                want_value[r[0]], fired = any(o[5] for o in near), True
            elif n < 3:
                fired = False
            if n >= 3 and was < 3:
                want_plain.add(r[0])
            was = n
    assert value == want_value and plain == want_plain
