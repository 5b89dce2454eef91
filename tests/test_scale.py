"""What a task holds doesn't grow with the tables."""

import os
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import expr as X
from tidemark.operators import crosssec
from tidemark.plans import base, catalog
from tidemark.sources import contracts

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@needs_tables
def test_buckets_and_shuffles_grow_with_the_tables(spark, monkeypatch):
    monkeypatch.setattr(base, "ROWS_A_PART", 500)
    base.forget(spark)
    try:
        d = base.Data(spark, SF)
        n = -(-d.table("lineitem").count() // 500)
        assert n > int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert d.facts.columns and d.weekly.columns  # staged
        tables = [base._staged[spark.sparkContext.applicationId, SF, name][1] for name in ("facts", "weekly")]
        buckets = [spark.sql(f"DESCRIBE EXTENDED {t}").where("col_name = 'Num Buckets'").head()["data_type"] for t in tables]
        assert buckets == [str(n)] * 2
        assert spark.conf.get(base.INITIAL_PARTS) == str(n)
    finally:
        base.forget(spark)
        monkeypatch.undo()
        base.Data(spark, SF)
    assert spark.conf.get(base.INITIAL_PARTS) == spark.conf.get("spark.sql.shuffle.partitions")


@needs_tables
@pytest.mark.parametrize("contract", [contracts.prices, contracts.facts])
def test_no_sums_of_a_whole_split(spark, contract):
    """Items are exchanged before they are summed: the first aggregate stands above the exchange."""
    lines = contract(spark, SF, parts=7)._jdf.queryExecution().executedPlan().toString().splitlines()
    assert max(k for k, x in enumerate(lines) if "Aggregate(" in x) < next(k for k, x in enumerate(lines) if "Exchange hashpartitioning(ticker" in x)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@needs_tables
@pytest.mark.parametrize("contract", [contracts.prices, contracts.facts])
def test_items_are_dealt_once_by_ticker(spark, contract):
    """Dealt by ticker alone, items and what is made of them need no second exchange for windows and buckets by it."""
    plan = _plan(contract(spark, SF, parts=7).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("ticker"))))
    assert len(re.findall(r"Exchange hashpartitioning\(ticker#\d+, 7\)", plan)) == plan.count("Exchange hashpartitioning(ticker") == 1


@needs_tables
def test_a_staged_contract_has_a_file_a_bucket(spark):
    base.forget(spark)
    d = base.Data(spark, SF)
    for name, rows in (("weekly", d.weekly), ("facts", d.facts)):
        files = os.listdir(base._staged[spark.sparkContext.applicationId, SF, name][0])
        buckets = [m.group(1) for f in files if (m := re.fullmatch(r"part-.*_(\d{5})\.c000.*\.parquet", f))]
        assert buckets and len(buckets) == len(set(buckets)) <= d.parts
        assert "Exchange" not in _plan(rows.groupBy("ticker").count())


@needs_tables
def test_a_query_of_some_tags_stages_only_their_facts(spark):
    base.forget(spark)
    catalog.QUERIES["W17"](spark, SF)
    names = {name for _, folder, name in base._staged if folder == SF}
    assert "facts_1" in names and "facts" not in names
    d = base.Data(spark, SF)
    alone = d.facts_of("2-HIGH", "1-URGENT")
    assert not d._is_staged("facts")
    every = d.facts.where("tag IN ('1-URGENT', '2-HIGH')")
    assert alone.count() == every.count() > 0 and alone.exceptAll(every).count() == 0
    assert _plan(d.facts_of("1-URGENT")).count("contracts_facts_0") == 0  # read from all facts, once these are there


@needs_tables
@pytest.mark.parametrize("name,scans", [("A5", 1), ("A7", 2), ("A8", 2)])
def test_the_benchmark_is_not_computed_from_the_events(spark, name, scans):
    """Facts are read for the events (and the surprises), not once more for the benchmark's returns at their entries."""
    assert _plan(catalog.QUERIES[name](spark, SF)).count("FileScan parquet spark_catalog.default.contracts_facts") == scans


def test_a_rank_sorts_its_group_once(spark):
    rows = spark.createDataFrame([("a", 2.0), ("a", 1.0), ("a", 2.0), ("a", None), ("b", 0.0), ("b", -0.0), ("b", float("nan"))], "g string, x double")
    ranked = rows.withColumn("rank", X.average_rank(F.col("x"), "g"))
    assert sorted((r["g"], r["rank"]) for r in ranked.where("x IS NOT NULL").collect()) == [("a", 1.0), ("a", 2.5), ("a", 2.5), ("b", 1.5), ("b", 1.5), ("b", 3.0)]
    assert ranked.where("x IS NULL").head()["rank"] is None
    assert ranked._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1


@pytest.mark.parametrize("n", [1, 7, 101, 1_999, 2_000, 2_001, 30_000])
def test_tail_quantiles_are_exact(spark, n):
    """Those of Spark's exact aggregate, with ties at the limits, one value only, and nulls."""
    x = F.xxhash64("id") / 1e15
    rows = spark.range(3 * n, numPartitions=5).select(
        (F.col("id") % 3).alias("date"), x.alias("a"), F.floor(x / 2000).cast("double").alias("b"), F.lit(4.0).alias("c"), F.when(F.col("id") % 4 > 0, x).alias("d"), F.when(F.col("id") % 3 > 0, x).alias("e")
    )
    names = list("abcde")
    found = {r["date"]: r for r in crosssec.tail_quantiles(rows, names).collect()}
    want = rows.groupBy("date").agg(*(F.percentile(f, F.lit(q)).alias(f"{f}_{side}") for f in names for side, q in (("low", 0.01), ("high", 0.99)))).collect()
    for r in want:
        for f in names:
            for c in (f"{f}_low", f"{f}_high"):
                assert found[r["date"]][c] == (None if r[c] is None else pytest.approx(r[c], rel=1e-12, abs=1e-12)), (c, r["date"])


@needs_tables
def test_the_matrix_holds_no_values_of_a_date_for_its_scores(spark):
    """No window and no exact quantile stands above the stored raw features."""
    plan = catalog.QUERIES["J2_matrix"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(date" not in plan and "percentile" not in plan
