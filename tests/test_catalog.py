"""The registered queries against their SQL in DuckDB, on the smallest tables."""

import math
import os
import pathlib

import duckdb
import pytest

import __spark_entry__
from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"
#: A quick one of each kind; TIDEMARK_ALL=1 takes every query.
QUICK = ("S5", "S17", "P2", "P11", "J4", "J8_log", "J11", "J12", "R1", "R8", "R11", "W1", "W8", "W15", "W16", "A1", "A3", "A22", "B4", "F1", "M1", "L2", "U5", "C1", "R4", "J21", "A4_costs", "A20_summary", "A28", "S13", "S14", "J2_matrix", "M5_folds")
NO_SQL = {"M4"}
NAMES = sorted(catalog.QUERIES) if os.environ.get("TIDEMARK_ALL") else QUICK


def norm(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if hasattr(x, "date") and callable(x.date):
        x = x.date()
    return round(float(x), 5) if isinstance(x, (int, float)) and not isinstance(x, bool) else x if isinstance(x, bool) else str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", [n for n in NAMES if n not in NO_SQL])
def test_query_equals_its_sql(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    cursor = duck.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    key = lambda row: tuple(str(x) for x in row)
    want = sorted((tuple(norm(row[k]) for k in order) for row in cursor.fetchall()), key=key)
    got = sorted((tuple(norm(row[c]) for c in columns) for row in found.collect()), key=key)
    assert got == want


def test_every_query_has_sql_or_a_reason():
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == NO_SQL
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns[:2] == ["date", "ticker"]


def test_nothing_else_imports_the_training_data_package():
    root = pathlib.Path(catalog.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert ".llm" not in p.read_text() and "import llm" not in p.read_text(), p


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_plans_over_bucketed_contracts(spark):
    """Nothing is exchanged by ticker for the matrix, and no dates meet intervals in a cartesian product, with hardly a side small enough to broadcast by size."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")
    try:
        plans = {n: catalog.QUERIES[n](spark, SF)._jdf.queryExecution().executedPlan().toString() for n in ("J2_matrix", "M1", "R1", "R10", "J8_log", "J10")}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert not any("CartesianProduct" in p for p in plans.values())
    assert "Exchange hashpartitioning(ticker" not in plans["J2_matrix"] and plans["J2_matrix"].count("Exchange hashpartitioning(date") == 1
    assert plans["M1"].count("Exchange ") < 30
