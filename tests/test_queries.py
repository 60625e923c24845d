"""Every registered query of the library against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from haggle import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def shown(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, (bool, str)):
        return str(v)
    if hasattr(v, "tolist") and getattr(v, "ndim", 0):
        return str(v.tolist())
    if isinstance(v, (int, float)) or hasattr(v, "item"):
        return repr(round(float(v), 6) + 0.0)
    return str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(map(shown, r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(con.sql(queries.ORACLE_SQL[name]).df())


def test_filters_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        plan = queries.QUERIES["valid_products"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = " ".join(line for line in plan.splitlines() if "lineitem" in line)
    assert "GreaterThanOrEqual(l_extendedprice,0.0)" in pushed and "LessThanOrEqual(l_extendedprice,20000.0)" in pushed
    assert "l_discount" not in pushed and "p_retailprice" not in plan


def test_a_limit_by_row_gathers_no_products_in_one_task(spark):
    """What a request's last ranking reads has been limited in parts before it."""
    plan = queries.QUERIES["crawl_topk"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    last = plan.index("Exchange hashpartitioning(request_id")
    ranked, limited = plan[:last], plan[last:].split("Exchange hashpartitioning(", 2)
    assert "Window [row_number() windowspecdefinition(request_id" in ranked and "_deal" not in ranked
    # Between the last exchange and the one before it, only what a part lets through is kept.
    assert "Filter" in limited[1] and "_rank" in limited[1] and "<= limit" in limited[1]
    assert "Window [row_number() windowspecdefinition(request_id" in limited[1] and "_deal" in limited[1]
    assert limited[2].split(",")[1].strip().startswith("_deal")


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
