"""Every query runs on the smallest tables; those with SQL agree with DuckDB."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from folioframe.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def _key(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 6)
    return v.item() if hasattr(v, "item") and getattr(v, "ndim", 0) == 0 else v


def rows(pdf, cols):
    return sorted(str(tuple(_key(v) for v in r)) for r in pdf[cols].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    got = QUERIES[name](spark, data).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        assert rows(got, cols) == rows(want, cols)


def test_entry(spark, data):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "status" in df.columns


def test_spatial_joins_are_no_nested_loops(spark, data):
    for name in ("glyph_owner_argmin", "region_evidence", "orphan_inline", "proposal_iou_best"):
        plan = QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_scan_is_pruned(spark, data):
    plan = QUERIES["visible_filter"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "mapped_text" not in plan.split("ReadSchema")[1]
