"""Every keypoint query with SQL gives the same rows in DuckDB, on the smallest tables; those that work by blocks of frames also where clips have several."""

import os

import duckdb
import pandas as pd
import pytest

from kinefold.plans.queries import ORACLE_SQL, QUERIES

DATA, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
BY_BLOCKS = ["dn1_densify", "src10_explode_pose_array", "src10_explode_visibility", "tk1_nms", "ag1_error_and_coverage"]


def tables(folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{folder}/{name}'")
    return con


@pytest.fixture(scope="module")
def duck():
    return tables(DATA)


def plain(value):
    if hasattr(value, "item"):
        value = value.item()
    return None if pd.api.types.is_scalar(value) and pd.isna(value) else value


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(([plain(v) for v in r] for r in frame.astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    compare(spark, duck, name, DATA)


@pytest.mark.parametrize("name", BY_BLOCKS)
def test_same_rows_of_several_blocks(spark, name):
    compare(spark, tables(LARGER), name, LARGER)


def compare(spark, duck, name, folder):
    got, want = QUERIES[name](spark, folder).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for u, v in zip(x, y, strict=True):
            assert u == v or (isinstance(u, float) and isinstance(v, float) and abs(u - v) < 2e-6 * max(1, abs(u)))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).limit(5).count() > 0


def test_native_plans_hold_no_python(spark):
    for name in ("ag1_error_and_coverage", "tk1_nms", "jn5_certified", "tr2_pool_weights", "wn4_eval_windows"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan
