"""Every registered query against the SQL that gives the same rows, run by DuckDB on the same tables."""

import glob
import os

import duckdb
import numpy as np
import pytest

from quakelode.plans import queries as registry


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def normal(p):
    p = p[sorted(p.columns)].copy()
    for c in p.columns:
        p[c] = p[c].map(lambda x: "null" if x is None or x != x else str(x)) if p[c].dtype == object else p[c].astype(float)
    return p.sort_values(list(p.columns)).reset_index(drop=True)


SLOW = {"m1_m17_model_scorecard", "m1_m3_m18_grid_forecast", "m8_sweep", "w7_best_settings", "e5_amplitude_fit", "s8_fit_report"}


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - SLOW))
def test_query_equals_sql(spark, sf, db, name):
    got = registry.queries()[name](spark, sf).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got) and not got.isna().all().any()
        return
    a, b = normal(got), normal(db.sql(sql).df())
    assert list(a.columns) == list(b.columns) and len(a) == len(b) and len(a)
    for c in a.columns:
        assert (a[c] == b[c]).all() if a[c].dtype == object else np.array_equal(a[c], b[c], equal_nan=True), c
