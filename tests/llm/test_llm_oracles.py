import glob
import os

import duckdb
import pytest

from quakelode.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = queries.queries()[name](spark, sf)
    rows = sorted(map(repr, (tuple(r) for r in got.select(*sorted(got.columns)).collect())))
    sql = con.sql(queries.oracle_sql()[name])
    want = sorted(map(repr, con.sql(f"select {', '.join(sorted(got.columns))} from sql").fetchall()))
    assert rows == want
