"""Every query that has SQL gives what DuckDB gives on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as E
from leafwork import plans
from verify import rows_of

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(plans.all_sql()))
def test_same_as_sql(spark, db, name):
    df = plans.all_queries()[name](spark, SF)
    cur = db.execute(plans.all_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cur.fetchall())


def test_registered():
    assert set(E.oracle_sql()) <= set(E.queries()) and set(plans.all_queries()) <= set(E.queries())
