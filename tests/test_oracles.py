"""Every registered query against its SQL, on the smallest driver tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracles import TABLES, compare
from rowrelay.plans.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    line = compare(spark, duck, name, QUERIES[name], ORACLES.get(name), SF_DIR)
    assert line.startswith("ok" if name in ORACLES else "ROWS"), line


def test_entry(spark):
    assert entry.entry(spark).columns == ["batch_index", "global_step", "global_index", "n_chars", "quality", "text"]
