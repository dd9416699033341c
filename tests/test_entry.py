import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    found = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        found.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return found


@pytest.mark.parametrize("name", sorted(entry.QUERIES))
def test_query_equals_its_sql(spark, connection, name):
    outcome, _ = check.compare(spark, connection, name, SF)
    assert outcome.startswith("ok")


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(entry.QUERIES) == set(entry.ORACLES)
