import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as contract
from check import TABLES, compare

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", contract.queries())
def test_query_equals_its_sql(spark, duck, name):
    sql = contract.oracle_sql().get(name)
    _, rows, verdict = compare(spark, duck, SF_DIR, name, contract.queries()[name], sql)
    assert verdict == ("same" if sql else "rows only") and rows > 0


def test_entry(spark):
    assert contract.entry(spark).columns == ["doc", "part_no", "part_count", "content", "page_count"]
