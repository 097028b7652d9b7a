import duckdb
import pytest

import __spark_entry__ as entry
from checks import changelog, exports, filesync, slowlog
from checks.compare import TABLES, normal

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


OWN = [name for family in (slowlog, changelog, filesync, exports) for name in family.QUERIES]


@pytest.mark.parametrize("name", OWN)
def test_query_like_sql(spark, con, name):
    got = entry.queries()[name](spark, SF_DIR).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = con.execute(sql).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 20 and "query_time" in df.columns


def test_every_query_has_sql():
    assert set(OWN) <= set(entry.oracle_sql())
