import math

import duckdb
import pytest

import __spark_entry__
from tracewell.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return repr(round(float(v), 9)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_gives_what_its_sql_gives(spark, views, name):
    got = catalog.QUERIES[name](spark, SF)
    want = views.sql(catalog.SQL[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    order = [want.columns.index(n) for n in names]
    a = sorted(tuple(plain(r[n]) for n in names) for r in got.collect())
    b = sorted(tuple(plain(r[i]) for i in order) for r in want.fetchall())
    assert a == b


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() == 1500 and "status" in df.columns
