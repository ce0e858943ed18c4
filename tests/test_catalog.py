"""Every catalogue query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from dagloom.plans import catalog, oracle

DATA = os.environ.get("DAGLOOM_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def norm(rows):
    return sorted(tuple("\0" if v is None else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    r = duck.sql(oracle.SQL[name])
    assert sorted(r.columns) == cols
    got, want = df.select(*cols).collect(), r.select(",".join(f'"{c}"' for c in cols)).fetchall()
    assert norm([tuple(x) for x in got]) == norm(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(oracle.SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).count() >= 0


def test_entry_point(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
