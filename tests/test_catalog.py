import os

import duckdb
import pytest

from plisse.plans.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    q = duck.execute(ORACLES[name])
    at = [d[0] for d in q.description]
    want = [tuple(r[at.index(n)] for n in names) for r in q.fetchall()]
    assert sorted(at) == names
    assert sorted(map(repr, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(repr, want))
    spark.catalog.clearCache()


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and "bytes_out" in df.columns
    assert set(e.oracle_sql()) <= set(e.queries())
