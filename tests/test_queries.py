"""Each query with SQL gives the SQL's rows on the smallest delivered tables."""

import glob
import os
from collections import Counter

import pytest

from meridia.plans import registry

DATA = os.environ.get("MERIDIA_TEST_DATA", "/root/testdata/sf0.001")
SQL = registry.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return round(v, 5)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no delivered tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = registry.queries()[name](spark, DATA)
    got = c.execute(SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    wanted = Counter(repr(tuple(plain(v) for v in r)) for r in got.fetchall())
    assert Counter(repr(tuple(plain(r[n]) for n in names)) for r in df.collect()) == wanted
