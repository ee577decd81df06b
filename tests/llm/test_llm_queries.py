import glob
import os
from collections import Counter

import pytest

from meridia.llm import registry

DATA = os.environ.get("MERIDIA_TEST_DATA", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no delivered tables")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_runs(spark, name):
    df = registry.queries()[name](spark, DATA)
    rows = df.collect()
    assert df.columns
    if name.endswith("_found"):
        assert max(Counter(rows).values(), default=1) == 1
    if sql := registry.oracle_sql().get(name):
        duckdb = pytest.importorskip("duckdb")
        c = duckdb.connect()
        for p in glob.glob(f"{DATA}/*.parquet"):
            c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
        got = c.execute(sql)
        names = [d[0] for d in got.description]
        assert Counter(tuple(str(r[n]) for n in names) for r in rows) == Counter(tuple(map(str, r)) for r in got.fetchall())
