import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from meridia.operators.snapshots import diff_bucket, file_date, json_value, snapshot_changes

ROWS, SNAPS = "series string, snapshot_id string, record_key string, content string, extra int", "series string, snapshot_id string, rank_by timestamp"


def brute(rows, snaps):
    out = set()
    for s in {x[0] for x in snaps if x[0]}:
        order = [i for _, i in sorted({(t, i) for a, i, t in snaps if a == s and i})]
        held = [{} for _ in order]
        for a, i, k, c, *_ in rows:
            if a == s and i in order and k is not None:
                held[order.index(i)].setdefault(k, set()).add(c)
        for i, (p, q) in enumerate(zip(held, held[1:]), 1):
            out |= {(s, order[i], k, "added" if k not in p else "removed" if k not in q else "changed") for k in p.keys() | q.keys() if p.get(k) != q.get(k)}
    return out


def run(spark, rows, snaps, buckets=8):
    got = snapshot_changes(spark.createDataFrame(rows, ROWS), spark.createDataFrame(snaps, SNAPS), buckets)
    return {tuple(r) for r in got.select("series", "snapshot_id", "record_key", "change_kind").collect()}


def test_against_brute(spark):
    rnd = random.Random(3)
    ts = [pd.Timestamp(2024, 1, d).to_pydatetime() for d in range(1, 6)]
    snaps = [(s, f"{s}{i}", ts[i]) for s in "ab" for i in range(5)] + [("a", "a0", ts[0])]
    rows = [(s, f"{s}{i}", f"k{rnd.randrange(30)}", rnd.choice(["x", "y", "z", None]), 1) for s in "ab" for i in (0, 1, 2, 4) for _ in range(40)]
    rows += rows[:10] + [("a", "a1", None, "x", 1), ("a", "zz", "k", "x", 1), (None, "a1", "k", "x", 1)]
    assert run(spark, rows, snaps) == brute(rows, snaps)
    # one key with a third of all rows, and one bucket
    assert run(spark, rows + [("a", "a2", "hot", str(i), 1) for i in range(300)], snaps, 1) == brute(rows + [("a", "a2", "hot", str(i), 1) for i in range(300)], snaps)


def test_empty(spark):
    assert run(spark, [], []) == set()
    assert run(spark, [], [("a", "x", pd.Timestamp(2024, 1, 1).to_pydatetime())]) == set()


def test_bucket_alone():
    df = pd.DataFrame({"series": [1, 1, 1], "ord": [0, 0, 2], "last": [3, 3, 3], "kh": [5, 6, 5], "rh": [1, 1, 2]}).astype(np.int64)
    got = set(map(tuple, diff_bucket(df)[["ord", "kh", "kind"]].itertuples(index=False)))
    assert got == {(1, 5, "removed"), (1, 6, "removed"), (2, 5, "added"), (3, 5, "removed")}


def test_json_values(one):
    same = ['{"a": 1.50, "b": "\\u00e9"}', '{"b":"é","a":1.5}']
    assert len({one(s, json_value) for s in same}) == 1
    assert one('{"a": "1"}', json_value) != one('{"a": 1}', json_value)
    assert one(None, json_value) is None and one("{", json_value) == "malformed:{"


def test_file_dates(one):
    assert str(one("a_03.6.2024-final.pdf", file_date)) == "2024-06-03" and one("a_41.6.2024.pdf", file_date) is None and one(None, file_date) is None


def test_written(spark):
    from meridia.operators.snapshots import written

    df = spark.createDataFrame([("a", None), (None, "a"), ("", "a")], "x string, y string").select(written(F.col("x"), F.col("y")).alias("w"))
    assert df.distinct().count() == 3
