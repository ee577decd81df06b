import os

import pytest
from pyspark.sql import functions as F

from meridia.operators import infile as I

BASE = {"filename": "f", "hotel": "H", "name": "H", "address": None, "locality": "L", "region": "R", "postcode": "1", "establishmenttype": "t", "operatorname": "o", "classraw": None, "managername": None, "rooms": 1, "beds": 2, "phones": ["1"], "faxes": [], "emails": [], "websites": [], "domain": None, "shared_domain": False, "strict_key": "s", "reversed_key": None, "merge_key": "m"}


def rows(*changes):
    return [BASE | {"seq": i} | c for i, c in enumerate(changes)]


def test_complementary_address():
    got = I.resolve(rows({}, {"address": "A 1", "rooms": 5, "strict_key": "x"}))
    assert [(g["seq"], g["address"], g["rooms"], g["merged"]) for g in got] == [(0, "A 1", 5, 2)]
    got = I.resolve(rows({"address": "A 1"}, {"address": None, "rooms": 5, "strict_key": "x"}))
    assert [(g["address"], g["rooms"]) for g in got] == [("A 1", 5)]
    assert len(I.resolve(rows({"address": "A 1"}, {"address": "B 2", "strict_key": "x"}))) == 2


def test_strong_duplicate():
    got = I.resolve(rows({"address": "A", "emails": ["e", "f"], "strict_key": "x", "merge_key": "a"}, {"address": "A", "emails": ["g", "e"], "locality": "R", "strict_key": "y", "merge_key": "b"}))
    assert [(g["locality"], g["emails"]) for g in got] == [("R", ["g", "e", "f"])]
    assert len(I.resolve(rows({"address": "A", "domain": "d", "strict_key": "x"}, {"address": "A", "domain": "d", "shared_domain": True, "strict_key": "y"}))) == 2


def test_reversed_and_strict():
    got = I.resolve(rows({"address": "A", "strict_key": "2|1"}, {"address": "A", "strict_key": "1|2", "reversed_key": "2|1"}, {"address": "A", "strict_key": "1|2", "name": "new"}))
    assert [(g["seq"], g["name"], g["merged"]) for g in got] == [(1, "new", 2)]


DATA = os.environ.get("MERIDIA_TEST_DATA", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no delivered tables")
def test_blocks_equal_whole_files(spark):
    raw = spark.read.parquet(f"{DATA}/raw_hotels.parquet")
    got = {tuple(r) for r in I.resolve_in_file(raw).select("filename", "seq", "merged", "address", "strict_key").collect()}
    wanted = set()
    for f in [r.f for r in raw.select(F.col("sourcefile.filename").alias("f")).distinct().collect()]:
        by_name = [r.asDict() for r in I.prepared(raw.where(F.col("sourcefile.filename") == f)).orderBy("seq").collect()]
        # one fold over the file, in which rows of other names must not meet
        for h in {r["hotel"] for r in by_name}:
            wanted |= {(f, g["seq"], g["merged"], g["address"], g["strict_key"]) for g in I.resolve([r for r in by_name if r["hotel"] == h])}
    assert got == wanted and len(got) < raw.count()
