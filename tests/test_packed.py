import pytest
from pyspark.sql import functions as F

from meridia.operators.packed import DELIMITERS, OPEN, SHUT, split_packed, unpack

CASES = [
    ("phones", "20 969553 ext. 3", ["20 969553 ext. 3"]),
    ("phones", "20-666934/+35792765049", ["20-666934", "+35792765049"]),
    ("phones", "+357 20 624 228\r\n+357 91 592 132,", ["+357 20 624 228", "+357 91 592 132"]),
    ("phones", '["20-879333", "93-531382"]', ["20-879333", "93-531382"]),
    ("phones", '"21 810381 ext. 50"; "98523972"', ["21 810381 ext. 50", "98523972"]),
    ("phones", "29 1 and 2 ,, 3 & 4", ["29 1", "2", "3", "4"]),
    ("emails", '"Desk, Front" <a@x.y>; b@x.y', ['"Desk, Front" <a@x.y>', "b@x.y"]),
    ("emails", 'a@x.y "Desk, Front" <b@x.y>\tc@x.y', ["a@x.y", '"Desk, Front" <b@x.y>', "c@x.y"]),
    ("emails", 'a@x.y "', ["a@x.y", '"']),
    ("websites", "http://r.example/show?ids=51,64", ["http://r.example/show?ids=51,64"]),
    ("websites", "https://x.e/rooms?a=1;b=6, www.x.e;http://y.e/?q=1&r=2", ["https://x.e/rooms?a=1;b=6", "www.x.e", "http://y.e/?q=1&r=2"]),
    ("websites", '"www.a"|"https://b?a=1;b=3" ; ', ["www.a", "https://b?a=1;b=3"]),
    ("phones", None, []),
    ("phones", " ,; ", []),
    ("phones", "", []),
    ("phones", f"1{OPEN}0{SHUT}, 2", [f"1{OPEN}0{SHUT}", "2"]),
]


@pytest.mark.parametrize("field, text, wanted", CASES)
def test_split(one, field, text, wanted):
    assert one(text, lambda c: split_packed(c, DELIMITERS[field])) == wanted


def test_unpack(spark):
    rows = [(1, ["a@b.c; d@e.f", None, " g@h.i "], "x"), (1, ["a@b.c; d@e.f", None, " g@h.i "], "x"), (2, ["a@b.c"], "x"), (3, None, "x"), (4, [], "x"), (None, ["a@b.c,d@e.f"], "x")]
    df = spark.createDataFrame(rows, "seq int, emails array<string>, pos string")
    got = sorted(map(tuple, unpack(df, "seq", {"emails": F.col("emails")}).collect()), key=str)
    part = [("emails", 1, "a@b.c"), ("emails", 2, "d@e.f"), ("emails", 3, "g@h.i")]
    assert got == sorted([(1, *p) for p in part] * 2 + [(None, "emails", 1, "a@b.c"), (None, "emails", 2, "d@e.f")], key=str)
    assert unpack(df.limit(0), "seq", {"emails": F.col("emails")}).count() == 0
    assert unpack(df, "seq", {"emails": F.col("emails")}, all_rows=True).where("seq = 2").count() == 1
    long = ",".join(f"u{i}@x.y" for i in range(5000))
    assert unpack(spark.createDataFrame([(1, [long])], "seq int, emails array<string>"), "seq", {"emails": F.col("emails")}).count() == 5000
