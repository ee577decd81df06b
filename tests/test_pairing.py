import random

from pyspark.sql import functions as F

from meridia.operators import matching as M
from meridia.operators.merge import hash_diff
from meridia.operators.pairing import blocked_join


def test_blocked_join_makes_each_pair_once(spark):
    l = spark.createDataFrame([("hot", i) for i in range(37)] + [("cold", 99), (None, 1), ("left", 3)], "k string, a int")  # noqa: E741
    r = spark.createDataFrame([("hot", i) for i in range(23)] + [("cold", 7), (None, 1), ("right", 3)], "k string, b int")
    got = blocked_join(l, r, ["k"], 5).collect()
    assert sorted((x.k, x.a, x.b) for x in got) == sorted([("hot", i, j) for i in range(37) for j in range(23)] + [("cold", 99, 7)])
    assert blocked_join(l.limit(0), r, ["k"], 5).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def test_name_keys_lose_no_like_name():
    rnd = random.Random(4)
    words = ["ROYAL", "BAY", "MARINA", "X", "AB", "GOLDEN", "SUN", "KALAMAKI", "7", "PANORAMIC"]
    names = [" ".join(rnd.sample(words, rnd.randrange(1, 8))) for _ in range(150)]
    for n in list(names):
        t = list(n)
        for _ in range(rnd.randrange(1, 7)):
            i = rnd.randrange(len(t) + 1)
            t[i : i + rnd.randrange(2)] = rnd.choice(["", "Q", "A", "7"])
        names.append(" ".join("".join(t).split()))
    names = sorted({n for n in names if n})
    for least in (M.VERY_STRONG, M.FUZZY):
        held = {n: set(M.held_keys([n], least)) for n in names}
        asked = {n: set(M.asked_keys([n], least)) for n in names}
        like = 0
        for a in names:
            for b in names:
                wa, wb = set(a.split()), set(b.split())
                if 1 - edits(a, b) / max(len(a), len(b)) >= least or len(wa & wb) / min(len(wa), len(wb)) >= least:
                    like += 1
                    assert asked[a] & held[b], (a, b, least)
        assert like > len(names)


def test_containing(spark):
    texts = ["A", "AB", "XABY", "12 MAIN STREET", "MAIN", "IN ST", None, "", "ZZZ"]
    df = spark.createDataFrame([(t,) for t in texts], "a string")
    got = {(r.a, r.b) for r in M.containing(df, df.withColumnRenamed("a", "b")).collect()}
    some = [t for t in texts if t]
    assert got == {(x, y) for x in some for y in some if x in y or y in x}


def test_crowded_contact_is_narrowed_and_loses_nothing(spark):
    side = "raw_names array<string>, reduced_names array<string>, contacts array<string>, shared_contacts array<string>, postcode string, street string, city string"
    rnd = random.Random(1)
    name = lambda: " ".join(rnd.sample(["ALPHA", "BETA", "GAMMA", "DELTA", "SUN", "SEA", "SEAS", "BETTA"], rnd.randrange(1, 4)))
    rows = lambda tag: [(f"{tag}{i}", [n := name()], [n], ["p:1"] if i % 3 else None, ["d:g"], "1", "OLD MAIN" if i % 2 else "MAIN", None) for i in range(40)]
    h = spark.createDataFrame(rows("h"), "hid string, " + side)
    c = spark.createDataFrame(rows("c"), "cid string, " + side).withColumn("richness", F.lit(0))
    assert sorted(M.proposals(c, h, 0).collect()) == sorted(M.proposals(c, h, 1_000).collect())


def test_null_is_no_text_in_hashes(spark):
    df = lambda rows: spark.createDataFrame(rows, "k int, a string, b string")
    got = hash_diff(df([(1, None, "x"), (2, None, "x"), (3, None, "x")]), df([(1, "null", "x"), (2, "x", None), (3, None, "x")]), ["k"], ["a", "b"])
    assert {r.k: r.action for r in got.collect()} == {1: "UPDATED", 2: "UPDATED", 3: "UNCHANGED"}
