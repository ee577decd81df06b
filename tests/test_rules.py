"""Pair rules and groups of registry entries against the scenarios they come from, and against brute force."""

import itertools
import random

from pyspark.sql import functions as F

from meridia.operators import rules as R
from meridia.plans.rule_queries import SQL

SCHEMA = """_id string, status string, name struct<original:string,normalized:string,basename:string,suffix:string>, establishmenttype string,
location struct<district:string,locality:string,postcode:string,address:string>, operator string, capacity struct<rooms:int,beds:int>,
contacts struct<phones:array<string>,emails:array<string>,websites:array<string>,domains:array<string>>, issues array<string>, extra string"""


def entry(i, base="SEA", suffix=None, rooms=1, beds=6, address="12 Main Str", locality="K. Town", district="PAFOS", postcode="8000", operator="Op", phones=("1",), emails=(), sites=(), domains=(), kind="VILLAS", status="ready", issues=()):
    name = base if suffix is None else f"{base} {suffix}"
    return (i, status, (name, name, base, suffix), kind, (district, locality, postcode, address), operator, (rooms, beds), (list(phones), list(emails), list(sites), list(domains)), list(issues), "x")


def facts(spark, rows):
    return R.entry_facts(spark.createDataFrame(rows, SCHEMA))


def test_shadow_aggregate(spark):
    siblings = [entry(f"s{n:02d}", suffix=str(n)) for n in range(2, 14)]
    got = R.shadow_entries(facts(spark, [entry("a", rooms=11, beds=64), *siblings, siblings[0]])).collect()
    assert [(r.id, r.siblings) for r in got] == [("a", 12)]
    for other in (entry("a", rooms=11, beds=64, address="99 Else Road"), entry("a", rooms=11, beds=90), entry("a", rooms=None, beds=64), entry("a", rooms=11, beds=64, phones=["2"], domains=["tsokkos.com"])):
        assert R.shadow_entries(facts(spark, [other, *siblings])).count() == 0
    assert R.shadow_entries(facts(spark, [entry("a", rooms=2, beds=13), *siblings[:2]])).count() == 0
    assert R.shadow_entries(facts(spark, [entry("a", rooms=11, beds=64), *siblings, entry("n", suffix="50", rooms=None)])).count() == 0


def test_numbered_and_artifact_groups(spark):
    rows = [entry("a", suffix="1"), entry("b", suffix="2", address="12 Main Street"), entry("c", suffix="3A", operator="Other"), entry("d", suffix="4", phones=["9"]), entry("e", suffix="5", issues=["bad"]), entry("f", base="LONE", suffix="1")]
    got = {r.id: (r.members, r["first"]) for r in R.numbered_groups(facts(spark, rows)).collect()}
    assert got == {"a": (3, "a"), "b": (3, "a"), "c": (3, "a")}
    rows = [entry("a"), entry("b", suffix="2"), entry("c", suffix="300"), entry("d", base="BAY"), entry("e", base="BAY"), entry("g", base="SUN", address=None, locality=None), entry("h", base="SUN", suffix="7", locality="Else")]
    got = {r.id: r.members for r in R.artifact_groups(facts(spark, rows)).collect()}
    assert got == {"a": 2, "b": 2, "g": 2, "h": 2}
    # neighbours that don't all agree are no group
    rows = [entry("a", suffix="1", phones=["1", "2"]), entry("b", suffix="2", phones=["1"]), entry("c", suffix="3", phones=["2"])]
    assert {r.id for r in R.numbered_groups(facts(spark, rows)).collect()} == {"b", "c"}


def test_same_name_rules(spark):
    rows = [entry("a", kind="HOTEL"), entry("b", kind="APTS"), *[entry(i, base="ONE", rooms=5, beds=b) for i, b in (("c", 10), ("d", 18))], *[entry(i, base="EQ", locality=t, address=None) for i, t in (("e", "Lofou"), ("f", None))], entry("g", base="FAR"), entry("h", base="FAR", postcode="9000"), entry("i", base="NONE", phones=[]), entry("j", base="NONE", phones=[])]
    got = {r.name: (r.multi_type, r.strong_identity, r.collapse) for r in R.same_name_groups(facts(spark, rows)).collect()}
    assert got == {"SEA": (True, False, False), "ONE": (False, False, True), "EQ": (False, True, False), "FAR": (False, False, False), "NONE": (False, False, False)}
    assert R.same_name_groups(facts(spark, rows[:1])).count() == 0


def test_complex(spark):
    rows = [entry(c, base=f"BIG HOUSE {c}") for c in "ABC"] + [entry("x", base="BIG HOUSE AA"), entry("p", base="OLD HOUSE A"), entry("q", base="OLD HOUSE B", issues=["i"])]
    assert [tuple(r) for r in R.complex_groups(facts(spark, rows), ["BIG HOUSE", "OLD HOUSE", "NO HOUSE"]).collect()] == [("BIG HOUSE", 3)]


def test_agreeing_blocks_against_brute(spark):
    rnd = random.Random(1)
    rows = [(f"b{rnd.randrange(14)}", i, ([rnd.choice("xyz") for _ in range(rnd.randrange(3))], rnd.choice(["1", None]) if rnd.random() < 0.9 else "2")) for i in range(44)]
    m = spark.createDataFrame([*rows, ("copies", 90, (["x"], None)), ("copies", 91, (["x"], None)), ("bare", 92, ([], None)), ("bare", 93, ([], None)), (None, 94, (["x"], None)), (None, 95, (["x"], None))], "b string, id int, x struct<a:array<string>,c:string>")
    rule = lambda l, r: F.arrays_overlap(l.a, r.a) & F.coalesce(l.c == r.c, F.lit(True))
    got = {r.b: r.members for r in R.agreeing_blocks(m, "b", rule).collect()}
    wanted = {"copies": 2}
    for b in {r[0] for r in rows}:
        group = [r[2] for r in rows if r[0] == b]
        if len(group) > 1 and all(set(p[0]) & set(q[0]) and (p[1] is None or q[1] is None or p[1] == q[1]) for p, q in itertools.combinations(group, 2)):
            wanted[b] = len(group)
    assert got == wanted


def test_hot_name_is_settled_without_all_pairs(spark):
    many = spark.range(20_000).select(F.lit("hot").alias("b"), "id", F.struct((F.col("id") % 3000).cast("string").alias("v")).alias("x"))
    assert R.agreeing_blocks(many, "b", lambda l, r: l.v == r.v).count() == 0
    assert R.agreeing_blocks(many, "b", lambda l, r: l.v.isNotNull() & r.v.isNotNull()).first().members == 20_000


def test_rules_have_sql():
    assert {"same_name_groups", "numbered_groups", "artifact_groups", "numbered_pairs", "shadow_entries"} == set(SQL)
