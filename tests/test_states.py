"""Guarded matches, states, runs, lookups and releases."""

import pytest
from pyspark.sql import functions as F

from meridia.functions import text as T
from meridia.operators import apply as A
from meridia.operators import dedupe, facets, geo
from meridia.operators import states as S
from meridia.sources import files



@pytest.fixture
def now(spark):
    return F.to_timestamp(F.lit("2026-01-02 03:04:05"))


def test_guards(spark, now):
    c = spark.createDataFrame([("free", None, "UNMATCHED"), ("elsewhere", "h9", "AUTO_MATCHED"), ("done", "h3", "AUTO_MATCHED"), ("late", None, "UNMATCHED"), ("held", "h4", "CONFIRMED"), ("rejected", "h7", "REJECTED"), ("r", None, "UNMATCHED"), ("foreign", None, "UNMATCHED")], "cid string, canonicalhotelid string, matchstatus string")
    h = spark.createDataFrame([("h1", None), ("h3", "hotel_geo_candidate:done"), ("h4", None), ("h5", "manual"), ("h7", None), ("h9", None)], "hid string, geo_source string")
    w = spark.createDataFrame([("free", "h1"), ("elsewhere", "h1x"), ("done", "h3"), ("late", "h4"), ("foreign", "h5"), ("r", "h7"), ("unknown", "h9"), ("held", "gone")], "cid string, hid string")
    got = {r.cid: r.action for r in A.apply_matches(w, c, h).collect()}
    assert got == {"free": A.AUTO, "elsewhere": A.CONFLICT, "done": A.ALREADY, "late": A.CONFLICT, "foreign": A.CONFLICT, "r": A.AUTO, "unknown": A.CONFLICT, "held": A.CONFLICT}
    assert {r.cid: r.action for r in A.apply_matches(w, c, h, True).collect()}["done"] == A.MANUAL
    full = c.withColumn("matchreasons", F.array().cast("array<string>")).withColumn("updatedat", F.lit(None).cast("timestamp"))
    after = {r.cid: r for r in A.bound_candidates(full, A.apply_matches(w, c, h).withColumn("s", F.lit(92)), A.match_reasons(F.lit("R"), F.col("s")), now).collect()}
    assert after["free"].canonicalhotelid == "h1" and after["free"].matchreasons == ["AUTO_MATCH", "R", "SCORE:92"] and after["late"].canonicalhotelid is None and after["done"].updatedat is None
    points = spark.createDataFrame([("free", 33.0, 35.0), ("done", 34.0, 36.0)], "cid string, lng double, lat double")
    hotels = h.select("hid", F.lit(None).cast("double").alias("lng"), F.lit(None).cast("double").alias("lat"), "geo_source", F.lit(None).cast("timestamp").alias("updatedat"))
    placed = {r.hid: (r.lng, r.geo_source) for r in A.placed_hotels(hotels, A.apply_matches(w, c, h), points, now).collect()}
    assert placed["h1"] == (33.0, "hotel_geo_candidate:free") and placed["h3"][0] == 34.0 and placed["h5"] == (None, "manual")
    assert {r.hid: r.action for r in A.manual_points(h.unionByName(spark.createDataFrame([("gone", None)], h.schema)).select("hid"), h).collect()} == {"h1": A.GEO_SET, "h3": A.CONFLICT, "h4": A.GEO_SET, "h5": A.GEO_SET, "h7": A.GEO_SET, "h9": A.GEO_SET, "gone": A.CONFLICT}
    assert A.apply_matches(w.limit(0), c, h).count() == 0


def test_parents(spark):
    h = spark.createDataFrame([("a", "active", 1.0), ("b", "closed", 1.0), ("c", "active", None)], "hid string, status string, lng double")
    items = spark.createDataFrame([(i, i) for i in ("a", "b", "c", "d")], "item string, hid string")
    assert {r.item: r.outcome for r in A.parents_of(items, h).collect()} == {"a": "computable", "b": "skipped", "c": "skipped", "d": "skipped"}


WORK = "id string, status string, run_id string, claimed_at timestamp, processed_at timestamp, target string, error string"


def test_work(spark, now):
    w = spark.createDataFrame([("a", "claimed", "r", None, None, None, "old"), ("b", None, "x", None, None, "t", "e"), ("c", "claimed", "r", None, None, "kept", None), ("d", "review_required", "r", None, None, "t", None)], WORK)
    begun = {r.id: r for r in S.initialise(w, F.col("status").isNotNull()).collect()}
    assert (begun["b"].status, begun["b"].run_id, begun["b"].target) == ("pending", None, None) and begun["a"].error == "old"
    ends = spark.createDataFrame([("a", "processed", "t1", None), ("c", "failed", None, "bad"), ("c", "failed", None, "bad"), ("zz", "failed", None, None)], "id string, status string, target string, error string")
    done = {r.id: r for r in S.finish(w, ends, "id", now).collect()}
    assert (done["a"].status, done["a"].target, done["a"].error) == ("processed", "t1", None) and (done["c"].status, done["c"].target, done["c"].error) == ("failed", "kept", "bad") and len(done) == 4 and done["a"].processed_at is not None
    assert {r.id: r.status for r in S.retry(w).collect()}["d"] == "pending"
    g = S.gate(w).first()
    assert (g.open, g.blocking) == (False, 2) and S.gate(w.limit(0)).first().open
    assert S.finish(w.limit(0), ends, "id", now).count() == 0


def test_runs(spark, now):
    kinds = "run_id string, stage string, status string, batch_size int, current_batch int, total long, processed long, failed long, ignored long, error string, started_at timestamp, finished_at timestamp, updated_at timestamp"
    r = S.queue_run(spark.createDataFrame([], kinds), "a", "s", 3, 2, now)
    assert [x.run_id for x in S.queue_run(r, "b", "s", 3, 2, now).collect()] == ["a"] and S.queue_run(r, "b", "t", 3, 2, now).count() == 2
    batches = lambda *x: spark.createDataFrame(x, "run_id string, batch int, processed int, failed int, ignored int")
    some = S.end_runs(S.count_batches(r, batches(("a", 1, 1, 0, 1)), now), now)
    assert (some.first().status, some.first().processed, some.first().current_batch) == ("running", 1, 1)
    assert S.end_runs(S.count_batches(some, batches(("a", 2, 1, 0, 0)), now), now).first().status == "completed"
    bad = S.count_batches(some, batches(("a", 2, 0, 1, 0)), now)
    assert S.end_runs(bad, now).first().status == "failed" and S.end_runs(bad, now, True).first().status == "completed"


def test_sets(spark):
    df = spark.createDataFrame([(None, ["a"], False), (["a", "b"], ["b", "a"], False), (["a"], ["a", "b"], False), (["a"], ["a", "b"], True), (["a", "c"], ["a", "b"], True), (["a", "a"], ["a"], False)], "o array<string>, n array<string>, g boolean")
    assert [r.k for r in df.select(S.like_components(F.col("o"), F.col("n"), F.col("g")).alias("k")).collect()] == [True, True, False, True, False, False]
    g = spark.createDataFrame([("g1", "a"), ("g1", "b"), ("g2", "c"), ("ccv1|single|d", "d"), ("ccv1|single|d", "e")], "group_key string, member_key string")
    assert {r.key for r in S.obsolete_singles(g).collect()} == {"ccv1|single|a", "ccv1|single|b", "ccv1|single|e"}
    assert S.distinct_texts(spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "t string, n int"), "t").count() == 1 and S.distinct_texts(g.withColumn("n", F.lit(1)), "n").count() == 0


def test_lookups(spark):
    df = spark.createDataFrame([("a" * 24, "x", 1, ["p"]), ("b" * 24, None, None, None), ("c" * 24, "x", 3, [])], "id string, n string, v int, l array<string>")
    ids = lambda d: "".join(sorted(r.id[0] for r in d.collect()))
    cases = [({"n": {"eq": None}}, "b"), ({"n": {"ne": None}}, "ac"), ({"v": {"nin": [1]}}, "bc"), ({"v": {"in": [1, None]}}, "ab"), ({"v": {"gte": 1, "lt": 3}}, "a"), ({"l[0]": {"exists": True}}, "a"), ({"l": {"has": "p"}}, "a"), ({}, "abc")]
    assert [ids(facets.where_match(df, c)) for c, _ in cases] == [w for _, w in cases]
    assert ids(facets.by_id(df, "id", "a" * 24)) == "a" and facets.by_id(df, "id", "short").count() == 0 and facets.by_id(df, "id", None).count() == 0
    assert facets.unique_by(df, "v", 3).count() == 1 and facets.unique_by(df, "v", 9).count() == 0
    with pytest.raises(ValueError):
        facets.unique_by(df, "n", "x")
    assert facets.first_rows(df, [F.asc("id")], "2").count() == 2 and facets.first_rows(df, [F.asc("id")], "all").count() == 3


def test_hosts(one):
    cases = [("http://WWW.A.com/x", "a.com", "a.com"), ("www.b.com/x?y", "b.com", None), ("c.com", "c.com", None), ("https://u@d.com:80", "d.com", "d.com"), (None, None, None)]
    assert [(one(v, T.host_registry), one(v, T.host_strict)) for v, _, _ in cases] == [(a, b) for _, a, b in cases]


def test_curated_access_points_come_first(spark):
    df = spark.createDataFrame([([[33.0, 35.0 + i / 1000] for i in range(7)],), ([],), (None,)], "a array<array<double>>")
    t = geo.target_points(F.lit("POINT"), F.lit("{}"), F.lit(1.0), F.lit(2.0), F.lit(33.0), F.lit(35.0061), F.col("a"))
    got = [r.t for r in df.select(t.alias("t")).collect()]
    assert [round(p[1], 3) for p in got[0]] == [35.006, 35.005, 35.004, 35.003, 35.002] and got[1:] == [[[1.0, 2.0]]] * 2


def test_capacities_against_a_fold(spark):
    import random

    rnd, rows = random.Random(2), []
    for g in range(120):
        rows += [(g, i, rnd.choice([None, 0, 1, 2]), rnd.choice([None, -1, 3, 4])) for i in range(rnd.randrange(1, 6))]
    got = {r.g: (r.rooms, r.beds, r.conflict) for r in dedupe.merged_capacities(spark.createDataFrame(rows, "g int, i int, rooms int, beds int"), "g", "i").collect()}
    for g in range(120):
        mine = [(r, b) for h, _, r, b in rows if h == g]
        (rooms, beds), conflict = mine[0], False
        for r, b in mine[1:]:
            if (r is not None and r <= 0) or (b is not None and b <= 0):
                continue
            if None not in (rooms, beds, r, b):
                conflict |= (rooms, beds) != (r, b)
            elif None not in (r, b):
                rooms, beds = r, b
            else:
                rooms, beds = r if rooms is None else rooms, b if beds is None else beds
        assert got[g] == (rooms, beds, conflict), mine


def test_release(spark, tmp_path):
    df = spark.createDataFrame([(1, 3), (2, 4), (3, 4)], "id int, datasetversion int")
    assert files.publish_release({"a": (df, 4)}, str(tmp_path / "r")) == {"a": 4} and spark.read.parquet(str(tmp_path / "r/a")).count() == 2
    with pytest.raises(ValueError):
        files.publish_release({"a": (df, 4), "b": (df, None)}, str(tmp_path / "q"))
    assert not (tmp_path / "q").exists() and files.source_path("/x/", "a.json") == "/x/a.json" and files.source_path("/x", "/y") == "/y"
