import json
import os

import pytest
from pyspark.sql import functions as F

from meridia.operators import dedupe, facets, grouping, matching, merge, runs
from meridia.sources import files
from meridia.sources.geojson import read_features
from meridia.streaming.upserts import compact, latest, stream_upsert

SIDE = "raw_names array<string>, reduced_names array<string>, contacts array<string>, shared_contacts array<string>, postcode string, street string, city string"


def sides(spark):
    row = lambda n, k=(), s=(), p=None, t=None, c=None: ([n], [" ".join(w for w in n.split() if w not in ("HOTEL", "VILLAGE", "HOLIDAY", "THE"))], list(k), list(s), p, t, c)
    h = [("h1", *row("NICHOLAS COLOR HOTEL", ["p:1"])), ("h2", *row("TSOKKOS PARADISE VILLAGE", (), ["d:tsokkos.com"])), ("h3", *row("LA VERANDA HOTEL", (), (), "6028")), ("h4", *row("AVANTI HOTEL")), ("h5", *row("AVANTI VILLAGE")), ("h6", *row("SOLO"))]
    c = [("c1", 0, *row("NICOLAS COLOR", ["p:1"])), ("c2", 5, *row("TSOKKOS PARADISE HOLIDAY VILLAG", (), ["d:tsokkos.com"])), ("c3", 0, *row("LA VERANDA DE LARNACA", (), (), "6028")), ("c4", 0, *row("AVANTI")), ("c5", 30, *row("SOLO")), ("c6", 0, *row("SOLO")), ("c7", 0, [], [], None, None, None, None, None)]
    return spark.createDataFrame(c, "cid string, richness int, " + SIDE), spark.createDataFrame(h, "hid string, " + SIDE)


def test_tiers_and_resolution(spark):
    found = matching.proposals(*sides(spark)).cache()
    assert {(r.cid, r.hid): r.score for r in found.collect()} == {("c1", "h1"): 92, ("c2", "h2"): 84, ("c3", "h3"): 82, ("c4", "h4"): 60, ("c4", "h5"): 60, ("c5", "h6"): 80, ("c6", "h6"): 80}
    best = matching.mutual_best(found)
    assert {(r.cid, r.hid) for r in best.collect()} == {("c1", "h1"), ("c2", "h2"), ("c3", "h3"), ("c5", "h6")}
    assert {(r.cid, r.hid) for r in matching.review_suggestions(found, best).collect()} == {("c4", "h4"), ("c6", "h6")}
    top = {r.hid: r.suggestions for r in matching.attach_top(sides(spark)[1].select("hid"), found, "hid", "cid", 1).collect()}
    assert [x.cid for x in top["h6"]] == ["c5"] and len(top) == 6
    # salted blocks give the same
    assert sorted(found.collect()) == sorted(matching.proposals(*sides(spark), crowd=0).collect())


def test_keep_and_conflicts(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), (None, 3, "y"), (None, 4, "z")], "k string, seq int, v string")
    assert {(r.k, r.v) for r in dedupe.keep_last(df, ["k"], "seq").collect()} == {("a", None), (None, "z")}
    assert {(r.k, r.v) for r in dedupe.keep_first(df, ["k"], "seq").collect()} == {("a", "x"), (None, "y")}
    assert dedupe.conflicts(df, "k", "v").collect() == [(None, 2, 2)]
    assert df.groupBy().agg(dedupe.strict_sum(F.when(F.col("seq") > 1, F.col("seq"))).alias("s"), dedupe.strict_sum("seq").alias("t")).first() == (None, 10)


def test_capacity_and_issues(spark):
    rows = [(1, 2, 0, 2), (1, 2, 3, 4), (1, None, 3, 4), (1, None, None, 5), (None, None, None, None)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int")
    got = [tuple(r.m) for r in df.select(dedupe.merge_capacity(*[F.col(x) for x in "abcd"]).alias("m")).collect()]
    assert got == [(1, 2, False), (1, 2, True), (3, 4, False), (1, 5, False), (None, None, False)]


def test_fold(spark):
    df = spark.createDataFrame([("f", 2, "b"), ("f", 1, "a"), ("g", 1, None)], "k string, seq int, v string")

    def fold(rows):
        return [{"k": rows[0]["k"], "all": "".join(r["v"] or "-" for r in rows)}]

    assert {tuple(r) for r in dedupe.fold_in_order(df, ["k"], "seq", fold, "k string, all string").collect()} == {("f", "ab"), ("g", "-")}


def test_shadow_and_collapse(spark):
    total = spark.createDataFrame([("a", 11, 64), ("b", 100, 100), ("c", None, 5)], "k string, rooms int, beds int")
    part = spark.createDataFrame([("a", 1, 6)] * 12 + [("b", 1, 6)] * 3 + [("c", 1, None)] * 3, "k string, rooms int, beds int")
    assert [r.k for r in grouping.shadow_aggregates(total, part, "k", ["rooms", "beds"]).collect()] == ["a"]
    rows = spark.createDataFrame([("x", 1, "t", 5, 10), ("x", 2, "t", 5, 20), ("y", 3, "t", 5, 10), ("y", 4, "t", 5, 21), ("z", 5, "t", 1, 1)], "b string, i int, t string, r int, d int")
    assert [tuple(r) for r in grouping.collapse_candidates(rows, "b", "i", "t", "r", "d").collect()] == [("x", 2, 1)]


def test_merge(spark):
    old = spark.createDataFrame([("a", "1", "k"), ("b", "2", None), ("c", None, "k")], "id string, v string, keep string")
    new = spark.createDataFrame([("a", "9", "n"), ("c", None, "n"), ("d", "4", "n")], "id string, v string, keep string")
    assert {tuple(r) for r in merge.hash_diff(old, new, ["id"], ["v"]).collect()} == {("a", "UPDATED"), ("b", "MISSING"), ("c", "UNCHANGED"), ("d", "INSERTED")}
    nxt = merge.upsert(old, new, ["id"], ["keep"])
    assert {tuple(r) for r in nxt.collect()} == {("a", "9", "k"), ("b", "2", None), ("c", None, "k"), ("d", "4", "n")}
    assert merge.upsert(nxt, new, ["id"], ["keep"]).exceptAll(nxt).count() == 0  # a second time changes nothing
    assert merge.action_counts(merge.hash_diff(old, new, ["id"], ["v"]), 2).first() == (5, 1, 1, 1, 1, 2)
    now = F.to_timestamp(F.lit("2026-01-01"))
    v = merge.next_version(spark.createDataFrame([], "dataset string, version int, status string, created_at timestamp, published_at timestamp"), "d", now)
    assert merge.publish_version(v, "d", 1, now).select("version", "status").first() == (1, "published")


def test_facets_and_pages(spark):
    df = spark.createDataFrame([("A", "x y"), ("A", None), (None, " "), ("C", "X")], "s string, t string")
    assert {tuple(r) for r in facets.facets(df, {"s": ["A", "B"], "t": None}).collect()} == {("s", "A", 2), ("s", "B", 0), ("t", "x y", 1), ("t", "X", 1)}
    assert facets.text_search(df, "x.", ["t"]).count() == 0 and facets.text_search(df, "X", ["t"]).count() == 2 and facets.where_all(df, s=None).count() == 4
    assert [facets.number(x, 50, 1, 200) for x in (None, "x", "7abc", "-3", 999)] == [50, 50, 7, 1, 200]


@pytest.mark.parametrize("done, total, completed, wanted", [(196, 701, False, 27.9), (10, 10, False, 99.9), (0, 0, True, 100.0)])
def test_progress(spark, done, total, completed, wanted):
    assert spark.range(1).select(runs.progress(F.lit(done), F.lit(total), F.lit(completed)).alias("p")).first().p == wanted


def test_page_ranges(spark):
    got = files.page_ranges(spark.createDataFrame([(8,), (9,), (13,), (14,), (0,)], "n int"), "n").collect()
    by = {}
    for r in got:
        by.setdefault(r.n, []).append((r.page_from, r.page_to))
    assert by == {8: [(1, 8)], 9: [(1, 5), (5, 9)], 13: [(1, 5), (5, 9), (9, 13)], 14: [(1, 5), (5, 9), (9, 13), (13, 14)]}


def test_discovery(spark):
    links = spark.createDataFrame([(1, "/f/hotels_a_1.2.2024.pdf"), (2, "/f/hotels_a_1.2.2024.pdf"), (3, "/f/pet-friendly_hotels_x.pdf"), (4, "x.html"), (5, None)], "seq int, href string")
    assert [r.filename for r in files.discover(links, "https://r.example/").collect()] == ["hotels_a_1.2.2024.pdf"]
    more = links.unionAll(spark.createDataFrame([(9, "https://r.example/pancyprian%20list_3.4.2025.pdf")], "seq int, href string"))
    assert [str(r.day) for r in files.discover(more, "https://r.example").collect()] == ["2025-04-03"]


def test_geojson(spark, tmp_path):
    feature = lambda i, **k: {"type": "Feature", "properties": {"@id": i} if i else {}, "geometry": {"type": "Point", "coordinates": [1, 2]}} | k
    (tmp_path / "good.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature("n/1"), feature(None), feature("n/2", id="way/100")]}))
    (tmp_path / "bad.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature("n/1"), {"type": "Feature"}]}))
    (tmp_path / "torn.geojson").write_text("{")
    got = {(os.path.basename(r.file), r.id, r.failed) for r in read_features(spark, str(tmp_path)).collect()}
    assert got == {("good.geojson", "n/1", None), ("good.geojson", None, "id"), ("good.geojson", "way/100", None), ("bad.geojson", None, "file"), ("torn.geojson", None, "file")}


def test_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    put = lambda rows: spark.createDataFrame(rows, "k string, at int, v string").coalesce(1).write.mode("append").parquet(src)
    put([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")])
    assert stream_upsert(spark, src, "k string, at int, v string", out, str(tmp_path / "c"), ["k"], "at") == 0
    put([("a", 1, "late"), ("b", 5, "new"), ("c", 1, "c")])
    stream_upsert(spark, src, "k string, at int, v string", out, str(tmp_path / "c"), ["k"], "at")
    assert {tuple(r) for r in latest(spark, out, 1).select("k", "v").collect()} == {("a", "y"), ("b", "new"), ("c", "c")}
    # a call that finds nothing new still names the last batch, and older ones stay readable until they're dropped
    assert stream_upsert(spark, src, "k string, at int, v string", out, str(tmp_path / "c"), ["k"], "at") == 1
    assert {tuple(r) for r in latest(spark, out, 0).select("k", "v").collect()} == {("a", "y"), ("b", "z")}
    compact(spark, out, 1)
    assert latest(spark, out).count() == 3


def test_publish(spark, tmp_path):
    p = str(tmp_path / "t")
    df = spark.createDataFrame([(1, 1), (2, 2)], "id int, datasetversion int")
    files.publish(df, p, 1)
    files.publish(df, p, 2)
    files.publish(df.where("id < 0").unionAll(spark.createDataFrame([(9, 2)], df.schema)), p, 2)
    assert {tuple(r) for r in spark.read.parquet(p).select("id", "datasetversion").collect()} == {(1, 1), (9, 2)}


def test_leases(spark):
    df = spark.createDataFrame([(f"{i}", None, None, "pending" if i % 2 else "done") for i in range(9)], "id string, run_id string, claimed_at timestamp, status string")
    got = runs.lease(df, "id", 2, "r", F.to_timestamp(F.lit("2026-01-01")), F.col("status") == "pending")
    assert [r.id for r in got.where("run_id = 'r'").orderBy("id").collect()] == ["1", "3"] and got.count() == 9


def test_resolve_targets(spark):
    cols = "key string, name string, kind string, address string, phones array<string>"
    known = spark.createDataFrame([("k1", "1", "A", "h", "x", ["p"]), ("k2", "2", "A", "h", "y", ["p"]), ("k3", "3", "B", "h", None, []), ("k4", "3", "C", "h", "z", None)], "kid string, " + cols)
    new = spark.createDataFrame([("r1", "1", "A", "h", "x", ["p"]), ("r2", "9", "A", "h", "y", []), ("r3", "9", "A", "h", None, ["p"]), ("r4", "9", "B", "h", "", [""]), ("r5", "3", "B", "h", None, None), ("r6", None, None, "h", "x", ["p"])], "rid string, " + cols)
    got = {r.rid: (r.kid, r.how) for r in merge.resolve_targets(new, known, ["address"], ["phones"]).collect()}
    assert got == {"r1": ("k1", "exact"), "r2": ("k2", "alike"), "r3": (None, "ambiguous"), "r4": (None, "new"), "r5": (None, "ambiguous"), "r6": (None, "new")}
