import math
import random

from meridia.operators import proximity as P
from meridia.operators.geo import mean_point, nearest, radius_search, target_points, vertices


def hav(a, b, r=P.EARTH_M):
    x = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * r * math.asin(min(1, math.sqrt(x)))


def usable(p):
    return None not in p and abs(p[0]) <= 180 and abs(p[1]) <= 90 and p != (0.0, 0.0) and not any(map(math.isnan, p))


def test_within_distance_against_brute(spark):
    rnd = random.Random(5)
    spots = [(33.0, 35.0), (179.999, 10.0), (-179.999, 10.0), (20.0, 89.999), (-100.0, 89.9995), (5.0, -89.999), (0.001, 0.001)]
    pts = [(x + rnd.uniform(-0.02, 0.02), y + rnd.uniform(-0.004, 0.004)) for x, y in spots for _ in range(30)] + [(0.0, 0.0), (None, 1.0), (200.0, 1.0), (1.0, 95.0), (float("nan"), 1.0)] + [(33.0, 35.0)] * 50
    pts = [(x if x is None or abs(x) <= 180 or x == 200 else x - math.copysign(360, x), y if abs(y) <= 90 or y == 95 else 90.0) for x, y in pts]
    cen = pts[::3]
    df = lambda ps: spark.createDataFrame([(x, y, "z") for x, y in ps], "lng double, lat double, region string")
    got = {tuple(r) for r in P.within_distance(df(pts), df(cen), 400.0).collect()}
    wanted = {(*p, *c) for p in set(pts) if usable(p) for c in set(cen) if usable(c) and hav(p, c) <= 400.0}
    assert got == wanted and len(wanted) > 50


def test_salted_cell(spark, monkeypatch):
    monkeypatch.setattr(P, "POINTS_PER_CELL", 10)
    pts = [(33 + i * 1e-6, 35.0) for i in range(200)]
    df = spark.createDataFrame(pts, "lng double, lat double")
    assert P.within_distance(df, df.limit(5), 400.0).count() == 1000


def test_regions_with_hole_and_boundary(spark):
    rings = [[[0.0, 1.0], [4.0, 1.0], [4.0, 5.0], [0.0, 5.0], [0.0, 1.0]], [[1.0, 2.0], [2.0, 2.0], [2.0, 3.0], [1.0, 3.0]]]
    r = spark.createDataFrame([("a", rings), ("b", None), ("c", [])], "id string, rings array<array<array<double>>>")
    edges = P.ring_edges(r, "id", r.rings)
    pts = [(3.0, 4.0), (1.5, 2.5), (0.0, 3.0), (4.0, 5.0), (5.0, 3.0), (1.0, 2.5), (2.0, 1.0), (None, None)]
    for height in (0.3, 1.0, 50.0):
        got = {(x.lng, x.lat) for x in P.points_in_regions(spark.createDataFrame(pts, "lng double, lat double"), edges, height).collect()}
        assert got == {(3.0, 4.0), (0.0, 3.0), (4.0, 5.0), (1.0, 2.5), (2.0, 1.0)}, height


def test_nearest_against_brute(spark):
    rnd = random.Random(2)
    cen = [(f"c{i:02d}", rnd.uniform(-170, 170), rnd.uniform(-80, 80)) for i in range(25)] + [("c99", None, 3.0)]
    pts = [(f"p{i}", rnd.uniform(-170, 170), rnd.uniform(-80, 80)) for i in range(12)] + [("p99", cen[0][1], cen[0][2])]
    p, c = spark.createDataFrame(pts, "pid string, lng double, lat double"), spark.createDataFrame(cen, "cid string, lng double, lat double")
    for k in (3, 40):
        got = {(r.pid, r.rank): r.cid for r in nearest(p, c, k).collect()}
        for i, x, y in pts:
            order = sorted((hav((x, y), (a, b), 6_378_100.0), n) for n, a, b in cen if a is not None)[:k]
            assert [got.get((i, j + 1)) for j in range(len(order))] == [n for _, n in order]
    # copies of a place, a far centre and one beyond the date line widen no search and lose nothing
    twins = [(f"t{i}", 10.0, 45.0) for i in range(9)] + [("far", -179.9999, 0.5), ("east", 179.9999, 0.5)]
    t = spark.createDataFrame(twins, "cid string, lng double, lat double")
    q = spark.createDataFrame([("q", 10.0001, 45.0), ("w", -179.99995, 0.5)], "pid string, lng double, lat double")
    got = {(r.pid, r.rank): r.cid for r in nearest(q, t, 2).collect()}
    assert got == {("q", 1): "t0", ("q", 2): "t1", ("w", 1): "far", ("w", 2): "east"}
    assert nearest(p.limit(0), c, 3).count() == 0 and nearest(p, c.limit(0), 3).count() == 0


def test_radius_order(spark):
    df = spark.createDataFrame([("b", 33.0, 35.001), ("a", 33.0, 35.001), ("c", 33.0, 35.0), ("d", 34.0, 35.0)], "id string, lng double, lat double")
    assert [r.id for r in radius_search(df, 33.0, 35.0, 200, 3).collect()] == ["c", "a", "b"]


def test_geometry(one, spark):
    line = '{"type": "LineString", "coordinates": [[0, 0], [1, 0], [2, 0], [3, 0], [4, 1e0]]}'
    assert one(line, vertices)[-1] == [4.0, 1.0] and tuple(one(line, lambda g: mean_point(vertices(g)))) == (2.0, 0.2)
    assert one("{}", vertices) == [] and one(None, vertices) == [] and one("{}", lambda g: mean_point(vertices(g))) is None
    from pyspark.sql import functions as F

    t = lambda g, k: one(g, lambda c: target_points(F.lit(k), c, F.lit(9.0), F.lit(9.0), F.lit(0.0), F.lit(0.0)))
    assert len(t(line, "LINE")) == 5 and t("{}", "AREA") == [[9.0, 9.0]]
    area = '{"type": "Polygon", "coordinates": [[[1, 1], [2, 1], [2, 2], [1, 2], [3, 3], [5, 5], [1, 1]]]}'
    assert t(area, "AREA") == [[1.0, 1.0], [2.0, 1.0], [1.0, 2.0], [2.0, 2.0]]
