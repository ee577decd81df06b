"""Distances, radius and nearest-neighbour searches, representative and target points, routes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meridia.operators.pairing import blocked_join
from meridia.operators.proximity import EARTH_M, haversine_m, point_ok
from meridia.session import cut

#: The sphere of index searches is a little larger than that of walking distances.
SEARCH_M = 6_378_100.0
WALKING_M_S = 1.25
TARGETS = 5


def rounded_m(lng1: Column, lat1: Column, lng2: Column, lat2: Column, radius: float = EARTH_M) -> Column:
    return F.floor(haversine_m(lng1, lat1, lng2, lat2, radius) + 0.5).cast("long")


def radius_search(points: DataFrame, lng: float, lat: float, metres: float, limit: int) -> DataFrame:
    """points (id, lng, lat, ..) within metres of one place on the search sphere, nearest first, then by id; a box that scans can skip by comes first."""
    reach = math.degrees(metres / SEARCH_M) * 1.001
    wide = 360.0 if abs(lat) + reach >= 90 else reach / math.cos(math.radians(min(89.9, abs(lat) + reach)))
    box = F.col("lat").between(lat - reach, lat + reach)
    if wide < 180 and abs(lng) + wide <= 180:
        box = box & F.col("lng").between(lng - wide, lng + wide)
    d = haversine_m(F.lit(lng), F.lit(lat), F.col("lng"), F.col("lat"), SEARCH_M)
    return points.where(box).withColumn("metres", d).where(F.col("metres") <= metres).orderBy("metres", "id").limit(limit)


#: Cubes of the unit sphere's space: a level's edge is 2 ** -level; those of the last are about 24 m wide.
LEVELS = 18


def _on_sphere(lng: Column, lat: Column) -> Column:
    """struct(x, y, z), shifted so that no coordinate is negative."""
    g, t = F.radians(lng), F.radians(lat)
    return F.struct((F.cos(t) * F.cos(g) + 1.0).alias("x"), (F.cos(t) * F.sin(g) + 1.0).alias("y"), (F.sin(t) + 1.0).alias("z"))


def _cube(v: Column, level: Column) -> Column:
    """struct(a, b, c): the cube of a level a place lies in. Above level 0 there is one for all."""
    n = F.pow(F.lit(2.0), level)
    at = lambda k: F.when(level < 0, F.lit(0)).otherwise(F.floor(v[k] * n).cast("int"))
    return F.struct(at("x").alias("a"), at("y").alias("b"), at("z").alias("c"))


def _around(cube: Column, level: Column) -> Column:
    """The cube and its 26 neighbours."""
    step = F.sequence(F.lit(-1), F.lit(1))
    near = lambda i, j, k: F.struct((cube.a + i).alias("a"), (cube.b + j).alias("b"), (cube.c + k).alias("c"))
    all_ = F.flatten(F.transform(step, lambda i: F.flatten(F.transform(step, lambda j: F.transform(step, lambda k: near(i, j, k))))))
    return F.when(level < 0, F.array(cube)).otherwise(all_)


def search_levels(places: DataFrame, centres: DataFrame, k: int) -> DataFrame:
    """(base, level): for each cube of the last level that holds places, the level to search its neighbours at.

    Of the levels at which the cube's surroundings (27 cubes) hold k centres the
    finest gives a bound for the k-th distance, 2 * sqrt(3) edges; two levels up
    an edge is longer than that, so there the 27 cubes around a place hold its k
    nearest. Where even level 0 has too few, all centres are searched. Centres are
    counted by cubes before they meet anything.
    """
    levels = F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level")
    counts = centres.select("v", levels).select("level", _cube(F.col("v"), F.col("level")).alias("cube")).groupBy("level", "cube").agg(F.count("*").alias("n"))
    around = counts.select("level", F.explode(_around(F.col("cube"), F.col("level"))).alias("cube"), "n").groupBy("level", "cube").agg(F.sum("n").alias("n")).where(F.col("n") >= k)
    base = places.select(_cube(F.col("v"), F.lit(LEVELS)).alias("base")).distinct()
    up = base.select("base", levels).select("base", "level", F.struct(*[F.floor(F.col(f"base.{c}") / F.pow(F.lit(2.0), LEVELS - F.col("level"))).cast("int").alias(c) for c in "abc"]).alias("cube"))
    finest = up.join(around.select("level", "cube"), ["level", "cube"], "left_semi").groupBy("base").agg(F.max("level").alias("finest"))
    return base.join(finest, "base", "left").select("base", F.greatest(F.lit(-1), F.coalesce("finest", F.lit(-1)) - 2).alias("level"))


def nearest(points: DataFrame, centres: DataFrame, k: int) -> DataFrame:
    """(pid, cid, metres, rank): the k nearest centres of each point on the search sphere, equal distances by cid.

    points: pid, lng, lat; centres: cid, lng, lat. Each place searches as far as
    the centres around it lie, so one far centre or place widens no other's
    search, and neither poles nor the date line matter. A place meets all centres
    only where these are fewer than k or it's far from all. Copies of one place
    are searched once; of centres at one place the first k by cid alone can
    count. Unusable coordinates never count; copies of an id count once; with
    fewer than k centres each point has all of them.
    """
    ok = lambda df, c: df.where(point_ok(F.col("lng"), F.col("lat"))).dropDuplicates([c]).select(c, "lng", "lat")
    c, p = ok(centres, "cid"), ok(points, "pid")
    at_place = F.row_number().over(Window.partitionBy("lng", "lat").orderBy("cid"))
    c = cut(c.withColumn("_n", at_place).where(F.col("_n") <= k).select("cid", F.col("lng").alias("clng"), F.col("lat").alias("clat"), _on_sphere(F.col("lng"), F.col("lat")).alias("v")))
    places = cut(p.select("lng", "lat").distinct().withColumn("v", _on_sphere(F.col("lng"), F.col("lat"))))
    levels = search_levels(places, c, k)
    asked = places.withColumn("base", _cube(F.col("v"), F.lit(LEVELS))).join(levels, "base").select("lng", "lat", "level", _cube(F.col("v"), F.col("level")).alias("cube"))
    asked = cut(asked)
    wanted = asked.select("level", "cube").distinct()
    used = sorted(r.level for r in wanted.select("level").distinct().collect())  # at most LEVELS + 2 numbers
    each = F.explode(F.array(*[F.lit(n) for n in used]) if used else F.array().cast("array<int>")).alias("level")
    held = c.select("cid", "clng", "clat", "v", each).select("level", F.explode(_around(_cube(F.col("v"), F.col("level")), F.col("level"))).alias("cube"), "cid", "clng", "clat")
    near = blocked_join(asked, held.join(wanted, ["level", "cube"], "left_semi"), ["level", "cube"], 10_000)
    d = haversine_m(F.col("lng"), F.col("lat"), F.col("clng"), F.col("clat"), SEARCH_M)
    rank = F.row_number().over(Window.partitionBy("lng", "lat").orderBy("metres", "cid"))
    best = near.select("lng", "lat", "cid", d.alias("metres")).withColumn("rank", rank).where(F.col("rank") <= k)
    return p.join(best, ["lng", "lat"]).select("pid", "cid", "metres", "rank")


def geometry_kind(kind: Column) -> Column:
    return F.when(kind.isin("Point", "MultiPoint"), "POINT").when(kind.isin("LineString", "MultiLineString"), "LINE").otherwise("AREA")


def vertices(geometry: Column) -> Column:
    """array<array<double>> of a GeoJSON text's [lng, lat] pairs at whatever nesting, a ring's repeated end included; [] without any.

    Innermost lists of numbers are the vertices, read by one pattern.
    """
    pairs = F.regexp_extract_all(F.regexp_extract(geometry, r'"coordinates"\s*:\s*([\[\]0-9eE+\-.,\s]+)', 1), F.lit(r"\[\s*(-?[0-9.eE+\-]+\s*,\s*-?[0-9.eE+\-]+)[^\[\]]*\]"), F.lit(1))
    return F.coalesce(F.transform(pairs, lambda p: F.transform(F.split(p, r"\s*,\s*"), lambda x: x.try_cast("double"))), F.array().cast("array<array<double>>"))


def mean_point(v: Column) -> Column:
    """struct(lng, lat), the mean of all vertices; null without any."""
    n = F.size(v)
    mean = lambda i: F.aggregate(v, F.lit(0.0), lambda s, p: s + F.get(p, F.lit(i))) / n
    return F.when(n > 0, F.struct(mean(0).alias("lng"), mean(1).alias("lat")))


def target_points(kind: Column, geometry: Column, lng: Column, lat: Column, from_lng: Column, from_lat: Column, access: Column | None = None) -> Column:
    """array<array<double>> of up to TARGETS places to walk to.

    Where access points (array<array<double>>, curated by hand) are given and
    there are any, the nearest of them count, repeated ones as often; else lines are sampled at their quarters, areas give the vertices of their outer
    ring nearest to the start; both without repeats. Points, multiple
    geometries, and what has no vertices give the profile's own point.
    """
    v = vertices(geometry)
    single = geometry.rlike(r'"type"\s*:\s*"(?:LineString|Polygon)"')
    at = lambda s: F.get(v, F.floor(s * (F.size(v) - 1) + 0.5).cast("int"))
    line = F.array_distinct(F.array(*[at(F.lit(s)) for s in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    ring = F.transform(
        F.filter(vertices(F.concat(F.lit('{"coordinates": '), F.regexp_extract(geometry, r'"coordinates"\s*:\s*\[\s*(\[[^a-z]*?\]\s*\])', 1))), lambda p: F.size(p) >= 2),
        lambda p, i: _walk_to(p, i, from_lng, from_lat),
    )
    area = F.array_distinct(F.transform(F.slice(F.array_sort(ring), 1, TARGETS), lambda x: x.p))
    own = F.array(F.array(lng, lat))
    made = F.when(single & (kind == "LINE") & (F.size(v) > 0), line).when(single & (kind == "AREA") & (F.size(area) > 0), area).otherwise(own)
    if access is None:
        return made
    near = F.array_sort(F.transform(access, lambda p, i: _walk_to(p, i, from_lng, from_lat)))
    return F.when(F.size(access) > 0, F.transform(F.slice(near, 1, TARGETS), lambda x: x.p)).otherwise(made)


def _walk_to(p: Column, i: Column, from_lng: Column, from_lat: Column) -> Column:
    """struct(m, i, p): whole metres to a point, its place in the list deciding between equal ones."""
    return F.struct(rounded_m(from_lng, from_lat, F.get(p, F.lit(0)), F.get(p, F.lit(1))).alias("m"), i.alias("i"), p.alias("p"))


def best_routes(targets: DataFrame, keys: list[str], alternatives: int = 2) -> DataFrame:
    """(keys.., metres, seconds, target, alternatives): of each pair the shortest straight walk to a target (lng, lat, to_lng, to_lat) and the next ones; equal ones by the target."""
    m = rounded_m(F.col("lng"), F.col("lat"), F.col("to_lng"), F.col("to_lat"))
    route = F.struct(m.alias("metres"), F.ceil(m / WALKING_M_S).alias("seconds"), F.array("to_lng", "to_lat").alias("target"))
    r = targets.groupBy(*keys).agg(F.sort_array(F.collect_set(route)).alias("r"))
    return r.select(*keys, F.col("r")[0].metres.alias("metres"), F.col("r")[0].seconds.alias("seconds"), F.col("r")[0].target.alias("target"), F.transform(F.slice("r", 2, alternatives), lambda x: x.metres).alias("alternatives"))
