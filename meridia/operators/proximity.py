"""Points in regions by crossing parity, and points near points on top of it.

A region's edges are binned into latitude strips, and each strip into cells of
about the strip's height, as far as the region's box reaches. A point meets the
edges of its own cell; those of one region to the east of it are its ray's
crossings, and an odd number of them puts it inside.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
#: A cell with more distinct points than this is split by salt.
POINTS_PER_CELL = 4_096


def haversine_m(lng1: Column, lat1: Column, lng2: Column, lat2: Column, radius: float = EARTH_M) -> Column:
    """Great-circle metres, unrounded."""
    dlat, dlng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlng) * F.sin(dlng)
    return F.lit(2 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def point_ok(lng: Column, lat: Column) -> Column:
    """False for null, (0, 0), NaN and out-of-range coordinates."""
    ok = (F.abs(lng) <= 180) & (F.abs(lat) <= 90) & ~((lng == 0) & (lat == 0)) & ~F.isnan(lng) & ~F.isnan(lat)
    return F.coalesce(ok, F.lit(False))


def _strip(lat: Column, height: float) -> Column:
    return F.floor((lat + 90.0) / height).cast("long")


def _cell_width(strip: Column, height: float) -> Column:
    """Degrees of longitude of a strip's cells: about the height on the ground, at most a whole turn."""
    farthest = F.greatest(F.abs(strip * height - 90.0), F.abs((strip + 1) * height - 90.0))
    return F.least(F.lit(360.0), F.lit(height) / F.greatest(F.lit(1e-9), F.cos(F.radians(F.least(F.lit(90.0), farthest)))))


def _cell(lng: Column, strip: Column, height: float) -> Column:
    return F.floor((lng + 180.0) / _cell_width(strip, height)).cast("long")


def region_cells(edges: DataFrame, height: float) -> DataFrame:
    """(strip, cell, region, edges) from (region, x0, y0, x1, y1): of each region the edges that touch a strip, in each cell of it within the region's box.

    The box is computed per region from pre-aggregated minima; a region's edges
    spread over its strips, so that none is gathered whole.
    """
    box = edges.groupBy("region").agg(F.min(F.least("x0", "x1")).alias("bx0"), F.max(F.greatest("x0", "x1")).alias("bx1"))
    binned = edges.select("region", "x0", "y0", "x1", "y1", F.explode(F.sequence(_strip(F.least("y0", "y1"), height), _strip(F.greatest("y0", "y1"), height))).alias("strip"))
    held = binned.groupBy("region", "strip").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("edges")).join(box, "region")
    return held.select("region", "strip", "edges", F.explode(F.sequence(_cell(F.col("bx0"), F.col("strip"), height), _cell(F.col("bx1"), F.col("strip"), height))).alias("cell"))


def _crossings(edges: Column, x: Column, y: Column) -> Column:
    """How many edges the ray to the east crosses; an edge holds its lower end, not its upper one."""

    def crosses(e: Column) -> Column:
        spans = (e.y0 <= y) != (e.y1 <= y)
        return spans & (e.x0 + (y - e.y0) / (e.y1 - e.y0) * (e.x1 - e.x0) > x)

    return F.size(F.filter(edges, crosses))


def _on_edge(edges: Column, x: Column, y: Column) -> Column:
    def holds(e: Column) -> Column:
        within = x.between(F.least(e.x0, e.x1), F.greatest(e.x0, e.x1)) & y.between(F.least(e.y0, e.y1), F.greatest(e.y0, e.y1))
        return within & ((e.x1 - e.x0) * (y - e.y0) == (x - e.x0) * (e.y1 - e.y0))

    return F.exists(edges, holds)


def points_in_regions(points: DataFrame, edges: DataFrame, height: float) -> DataFrame:
    """(lng, lat, region): the region of edges each distinct point lies in, boundary points included.

    points: lng, lat; edges: region, x0, y0, x1, y1, the rings' edges in
    degrees, holes as further rings. Points that point_ok refuses, and repeated
    points, are left out; regions without edges hold nothing. height is that of
    a strip in degrees. A cell with many points is salted: its points are
    spread, its edges copied once for each salt.
    """
    strip = _strip(F.col("lat"), height)
    at = points.where(point_ok(F.col("lng"), F.col("lat"))).select("lng", "lat").distinct().withColumn("strip", strip).withColumn("cell", _cell(F.col("lng"), F.col("strip"), height))
    full = at.groupBy("strip", "cell").count().where(F.col("count") > POINTS_PER_CELL)
    salts = full.select("strip", "cell", F.ceil(F.col("count") / POINTS_PER_CELL).cast("int").alias("salts"))
    spread = at.join(salts, ["strip", "cell"], "left").withColumn("salt", F.pmod(F.hash("lng", "lat"), F.coalesce("salts", F.lit(1))))
    cells = region_cells(edges, height).join(salts, ["strip", "cell"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    met = spread.drop("salts").join(cells.drop("salts"), ["strip", "cell", "salt"])
    inside = (_crossings(F.col("edges"), F.col("lng"), F.col("lat")) % 2 == 1) | _on_edge(F.col("edges"), F.col("lng"), F.col("lat"))
    return met.where(inside).select("lng", "lat", "region")


def disc_boxes(centres: DataFrame, metres: float) -> DataFrame:
    """(region, x0, y0, x1, y1): for each distinct centre the edges of a box that holds all points within metres; over the poles and the date line it's made of several rings."""
    reach = math.degrees(metres / EARTH_M) * (1 + 1e-9) + 1e-12
    c = centres.where(point_ok(F.col("lng"), F.col("lat"))).select("lng", "lat").distinct()
    y0, y1 = F.greatest(F.lit(-90.0), F.col("lat") - reach), F.least(F.lit(90.0), F.col("lat") + reach)
    polar = (F.abs("lat") + reach) >= 90
    wide = F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.lit(math.radians(reach))) / F.greatest(F.lit(1e-12), F.cos(F.radians("lat")))))) * (1 + 1e-9) + 1e-12
    w, e = F.col("lng") - wide, F.col("lng") + wide
    ring = lambda a, b: F.struct(a.alias("w"), b.alias("e"))
    rings = (
        F.when(polar, F.array(ring(F.lit(-180.0), F.lit(180.0))))
        .when(w < -180, F.array(ring(F.lit(-180.0), e), ring(w + 360, F.lit(180.0))))
        .when(e > 180, F.array(ring(w, F.lit(180.0)), ring(F.lit(-180.0), e - 360)))
        .otherwise(F.array(ring(w, e)))
    )
    r = c.select(F.col("lng").alias("clng"), F.col("lat").alias("clat"), y0.alias("s"), y1.alias("n"), F.posexplode(rings).alias("part", "r"))
    edge = lambda x0, ya, x1, yb: F.struct(x0.alias("x0"), ya.alias("y0"), x1.alias("x1"), yb.alias("y1"))
    rw, re, s, n = F.col("r.w"), F.col("r.e"), F.col("s"), F.col("n")
    four = F.array(edge(rw, s, re, s), edge(re, s, re, n), edge(re, n, rw, n), edge(rw, n, rw, s))
    return r.select(F.struct("clng", "clat", "part").alias("region"), F.inline(four))


def within_distance(points: DataFrame, centres: DataFrame, metres: float) -> DataFrame:
    """(lng, lat, clng, clat): distinct points at most metres, by haversine, from distinct centres.

    Crossing parity on boxes around the centres finds the candidates, and
    loses none; the distance then decides. A pair comes once. Points and
    centres that point_ok refuses never count.
    """
    height = max(math.degrees(metres / EARTH_M), 1e-6)
    near = points_in_regions(points, disc_boxes(centres, metres), height).select("lng", "lat", F.col("region.clng").alias("clng"), F.col("region.clat").alias("clat"))
    return near.where(haversine_m(F.col("lng"), F.col("lat"), F.col("clng"), F.col("clat")) <= metres).distinct()


def ring_edges(df: DataFrame, region: str, rings: Column) -> DataFrame:
    """(region, x0, y0, x1, y1) from array<array<array<double>>> rings of [lng, lat]; rings are closed where they aren't, malformed vertices are skipped."""
    r = df.select(F.col(region).alias("region"), F.explode(rings).alias("ring"))
    v = F.filter("ring", lambda p: (F.size(p) >= 2) & F.get(p, F.lit(0)).isNotNull() & F.get(p, F.lit(1)).isNotNull())
    nxt = F.concat(F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(0))), F.slice("v", 1, 1))
    pair = F.arrays_zip(F.col("v").alias("a"), nxt.alias("b"))
    e = r.withColumn("v", v).where(F.size("v") >= 3).select("region", F.explode(pair).alias("p"))
    at = lambda p, i: F.get(F.col(f"p.{p}"), F.lit(i))
    flat = e.select("region", at("a", 0).alias("x0"), at("a", 1).alias("y0"), at("b", 0).alias("x1"), at("b", 1).alias("y1"))
    return flat.where((F.col("x0") != F.col("x1")) | (F.col("y0") != F.col("y1")))
