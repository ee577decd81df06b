"""p3: hotel points near beaches, and in them. p7: contact cells of several values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.operators.packed import unpack
from meridia.operators.proximity import point_ok, points_in_regions, ring_edges, within_distance
from meridia.session import table

BEACH_METRES = 400.0
#: Height in degrees of the strips for beach outlines.
REGION_STRIP = 0.01


def _at(df: DataFrame, key: str, point: str) -> DataFrame:
    """(key, lng, lat): distinct, coordinates as written, usable ones only."""
    xy = lambda i: F.get(F.col(f"{point}.coordinates"), F.lit(i))
    return df.select(F.col("_id").alias(key), xy(0).alias("lng"), xy(1).alias("lat")).where(point_ok(F.col("lng"), F.col("lat"))).distinct()


def hotel_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    geo, runs, edges = (table(spark, sf_dir, t) for t in ("hotel_geo_candidates", "geo_import_runs", "hotel_beach_access_edges"))
    last = runs.where("status = 'COMPLETED' and importkind = 'HOTELS'").agg(F.max_by("_id", F.struct("startedat", "_id")).alias("run"))
    newest = geo.join(last, F.col("source.importrunid") == F.col("run"), "left_semi")
    return _at(newest, "pointid", "point").unionByName(_at(edges, "pointid", "hotelpoint"))


def active_beaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "beach_profiles").where("datasetversion = 4 and lifecycle.status = 'ACTIVE'")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    beaches, points = _at(active_beaches(spark, sf_dir), "beachid", "point"), hotel_points(spark, sf_dir)
    near = within_distance(points, beaches, BEACH_METRES)
    centre = beaches.select("beachid", F.col("lng").alias("clng"), F.col("lat").alias("clat"))
    return near.join(centre, ["clng", "clat"]).join(points, ["lng", "lat"]).select("beachid", "pointid").distinct()


P3_SQL = """
with pts as (
  select g._id as pointid, g.point.coordinates[1] as x, g.point.coordinates[2] as y from hotel_geo_candidates g
  where g.source.importrunid = (select _id from geo_import_runs where status = 'COMPLETED' and importkind = 'HOTELS' order by startedat desc, _id desc limit 1)
  union select _id, hotelpoint.coordinates[1], hotelpoint.coordinates[2] from hotel_beach_access_edges),
b as (select distinct _id as beachid, point.coordinates[1] as x, point.coordinates[2] as y from beach_profiles where datasetversion = 4 and lifecycle.status = 'ACTIVE')
select distinct beachid, pointid from b join pts p on abs(p.y - b.y) < 0.01
where abs(p.x) <= 180 and abs(p.y) <= 90 and abs(b.x) <= 180 and abs(b.y) <= 90 and not (p.x = 0 and p.y = 0) and not (b.x = 0 and b.y = 0)
and 2 * 6371000 * asin(sqrt(pow(sin(radians(p.y - b.y) / 2), 2) + cos(radians(b.y)) * cos(radians(p.y)) * pow(sin(radians(p.x - b.x) / 2), 2))) <= 400
"""


def p3_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hotel points, and the beaches' own points, within the outlines of active beaches, of several parts too."""
    active = active_beaches(spark, sf_dir)
    kind = F.get_json_object("geometry", "$.type")
    one = F.from_json("geometry", "coordinates array<array<array<double>>>")["coordinates"]
    many = F.flatten(F.from_json("geometry", "coordinates array<array<array<array<double>>>>")["coordinates"])
    rings = F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many)
    beaches = active.where(kind.isin("Polygon", "MultiPolygon"))
    points = hotel_points(spark, sf_dir).unionByName(_at(active, "pointid", "point"))
    inside = points_in_regions(points, ring_edges(beaches, "_id", rings).distinct(), REGION_STRIP)
    return inside.join(points, ["lng", "lat"]).select(F.col("region").alias("beachid"), "pointid").distinct()


P3_INSIDE_SQL = """
with pts as (
  select g._id as pointid, g.point.coordinates[1] as x, g.point.coordinates[2] as y from hotel_geo_candidates g
  where g.source.importrunid = (select _id from geo_import_runs where status = 'COMPLETED' and importkind = 'HOTELS' order by startedat desc, _id desc limit 1)
  union select _id, hotelpoint.coordinates[1], hotelpoint.coordinates[2] from hotel_beach_access_edges
  union select _id, point.coordinates[1], point.coordinates[2] from beach_profiles where datasetversion = 4 and lifecycle.status = 'ACTIVE'),
b as (select distinct _id as beachid, from_json(geometry, '{"coordinates": [[["DOUBLE"]]]}').coordinates as rings from beach_profiles
  where datasetversion = 4 and lifecycle.status = 'ACTIVE' and geometry like '%"Polygon"%'),
ring as (select beachid, unnest(rings) as v from b),
e as (select beachid, v[i][1] as x0, v[i][2] as y0, v[i % len(v) + 1][1] as x1, v[i % len(v) + 1][2] as y1 from (select beachid, v, unnest(range(1, len(v) + 1)) as i from ring)),
hit as (select beachid, pointid, count(*) as n from e join pts p on (y0 <= y) <> (y1 <= y) and x0 + (y - y0) / (y1 - y0) * (x1 - x0) > x
  where not (x = 0 and y = 0) and abs(x) <= 180 and abs(y) <= 90 group by all)
select beachid, pointid from hit where n % 2 = 1
"""


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "raw_hotels").select("seq", "contacts.phones", "contacts.emails", "contacts.websites")
    return unpack(raw, "seq", {f: F.col(f) for f in ("phones", "emails", "websites")})


_P7_FIELD = """
select seq, '{f}' as field_name, (row_number() over (partition by seq order by i, j))::int as pos, val from (
  select seq, i, j, trim(regexp_replace(replace(replace(replace(v, chr(57346), ','), chr(57347), ';'), chr(57348), ' '), '^"([^"]*)"$', '\\1')) as val, max(n) over (partition by seq) as most from (
    select seq, i, unnest(range(1, len(vs) + 1)) as j, unnest(vs) as v, len(vs) as n from (
      select seq, i, list_filter(list_transform(regexp_split_to_array({protect}, '{split}'), lambda x: trim(x, E' \\t\\r\\n,;|/&')), lambda x: x <> '') as vs
      from (select seq, unnest(range(1, len(contacts.{f}) + 1)) as i, regexp_replace(unnest(contacts.{f}), '^\\s*\\[\\s*(".*")\\s*\\]\\s*$', '\\1') as e from raw_hotels)))
  where v <> '') where most > 1
"""
#: Within quotes every second part of a text split at its quote marks, but for a last one that no mark closes.
_HIDE = "array_to_string(list_transform(string_split({e}, '\"'), lambda x, k: case when k % 2 = 0 and k < len(string_split({e}, '\"')) then replace(replace(replace(x, ',', chr(57346)), ';', chr(57347)), ' ', chr(57348)) else x end), '\"')"
P7_SQL = " union all ".join(
    (
        _P7_FIELD.format(f="phones", protect=_HIDE.format(e="e"), split=r"\s*[,;/|&]+\s*|\s*[\r\n\t]+\s*|\s+and\s+"),
        # the blank between a display name and its address stays
        _P7_FIELD.format(f="emails", protect="regexp_replace(" + _HIDE.format(e="e") + ", '\\s+<', chr(57348) || '<', 'g')", split=r"\s*[,;/|&]+\s*|\s+and\s+|\s+"),
        # , and ; within a link stand before something that begins no new one
        _P7_FIELD.format(f="websites", protect="regexp_replace(regexp_replace(" + _HIDE.format(e="e") + ", ',([^\\s,;|\"hHwW])', chr(57346) || '\\1', 'g'), ';([^\\s,;|\"hHwW])', chr(57347) || '\\1', 'g')", split=r"\s*[,;|]+\s*|\s+and\s+|\s+"),
    )
)


def p3_p7_queries() -> dict:
    return {"p3_found": p3_found, "p3_inside": p3_inside, "p7_found": p7_found}


def p3_p7_sql() -> dict:
    return {"p3_found": P3_SQL, "p3_inside": P3_INSIDE_SQL, "p7_found": P7_SQL}
