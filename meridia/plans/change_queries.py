"""p2: changes of the delivered tables from snapshot to snapshot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.operators.snapshots import bucket_count, file_date, json_value, snapshot_changes, written
from meridia.session import table

RAW_IGNORED = ("_id", "seq", "namenormalized", "sourcefile", "processing", "createdat", "updatedat")


def raw_snapshots(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    compared = [F.col(c) for c in raw.columns if c.lower() not in RAW_IGNORED]
    series = F.concat(F.lit("raw_hotels|"), F.coalesce(F.lower("region"), F.lit("")))
    rows = raw.where(file_date(F.col("sourcefile.filename")).isNotNull()).select(
        series.alias("series"), F.col("sourcefile.filename").alias("snapshot_id"), F.col("stricthoteldedupekey").alias("record_key"), written(*compared).alias("content")
    )
    names = raw.select(series.alias("series"), F.col("sourcefile.filename").alias("snapshot_id")).distinct()
    listed = names.withColumn("rank_by", file_date(F.col("snapshot_id")).cast("timestamp")).where("rank_by is not null")
    return rows, listed


def geo_snapshots(geo: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    series = F.lit("hotel_geo_candidates|")
    rows = geo.select(
        series.alias("series"),
        F.col("source.importrunid").alias("snapshot_id"),
        F.col("source.id").alias("record_key"),
        written(json_value(F.col("geometry")), json_value(F.col("sourceproperties"))).alias("content"),
    )
    listed = runs.where("status = 'COMPLETED' and importkind = 'HOTELS'").select(series.alias("series"), F.col("_id").alias("snapshot_id"), F.col("startedat").alias("rank_by"))
    return rows, listed


def beach_snapshots(beaches: DataFrame) -> tuple[DataFrame, DataFrame]:
    series = F.lit("beach_profiles|")
    version = F.col("datasetversion").cast("string")
    rows = beaches.where("lifecycle.status = 'ACTIVE'").select(
        series.alias("series"),
        version.alias("snapshot_id"),
        F.col("source.id").alias("record_key"),
        written(json_value(F.col("geometry")), json_value(F.col("sourceproperties"))).alias("content"),
    )
    listed = beaches.select("datasetversion").distinct().select(series.alias("series"), version.alias("snapshot_id"), F.timestamp_seconds("datasetversion").alias("rank_by"))
    return rows, listed


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, geo, runs, beaches = (table(spark, sf_dir, t) for t in ("raw_hotels", "hotel_geo_candidates", "geo_import_runs", "beach_profiles"))
    parts = [raw_snapshots(raw), geo_snapshots(geo, runs), beach_snapshots(beaches)]
    union = lambda i: reduce(DataFrame.unionByName, [p[i] for p in parts])
    buckets = bucket_count(sum(t.count() for t in (raw, geo, beaches)))
    found = snapshot_changes(union(0), union(1), buckets)
    return found.select(F.split("series", r"\|")[0].alias("tablename"), "snapshot_id", "record_key", "change_kind")


_RAW_CONTENT = """to_json([name, address, locality, region, postcode, establishmenttype, classraw, stars::varchar, rooms::varchar, beds::varchar,
  operatorname, managername, licensestatus, to_json(contacts)::varchar, stricthoteldedupekey])"""
_JSON = """(select string_agg(p.kv, chr(1) order by p.kv) from (select j.fullkey || chr(2) || j.type || chr(2) || coalesce(j.atom::varchar, '') as kv
  from json_tree({}::json) j where j.atom is not null or j.type = 'NULL') p)"""

P2_SQL = f"""
with dated as (
  select distinct lower(coalesce(region, '')) as series, sourcefile.filename as sid,
    make_date(regexp_extract(sourcefile.filename, '(\\d{{1,2}})\\.(\\d{{1,2}})\\.(\\d{{4}})', 3)::int, regexp_extract(sourcefile.filename, '(\\d{{1,2}})\\.(\\d{{1,2}})\\.(\\d{{4}})', 2)::int,
      regexp_extract(sourcefile.filename, '(\\d{{1,2}})\\.(\\d{{1,2}})\\.(\\d{{4}})', 1)::int)::timestamp as ts from raw_hotels),
snaps as (
  select 'raw_hotels' as t, series, sid, ts from dated
  union all select 'hotel_geo_candidates', '', _id, startedat::timestamp from geo_import_runs where status = 'COMPLETED' and importkind = 'HOTELS'
  union all select distinct 'beach_profiles', '', datasetversion::varchar, make_date(2000 + datasetversion, 1, 1)::timestamp from beach_profiles),
ord as (select *, row_number() over (partition by t, series order by ts, sid) as n from snaps),
rec as (
  select distinct 'raw_hotels' as t, lower(coalesce(region, '')) as series, sourcefile.filename as sid, stricthoteldedupekey as k, {_RAW_CONTENT}::varchar as c from raw_hotels
  union all select distinct 'hotel_geo_candidates', '', source.importrunid, source.id, geometry::json::varchar || chr(3) || {_JSON.format('sourceproperties')} from hotel_geo_candidates
  union all select distinct 'beach_profiles', '', datasetversion::varchar, source.id, geometry::json::varchar || chr(3) || {_JSON.format('sourceproperties')} from beach_profiles where lifecycle.status = 'ACTIVE'),
r as (select o.t, o.series, o.n, rec.k, string_agg(rec.c, chr(4) order by rec.c) as c from rec join ord o on o.t = rec.t and o.series = rec.series and o.sid = rec.sid where rec.k is not null group by all),
ch as (
  select coalesce(a.t, b.t) as t, coalesce(a.series, b.series) as series, coalesce(b.n, a.n + 1) as n, coalesce(a.k, b.k) as k,
    case when a.k is null then 'added' when b.k is null then 'removed' else 'changed' end as kind
  from r a full join r b on a.t = b.t and a.series = b.series and a.n + 1 = b.n and a.k = b.k where a.c is distinct from b.c)
select ch.t as tablename, o.sid as snapshot_id, ch.k as record_key, ch.kind as change_kind
from ch join ord o on o.t = ch.t and o.series = ch.series and o.n = ch.n where ch.n > 1
"""
