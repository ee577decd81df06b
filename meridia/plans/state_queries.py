"""Matches applied, states, runs, releases, lookups and sources over the delivered tables, and the same in SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.functions import keys as K
from meridia.functions import text as T
from meridia.operators import apply, facets, geo, merge, runs, states
from meridia.operators.proximity import point_ok
from meridia.plans.core_sql import _LAST, _mn
from meridia.session import shared_dir, table
from meridia.sources import files
from meridia.sources.geojson import read_features

AT = "2026-01-02 03:04:05"


def _now() -> Column:
    return F.to_timestamp(F.lit(AT))


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/query-{uuid.uuid4().hex}"


def _xy(point: str, i: int) -> Column:
    return F.get(F.col(f"{point}.coordinates"), F.lit(i))


# --- matches -------------------------------------------------------------------------------------------------


def _bindings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(wanted, candidates, hotels, points): candidates of the last run wanted by the hotel of exactly their name, the least of each name; of those left some are bound by hand, so that all conflicts occur."""
    last = table(spark, d, "geo_import_runs").where("status = 'COMPLETED' and importkind = 'HOTELS'").agg(F.max_by("_id", F.struct("startedat", "_id")).alias("run"))
    g = table(spark, d, "hotel_geo_candidates").join(last, F.col("source.importrunid") == F.col("run"), "left_semi").dropDuplicates(["_id"])
    g = g.select(F.col("_id").alias("cid"), T.match_name(F.col("name")).alias("n"), _xy("point", 0).alias("lng"), _xy("point", 1).alias("lat")).where("n <> ''")
    h = table(spark, d, "canonical_hotels").select(F.col("_id").alias("hid"), T.match_name(F.col("canonicalname")).alias("n"), F.col("geo.source").alias("geo_source"), "status", _xy("geo.point", 0).alias("lng"), _xy("geo.point", 1).alias("lat"), "updatedat")
    one = h.groupBy("n").agg(F.min("hid").alias("hid"))
    first = g.groupBy("n").agg(F.min("cid").alias("first"), F.max("cid").alias("last"))
    named = g.join(first, "n").join(one, "n", "left")
    odd = F.substring("cid", -1, 1).isin("1", "3", "5", "7", "9")
    state = F.when((F.col("cid") != F.col("first")) & odd, F.col("hid"))
    candidates = named.select("cid", state.alias("canonicalhotelid"), F.when(state.isNotNull(), "CONFIRMED").otherwise("UNMATCHED").alias("matchstatus"), F.array().cast("array<string>").alias("matchreasons"), F.lit(None).cast("timestamp").alias("updatedat"))
    wanted = named.where((F.col("cid") == F.col("first")) & F.col("hid").isNotNull()).select("cid", "hid")
    return wanted, candidates, h.drop("n"), g.drop("n")


def applied_matches(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each wanted match."""
    wanted, candidates, hotels, _ = _bindings(spark, d)
    return apply.apply_matches(wanted, candidates, hotels)


def bound_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The candidates after the wanted matches."""
    wanted, candidates, hotels, _ = _bindings(spark, d)
    done = apply.apply_matches(wanted, candidates, hotels).withColumn("reason", F.lit("RAW_EXACT_NAME")).withColumn("score", F.lit(80))
    after = apply.bound_candidates(candidates, done, apply.match_reasons(F.col("reason"), F.col("score")), _now())
    return after.select("cid", "canonicalhotelid", "matchstatus", F.array_join("matchreasons", ",").alias("reasons"))


def placed_hotels(spark: SparkSession, d: str) -> DataFrame:
    """The hotels after the wanted matches."""
    wanted, candidates, hotels, points = _bindings(spark, d)
    return apply.placed_hotels(hotels, apply.apply_matches(wanted, candidates, hotels), points, _now()).select("hid", "lng", "lat", "geo_source")


def manual_points(spark: SparkSession, d: str) -> DataFrame:
    """Points set by hand, for all hotels, after the matches have placed some."""
    wanted, candidates, hotels, points = _bindings(spark, d)
    placed = apply.placed_hotels(hotels, apply.apply_matches(wanted, candidates, hotels), points, _now())
    return apply.manual_points(hotels.select("hid"), placed)


def item_parents(spark: SparkSession, d: str) -> DataFrame:
    """Whether the hotel of each edge can be computed: it is there, active, and has a point."""
    h = table(spark, d, "canonical_hotels").select(F.col("_id").alias("hid"), "status", _xy("geo.point", 0).alias("lng"))
    items = table(spark, d, "hotel_beach_access_edges").dropDuplicates(["_id"]).select("_id", F.col("canonicalhotelid").alias("hid"))
    return apply.parents_of(items, h).select("_id", "outcome")


def matches_and_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Accepted matches and, after them, all that was suggested, as a bag."""
    wanted, candidates, hotels, _ = _bindings(spark, d)
    done = apply.apply_matches(wanted, candidates, hotels).where(F.col("action") != apply.CONFLICT)
    return done.select("hid", "cid").unionByName(wanted.select("hid", "cid"))


# --- states and runs -----------------------------------------------------------------------------------------


def _work(spark: SparkSession, d: str) -> DataFrame:
    p = lambda c: F.col(f"processing.{c}")
    return table(spark, d, "raw_hotels").select("_id", "seq", p("status").alias("status"), p("runid").alias("run_id"), p("claimedat").alias("claimed_at"), p("processedat").alias("processed_at"), p("hotelregistryentryid").alias("target"), p("error").alias("error"))


def work_states(spark: SparkSession, d: str) -> DataFrame:
    """The raw rows' work after one batch: rows without a state get one, the first pending ones are claimed and end by their number, failed ones are retried."""
    w = states.initialise(_work(spark, d), F.col("seq") % 50 != 0)
    batch = runs.lease(w, "_id", 100, "run-1", _now(), F.col("status") == states.PENDING)
    claimed = batch.withColumn("status", F.when(F.col("run_id") == "run-1", states.CLAIMED).otherwise(F.col("status")))
    kind = F.when(F.col("seq") % 7 == 0, states.FAILED).when(F.col("seq") % 7 == 1, states.IGNORED).when(F.col("seq") % 7 == 2, states.REVIEW).otherwise(states.PROCESSED)
    ends = claimed.where("status = 'claimed' and run_id = 'run-1' and seq % 11 <> 0").select("_id", kind.alias("status"), F.when(kind == states.PROCESSED, F.concat(F.lit("t-"), "_id")).alias("target"), F.when(kind == states.FAILED, "bad row").alias("error"))
    done = states.retry(states.finish(claimed, ends, "_id", _now()))
    return done.groupBy("status", "error").agg(F.count("*").alias("n"), F.count("target").alias("targets"), F.count("claimed_at").alias("claims"), F.count_if(F.col("run_id") == "run-1").alias("of_run"))


def recovered_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims half an hour old, here those on rows of an even number, are pending again."""
    w = _work(spark, d).withColumn("status", F.when(F.col("seq") % 3 == 0, states.CLAIMED).otherwise(F.col("status"))).withColumn("claimed_at", F.when(F.col("seq") % 2 == 0, F.to_timestamp(F.lit("2026-01-02 02:00:00"))).otherwise(F.to_timestamp(F.lit("2026-01-02 03:00:00"))))
    return states.recover(w, runs.expired(F.col("claimed_at"), _now())).groupBy("status").agg(F.count("*").alias("n"), F.count("claimed_at").alias("claims"))


def stage_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether the next stage may begin."""
    return states.gate(_work(spark, d))


def run_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """A run for each batch size over the raw rows: queued, counted batch by batch, ended; a second one of a busy stage isn't queued."""
    empty = spark.createDataFrame([], "run_id string, stage string, status string, batch_size int, current_batch int, total long, processed long, failed long, ignored long, error string, started_at timestamp, finished_at timestamp, updated_at timestamp")
    w = _work(spark, d).where("status <> 'pending'")
    r = states.queue_run(empty, "a", "stage-2", 0, 50, _now())
    r = states.queue_run(r, "b", "stage-2", 1, 50, _now())
    r = states.queue_run(r, "c", "stage-3", 1, 50, _now())
    r = r.withColumn("total", F.when(F.col("run_id") == "a", w.agg(F.count("*")).scalar()).otherwise(F.col("total")))
    of = lambda s: F.count_if(F.col("status") == s)
    batches = w.groupBy(F.lit("a").alias("run_id"), F.ceil(F.col("seq") / 50).cast("int").alias("batch")).agg(of("processed").alias("processed"), of("failed").alias("failed"), of("ignored").alias("ignored"))
    ended = states.end_runs(states.count_batches(r, batches, _now()), _now())
    loose = states.end_runs(states.count_batches(r, batches, _now()), _now(), True).select(F.concat("run_id", F.lit("-loose")).alias("run_id"), "stage", "status", "total", "processed", "failed", "ignored", "error")
    return ended.select(*loose.columns).unionByName(loose)


def run_ids(spark: SparkSession, d: str) -> DataFrame:
    """The distinct run ids of edges and entries."""
    e = table(spark, d, "hotel_beach_access_edges").select(F.col("runid").alias("run_id"))
    return states.distinct_texts(e.unionByName(table(spark, d, "hotel_registry_entries").select(F.col("processing.runid").alias("run_id"))), "run_id")


def latest_runs(spark: SparkSession, d: str) -> DataFrame:
    """The latest run by the time its id begins with; ids without one are passed over."""
    named = F.when(F.col("status") == "COMPLETED", F.concat(F.date_format("startedat", "yyyy-MM-dd'T'HH-mm-ss"), F.lit("-"), F.lower("importkind"))).otherwise(F.col("_id"))
    r = table(spark, d, "geo_import_runs").select(named.alias("run"))
    return runs.latest_run(r, "run", T.run_time(F.col("run")))


def rolled_back(spark: SparkSession, d: str) -> DataFrame:
    """What is left of sources and targets once the run that did every fifth raw row is taken back."""
    sources = table(spark, d, "raw_hotels").select("_id", F.when(F.col("seq") % 5 == 0, "run-5").otherwise("run-1").alias("run_id"))
    targets = sources.select(F.concat(F.lit("t-"), "_id").alias("target"), "run_id")
    s, t = runs.rollback(sources, targets, "run_id", "run_id", F.lit("run-5"))
    return s.groupBy("run_id").agg(F.count("*").alias("sources")).join(t.groupBy("run_id").agg(F.count("*").alias("targets")), "run_id", "left")


# --- versions and releases -----------------------------------------------------------------------------------


def _hotels(spark: SparkSession, d: str) -> DataFrame:
    verification = F.when(F.col("geo.source") == "manual", "location_verified").when(F.col("operator").isNull(), "location_unverified").otherwise("unreviewed")
    return table(spark, d, "canonical_hotels").select("_id", "canonicalname", "status", "datasetversion", "updatedat", verification.alias("verification"), F.col("geo.point").isNotNull().alias("has_point"), F.col("location.locality").alias("locality"), F.col("contacts.phones").alias("phones"))


def release_metrics(spark: SparkSession, d: str) -> DataFrame:
    return states.release_metrics(_hotels(spark, d), 4)


def first_release(spark: SparkSession, d: str) -> DataFrame:
    """The first version's rows, of datasets of which some rows have no version yet."""
    bare = lambda t, k: table(spark, d, t).select(k, "datasetversion").distinct().select(k, F.when(F.ascii(F.substring(k, -1, 1)) % 2 == 0, F.col("datasetversion")).alias("datasetversion"))
    return states.first_release({"hotels": bare("canonical_hotels", "_id"), "beaches": bare("beach_profiles", "_id"), "edges": bare("hotel_beach_access_edges", "_id")}, 1)[1]


def release_copy(spark: SparkSession, d: str) -> DataFrame:
    """A release's datasets, stamped, published by version, pinned, copied and read again: rows of each."""
    at = _folder(spark)
    b = table(spark, d, "beach_profiles").select("_id", "datasetversion")
    for v in (3, 4):
        files.publish(b, f"{at}/beaches", v)
    e = merge.stamp(table(spark, d, "hotel_beach_access_edges").select("_id"), 7)
    files.append(e, f"{at}/edges")
    files.append(e.limit(0), f"{at}/edges")
    pinned = files.publish_release({"beaches": (files.at_version(spark, f"{at}/beaches", 4), 4), "edges": (spark.read.parquet(f"{at}/edges"), 7)}, f"{at}/release")
    return reduce(DataFrame.unionByName, [spark.read.parquet(f"{at}/release/{n}").agg(F.lit(n).alias("dataset"), F.lit(v).alias("version"), F.count("*").alias("n"), F.count_distinct("_id").alias("ids")) for n, v in pinned.items()])


def chosen_release(spark: SparkSession, d: str) -> DataFrame:
    """The latest published of the beach versions, the last of which is a draft still; and one by its number."""
    v = table(spark, d, "beach_profiles").groupBy(F.col("datasetversion").alias("version")).agg(F.max("updatedat").alias("published_at"))
    r = v.select(F.concat(F.lit("r-"), "version").alias("release_key"), "version", F.when(F.col("version") == 4, "draft").otherwise("published").alias("status"), "published_at")
    return merge.choose_release(r).select("release_key", "version").unionByName(merge.choose_release(r, version=1).select("release_key", "version")).unionByName(merge.choose_release(r, key="r-2").select("release_key", "version"))


# --- lookups -------------------------------------------------------------------------------------------------


def matched_rows(spark: SparkSession, d: str) -> DataFrame:
    """Raw rows by conditions of every kind."""
    raw = table(spark, d, "raw_hotels").withColumn("phones", F.col("contacts.phones"))
    tests = {"region": {"ne": None}, "stars": {"nin": [1, 2]}, "rooms": {"gte": 10, "lt": 200}, "locality": {"exists": True}, "contacts.phones[0]": {"exists": True}, "licensestatus": {"in": ["L", "P", None]}, "processing.status": {"eq": "processed"}}
    return facets.where_match(raw, tests).select("seq")


def looked_up(spark: SparkSession, d: str) -> DataFrame:
    """One hotel by its id, one by its unique name, none by an id that is none."""
    h = _hotels(spark, d)
    first = h.agg(F.min("_id").alias("i"), F.min_by("canonicalname", "_id").alias("n")).first()
    found = [facets.by_id(h, "_id", first.i), facets.unique_by(h, "canonicalname", first.n), facets.by_id(h, "_id", "no id"), facets.by_id(h, "_id", None)]
    return reduce(DataFrame.unionByName, [f.select(F.lit(i).alias("way"), "_id") for i, f in enumerate(found)])


def geo_counts(spark: SparkSession, d: str) -> DataFrame:
    return facets.geo_counts(table(spark, d, "canonical_hotels"), F.col("status"), F.col("geo.point"))


def without_geo(spark: SparkSession, d: str) -> DataFrame:
    """A page of the hotels that may be matched and have no point, by id."""
    h = _hotels(spark, d)
    return facets.page(h.where(facets.eligible(F.col("status"), F.col("verification")) & ~F.col("has_point")), [F.asc("_id")], "20", "5").select("_id")


def first_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The input of a limited match, latest first; with 0 all of it."""
    g = table(spark, d, "hotel_geo_candidates").dropDuplicates(["_id", "updatedat"]).select("_id", "updatedat")
    order = [F.desc("updatedat"), F.asc("_id")]
    some = facets.first_rows(g, order, "30")
    return some.select(F.lit("30").alias("asked"), "_id").unionByName(facets.first_rows(g, order, "0").select(F.lit("0").alias("asked"), "_id"))


def component_checks(spark: SparkSession, d: str) -> DataFrame:
    """Of each duplicate group, whether its members may stand for the first of them, grown or not, and in another order."""
    g = table(spark, d, "registry_duplicates").distinct().groupBy("dup_group").agg(F.collect_set("entryid").alias("new"), F.array(F.min("entryid")).alias("old"))
    return g.select("dup_group", states.like_components(F.col("old"), F.col("new"), F.lit(True)).alias("grown"), states.like_components(F.col("old"), F.col("new"), F.lit(False)).alias("same"), states.like_components(F.sort_array("new", False), F.col("new"), F.lit(False)).alias("reordered"))


def obsolete_singles(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the single candidates that duplicate groups have taken up."""
    g = table(spark, d, "registry_duplicates").select(F.concat(F.lit("ccv1|group|"), F.col("dup_group").cast("string")).alias("group_key"), F.col("entryid").alias("member_key"))
    return states.obsolete_singles(g)


# --- sources, places and hosts -------------------------------------------------------------------------------


def geojson_features(spark: SparkSession, d: str) -> DataFrame:
    """The beaches written as GeoJSON files, some hundred features each, and scanned; a file with one broken feature is refused whole."""
    at = _folder(spark)
    b = table(spark, d, "beach_profiles").select(F.col("source.id").alias("id"), F.col("datasetversion").alias("v"), "geometry", F.coalesce("sourceproperties", F.lit("{}")).alias("p")).distinct()
    one = F.concat(F.lit('{"type":"Feature","id":'), F.to_json(F.struct("id")).substr(F.lit(7), F.length(F.to_json(F.struct("id"))) - 7), F.lit(',"properties":'), "p", F.lit(',"geometry":'), "geometry", F.lit("}"))
    part = F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.lit(b.count() // 400)))
    packed = b.groupBy("v", part.alias("part")).agg(F.array_join(F.collect_list(one), ",").alias("f"))
    broken = F.when(F.col("v") == 1, F.lit(',{"type":"Feature"}')).otherwise(F.lit(""))
    packed.select("v", "part", F.concat(F.lit('{"type":"FeatureCollection","features":['), "f", broken, F.lit("]}")).alias("value")).write.partitionBy("v", "part").text(at)
    return read_features(spark, at).groupBy("kind", "failed").agg(F.count_distinct("id").alias("ids"), F.count_if(F.col("failed").isNull()).alias("n"))


def json_hashes(spark: SparkSession, d: str) -> DataFrame:
    """How many values of geometry each beach has had, by their hashes."""
    b = table(spark, d, "beach_profiles")
    return b.groupBy(F.col("source.id").alias("id")).agg(F.count_distinct(K.json_hash(F.col("geometry"))).alias("shapes"))


def parsed_coordinates(spark: SparkSession, d: str) -> DataFrame:
    """Points written as texts and read again; those out of range are none."""
    g = table(spark, d, "hotel_geo_candidates").dropDuplicates(["_id", "updatedat"]).select("_id", _xy("point", 0).alias("x"), _xy("point", 1).alias("y"))
    c = T.coordinates(F.format_string("%.7f, %.7f", "y", "x")).alias("c")
    return g.select(c).agg(F.count_if(F.col("c").isNotNull()).alias("read"), F.count_if(F.col("c").isNull()).alias("refused"))


def curated_targets(spark: SparkSession, d: str) -> DataFrame:
    """Of each hotel's edges the walk to the nearest of the beach's access points, here all places its edges have led to; a beach without any is walked to by its outline."""
    e = table(spark, d, "hotel_beach_access_edges").dropDuplicates(["_id"]).select("_id", "beachprofileid", _xy("hotelpoint", 0).alias("lng"), _xy("hotelpoint", 1).alias("lat"), "beachpoint").where(point_ok(F.col("lng"), F.col("lat")))
    to = e.where("beachpoint is not null").groupBy("beachprofileid").agg(F.array_sort(F.collect_set("beachpoint.coordinates")).alias("access"))
    own = F.array(F.array(F.lit(0.0), F.lit(0.0)))
    t = e.join(to, "beachprofileid").select("_id", "lng", "lat", geo.target_points(F.lit("POINT"), F.lit("{}"), F.lit(0.0), F.lit(0.0), F.col("lng"), F.col("lat"), F.coalesce("access", own)).alias("t"))
    r = geo.best_routes(t.select("_id", "lng", "lat", F.explode("t").alias("p")).select("_id", "lng", "lat", F.get("p", F.lit(0)).alias("to_lng"), F.get("p", F.lit(1)).alias("to_lat")), ["_id"])
    return r.select("_id", "metres", "seconds", F.size("alternatives").alias("others"))


def edge_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Edges computed anew, some for a later version: by beach, hotel and version new ones replace old ones, older versions stay, and ids once given are kept."""
    e = table(spark, d, "hotel_beach_access_edges").dropDuplicates(["canonicalhotelid", "beachprofileid", "datasetversion"])
    old = e.select("beachprofileid", "canonicalhotelid", "datasetversion", "_id", "status")
    new = old.where(F.ascii(F.substring("_id", -1, 1)) % 2 == 0).withColumn("datasetversion", F.col("datasetversion") + F.when(F.ascii(F.substring("_id", -1, 1)) % 4 == 0, 1).otherwise(0)).withColumn("_id", F.concat(F.lit("n-"), "_id")).withColumn("status", F.lit("recomputed"))
    return merge.upsert(old, new, ["beachprofileid", "canonicalhotelid", "datasetversion"], ["_id"]).groupBy("datasetversion", "status").agg(F.count("*").alias("n"), F.count_if(F.col("_id").startswith("n-")).alias("new_ids"))


def host_variants(spark: SparkSession, d: str) -> DataFrame:
    """The hosts of raw rows' first websites in the three ways they're compared."""
    w = F.get("contacts.websites", F.lit(0))
    return table(spark, d, "raw_hotels").select("seq", T.host_of(w).alias("matching"), T.host_registry(w).alias("registry"), T.host_strict(w).alias("strict"))


QUERIES = {
    f.__name__: f
    for f in (
        applied_matches, bound_candidates, placed_hotels, manual_points, item_parents, matches_and_suggestions, work_states, recovered_claims, stage_gate, run_lifecycle, run_ids, latest_runs, rolled_back,
        release_metrics, first_release, release_copy, chosen_release, matched_rows, looked_up, geo_counts, without_geo, first_candidates, component_checks, obsolete_singles,
        geojson_features, json_hashes, parsed_coordinates, curated_targets, edge_upsert, host_variants,
    )
}

_BIND = f"""
g as (select distinct on (_id) _id as cid, {_mn('name')} as n, point.coordinates[1] as lng, point.coordinates[2] as lat from hotel_geo_candidates where source.importrunid = {_LAST} and {_mn('name')} <> ''),
h as (select _id as hid, {_mn('canonicalname')} as n, geo.source as src, geo.point.coordinates[1] as lng, geo.point.coordinates[2] as lat from canonical_hotels),
o as (select n, min(hid) as hid from h group by n),
f as (select n, min(cid) as lo from g group by n),
m as (select g.cid, g.lng, g.lat, o.hid, g.cid = f.lo as lead, case when g.cid <> f.lo and right(g.cid, 1) in ('1', '3', '5', '7', '9') then o.hid end as at from g join f using (n) left join o using (n)),
a as (select m.cid, m.hid, m.lng, m.lat, case when exists (select 1 from m x where x.at = m.hid and x.cid <> m.cid) or (select src from h where h.hid = m.hid) <> 'hotel_geo_candidate:' || m.cid then 'CONFLICT' else 'AUTO_MATCHED' end as action
  from m where lead and hid is not null)"""
_W = """w as (select _id, seq, case when seq % 50 = 0 then 'pending' else processing.status end as status, case when seq % 50 = 0 then null else processing.hotelregistryentryid end as target, case when seq % 50 = 0 then null else processing.error end as error,
  case when seq % 50 = 0 then null else processing.claimedat end as claimed from raw_hotels)"""
_VER = "case when geo.source = 'manual' then 'location_verified' when operator is null then 'location_unverified' else 'unreviewed' end"
_HOST = "regexp_extract(trim({0}), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/?#:]+)', 2)"
_WEB = "list_extract(contacts.websites, 1)"
_FIRST = "(select distinct _id, datasetversion, case when ascii(right(_id, 1)) % 2 = 0 then datasetversion end as v from {})"

SQL = {
    "applied_matches": f"with {_BIND} select cid, hid, action from a",
    "bound_candidates": f"""with {_BIND} select m.cid, case when a.action = 'AUTO_MATCHED' then a.hid else m.at end as canonicalhotelid, case when a.action = 'AUTO_MATCHED' then 'AUTO_MATCHED' when m.at is not null then 'CONFIRMED' else 'UNMATCHED' end as matchstatus,
        case when a.action = 'AUTO_MATCHED' then 'AUTO_MATCH,RAW_EXACT_NAME,SCORE:80' else '' end as reasons from m left join a on a.cid = m.cid""",
    "placed_hotels": f"with {_BIND} select h.hid, case when a.hid is null then h.lng else a.lng end as lng, case when a.hid is null then h.lat else a.lat end as lat, case when a.hid is null then h.src else 'hotel_geo_candidate:' || a.cid end as geo_source from h left join a on a.hid = h.hid and a.action <> 'CONFLICT'",
    "manual_points": f"with {_BIND} select h.hid, case when a.hid is null and (h.src is null or h.src = 'manual') then 'MANUAL_GEO_SET' else 'CONFLICT' end as action from h left join a on a.hid = h.hid and a.action <> 'CONFLICT'",
    "item_parents": "select e._id, case when h.status = 'active' and h.geo.point is not null then 'computable' else 'skipped' end as outcome from (select distinct on (_id) _id, canonicalhotelid from hotel_beach_access_edges) e left join canonical_hotels h on h._id = e.canonicalhotelid",
    "matches_and_suggestions": f"with {_BIND} select hid, cid from a where action <> 'CONFLICT' union all select hid, cid from a",
    "work_states": f"""with {_W}, b as (select *, _id in (select _id from w where status = 'pending' order by _id limit 100) as mine from w),
        e as (select *, mine and seq % 11 <> 0 as ended, case seq % 7 when 0 then 'failed' when 1 then 'ignored' when 2 then 'review_required' else 'processed' end as kind from b),
        r as (select case when ended and kind = 'review_required' then 'pending' when ended then kind when mine then 'claimed' else status end as status, case when ended and kind = 'failed' then 'bad row' when ended then null else error end as error,
          case when ended and kind = 'processed' then 't-' || _id when ended and kind = 'review_required' then null else target end as target, case when ended then null when mine then 1 when claimed is not null then 1 end as cl, mine and not (ended and kind = 'review_required') as own from e)
        select status, error, count(*) as n, count(target) as targets, count(cl) as claims, count(*) filter (own) as of_run from r group by 1, 2""",
    "recovered_claims": """with w as (select case when seq % 3 = 0 then 'claimed' else processing.status end as status, seq % 2 = 0 as old from raw_hotels)
        select case when status = 'claimed' and old then 'pending' else status end as status, count(*) as n, count(*) filter (not (status = 'claimed' and old)) as claims from w group by 1""",
    "stage_gate": """with s as (select count(*) filter (processing.status = 'pending') as pending, count(*) filter (processing.status = 'claimed') as claimed, count(*) filter (processing.status = 'failed') as failed from raw_hotels)
        select pending + claimed + failed = 0 as open, pending + claimed + failed as blocking, pending, claimed, failed from s""",
    "run_lifecycle": """with s as (select count(*) as total, count(*) filter (processing.status = 'processed') as processed, count(*) filter (processing.status = 'failed') as failed, count(*) filter (processing.status = 'ignored') as ignored from raw_hotels where processing.status <> 'pending')
        select 'a' as run_id, 'stage-2' as stage, case when failed > 0 then 'failed' when processed + failed + ignored >= total then 'completed' else 'running' end as status, total, processed, failed, ignored, case when failed > 0 then failed || ' rows failed' end as error from s
        union all select 'a-loose', 'stage-2', case when processed + failed + ignored >= total then 'completed' else 'running' end, total, processed, failed, ignored, null from s
        union all select 'c', 'stage-3', 'queued', 1, 0, 0, 0, null union all select 'c-loose', 'stage-3', 'queued', 1, 0, 0, 0, null""",
    "run_ids": "select runid as run_id from hotel_beach_access_edges where runid is not null union select processing.runid from hotel_registry_entries where processing.runid is not null",
    "latest_runs": "select strftime(startedat::timestamp, '%Y-%m-%dT%H-%M-%S') || '-' || lower(importkind) as run from geo_import_runs where status = 'COMPLETED' order by startedat desc, run limit 1",
    "rolled_back": "select case when seq % 5 = 0 then null else 'run-1' end as run_id, count(*) as sources, case when seq % 5 = 0 then null else count(*) end as targets from raw_hotels group by seq % 5 = 0, 1".replace("case when seq % 5 = 0 then null else count(*) end", "case when any_value(seq % 5 = 0) then null else count(*) end").replace("group by seq % 5 = 0, 1", "group by 1"),
    "release_metrics": f"select count(*) as total, count(*) filter ({_VER} = 'location_verified') as verified, count(*) filter ({_VER} <> 'unreviewed') as manually_checked, count(*) filter (geo.point is null) as without_geo from canonical_hotels where datasetversion = 4",
    "first_release": " union all ".join(f"select '{n}' as dataset, 1 as version, 'published' as status, count(*) as total from {_FIRST.format(t)} where coalesce(v, 1) = 1" for n, t in (("hotels", "canonical_hotels"), ("beaches", "beach_profiles"), ("edges", "hotel_beach_access_edges"))),
    "release_copy": "select 'beaches' as dataset, 4 as version, count(*) as n, count(distinct _id) as ids from beach_profiles where datasetversion = 4 union all select 'edges', 7, count(*), count(distinct _id) from hotel_beach_access_edges",
    "chosen_release": "select * from (select 'r-' || datasetversion as release_key, datasetversion as version from beach_profiles where datasetversion < 4 group by datasetversion order by max(updatedat) desc, datasetversion desc limit 1) union all select 'r-1', 1 union all select 'r-2', 2",
    "matched_rows": """select seq from raw_hotels where region is not null and (stars is null or stars not in (1, 2)) and rooms >= 10 and rooms < 200 and locality is not null and list_extract(contacts.phones, 1) is not null
        and (licensestatus is null or licensestatus in ('L', 'P')) and processing.status = 'processed'""",
    "looked_up": "select unnest([0, 1]) as way, min(_id) as _id from canonical_hotels",
    "geo_counts": "select count(geo.point) as with_geo, count(*) - count(geo.point) as without_geo from canonical_hotels where status = 'active'",
    "without_geo": f"select _id from canonical_hotels where status = 'active' and {_VER} <> 'location_unverified' and geo.point is null order by _id limit 20 offset 5",
    "first_candidates": "with g as (select distinct on (_id, updatedat) _id, updatedat from hotel_geo_candidates) select * from (select '30' as asked, _id from g order by updatedat desc, _id limit 30) union all select '0', _id from g",
    "component_checks": "select dup_group, true as grown, count(distinct entryid) = 1 as same, true as reordered from registry_duplicates group by 1",
    "obsolete_singles": "select distinct 'ccv1|single|' || entryid as key from registry_duplicates where dup_group in (select dup_group from registry_duplicates group by 1 having count(distinct entryid) > 1)",
    "geojson_features": """with b as (select distinct datasetversion as v, source.id as id, geometry, sourceproperties, json_extract_string(geometry::json, '$.type') as kind from beach_profiles)
        select kind, null::varchar as failed, count(distinct id) as ids, count(*) as n from b where v <> 1 group by 1 union all select null, 'file', 0, 0""",
    "json_hashes": "select source.id as id, count(distinct geometry::json::varchar) as shapes from beach_profiles group by 1",
    "parsed_coordinates": """with g as (select distinct on (_id, updatedat) point.coordinates[1] as x, point.coordinates[2] as y from hotel_geo_candidates)
        select count(*) filter (abs(x) <= 180 and abs(y) <= 90) as read, count(*) - count(*) filter (abs(x) <= 180 and abs(y) <= 90) as refused from g""",
    "curated_targets": """with e as (select distinct on (_id) _id, beachprofileid as b, hotelpoint.coordinates[1] as x, hotelpoint.coordinates[2] as y, beachpoint from hotel_beach_access_edges),
        ok as (select * from e where abs(x) <= 180 and abs(y) <= 90 and not (x = 0 and y = 0)),
        t as (select distinct b, beachpoint.coordinates[1] as bx, beachpoint.coordinates[2] as by_ from ok where beachpoint is not null),
        r as (select _id, floor(2 * 6371000 * asin(least(1.0, sqrt(pow(sin(radians(by_ - y) / 2), 2) + cos(radians(y)) * cos(radians(by_)) * pow(sin(radians(bx - x) / 2), 2)))) + 0.5)::bigint as m from ok join t using (b))
        select _id, min(m) as metres, ceil(min(m) / 1.25)::bigint as seconds, least(2, count(*) - 1)::int as others from r group by 1""",
    "edge_upsert": """with e as (select distinct canonicalhotelid, beachprofileid, datasetversion as v, min(_id) over (partition by canonicalhotelid, beachprofileid, datasetversion) as i from hotel_beach_access_edges),
        s as (select distinct on (canonicalhotelid, beachprofileid, datasetversion) canonicalhotelid as h, beachprofileid as b, datasetversion as v, _id as i, status from hotel_beach_access_edges),
        n as (select h, b, v + case when ascii(right(i, 1)) % 4 = 0 then 1 else 0 end as v, 'n-' || i as i from s where ascii(right(i, 1)) % 2 = 0),
        u as (select coalesce(n.v, s.v) as v, coalesce(s.i, n.i) as i, case when n.h is null then s.status else 'recomputed' end as status from s full join n on n.h = s.h and n.b = s.b and n.v = s.v)
        select v as datasetversion, status, count(*) as n, count(*) filter (i like 'n-%') as new_ids from u group by 1, 2""",
    "host_variants": f"""select seq, nullif(regexp_replace(regexp_extract(regexp_replace(regexp_replace(lower(trim({_WEB})), '^[a-z][a-z0-9+.-]*://', ''), '^[^/?#@]*@', ''), '^[^/?#:]+'), '^www\\.', ''), '') as matching,
        regexp_replace(lower(trim(case when {_HOST.format(_WEB)} <> '' then {_HOST.format(_WEB)} else regexp_extract(regexp_replace({_WEB}, '^https?://', ''), '^([^/]*)', 1) end)), '^www\\.', '') as registry,
        case when {_HOST.format(_WEB)} <> '' then lower(regexp_replace({_HOST.format(_WEB)}, '(?i)^www\\.', '')) end as strict from raw_hotels""",
}
