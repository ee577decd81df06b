"""Queries of the core operators over the delivered tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.functions import keys as K
from meridia.functions import text as T
from meridia.operators import dedupe, facets, geo, grouping, infile, matching, merge, rules, runs
from meridia.operators.proximity import point_ok
from meridia.operators.snapshots import file_date
from meridia.session import cut, table
from meridia.sources import files

#: Beaches of each hotel point, which its routes are computed to; suggestions of a hotel; edges of a hotel; import runs listed.
NEAREST_BEACHES, SUGGESTIONS, ADJACENT, RECENT_RUNS = 20, 5, 20, 50


def text_names(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("name")
    made = {"name_text": T.name_text(n), "plain": T.plain_text(n), "match": T.match_name(n), "reduced": T.reduced_name(n), "hotel": T.hotel_name(n), "match_key": T.name_match_key(n), "ident": T.identity_text(F.col("operatorname")), "place": T.place_text(F.col("locality"))}
    return table(spark, d, "raw_hotels").select("seq", *[c.alias(k) for k, c in made.items()])


def text_keys(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(spark, d, "raw_hotels").select(
        "seq",
        K.strict_key(c("name"), c("postcode"), c("contacts.phones"), c("rooms"), c("beds")).alias("strict_key"),
        K.soft_key(c("name"), c("postcode"), c("contacts.phones"), c("rooms"), c("beds")).alias("soft_key"),
        K.merge_key(c("name"), c("establishmenttype"), c("region"), c("locality"), c("postcode"), c("operatorname"), c("contacts.phones")).alias("merge_key"),
        K.registry_key(c("name"), c("establishmenttype"), c("region"), c("locality"), c("postcode"), c("address")).alias("registry_key"),
        K.component_key(c("name"), c("establishmenttype"), c("postcode"), c("address")).alias("component_key"),
    )


def canonical_keys(spark: SparkSession, d: str) -> DataFrame:
    c, at, of = F.col, "location.", "contacts."
    return table(spark, d, "canonical_hotels").select(
        "_id",
        K.canonical_key(c("kind"), c("canonicalname"), c(at + "district"), c(at + "locality"), c(at + "postcode"), c(at + "address"), c("operator"), c(of + "phones"), c(of + "emails")).alias("key"),
        K.strong_identity(c("canonicalname"), c(at + "district"), c(at + "locality"), c(at + "postcode"), c(at + "address"), c("operator"), c(of + "phones"), c(of + "emails")).alias("strong"),
        K.contacts_key(c(of + "phones"), c(of + "emails"), c(of + "websites"), c(of + "domains")).alias("contacts_key"),
    )


def name_class_repair(spark: SparkSession, d: str) -> DataFrame:
    r, k = T.repair_name_class(F.col("name"), F.col("classraw")).alias("r"), T.repair_capacity(F.col("rooms"), F.col("beds")).alias("k")
    return table(spark, d, "raw_hotels").select("seq", r, k).select("seq", F.col("r.name").alias("name"), F.col("r.class").alias("class_raw"), F.col("k.rooms").alias("rooms"), F.col("k.beds").alias("beds"))


def location_repair(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_hotels").select("seq", T.repair_location(F.col("address"), F.col("postcode"), F.col("locality")).alias("l")).select("seq", "l.*")


def contact_keys(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("contacts.emails")
    return table(spark, d, "raw_hotels").select(
        "seq",
        T.postcode_key(F.col("postcode")).alias("postcode_key"),
        F.array_join(T.phone_list(F.col("contacts.phones")), ",").alias("phones"),
        T.phone_match(F.get("contacts.phones", F.lit(0))).alias("phone_match"),
        T.email_key(F.get(e, F.lit(0))).alias("email"),
        T.email_domain(F.get(e, F.lit(0))).alias("email_domain"),
        T.host_of(F.get("contacts.websites", F.lit(0))).alias("host"),
    )


def phone_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_hotels").select("seq", F.array_join(T.phones_in(F.col("contacts.phones")), ",").alias("phones"))


def website_kinds(spark: SparkSession, d: str) -> DataFrame:
    k = T.website_kind(F.col("contacts.websites"), F.col("contacts.domains")).alias("k")
    return table(spark, d, "canonical_hotels").select("_id", k, F.array_join(T.website_list(F.col("contacts.websites")), " ").alias("links")).select("_id", F.col("k.declared").alias("declared"), F.col("k.kind").alias("kind"), "links")


def suffix_numbers(spark: SparkSession, d: str) -> DataFrame:
    s = T.suffix_split(T.hotel_name(F.col("name"))).alias("s")
    return table(spark, d, "raw_hotels").select("seq", s).select("seq", F.col("s.base").alias("base"), F.col("s.suffix").alias("suffix"), T.suffix_number(F.col("s.suffix")).alias("number"))


def address_forms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_hotels").select("seq", T.address_form(F.col("address")).alias("address"), T.address_form(F.col("address"), False).alias("address_plain"), T.locality_form(F.col("locality")).alias("locality"))


def file_names(spark: SparkSession, d: str) -> DataFrame:
    f = F.col("sourcefile.filename")
    return table(spark, d, "raw_hotels").groupBy(f.alias("filename")).agg(F.count("*").alias("n")).select("filename", file_date(F.col("filename")).alias("day"), T.file_region(F.col("filename")).alias("region"), "n")


def beach_types(spark: SparkSession, d: str) -> DataFrame:
    surface = F.get_json_object("sourceproperties", "$.surface")
    kind = geo.geometry_kind(F.get_json_object("geometry", "$.type"))
    return table(spark, d, "beach_profiles").groupBy("datasetversion", T.beach_type(surface).alias("beach_type"), kind.alias("kind")).agg(F.count("*").alias("n"))


def _tag(*names: str):
    return F.array_compact(F.array(*[F.get_json_object("sourceproperties", f"$['{n}']") for n in names]))


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    filled = lambda a: F.array_distinct(F.filter(a, lambda x: x.isNotNull() & (x != "")))
    tag = lambda t, a, f: F.transform(a, lambda x: F.concat(F.lit(t), f(x)))
    strong = lambda a: F.filter(a, lambda x: ~T.in_shared(F.regexp_extract(x, "^(?:[^@]*@|d:)(.*)$", 1)))
    contacts = lambda p, e, w: filled(F.concat(tag("p:", p, T.phone_match), strong(tag("e:", e, T.email_key)), strong(tag("d:", w, T.host_of))))
    shared = lambda e, w: filled(F.filter(F.concat(tag("e:", e, T.email_key), tag("d:", w, T.host_of)), lambda x: T.in_shared(F.regexp_extract(x, "^(?:[^@]*@|d:)(.*)$", 1))))
    named = lambda f, c: filled(F.array(f(c)))
    last = table(spark, d, "geo_import_runs").where("status = 'COMPLETED' and importkind = 'HOTELS'").agg(F.max_by("_id", F.struct("startedat", "_id")).alias("run"))
    g = table(spark, d, "hotel_geo_candidates").join(last, F.col("source.importrunid") == F.col("run"), "left_semi").dropDuplicates(["_id"])
    phones, mails, sites = _tag("phone", "contact:phone", "contact:mobile"), _tag("email", "contact:email"), _tag("website", "contact:website", "url")
    has = lambda n: F.get_json_object("sourceproperties", f"$['{n}']").isNotNull().cast("int")
    kind = F.when(F.col("source.id").startswith("relation/"), 8).when(F.col("source.id").startswith("way/"), 5).otherwise(0)
    text = lambda c: F.when(T.match_name(c) != "", T.match_name(c))
    one = lambda n: F.get_json_object("sourceproperties", f"$['{n}']")
    candidates = g.select(
        F.col("_id").alias("cid"), (30 * has("phone") + 25 * has("email") + 20 * has("website") + 10 * has("stars") + kind).alias("richness"),
        named(T.match_name, F.col("name")).alias("raw_names"), named(T.reduced_name, F.col("name")).alias("reduced_names"),
        contacts(phones, mails, sites).alias("contacts"), shared(mails, sites).alias("shared_contacts"),
        text(one("addr:postcode")).alias("postcode"), text(one("addr:street")).alias("street"), text(one("addr:city")).alias("city"),
    )
    h = table(spark, d, "canonical_hotels").where("status = 'active'")
    of = lambda n: F.coalesce(F.col(f"contacts.{n}"), F.array().cast("array<string>"))
    hotels = h.select(
        F.col("_id").alias("hid"), named(T.match_name, F.col("canonicalname")).alias("raw_names"), named(T.reduced_name, F.col("canonicalname")).alias("reduced_names"),
        contacts(of("phones"), of("emails"), of("websites")).alias("contacts"), shared(of("emails"), of("websites")).alias("shared_contacts"),
        text(F.col("location.postcode")).alias("postcode"), text(F.col("location.address")).alias("street"), text(F.col("location.locality")).alias("city"),
    )
    return candidates, hotels


def scored_matches(spark: SparkSession, d: str) -> DataFrame:
    return matching.proposals(*_sides(spark, d)).select("cid", "hid", "score", "reason", F.round("name_score", 6).alias("name_score"), "richness")


def mutual_matches(spark: SparkSession, d: str) -> DataFrame:
    return matching.mutual_best(cut(matching.proposals(*_sides(spark, d)))).select("cid", "hid", "score", "reason")


def match_reviews(spark: SparkSession, d: str) -> DataFrame:
    found = cut(matching.proposals(*_sides(spark, d)))
    return matching.review_suggestions(found, matching.mutual_best(found))


def match_suggestions(spark: SparkSession, d: str) -> DataFrame:
    candidates, hotels = _sides(spark, d)
    top = matching.attach_top(hotels.select("hid"), matching.proposals(candidates, hotels), "hid", "cid", SUGGESTIONS)
    return top.select("hid", F.size(F.coalesce("suggestions", F.array())).alias("n"), F.array_join(F.transform("suggestions", lambda x: x.cid), ",").alias("cids"))


def unmatched_hotels(spark: SparkSession, d: str) -> DataFrame:
    candidates, hotels = _sides(spark, d)
    return hotels.join(matching.proposals(candidates, hotels).select("hid"), "hid", "left_anti").select("hid")


def _raw_key(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "raw_hotels")
    return raw.select(F.col("sourcefile.filename").alias("filename"), F.col("stricthoteldedupekey").alias("strict"), "seq", "name", "rooms", "beds")


def dedupe_last(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.keep_last(_raw_key(spark, d), ["filename", "strict"], "seq")


def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.keep_first(_raw_key(spark, d), ["filename", "strict"], "seq")


def soft_conflicts(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    keyed = table(spark, d, "raw_hotels").select(K.soft_key(c("name"), c("postcode"), c("contacts.phones"), c("rooms"), c("beds")).alias("soft"), c("stricthoteldedupekey").alias("strict"))
    return dedupe.conflicts(keyed, "soft", "strict")


def strong_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Pairs within one file of like identity that share an e-mail address or website; equal rows are reduced to their first before any pair is made."""
    raw = table(spark, d, "raw_hotels").where("postcode is not null and operatorname is not null and rooms is not null and beds is not null")
    ident = K.joined(F.col("sourcefile.filename"), T.hotel_name(F.col("name")), T.identity_text(F.col("establishmenttype")), T.postcode_key(F.col("postcode")), T.identity_text(F.col("operatorname")), F.col("rooms"), F.col("beds"))
    tokens = F.array_distinct(F.concat(F.transform("contacts.emails", lambda x: F.lower(F.trim(x))), F.transform("contacts.websites", lambda x: F.lower(F.trim(x)))))
    r = raw.select("seq", ident.alias("ident"), F.coalesce(tokens, F.array().cast("array<string>")).alias("tokens"))
    one = r.select("seq", "ident", F.explode("tokens").alias("token"))
    first = one.groupBy("ident", "token").agg(F.min("seq").alias("first_seq"))
    return one.join(first, ["ident", "token"]).where("seq > first_seq").select("first_seq", "seq").distinct()


def resolved_rows(spark: SparkSession, d: str) -> DataFrame:
    """Each file's rows after resolution in reading order."""
    return infile.resolve_in_file(table(spark, d, "raw_hotels")).select("filename", "seq", "merged", "name", "address", "locality", "rooms", "beds", F.array_join("phones", ",").alias("phones"))


def survivor_merge(spark: SparkSession, d: str) -> DataFrame:
    """One record of each group: the operator of the first row that has one, the most telling location, all contacts, strict sums."""
    e, g = table(spark, d, "hotel_registry_entries").dropDuplicates(["_id"]), table(spark, d, "registry_duplicates")
    j = g.join(e, F.col("entryid") == F.col("_id"))
    loc = F.struct(dedupe.location_score(F.col("location.district"), F.col("location.locality"), F.col("location.postcode"), F.col("location.address")).alias("s"), F.col("_id").alias("i"))
    j = j.withColumn("loc", loc).withColumn("rooms", F.col("capacity.rooms"))
    lists = ("phones", "emails", "websites", "domains")
    for f in lists:
        j = j.withColumn(f, F.col(f"contacts.{f}"))
    return j.groupBy("dup_group").agg(
        F.max_by("location.address", "loc").alias("address"), F.max("loc.s").alias("location_score"), dedupe.first_filled("operator", "_id").alias("operator"),
        *[F.array_join(dedupe.sorted_union(f), ",").alias(f) for f in lists], dedupe.strict_sum("rooms").alias("rooms_sum"), F.count("*").alias("n"),
    )


def capacity_merge(spark: SparkSession, d: str) -> DataFrame:
    e, g = table(spark, d, "hotel_registry_entries").dropDuplicates(["_id"]), table(spark, d, "registry_duplicates")
    j = g.join(e, F.col("entryid") == F.col("_id")).select("dup_group", "_id", "capacity")
    return dedupe.merged_capacities(j.select("dup_group", "_id", "capacity.rooms", "capacity.beds"), "dup_group", "_id")


def quality_issues(spark: SparkSession, d: str) -> DataFrame:
    issues = dedupe.quality_issues(F.col("name"), [F.col("establishmenttype"), F.col("region"), F.col("locality")], F.col("rooms"), F.col("beds"))
    return table(spark, d, "raw_hotels").select(F.array_join(issues, ",").alias("issues")).groupBy("issues").agg(F.count("*").alias("n"))


def strict_sums(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_hotels").groupBy("region", "establishmenttype").agg(dedupe.strict_sum("rooms").alias("rooms"), dedupe.strict_sum("beds").alias("beds"), F.count("*").alias("n"))


def facet_stats(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "beach_profiles").select(F.col("lifecycle.status").alias("lifecycle"), "geometrykind", "beachtype", F.col("quality.status").alias("quality"))
    return facets.facets(b, {"lifecycle": ["ACTIVE", "STALE", "REMOVED_FROM_SOURCE"], "geometrykind": ["POINT", "LINE", "AREA"], "beachtype": ["SAND", "PEBBLE", "ROCK", "MIXED", "UNKNOWN"], "quality": None})


def filled_counts(spark: SparkSession, d: str) -> DataFrame:
    one = lambda *n: facets.filled_any([F.get_json_object("sourceproperties", f"$['{x}']") for x in n])
    g = table(spark, d, "hotel_geo_candidates")
    return g.groupBy(F.col("source.importrunid").alias("run")).agg(
        F.count_if(F.coalesce(F.col("name") != "", F.lit(False))).alias("with_name"), F.count_if(one("phone", "contact:phone", "contact:mobile")).alias("with_phone"), F.count_if(one("website", "contact:website", "url")).alias("with_website"), F.count("*").alias("n")
    )


def list_page(spark: SparkSession, d: str) -> DataFrame:
    g = facets.where_all(table(spark, d, "hotel_geo_candidates").dropDuplicates(["_id", "updatedat"]), matchstatus="UNMATCHED", componentid=None)
    found = facets.text_search(g, "royal", ["name", "normalizedname", "sourceproperties"])
    return facets.page(found.select("_id", "name", "updatedat"), [F.desc("updatedat"), F.asc("_id")], "25", 10).select("_id", "name")


def adjacency(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "hotel_beach_access_edges").dropDuplicates(["_id"]).select("_id", "canonicalhotelid", "beachprofileid", "walkingdistancemeters", "straightdistancemeters", "status")
    return facets.top_per_key(e, "canonicalhotelid", [F.asc_nulls_first("walkingdistancemeters"), F.asc_nulls_first("straightdistancemeters"), F.asc("_id")], ADJACENT)


def recent_runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "geo_import_runs").orderBy(F.desc("startedat"), "_id").limit(RECENT_RUNS).select("_id", "importkind", "status")


def clique_groups(spark: SparkSession, d: str) -> DataFrame:
    """Names within one file of several rows that all share an e-mail address with each other and contradict each other in no postcode."""
    code = F.when(T.postcode_key(F.col("postcode")) != "", T.postcode_key(F.col("postcode")))
    facts = F.struct(F.array_sort(F.array_distinct(F.coalesce("contacts.emails", F.array().cast("array<string>")))).alias("mails"), code.alias("code"))
    block = K.joined(F.col("sourcefile.filename"), T.suffix_split(T.hotel_name(F.col("name"))).base).alias("block")
    m = table(spark, d, "raw_hotels").select(block, F.col("seq").alias("id"), facts.alias("x"))
    return rules.agreeing_blocks(m, "block", lambda l, r: grouping.overlaps(l.mails, r.mails) & F.coalesce(l.code == r.code, F.lit(True)))


def shadow_aggregates(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose total is the sum of three or more lines within a fifth."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("price"))
    return grouping.shadow_aggregates(o, li, "o_orderkey", ["price"]).select("o_orderkey", "parts", F.round("sum_price", 2).alias("sum_price"))


def capacity_collapse(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "raw_hotels").select(K.joined(F.col("sourcefile.filename"), T.suffix_split(T.hotel_name(F.col("name"))).base).alias("block"), "seq", "establishmenttype", "rooms", "beds")
    return grouping.collapse_candidates(raw, "block", "seq", "establishmenttype", "rooms", "beds")


def similar_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Distinct address forms of one file and postcode with the same leading number and few edits."""
    raw = table(spark, d, "raw_hotels").where("address is not null and postcode is not null")
    a = raw.select(F.col("sourcefile.filename").alias("filename"), T.postcode_key(F.col("postcode")).alias("code"), T.address_form(F.col("address")).alias("address")).distinct()
    a = a.withColumn("number", grouping.leading_number(F.col("address"))).where("number is not null")
    p = a.alias("l").join(a.alias("r"), ["filename", "code", "number"]).where("l.address < r.address")
    return p.where(grouping.similar_address(F.col("l.address"), F.col("r.address"))).select("filename", F.col("l.address").alias("a"), F.col("r.address").alias("b"))


def edge_distances(spark: SparkSession, d: str) -> DataFrame:
    xy = lambda p, i: F.get(F.col(f"{p}.coordinates"), F.lit(i))
    e = table(spark, d, "hotel_beach_access_edges").dropDuplicates(["_id"]).where("hotelpoint is not null and beachpoint is not null")
    m = geo.rounded_m(xy("hotelpoint", 0), xy("hotelpoint", 1), xy("beachpoint", 0), xy("beachpoint", 1))
    return e.select("_id", m.alias("metres"), F.ceil(m / geo.WALKING_M_S).cast("long").alias("seconds"))


def _points(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    xy = lambda i: F.get(F.col("point.coordinates"), F.lit(i))
    last = table(spark, d, "geo_import_runs").where("status = 'COMPLETED' and importkind = 'HOTELS'").agg(F.max_by("_id", F.struct("startedat", "_id")).alias("run"))
    g = table(spark, d, "hotel_geo_candidates").join(last, F.col("source.importrunid") == F.col("run"), "left_semi").dropDuplicates(["_id"])
    b = table(spark, d, "beach_profiles").where("datasetversion = 4 and lifecycle.status = 'ACTIVE'").dropDuplicates(["_id"])
    pick = lambda t, k: t.select(F.col("_id").alias(k), xy(0).alias("lng"), xy(1).alias("lat")).where(point_ok(F.col("lng"), F.col("lat")))
    return pick(g, "pid"), pick(b, "cid")


def radius_search(spark: SparkSession, d: str) -> DataFrame:
    points, _ = _points(spark, d)
    return geo.radius_search(points.withColumnRenamed("pid", "id"), 33.0, 35.0, 10_000, 50).select("id", F.round("metres", 3).alias("metres"))


def nearest_beaches(spark: SparkSession, d: str) -> DataFrame:
    points, beaches = _points(spark, d)
    return geo.nearest(points, beaches, NEAREST_BEACHES).select("pid", "cid", F.round("metres", 3).alias("metres"), "rank")


def representative_points(spark: SparkSession, d: str) -> DataFrame:
    m = geo.mean_point(geo.vertices(F.col("geometry"))).alias("m")
    return table(spark, d, "beach_profiles").select("_id", "datasetversion", m).select("_id", "datasetversion", F.round("m.lng", 9).alias("lng"), F.round("m.lat", 9).alias("lat"))


def beach_routes(spark: SparkSession, d: str) -> DataFrame:
    """The shortest straight walk from each point to each of its nearest beaches, with alternatives."""
    points, beaches = _points(spark, d)
    shape = table(spark, d, "beach_profiles").where("datasetversion = 4").dropDuplicates(["_id"]).select(F.col("_id").alias("cid"), "geometry", geo.geometry_kind(F.get_json_object("geometry", "$.type")).alias("kind"))
    n = geo.nearest(points, beaches, NEAREST_BEACHES).join(points, "pid").join(beaches.select("cid", F.col("lng").alias("blng"), F.col("lat").alias("blat")), "cid").join(shape, "cid")
    t = n.withColumn("t", F.explode(geo.target_points(F.col("kind"), F.col("geometry"), F.col("blng"), F.col("blat"), F.col("lng"), F.col("lat"))))
    r = geo.best_routes(t.select("pid", "cid", "lng", "lat", F.get("t", F.lit(0)).alias("to_lng"), F.get("t", F.lit(1)).alias("to_lat")), ["pid", "cid"])
    return r.select("pid", "cid", "metres", "seconds", F.array_join(F.transform("alternatives", lambda x: x.cast("string")), ",").alias("alternatives"))


def _beach(spark: SparkSession, d: str, version: int) -> DataFrame:
    b = table(spark, d, "beach_profiles").where(F.col("datasetversion") == version)
    return b.select("_id", F.get_json_object("sourceproperties", "$.surface").alias("surface"), F.get_json_object("sourceproperties", "$.name").alias("label"), F.col("lifecycle.status").alias("status")).dropDuplicates(["_id"])


def hash_diff_upsert(spark: SparkSession, d: str) -> DataFrame:
    return merge.hash_diff(_beach(spark, d, 3), _beach(spark, d, 4), ["_id"], ["surface", "label", "status"])


def upsert_counts(spark: SparkSession, d: str) -> DataFrame:
    return merge.action_counts(merge.hash_diff(_beach(spark, d, 1), _beach(spark, d, 4), ["_id"], ["surface", "label", "status"]))


def upsert_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return merge.upsert(_beach(spark, d, 1), _beach(spark, d, 4), ["_id"], ["label"])


def stale_marks(spark: SparkSession, d: str) -> DataFrame:
    old = _beach(spark, d, 1).withColumn("stale_since", F.lit(None).cast("timestamp"))
    return merge.mark_stale(old, _beach(spark, d, 4), ["_id"], F.timestamp_seconds(F.lit(1_760_000_000))).select("_id", F.col("stale_since").isNotNull().alias("stale"))


def fill_merge(spark: SparkSession, d: str) -> DataFrame:
    return merge.fill_merge(_beach(spark, d, 1), _beach(spark, d, 4), "_id", ["label"], ["surface", "status"])


def resolved_targets(spark: SparkSession, d: str) -> DataFrame:
    """The canonical hotel each ready registry entry belongs to, by key, or by name and a shared fact."""
    fold = lambda c: F.when(T.name_text(F.col(c)) != "", T.name_text(F.col(c)))
    loc = [fold("location.address").alias("address"), F.when(T.postcode_key(F.col("location.postcode")) != "", T.postcode_key(F.col("location.postcode"))).alias("postcode"), fold("operator").alias("operator")]
    lists = [F.col("contacts.phones").alias("phones"), F.col("contacts.emails").alias("mails")]
    key = lambda n: K.joined(T.hotel_name(F.col(n)), T.postcode_key(F.col("location.postcode")), T.name_text(F.col("location.address"))).alias("key")
    e = table(spark, d, "hotel_registry_entries").where("status = 'ready'").dropDuplicates(["_id"])
    records = e.select(F.col("_id").alias("rid"), key("name.original"), T.hotel_name(F.col("name.original")).alias("name"), F.lit("hotel").alias("kind"), *loc, *lists)
    known = table(spark, d, "canonical_hotels").select(F.col("_id").alias("kid"), key("canonicalname"), T.hotel_name(F.col("canonicalname")).alias("name"), F.lit("hotel").alias("kind"), *loc, *lists)
    return merge.resolve_targets(records, known, ["address", "postcode", "operator"], ["phones", "mails"])


def version_publish(spark: SparkSession, d: str) -> DataFrame:
    now = F.to_timestamp(F.lit("2026-01-02 03:04:05"))
    v = table(spark, d, "beach_profiles").select(F.lit("beaches").alias("dataset"), F.col("datasetversion").cast("int").alias("version")).distinct().withColumn("status", F.lit("published")).withColumn("created_at", now).withColumn("published_at", now)
    drafted = merge.next_version(v, "beaches", now)
    return merge.publish_version(drafted, "beaches", 5, now).select("dataset", "version", "status")


def lease_rows(spark: SparkSession, d: str) -> DataFrame:
    """Of the raw rows the first fifty unleased go to a run; leases half an hour old have ended."""
    now = F.to_timestamp(F.lit("2026-01-01 00:00:00"))
    w = table(spark, d, "raw_hotels").select("_id", F.col("processing.status").alias("status"), F.col("processing.runid").alias("run_id"), F.col("processing.claimedat").alias("claimed_at"))
    free = (F.col("status") == "pending") | ((F.col("status") == "claimed") & runs.expired(F.col("claimed_at"), now))
    return runs.lease(w, "_id", 50, "run-1", now, free).where("run_id = 'run-1'").select("_id", "status")


def run_progress(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "hotel_beach_access_edges").dropDuplicates(["_id"])
    g = e.groupBy("runid").agg(F.count_if(F.col("status") != "failed").alias("done"), F.count("*").alias("total"))
    return g.select("runid", runs.progress(F.col("done"), F.col("total"), F.col("done") == F.col("total")).alias("percent"))


def page_ranges(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.ceil(F.col("n_chars") / 500).cast("int").alias("pages"))
    return files.page_ranges(docs, "pages")


def discovered_files(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "raw_hotels").groupBy(F.concat(F.lit("/files/"), F.col("sourcefile.filename")).alias("href")).agg(F.min("seq").alias("seq"))
    return files.discover(links, "https://registry.example").select("url", "filename", "day", "region")


def fresh_files(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "raw_hotels")
    parsed = raw.groupBy(F.col("sourcefile.filename").alias("filename")).agg(F.max("createdat").alias("parsed_at"))
    return files.not_cached(parsed.select("filename"), parsed, F.to_timestamp(F.lit("2025-05-06 03:00:00")))


def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The events as a folder of files, upserted by user and type in micro-batches until none is left."""
    import uuid

    from meridia.session import shared_dir
    from meridia.streaming.upserts import latest, stream_upsert as run

    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    events.repartition(4, "event_id").write.parquet(f"{at}/in")
    run(spark, f"{at}/in", "event_id long, user_id long, event_type string, value double", f"{at}/out", f"{at}/checkpoint", ["user_id", "event_type"], "event_id", 1)
    return latest(spark, f"{at}/out")


QUERIES = {
    f.__name__: f
    for f in (
        text_names, text_keys, canonical_keys, name_class_repair, location_repair, contact_keys, phone_scan, website_kinds, suffix_numbers, address_forms, file_names, beach_types,
        scored_matches, mutual_matches, match_reviews, match_suggestions, unmatched_hotels, dedupe_last, dedupe_first, soft_conflicts, strong_duplicates, resolved_rows, survivor_merge, capacity_merge,
        quality_issues, strict_sums, facet_stats, filled_counts, list_page, adjacency, recent_runs, clique_groups, shadow_aggregates, capacity_collapse, similar_addresses, edge_distances,
        radius_search, nearest_beaches, representative_points, beach_routes, hash_diff_upsert, upsert_counts, upsert_snapshot, stale_marks, fill_merge, resolved_targets, version_publish, lease_rows,
        run_progress, page_ranges, discovered_files, fresh_files, stream_upsert,
    )
}
