"""Guarded application of matches and geo points: each gives the action taken and the rows as they are after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States, actions and the mark of a point's origin.
CONFLICT, ALREADY, AUTO, MANUAL, GEO_SET = "CONFLICT", "ALREADY_MATCHED", "AUTO_MATCHED", "MANUAL_MATCHED", "MANUAL_GEO_SET"
BOUND = ("AUTO_MATCHED", "CONFIRMED")
ORIGIN, MANUAL_ORIGIN = "hotel_geo_candidate:", "manual"


def apply_matches(wanted: DataFrame, candidates: DataFrame, hotels: DataFrame, manual: bool = False) -> DataFrame:
    """(cid, hid, action) of each wanted match, all judged by the state before.

    wanted: cid, hid, each at most once, as matching leaves them; candidates: cid,
    canonicalhotelid, matchstatus; hotels: hid, geo_source. A match conflicts if
    its candidate doesn't exist or is bound elsewhere, if another candidate is
    bound to its hotel, or if the hotel doesn't exist or has its point from
    elsewhere. Joins only: bound candidates are counted by hotel before they meet anything.
    """
    c = candidates.dropDuplicates(["cid"]).select("cid", F.lit(True).alias("_there"), F.col("canonicalhotelid").alias("_at"), F.col("matchstatus").alias("_state"))
    bound = candidates.dropDuplicates(["cid"]).where(F.col("canonicalhotelid").isNotNull() & F.col("matchstatus").isin(*BOUND)).groupBy(F.col("canonicalhotelid").alias("hid")).agg(F.min("cid").alias("_one"), F.max("cid").alias("_other"))
    h = hotels.dropDuplicates(["hid"]).select("hid", F.lit(True).alias("_hotel"), F.col("geo_source").alias("_source"))
    j = wanted.select("cid", "hid").distinct().join(c, "cid", "left").join(bound, "hid", "left").join(h, "hid", "left")
    no = lambda x: F.coalesce(x, F.lit(False))
    elsewhere = F.col("_there").isNull() | no(F.col("_at") != F.col("hid"))
    taken = no(F.col("_one") != F.col("cid")) | no(F.col("_other") != F.col("cid"))
    foreign = F.col("_hotel").isNull() | no(F.col("_source") != F.concat(F.lit(ORIGIN), F.col("cid")))
    done = no((F.col("_state") == ("CONFIRMED" if manual else "AUTO_MATCHED")) & (F.col("_at") == F.col("hid")))
    action = F.when(elsewhere | taken | foreign, CONFLICT).when(done, ALREADY).otherwise(MANUAL if manual else AUTO)
    return j.select("cid", "hid", action.alias("action"))


def match_reasons(reason: Column | None, score: Column | None) -> Column:
    """What a match writes down: AUTO_MATCH, its reason and score, or MANUAL_MATCH."""
    return F.array(F.lit("MANUAL_MATCH")) if reason is None else F.array(F.lit("AUTO_MATCH"), reason, F.concat(F.lit("SCORE:"), score.cast("string")))


def bound_candidates(candidates: DataFrame, applied: DataFrame, reasons: Column, now: Column, manual: bool = False) -> DataFrame:
    """candidates (cid, canonicalhotelid, matchstatus, matchreasons, updatedat, ..) with the new matches written in; what conflicts, or was matched already, stays as it is. applied: cid, hid, action and what reasons reads."""
    new = applied.where(F.col("action") == (MANUAL if manual else AUTO)).select("cid", F.col("hid").alias("_hid"), reasons.alias("_reasons"))
    pick = lambda new, old: F.when(F.col("_hid").isNotNull(), new).otherwise(F.col(old)).alias(old)
    written = {"canonicalhotelid": F.col("_hid"), "matchstatus": F.lit("CONFIRMED" if manual else "AUTO_MATCHED"), "matchreasons": F.col("_reasons"), "updatedat": now}
    return candidates.join(new, "cid", "left").select(*[pick(written[c], c) if c in written else F.col(c) for c in candidates.columns])


def placed_hotels(hotels: DataFrame, applied: DataFrame, points: DataFrame, now: Column) -> DataFrame:
    """hotels (hid, lng, lat, geo_source, updatedat, ..) with the points of the candidates matched to them; points: cid, lng, lat. A hotel that was matched already has its point renewed."""
    won = applied.where(F.col("action") != CONFLICT).join(points.dropDuplicates(["cid"]).select("cid", F.col("lng").alias("_lng"), F.col("lat").alias("_lat")), "cid").select("hid", "_lng", "_lat", F.concat(F.lit(ORIGIN), F.col("cid")).alias("_source"))
    written = {"lng": "_lng", "lat": "_lat", "geo_source": "_source"}
    pick = lambda c: F.when(F.col("_source").isNotNull(), now if c == "updatedat" else F.col(written[c])).otherwise(F.col(c)).alias(c)
    return hotels.join(won, "hid", "left").select(*[pick(c) if c in written or c == "updatedat" else F.col(c) for c in hotels.columns])


def manual_points(wanted: DataFrame, hotels: DataFrame) -> DataFrame:
    """(hid, action): a point set by hand conflicts with one of another origin, and with a missing hotel. wanted: hid; hotels: hid, geo_source."""
    h = hotels.dropDuplicates(["hid"]).select("hid", F.lit(True).alias("_there"), F.col("geo_source").alias("_source"))
    free = F.coalesce(F.col("_there") & (F.col("_source").isNull() | (F.col("_source") == MANUAL_ORIGIN)), F.lit(False))
    return wanted.select("hid").distinct().join(h, "hid", "left").select("hid", F.when(free, GEO_SET).otherwise(CONFLICT).alias("action"))


def parents_of(items: DataFrame, hotels: DataFrame) -> DataFrame:
    """items (hid, ..) with outcome 'skipped' where the hotel is missing, not active or has no point, else 'computable'. hotels: hid, status, lng."""
    h = hotels.dropDuplicates(["hid"]).select("hid", F.coalesce((F.col("status") == "active") & F.col("lng").isNotNull(), F.lit(False)).alias("_fit"))
    return items.join(h, "hid", "left").withColumn("outcome", F.when(F.coalesce("_fit", F.lit(False)), "computable").otherwise("skipped")).drop("_fit")
