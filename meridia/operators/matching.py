"""Scored matching of two sources and its one-to-one resolution."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meridia.operators.pairing import blocked_join, tagged
from meridia.session import cut

#: Scores of the tiers, the first that holds decides, and the name scores they ask for.
TIERS = (("CONTACT_AND_COMPATIBLE_NAME", 100), ("CONTACT_AND_FUZZY_NAME", 92), ("SHARED_GROUP_CONTACT_AND_STRONG_NAME", 84), ("ADDRESS_AND_STRONG_NAME", 82), ("RAW_EXACT_NAME", 80), ("REDUCED_EXACT_NAME", 60))
FUZZY, VERY_STRONG = 0.72, 0.82


def text_score(a: Column, b: Column) -> Column:
    """1 for equal texts; the ratio of lengths where one contains the other; else 1 less the edits by the longer length; 0 for an empty text."""
    la, lb = F.length(a), F.length(b)
    low, high = F.least(la, lb).cast("double"), F.greatest(la, lb).cast("double")
    return (
        F.when((la == 0) | (lb == 0), F.lit(0.0))
        .when(a == b, F.lit(1.0))
        .when(a.contains(b) | b.contains(a), low / high)
        .otherwise(F.lit(1.0) - F.levenshtein(a, b) / high)
    )


def token_score(a: Column, b: Column) -> Column:
    """Common words by the words of the shorter text; 0 for an empty one."""
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))
    wa, wb = words(a), words(b)
    least = F.least(F.size(wa), F.size(wb))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(wa, wb)) / F.greatest(least, F.lit(1)))


def _any_pair(xs: Column, ys: Column, test) -> Column:
    return F.exists(xs, lambda x: F.exists(ys, lambda y: test(x, y)))


def name_scores(raw_l: Column, red_l: Column, raw_r: Column, red_r: Column) -> Column:
    """struct(score, raw_exact, reduced_exact, compatible) of two sides' arrays of raw and reduced names, null and '' left out."""
    raw_exact, red_exact = F.coalesce(F.arrays_overlap(raw_l, raw_r), F.lit(False)), F.coalesce(F.arrays_overlap(red_l, red_r), F.lit(False))
    best = F.aggregate(red_l, F.lit(0.0), lambda s, x: F.greatest(s, F.aggregate(red_r, F.lit(0.0), lambda t, y: F.greatest(t, text_score(x, y), token_score(x, y)))))
    return F.struct(
        F.greatest(best, F.when(raw_exact | red_exact, 1.0).otherwise(0.0)).alias("score"),
        raw_exact.alias("raw_exact"),
        red_exact.alias("reduced_exact"),
        (raw_exact | red_exact | _any_pair(red_l, red_r, lambda x, y: x.contains(y) | y.contains(x))).alias("compatible"),
    )


def _edits(size: int, least: float) -> int:
    """The most edits by which a text of a size may differ from a longer one that it still scores `least` with."""
    return int((1 - least) * int(size / least + 1e-9) + 1e-9)


def _cuts(size: int, least: float) -> list[tuple[int, int]]:
    """(start, length) of one segment more than edits: one of them stays whole in every text that scores enough."""
    n = min(size, _edits(size, least) + 1)
    ends = [size * (i + 1) // n for i in range(n)]
    return [(b, e - b) for b, e in zip([0, *ends], ends)]


def held_keys(names: list[str], least: float) -> list[str]:
    """The keys of an indexed side's names: segments by the text's length, and all words."""
    out = set()
    for t in names:
        out |= {f"{len(t)}.{i}:{t[b : b + n]}" for i, (b, n) in enumerate(_cuts(len(t), least))}
        words = {w for w in t.split(" ") if w}
        out |= {f"w:{w}" for w in words} | {f"s:{w}" for w in _longest(words, least)}
    return sorted(out)


def asked_keys(names: list[str], least: float) -> list[str]:
    """The keys a name asks with, so that every name that scores `least` with it holds one of them.

    Texts within so many edits share a segment near its place (the i-th one is
    moved by at most i edits before it and by those left after it). Of texts that
    share their words the shorter's longest ones are among the other's words.
    """
    out = set()
    for t in names:
        for size in range(max(1, math.ceil(least * len(t) - 1e-9)), int(len(t) / least + 1e-9) + 1):
            cuts, moved = _cuts(size, least), len(t) - size
            for i, (at, n) in enumerate(cuts):
                last = len(cuts) - 1 - i
                for b in range(max(0, at - i, at + moved - last), min(len(t) - n, at + i, at + moved + last) + 1):
                    out.add(f"{size}.{i}:{t[b : b + n]}")
        words = {w for w in t.split(" ") if w}
        out |= {f"s:{w}" for w in words} | {f"w:{w}" for w in _longest(words, least)}
    return sorted(out)


def _longest(words: set[str], least: float) -> list[str]:
    """So many of a text's words, the longest first, that a text with enough of its words has one of them."""
    spare = len(words) - math.ceil(least * len(words) - 1e-9)
    return sorted(words, key=lambda w: (-len(w), w))[: spare + 1]


def _keys(names: Column, of, least: float) -> Column:
    return F.pandas_udf(lambda s: pd.Series([of(list(x), least) if x is not None else [] for x in s]), "array<string>")(names)


def _parts(text: Column, low: int, high: int) -> Column:
    """All parts of a text of low to high characters."""
    one = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n))))
    return F.array_distinct(F.flatten(F.array_compact(F.array(*[one(n) for n in range(low, high + 1)]))))


def containing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b): distinct texts of which one contains the other, of two one-column tables a and b.

    The shorter one asks with one of its parts of three characters, or with the
    whole of it where it has fewer, among all parts of the longer. Empty and null texts contain nothing.
    """

    def one_way(long: DataFrame, lc: str, short: DataFrame, sc: str) -> DataFrame:
        held = long.select(lc, F.explode(_parts(F.col(lc), 1, 3)).alias("_part"))
        whole = F.filter(_parts(F.col(sc), 3, 3), lambda x: x != "")
        least = F.array_min(F.transform(whole, lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("x")))).x
        asks = short.select(sc, F.when(F.length(sc) < 3, F.col(sc)).otherwise(least).alias("_part"))
        return blocked_join(held, asks, ["_part"]).where(F.col(lc).contains(F.col(sc))).select("a", "b")

    a, b = (df.where(F.coalesce(F.length(c) > 0, F.lit(False))).select(c).distinct() for df, c in ((a, "a"), (b, "b")))
    return one_way(a, "a", b, "b").unionByName(one_way(b, "b", a, "a")).distinct()


def candidate_pairs(candidates: DataFrame, hotels: DataFrame, crowd: int) -> DataFrame:
    """(cid, hid): the pairs that can reach a tier, each once; none that can is left out.

    Contacts and equal names are blocks of their own. A place (postcode, town,
    street) or a group's shared contact is none: the name must be very like
    too, so these are joined with the name's keys. So are contacts that more than
    `crowd` candidates or hotels have, with the keys of a lower score and of containment.
    """
    none = F.array().cast("array<string>")
    e = lambda c: F.coalesce(F.col(c), none)
    own = lambda df, k: df.select(k, *[e(f).alias(f) for f in ("raw_names", "reduced_names", "contacts", "shared_contacts")], "postcode", "street", "city")
    c, h = cut(own(candidates, "cid")), cut(own(hotels, "hid"))

    exact = F.concat(tagged("r:", F.col("raw_names")), tagged("d:", F.col("reduced_names")))
    contact = lambda df, k: df.select(k, F.explode(F.array_distinct("contacts")).alias("block"))
    count = lambda df: df.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("block")
    cc, hc = contact(c, "cid"), contact(h, "hid")
    crowded = cut(count(cc).unionAll(count(hc)).distinct())
    named = lambda df, k: df.select(k, F.explode(F.array_distinct(exact)).alias("block"))
    blocks = lambda contacts, df, k: contacts.join(crowded, "block", "left_anti").unionByName(named(df, k))
    alike = blocked_join(blocks(cc, c, "cid"), blocks(hc, h, "hid"), ["block"]).select("cid", "hid")

    near = containing(c.select(F.col("street").alias("a")), h.select(F.col("street").alias("b")))
    streets = near.groupBy(F.col("a").alias("street")).agg(F.collect_set("b").alias("_streets"))
    at = lambda streets: F.array_compact(F.concat(F.array(F.concat(F.lit("p:"), F.col("postcode")), F.concat(F.lit("c:"), F.col("city"))), tagged("s:", streets), tagged("h:", F.col("shared_contacts"))))
    cp = cut(c.join(streets, "street", "left").select("cid", F.array_distinct(at(F.coalesce("_streets", none))).alias("places"), "reduced_names"))
    hp = h.select("hid", F.array_distinct(at(F.array_compact(F.array("street")))).alias("places"), "reduced_names")
    found = alike.unionByName(_narrowed(cp, hp, VERY_STRONG, False))
    if crowded.isEmpty():
        return found.distinct()
    hot = lambda df, k, own: df.join(crowded, "block").groupBy(k).agg(F.collect_set("block").alias("places")).join(own.select(k, "reduced_names"), k)
    return found.unionByName(_narrowed(hot(cc, "cid", c), hot(hc, "hid", h), FUZZY, True)).distinct()


def _narrowed(c: DataFrame, h: DataFrame, least: float, contained: bool) -> DataFrame:
    """(cid, hid) of the pairs that share a place and a name key; names are joined once per place, whatever many rows bear them."""

    def one(df: DataFrame, k: str) -> DataFrame:
        return df.select(k, "places", F.explode(F.array_distinct(F.filter("reduced_names", lambda n: n != ""))).alias("name")).select(k, "name", F.explode("places").alias("place"))

    rows_c, rows_h = one(c, "cid"), one(h, "hid")
    names = lambda rows, of, n: rows.select("place", "name").distinct().select("place", F.col("name").alias(n), F.explode(_keys(F.array("name"), of, least)).alias("key"))
    met = blocked_join(cut(names(rows_c, asked_keys, "_cn")), cut(names(rows_h, held_keys, "_hn")), ["place", "key"]).select("place", "_cn", "_hn")
    if contained:
        pair = containing(rows_c.select(F.col("name").alias("a")), rows_h.select(F.col("name").alias("b")))
        at = lambda rows, n: rows.select("place", F.col("name").alias(n)).distinct()
        held = at(rows_c, "_cn").join(pair.select(F.col("a").alias("_cn"), F.col("b").alias("_hn")), "_cn").join(at(rows_h, "_hn"), ["place", "_hn"])
        met = met.unionByName(held)
    # of names that meet by a key only those that are alike go on to their rows
    alike = F.greatest(text_score(F.col("_cn"), F.col("_hn")), token_score(F.col("_cn"), F.col("_hn"))) >= least
    if contained:
        alike = alike | F.col("_cn").contains(F.col("_hn")) | F.col("_hn").contains(F.col("_cn"))
    met = cut(met.where(alike).distinct())
    left = cut(rows_c.select("cid", "place", F.col("name").alias("_cn")).join(met, ["place", "_cn"]).select("cid", "place", "_hn").distinct())
    return blocked_join(left, rows_h.select("hid", "place", F.col("name").alias("_hn")), ["place", "_hn"]).select("cid", "hid").distinct()


def proposals(candidates: DataFrame, hotels: DataFrame, crowd: int = 1_000) -> DataFrame:
    """(cid, hid, score, reason, name_score, richness) of every pair that reaches a tier.

    candidates: cid, richness and the fields below; hotels: hid and those fields:
    raw_names, reduced_names, contacts, shared_contacts (arrays of texts),
    postcode, street, city. Null arrays count as empty, null texts as unknown;
    empty tables propose nothing.
    """
    pairs = candidate_pairs(candidates, hotels, crowd)
    fields = ("raw_names", "reduced_names", "contacts", "shared_contacts", "postcode", "street", "city")
    e = lambda f: F.coalesce(F.col(f), F.array().cast("array<string>")) if f in fields[:4] else F.col(f)
    c = candidates.select("cid", "richness", *[e(f).alias(f"c_{f}") for f in fields])
    h = hotels.select("hid", *[e(f).alias(f"h_{f}") for f in fields])
    j = pairs.join(c, "cid").join(h, "hid").withColumn("n", name_scores(F.col("c_raw_names"), F.col("c_reduced_names"), F.col("h_raw_names"), F.col("h_reduced_names")))
    overlap = lambda f: F.coalesce(F.arrays_overlap(f"c_{f}", f"h_{f}"), F.lit(False))
    street = F.col("c_street").contains(F.col("h_street")) | F.col("h_street").contains(F.col("c_street"))
    address = F.coalesce(F.col("c_postcode") == F.col("h_postcode"), F.lit(False)) | F.coalesce(street, F.lit(False)) | F.coalesce(F.col("c_city") == F.col("h_city"), F.lit(False))
    conditions = (
        overlap("contacts") & F.col("n.compatible"),
        overlap("contacts") & (F.col("n.score") >= FUZZY),
        overlap("shared_contacts") & (F.col("n.score") >= VERY_STRONG),
        address & (F.col("n.score") >= VERY_STRONG),
        F.col("n.raw_exact"),
        F.col("n.reduced_exact"),
    )
    score, reason = F.lit(None).cast("int"), F.lit(None).cast("string")
    for cond, (name, points) in reversed(list(zip(conditions, TIERS))):
        score, reason = F.when(cond, points).otherwise(score), F.when(cond, name).otherwise(reason)
    return j.withColumn("score", score).where("score is not null").select("cid", "hid", "score", reason.alias("reason"), F.col("n.score").alias("name_score"), "richness")


def mutual_best(found: DataFrame, left: str = "cid", right: str = "hid", by: tuple[str, ...] = ("score", "richness")) -> DataFrame:
    """The rows that are the one best of their left and of their right; where several share the first place, none is. Without windows over a side's rows: two maxima."""
    order = F.struct(*by)

    def best(k: str) -> DataFrame:
        top = found.groupBy(k).agg(F.max(order).alias("_top"))
        tied = found.join(top, k).where(order == F.col("_top")).groupBy(k).agg(F.count("*").alias("_n"), F.first("_top").alias("_top")).where("_n = 1")
        return tied.select(k, F.col("_top").alias(f"_{k}"))

    return found.join(best(left), left).join(best(right), right).where((order == F.col(f"_{left}")) & (order == F.col(f"_{right}"))).drop(f"_{left}", f"_{right}")


def review_suggestions(found: DataFrame, accepted: DataFrame, left: str = "cid", right: str = "hid") -> DataFrame:
    """Each left side without an accepted row with its best one; equal ones go to the lesser right side."""
    rest = found.join(accepted.select(left).distinct(), left, "left_anti")
    top = rest.groupBy(left).agg(F.min_by(F.struct(right, "score", "reason"), F.struct(-F.col("score"), -F.col("richness"), F.col(right))).alias("b"))
    return top.select(left, f"b.{right}", "b.score", "b.reason")


def attach_top(parents: DataFrame, children: DataFrame, key: str, child: str, n: int, required: bool = False) -> DataFrame:
    """parents with an array of the n best children, by score and then the lesser child; with required only those that have one."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), child)
    kept = children.select(key, child, "score").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    lists = kept.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_r", child, "score"))).alias("l")).select(key, F.transform("l", lambda x: F.struct(x[child].alias(child), x["score"].alias("score"))).alias("suggestions"))
    return parents.join(lists, key, "inner" if required else "left")
