"""p6: one postal address written differently.

Parsed addresses are banded by MinHash over tokens and q-grams within one
region and house number; the candidates are verified by an affine-gap alignment
of their tokens, whose substitution costs know the abbreviations.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm.addresskit import STREET_KINDS, TOWN_PREFIX, address, postcode, same_town, street_kind, towns
from meridia.llm.minhash import band_keys
from meridia.llm.namekit import close, fold
from meridia.operators.pairing import blocked_join
from meridia.operators.snapshots import file_date
from meridia.session import cut, table

#: Bands of MinHash over a street's shingles. Spellings one edit apart share about half of theirs and are lost once in 100,000 times, two edits apart once in 50.
BANDS, ROWS = 40, 2
#: Of a bucket, members beyond this are spread by salt.
BUCKET = 2_000
GAP_OPEN, GAP_EXTEND = 0.6, 0.2
#: The greatest cost at which two streets are one: a token left out, or one or two typing errors, but not both; and never two tokens that only stand against gaps.
MOST_COST = 0.8


def bands(street: str) -> list[int]:
    return list(band_keys(street, 2, ROWS, BANDS))


def substitution(a: str, b: str) -> float:
    """0 for one word in two spellings of the dictionaries or romanisations, small for typing errors, else more than a gap."""
    if a == b or fold(a) == fold(b):
        return 0.0
    ka, kb = STREET_KINDS.get(a), STREET_KINDS.get(b)
    if ka or kb:
        return 0.0 if (ka or street_kind(a)) == (kb or street_kind(b)) else 3.0
    if TOWN_PREFIX.get(a, a) == TOWN_PREFIX.get(b, b):
        return 0.0
    if min(len(a), len(b)) >= 5:
        d = min(close(a, b), close(fold(a), fold(b)))
        if d == 1:
            return 0.4
        if min(len(a), len(b)) >= 7 and within_two(a, b):
            return 0.8
    return 3.0


def within_two(a: str, b: str) -> bool:
    """At most two edits, swapped neighbours as one; as spelled or as folded."""
    return _edits(a, b) <= 2 or _edits(fold(a), fold(b)) <= 2


@lru_cache(1 << 16)
def _letters(word: str) -> int:
    """The letters a word has, as bits."""
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) & 63)
    return bits


def _edits(a: str, b: str) -> int:
    """Edits between two words, three and more as 3; each letter that only one of them has costs one, which settles most pairs."""
    if abs(len(a) - len(b)) > 2:
        return 3
    x, y = _letters(a), _letters(b)
    if (x & ~y).bit_count() > 2 or (y & ~x).bit_count() > 2:
        return 3
    # what both begin and end with costs nothing
    n = next((i for i, (c, d) in enumerate(zip(a, b)) if c != d), min(len(a), len(b)))
    a, b = a[n:], b[n:]
    n = next((i for i, (c, d) in enumerate(zip(reversed(a), reversed(b))) if c != d), min(len(a), len(b)))
    a, b = a[: len(a) - n], b[: len(b) - n]
    before, row = None, list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            x = min(new[j - 1] + 1, row[j] + 1, row[j - 1] + (c != d))
            if before and j > 1 and i > 1 and c == b[j - 2] and a[i - 2] == d:
                x = min(x, before[j - 2] + 1)
            new.append(x)
        before, row = row, new
    return min(3, row[-1])


def alignment(a: list[str], b: list[str]) -> float:
    """The least cost of aligning two token lists, in which a run of left-out tokens costs GAP_OPEN and then GAP_EXTEND each."""
    inf = float("inf")
    n, m = len(a), len(b)
    match = [[inf] * (m + 1) for _ in range(n + 1)]
    skip_a = [[inf] * (m + 1) for _ in range(n + 1)]
    skip_b = [[inf] * (m + 1) for _ in range(n + 1)]
    match[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            if i and j:
                match[i][j] = min(match[i - 1][j - 1], skip_a[i - 1][j - 1], skip_b[i - 1][j - 1]) + substitution(a[i - 1], b[j - 1])
            if i:
                skip_a[i][j] = min(min(match[i - 1][j], skip_b[i - 1][j]) + GAP_OPEN, skip_a[i - 1][j] + GAP_EXTEND)
            if j:
                skip_b[i][j] = min(min(match[i][j - 1], skip_a[i][j - 1]) + GAP_OPEN, skip_b[i][j - 1] + GAP_EXTEND)
    return min(match[n][m], skip_a[n][m], skip_b[n][m])


def same_place(sa: str, ka: str, sb: str, kb: str) -> bool:
    """Whether two streets are one: kinds equal where both have one, and the names' tokens aligned at no more than MOST_COST."""
    if ka and kb and ka != kb:
        return False
    return alignment(sa.split(), sb.split()) <= MOST_COST


def _parse(text: pd.Series, code: pd.Series, town: pd.Series) -> pd.DataFrame:
    out = []
    for a, p, t in zip(text, code, town):
        got = address(a)
        if got is None:
            out.append((None, None, None, None, None, None))
            continue
        number, street, kind, tail_code, tail_town = got
        names = towns(t) or towns(tail_town)
        out.append((number, street, kind, postcode(p) or tail_code, "|".join(names), bands(street)))
    return pd.DataFrame(out, columns=["number", "street", "kind", "code", "town", "bands"])


def _verify(sa: pd.Series, ka: pd.Series, ca: pd.Series, wa: pd.Series, sb: pd.Series, kb: pd.Series, cb: pd.Series, wb: pd.Series) -> pd.Series:
    """2: one place; 1: one street, but a town is not known; 0: two places."""
    out = []
    for s, k, c, w, s2, k2, c2, w2 in zip(sa, ka, ca, wa, sb, kb, cb, wb):
        if not same_place(s, k, s2, k2) or (c and c2 and c != c2):
            out.append(0)
        elif c and c == c2:
            out.append(2)
        elif w and w2:
            out.append(2 if same_town(tuple(w.split("|")), tuple(w2.split("|"))) else 0)
        else:
            out.append(1)
    return pd.Series(out, dtype="int32")


def parsed_addresses(df: DataFrame, row: str, region: Column, text: Column, code: Column, town: Column) -> DataFrame:
    """(row, region, number, street, kind, code, town, bands) of the rows whose address can be a place.

    A known code gives the town, by the commonest town of each code over all
    rows; without one, a short form of two towns is taken for the one that has
    a code, where only one has.
    """
    p = F.pandas_udf(_parse, "number string, street string, kind string, code string, town string, bands array<long>")(text, code, town)
    got = cut(df.select(F.col(row).alias("row"), F.coalesce(region, F.lit("")).alias("region"), p.alias("p")).where("p.street is not null").select("row", "region", "p.*"))
    usual = got.where("code <> '' and town <> '' and town not like '%|%'").groupBy("code", "town").count()
    usual = usual.groupBy("code").agg(F.max_by("town", F.struct("count", "town")).alias("usual"))
    named = usual.select(F.col("usual").alias("one")).distinct()
    short = got.where("code = '' and town like '%|%'").select("town").distinct().withColumn("one", F.explode(F.split("town", r"\|")))
    short = short.join(named, "one").groupBy("town").agg(F.min("one").alias("one"), F.count("*").alias("n")).where("n = 1").drop("n")
    coded = got.join(usual, "code", "left").join(short, "town", "left")
    return coded.withColumn("town", F.coalesce(F.when(F.col("code") != "", F.col("usual")), "one", "town")).drop("usual", "one")


def place_classes(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((row, place), (a, b)): each row's place as written, and the pairs a < b of written places that are one place.

    Equal writings are one class before any pair is made, so copies are never
    paired in the search. A bucket of many classes is salted.
    """
    as_written = ["region", "number", "street", "kind", "code", "town"]
    keyed = parsed.withColumn("place", F.xxhash64(*as_written))
    once = cut(keyed.dropDuplicates(["place"]).drop("row"))
    each = once.select("place", "region", "number", F.explode("bands").alias("band")).withColumn("bucket", F.xxhash64("region", "number", "band")).select("place", "bucket")
    size = each.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / BUCKET).cast("int"))
    full = each.join(size.select("bucket", "parts"), "bucket")
    held = full.withColumn("salt", F.pmod(F.hash("place"), F.col("parts"))).select(F.col("place").alias("a"), "bucket", "salt")
    asks = full.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(F.col("place").alias("b"), "bucket", "salt")
    pairs = held.join(asks, ["bucket", "salt"]).where("a < b").select("a", "b").distinct()
    what = ["street", "kind", "code", "town"]
    side = lambda s: once.select(F.col("place").alias(s), *[F.col(c).alias(c + s) for c in what])
    full_pairs = pairs.join(side("a"), "a").join(side("b"), "b")
    kind = F.pandas_udf(_verify, "int")(*[c + "a" for c in what], *[c + "b" for c in what])
    judged = cut(full_pairs.withColumn("verdict", kind).where("verdict > 0"))
    # a place without a known town joins only where all its likes lie in one town
    known = lambda s, o: judged.where("verdict = 1").select(F.col(s).alias("place"), F.col("code" + o).alias("code"), F.col("town" + o).alias("town"))
    likes = known("a", "b").unionAll(known("b", "a")).where("code <> '' or town <> ''").withColumn("at", F.when(F.col("town") != "", F.col("town")).otherwise(F.col("code"))).groupBy("place").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    several = likes.where("low <> high").select("place")
    sure = judged.where("verdict = 2").select("a", "b")
    guess = judged.where("verdict = 1").select("a", "b").join(several, F.col("a") == F.col("place"), "left_anti").join(several, F.col("b") == F.col("place"), "left_anti")
    return keyed.select("row", "place"), sure.unionAll(guess)


def place_pairs(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(seq_a, seq_b) of each two rows at one place, smaller first. A place of many rows is split by its size, on both sides."""
    own = rows.select(F.col("place").alias("a"), F.col("place").alias("b")).distinct()
    x = links.select("a", "b").unionByName(own).join(rows.select(F.col("place").alias("a"), F.col("row").alias("x")), "a").select("b", "x", (F.col("a") == F.col("b")).alias("_own"))
    met = blocked_join(x, rows.select(F.col("place").alias("b"), F.col("row").alias("y")), ["b"]).where(~F.col("_own") | (F.col("x") < F.col("y")))
    return met.select(F.least("x", "y").alias("seq_a"), F.greatest("x", "y").alias("seq_b")).distinct()


def latest_files(raw: DataFrame) -> DataFrame:
    """The rows of each region's file of the latest date; a file's region is that of its rows."""
    dated = raw.withColumn("_day", file_date(F.col("sourcefile.filename")))
    last = dated.groupBy("region").agg(F.max("_day").alias("_last"))
    return dated.join(last, [dated.region.eqNullSafe(last.region), dated._day == last._last]).drop(last.region).drop("_day", "_last")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = latest_files(table(spark, sf_dir, "raw_hotels").select("seq", "region", "sourcefile", "address", "postcode", "locality"))
    parsed = parsed_addresses(raw, "seq", F.col("region"), F.col("address"), F.col("postcode"), F.col("locality"))
    rows, links = place_classes(parsed)
    return place_pairs(rows, links)
