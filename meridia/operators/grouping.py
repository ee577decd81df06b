"""Groups of related records: pair predicates within a block, and checks over all pairs by counting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADDRESS_EDITS, SHADOW_SHARE, SHADOW_SIBLINGS, BED_TOLERANCE = 0.25, 0.2, 3, 10


def overlaps(a: Column, b: Column) -> Column:
    """Whether two arrays share an element; null and empty arrays share none."""
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def leading_number(address: Column) -> Column:
    """The house number a normalised address begins with, its letter included; null without one."""
    n = F.regexp_extract(address, r"^(\d+[A-Z]?)", 1)
    return F.when(n != "", n)


def similar_address(a: Column, b: Column) -> Column:
    """The same leading house number, and edits of at most a quarter of the longer text."""
    same = leading_number(a) == leading_number(b)
    return F.coalesce(same & (F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)) <= ADDRESS_EDITS), F.lit(False))


def compatible_text(a: Column, b: Column) -> Column:
    """Equal, one within the other, or one of them missing or empty."""
    return F.coalesce((a == "") | (b == "") | a.contains(b) | b.contains(a), F.lit(True))


def shadow_aggregates(totals: DataFrame, parts: DataFrame, key: str, measures: list[str], most: float = SHADOW_SHARE, least: int = SHADOW_SIBLINGS) -> DataFrame:
    """(key, parts, sum_<m>..): rows that only sum up others: at least so many parts, each measure above the greatest part and within a share of the parts' sum. A part with a null measure disqualifies."""
    agg = [F.count("*").alias("parts")]
    for m in measures:
        agg += [F.when(F.count(m) == F.count(F.lit(1)), F.sum(m)).alias(f"sum_{m}"), F.max(m).alias(f"_max_{m}")]
    j = totals.join(parts.groupBy(key).agg(*agg), key)
    ok = F.col("parts") >= least
    for m in measures:
        ok = ok & (F.col(m) > F.col(f"_max_{m}")) & (F.col(f"sum_{m}") > 0) & (F.abs(F.col(f"sum_{m}") - F.col(m)) / F.col(f"sum_{m}") <= most)
    return j.where(ok).select(key, "parts", *[f"sum_{m}" for m in measures])


def collapse_candidates(rows: DataFrame, block: str, order: str, kind: str, rooms: str, beds: str, tolerance: int = BED_TOLERANCE) -> DataFrame:
    """(block, members, keeper): blocks of one kind whose capacities all fit the first row's, rooms equal and beds within the tolerance; null fits all."""
    first = rows.groupBy(block).agg(F.min_by(F.struct(order, rooms, beds), order).alias("_f"), F.count("*").alias("members"), F.count_distinct(kind).alias("_k"))
    fits = F.coalesce(F.col(rooms) == F.col(f"_f.{rooms}"), F.lit(True)) & F.coalesce(F.abs(F.col(beds) - F.col(f"_f.{beds}")) <= tolerance, F.lit(True))
    bad = rows.join(first, block).where(~fits).select(block).distinct()
    return first.where("members > 1 and _k = 1").join(bad, block, "left_anti").select(block, "members", F.col(f"_f.{order}").alias("keeper"))
