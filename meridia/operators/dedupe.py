"""Duplicates: keep one by key, merge survivors, fold in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def _one(df: DataFrame, keys: list[str], order: str, pick: Callable[[Column, Column], Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(pick(F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(rest)]), F.col(order)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row._{i}").alias(c) for i, c in enumerate(rest)]).select(*df.columns)


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the greatest order. Null keys are one key; a null order comes before all; map-side reduced, so a hot key is no burden."""
    return _one(df, keys, order, F.max_by)


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the least order."""
    return _one(df, keys, order, F.min_by)


def conflicts(df: DataFrame, loose: str, strict: str) -> DataFrame:
    """(loose, strict_keys, rows) of loose keys that more than one strict key shares."""
    return df.groupBy(loose).agg(F.count_distinct(strict).alias("strict_keys"), F.count("*").alias("rows")).where("strict_keys > 1")


def strict_sum(col: str | Column) -> Column:
    """The sum, null as soon as one value is."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def sorted_union(col: str) -> Column:
    """Aggregate: all distinct elements of the group's arrays, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(col, F.array().cast("array<string>"))))))


def first_filled(col: str, order: str) -> Column:
    """Aggregate: the first non-null value by order."""
    return F.min_by(F.col(col), F.when(F.col(col).isNotNull(), F.col(order)))


def quality_issues(name: Column, required: list[Column], rooms: Column, beds: Column) -> Column:
    """Sorted array of missing_name, missing_required_identity_fields and invalid_capacity."""
    blank = lambda c: F.coalesce(F.trim(c.cast("string")), F.lit("")) == ""
    missing = blank(required[0])
    for c in required[1:]:
        missing = missing | blank(c)
    bad = lambda n: F.coalesce(n <= 0, F.lit(False))
    return F.array_sort(F.array_compact(F.array(F.when(blank(name), "missing_name"), F.when(missing, "missing_required_identity_fields"), F.when(bad(rooms) | bad(beds), "invalid_capacity"))))


def location_score(district: Column, locality: Column, postcode: Column, address: Column) -> Column:
    """How telling a location is: a district that contains more than the locality, a postcode, an address and its length, a locality, a district."""
    filled = lambda c: F.coalesce(c != "", F.lit(False))
    within = filled(district) & filled(locality) & (F.upper(district) != F.upper(locality)) & F.upper(district).contains(F.upper(locality))
    points = lambda cond, n: F.when(cond, n).otherwise(0)
    return F.when(within, 10000).otherwise(100) + points(filled(postcode), 1000) + F.when(filled(address), 100 + F.length(address)).otherwise(0) + points(filled(locality), 10) + points(filled(district), 1)


def merge_capacity(old_rooms: Column, old_beds: Column, new_rooms: Column, new_beds: Column) -> Column:
    """struct(rooms, beds, conflict): an invalid new capacity changes nothing, a complete one replaces an incomplete, two complete and different ones conflict and the old stays, else fields fill each other."""
    bad = F.coalesce((new_rooms <= 0) | (new_beds <= 0), F.lit(False))
    old_full, new_full = old_rooms.isNotNull() & old_beds.isNotNull(), new_rooms.isNotNull() & new_beds.isNotNull()
    differ = old_full & new_full & ((old_rooms != new_rooms) | (old_beds != new_beds)) & ~bad
    replace = ~bad & new_full & ~old_full
    keep = bad | differ
    pick = lambda o, n: F.when(keep, o).when(replace, n).otherwise(F.coalesce(o, n))
    return F.struct(pick(old_rooms, new_rooms).alias("rooms"), pick(old_beds, new_beds).alias("beds"), differ.alias("conflict"))


def merged_capacities(df: DataFrame, key: str, order: str) -> DataFrame:
    """(key, rooms, beds, conflict): what merge_capacity gives when each group's rows are taken in by order, without a row of a group waiting for another.

    What counts is when a capacity became complete: by the first complete valid
    row, or before it by fields that others filled; that one stays, and later
    complete ones that differ conflict. The first row counts even if it isn't
    valid. df: key, order (unique within a key), rooms, beds.
    """
    first = df.groupBy(key).agg(F.min(order).alias("_first"))
    bad = F.coalesce((F.col("rooms") <= 0) | (F.col("beds") <= 0), F.lit(False))
    j = df.join(first, key).where(~bad | (F.col(order) == F.col("_first"))).select(key, order, "rooms", "beds")
    full = F.col("rooms").isNotNull() & F.col("beds").isNotNull()
    at = lambda cond: F.when(cond, F.col(order))
    c = j.groupBy(key).agg(
        *[f(x) for n in ("rooms", "beds") for f, x in ((lambda x, n=n: F.min_by(n, x).alias(f"_{n}"), at(F.col(n).isNotNull())), (lambda x, n=n: F.min(x).alias(f"_at_{n}"), at(F.col(n).isNotNull())))],
        F.min_by(F.struct("rooms", "beds"), at(full)).alias("_whole"), F.min(at(full)).alias("_at"),
    )
    filled = F.greatest("_at_rooms", "_at_beds")
    by_row = F.col("_at").isNotNull() & (F.col("_at_rooms").isNull() | F.col("_at_beds").isNull() | (F.col("_at") <= filled))
    pick = lambda n: F.when(by_row, F.col(f"_whole.{n}")).otherwise(F.col(f"_{n}")).alias(n)
    done = F.when(by_row, F.col("_at")).when(F.col("_at_rooms").isNotNull() & F.col("_at_beds").isNotNull(), filled)
    state = c.select(key, pick("rooms"), pick("beds"), done.alias("_done"))
    later = j.where(full).select(key, order, F.col("rooms").alias("_r"), F.col("beds").alias("_b")).join(state, key).where((F.col(order) > F.col("_done")) & ((F.col("_r") != F.col("rooms")) | (F.col("_b") != F.col("beds")))).select(key).distinct().withColumn("_c", F.lit(True))
    return state.join(later, key, "left").select(key, "rooms", "beds", F.coalesce("_c", F.lit(False)).alias("conflict"))


def fold_in_order(df: DataFrame, block: list[str], order: str, fold: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """Each block's rows, by order, through a fold in which later rows see what earlier ones left; for semantics that depend on order alone.

    Rows come sorted to the partitions, which read them in batches and hold one
    block at a time. A block is small by nature, as a name of one file is;
    whole files or sources belong to other operators. Null is a block of its own.
    """
    target = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_type = to_arrow_schema(target)
        at, held = None, []

        def done() -> list[dict]:
            return fold(held) if held else []

        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                key = tuple(row[c] for c in block)
                if key != at:
                    out += done()
                    at, held = key, []
                held.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=out_type)
        yield pa.RecordBatch.from_pylist(done(), schema=out_type)

    return df.repartition(*block).sortWithinPartitions(*block, order).mapInArrow(run, schema)
