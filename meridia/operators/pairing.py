"""Joins of two sides on a block key of which some blocks are hot: each is split by its measured size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one side of a block that one task may hold against as many of the other.
ROWS = 2_000


def blocked_join(left: DataFrame, right: DataFrame, keys: list[str], rows: int = ROWS) -> DataFrame:
    """left and right joined on the keys; no other column may be on both sides.

    Both sides of a block are counted before anything meets. A block of more
    than `rows` on a side is cut into as many parts as that takes, without an
    upper bound, and each part of one side meets each part of the other: every
    pair is made once, and none of the tasks holds a whole hot block. Only hot
    blocks, at most one for `rows` rows, are looked up by the rows. Null keys join nothing.
    """
    size = lambda df, n: df.groupBy(*keys).agg(F.ceil(F.count("*") / rows).cast("int").alias(n))
    hot = size(left, "_lp").join(size(right, "_rp").hint("merge"), keys).where((F.col("_lp") > 1) | (F.col("_rp") > 1))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))

    def spread(df: DataFrame, own: str, other: str, at: str, across: str) -> DataFrame:
        rest = [F.col(c) for c in df.columns]
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if c not in keys]), F.coalesce(own, F.lit(1))).cast("int")
        return df.join(hot, keys, "left").select(*rest, salt.alias(at), F.col(other)).select(*rest, at, each(other).alias(across))

    l, r = spread(left, "_lp", "_rp", "_la", "_ra"), spread(right, "_rp", "_lp", "_ra", "_la")  # noqa: E741
    return l.join(r, [*keys, "_la", "_ra"]).drop("_la", "_ra")


def tagged(tag: str, array: Column) -> Column:
    """Each element with a tag before it; null stays null."""
    return F.transform(array, lambda x: F.concat(F.lit(tag), x))
