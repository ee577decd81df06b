"""Filters, facets, paging and search over one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where_all(df: DataFrame, **equal) -> DataFrame:
    """Rows whose columns equal the given values; None values are no condition."""
    conditions = [F.col(c) == v for c, v in equal.items() if v is not None]
    return df.where(reduce(Column.__and__, conditions)) if conditions else df


def where_match(df: DataFrame, conditions: dict[str, dict]) -> DataFrame:
    """Rows that meet every condition {column: {operator: value}}: eq, ne, in, nin, gte, gt, lte, lt, exists, has (an array's element).

    Null equals null and a missing value alike: eq None finds nulls, ne and nin
    keep them, comparisons never do. A column may be a path, as a.b or list[0].
    """
    made = {
        "eq": lambda c, v: c.eqNullSafe(F.lit(v)),
        "ne": lambda c, v: ~c.eqNullSafe(F.lit(v)),
        "in": lambda c, v: F.coalesce(c.isin(*[x for x in v if x is not None]), F.lit(False)) | (c.isNull() if None in v else F.lit(False)),
        "nin": lambda c, v: ~(F.coalesce(c.isin(*[x for x in v if x is not None]), F.lit(False)) | (c.isNull() if None in v else F.lit(False))),
        "gte": lambda c, v: c >= v, "gt": lambda c, v: c > v, "lte": lambda c, v: c <= v, "lt": lambda c, v: c < v,
        "exists": lambda c, v: c.isNotNull() if v else c.isNull(),
        "has": lambda c, v: F.coalesce(F.array_contains(c, v), F.lit(False)),
    }

    def path(name: str) -> Column:
        import re

        m = re.fullmatch(r"(.+)\[(\d+)\]", name)
        return F.get(F.col(m[1]), F.lit(int(m[2]))) if m else F.col(name)

    tests = [made[op](path(c), v) for c, ops in conditions.items() for op, v in ops.items()]
    return df.where(reduce(Column.__and__, tests)) if tests else df


def by_id(df: DataFrame, key: str, value: str | None, pattern: str = r"[0-9a-z]{24}") -> DataFrame:
    """The row of an id; none for an id that isn't like one, which is no error."""
    import re

    return df.where(F.col(key) == value).limit(1) if value is not None and re.fullmatch(pattern, value) else df.limit(0)


def unique_by(df: DataFrame, column: str, value) -> DataFrame:
    """The one row with a value, or none; an error where several have it. Two rows at most are fetched."""
    found = df.where(F.col(column) == value)
    if len(found.limit(2).take(2)) > 1:
        raise ValueError(f"{column} {value!r} is not unique")
    return found


def eligible(status: Column, verification: Column) -> Column:
    """Active, and not known to lie elsewhere; without a verification it is."""
    return F.coalesce(status == "active", F.lit(False)) & F.coalesce(verification != "location_unverified", F.lit(True))


def geo_counts(df: DataFrame, status: Column, point: Column) -> DataFrame:
    """One row: with_geo, without_geo of the active rows."""
    return df.where(status == "active").agg(F.count_if(point.isNotNull()).alias("with_geo"), F.count_if(point.isNull()).alias("without_geo"))


def first_rows(df: DataFrame, order: list[Column], limit: str | int | None) -> DataFrame:
    """The first rows by order; 0, or what is no number, means all."""
    n = number(limit, 0, 0, 1 << 30)
    return df.orderBy(*order).limit(n) if n else df.orderBy(*order)


def text_search(df: DataFrame, query: str | None, columns: list[str]) -> DataFrame:
    """Rows of which one column holds the query literally, in any case; a null column holds nothing; no query, no condition."""
    if not query:
        return df
    return df.where(reduce(Column.__or__, [F.coalesce(F.contains(F.lower(F.col(c)), F.lit(query.lower())), F.lit(False)) for c in columns]))


def facets(df: DataFrame, columns: dict[str, list[str] | None]) -> DataFrame:
    """(facet, value, n) of several columns in one pass; a fixed domain is filled with zeros and anything else left out, an open one (None) drops null and blank."""
    names = list(columns)
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("facet"), F.col(n).cast("string").alias("value")) for n in names])).alias("s")).select("s.*")
    counted = stacked.groupBy("facet", "value").agg(F.count("*").alias("n"))
    fixed = [(n, v) for n, vs in columns.items() if vs is not None for v in vs]
    opened = counted.where(F.col("facet").isin(*[n for n, vs in columns.items() if vs is None]) & (F.coalesce(F.trim("value"), F.lit("")) != "")) if any(v is None for v in columns.values()) else None
    if not fixed:
        return opened
    domain = df.sparkSession.createDataFrame(fixed, "facet string, value string")
    filled = domain.join(counted, ["facet", "value"], "left").select("facet", "value", F.coalesce("n", F.lit(0)).alias("n"))
    return filled.unionByName(opened) if opened is not None else filled


def page(df: DataFrame, order: list[Column], limit: str | int | None = None, offset: str | int | None = None) -> DataFrame:
    """One page in a total order; limit 50 by default within 1 to 200, offset from 0."""
    return df.orderBy(*order).offset(number(offset, 0, 0, 1 << 30)).limit(number(limit, 50, 1, 200))


def number(text: str | int | None, default: int, low: int, high: int) -> int:
    """A leading integer within bounds; the default where there's none."""
    import re

    m = re.match(r"\s*([+-]?\d+)", str(text)) if text is not None else None
    return max(low, min(high, int(m[1]))) if m else default


def top_per_key(df: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key by order, with rank from 1."""
    from pyspark.sql.window import Window

    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def filled_any(columns: list[Column]) -> Column:
    """Whether one of several fields is filled; '' and null aren't, blanks are."""
    return reduce(Column.__or__, [F.coalesce(c != "", F.lit(False)) for c in columns])
