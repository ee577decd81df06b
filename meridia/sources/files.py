"""Discovery, caching and page ranges of delivered files, and writing of versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.functions.text import file_region
from meridia.operators.snapshots import file_date

PAGES, OVERLAP, WHOLE = 5, 1, 8


def discover(links: DataFrame, base: str) -> DataFrame:
    """(url, filename, day, region) of the registry files among links (seq, href).

    Links are made absolute and kept once, the first by seq. Files with
    'pancyprian' in their name stand for all; only without any do those that
    begin with hotels_ or hold _hotels_ count. Lists of pet or vegan friendly
    houses are left out.
    """
    href = F.trim("href")
    url = F.when(href.rlike("^https?://"), href).when(href.startswith("/"), F.concat(F.lit(base.rstrip("/")), href)).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), href))
    named = links.where(href != "").select("seq", url.alias("url")).withColumn("filename", F.url_decode(F.regexp_extract("url", r"([^/?#]+)(?:[?#].*)?$", 1)))
    once = named.groupBy("url").agg(F.min_by("filename", "seq").alias("filename"))
    low = F.lower("filename")
    fits = once.where(low.endswith(".pdf") & ~low.rlike("pet[-_ ]?friendly|vegan")).withColumn("_first", low.contains("pancyprian")).withColumn("_second", low.rlike("_hotels_|^hotels_"))
    any_first = fits.agg(F.coalesce(F.bool_or("_first"), F.lit(False))).scalar()
    return fits.where(F.when(any_first, F.col("_first")).otherwise(F.col("_second"))).select("url", "filename", file_date(F.col("filename")).alias("day"), file_region(F.col("filename")).alias("region"))


def page_ranges(files: DataFrame, pages: str, size: int = PAGES, overlap: int = OVERLAP, whole: int = WHOLE) -> DataFrame:
    """files with page_from and page_to: one range up to `whole` pages, else ranges of `size` that overlap, the last one clipped."""
    n = F.col(pages)
    step = size - overlap
    starts = F.when(n <= whole, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.greatest(F.lit(1), n - overlap), F.lit(step)))
    ranged = files.where(n > 0).withColumn("page_from", F.explode(starts))
    return ranged.withColumn("page_to", F.when(n <= whole, n).otherwise(F.least(n, F.col("page_from") + size - 1)).cast("int")).withColumn("page_from", F.col("page_from").cast("int"))


def not_cached(files: DataFrame, parsed: DataFrame, now: Column, hours: int = 12) -> DataFrame:
    """Files whose newest parsing (filename, parsed_at) is older than so many hours, or that have none."""
    fresh = parsed.groupBy("filename").agg(F.max("parsed_at").alias("_at")).where(F.col("_at") >= now - F.make_dt_interval(F.lit(0), F.lit(hours)))
    return files.join(fresh.select("filename"), "filename", "left_anti")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def publish_release(components: dict[str, tuple[DataFrame, int | None]], target: str, column: str = "datasetversion") -> dict[str, int]:
    """Write each component's pinned version anew under target/<name>; gives the pinned versions. A component without one is an error, and then nothing is written."""
    missing = sorted(n for n, (_, v) in components.items() if v is None)
    if missing:
        raise ValueError(f"no version pinned for {', '.join(missing)}")
    for name, (df, version) in components.items():
        df.where(F.col(column) == version).write.mode("overwrite").parquet(f"{target}/{name}")
    return {n: v for n, (_, v) in components.items()}


def at_version(spark: SparkSession, path: str, version: int, column: str = "datasetversion") -> DataFrame:
    """The rows of one published version; other versions' partitions aren't read."""
    return spark.read.parquet(path).where(F.col(column) == version)


def source_path(folder: str, name: str) -> str:
    """A source's file: as given where it is absolute, else within the folder."""
    return name if name.startswith("/") or "://" in name else f"{folder.rstrip('/')}/{name}"


def publish(df: DataFrame, path: str, version: int, column: str = "datasetversion") -> None:
    """The rows of one version replace that version's partition; other versions stay."""
    df.where(F.col(column) == version).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
