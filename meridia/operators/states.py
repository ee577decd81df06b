"""States of work rows and runs as set operations: defaults, ends, retries, gates and counters. None changes a table in place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PENDING, CLAIMED, PROCESSED, FAILED, IGNORED, REVIEW = "pending", "claimed", "processed", "failed", "ignored", "review_required"
QUEUED, RUNNING, COMPLETED = "queued", "running", "completed"
WORK = ("status", "run_id", "claimed_at", "processed_at", "target", "error")


def initialise(df: DataFrame, has_state: Column) -> DataFrame:
    """df with WORK's columns at their beginning, pending and otherwise null, where a row has no state yet."""
    begin = lambda c: F.lit(PENDING) if c == "status" else F.lit(None).cast(dict(df.dtypes)[c])
    return df.select(*[F.when(has_state, F.col(c)).otherwise(begin(c)).alias(c) if c in WORK else F.col(c) for c in df.columns])


def recover(df: DataFrame, stale: Column) -> DataFrame:
    """df with claims that have gone stale pending again; claim, run and error are cleared."""
    hit = F.coalesce((F.col("status") == CLAIMED) & stale, F.lit(False))
    clear = lambda c: F.lit(PENDING) if c == "status" else F.lit(None).cast(dict(df.dtypes)[c])
    return df.select(*[F.when(hit, clear(c)).otherwise(F.col(c)).alias(c) if c in ("status", "run_id", "claimed_at", "error") else F.col(c) for c in df.columns])


def finish(df: DataFrame, outcomes: DataFrame, key: str, now: Column) -> DataFrame:
    """df (key, WORK's columns, ..) with the outcomes (key, status, target, error) written in: claims end, the time is set, a target is kept where none is given.

    Statuses are processed, failed, ignored or review_required; rows without an
    outcome stay. Of several outcomes of a row the greatest status counts.
    """
    o = outcomes.groupBy(key).agg(F.max(F.struct(F.col("status").alias("s"), F.col("target").alias("t"), F.col("error").alias("e"))).alias("_o"))
    new = {"status": F.col("_o.s"), "claimed_at": F.lit(None), "processed_at": now, "target": F.coalesce("_o.t", "target"), "error": F.col("_o.e")}
    return df.join(o, key, "left").select(*[F.when(F.col("_o").isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in df.columns])


def retry(df: DataFrame, status: str = REVIEW) -> DataFrame:
    """df with the rows of a status pending again and the rest of their work columns cleared."""
    return initialise(df, ~F.coalesce(F.col("status") == status, F.lit(False)))


def gate(df: DataFrame, blocking: tuple[str, ...] = (PENDING, CLAIMED, FAILED)) -> DataFrame:
    """One row (open, blocking, and a count for each blocking status): whether nothing stands before the next stage."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in blocking]
    total = reduce(Column.__add__, [F.col(s) for s in blocking])
    return df.agg(*counts).select((total == 0).alias("open"), total.alias("blocking"), *blocking)


def queue_run(runs: DataFrame, run: str, stage: str, total: int, size: int, now: Column) -> DataFrame:
    """runs (run_id, stage, status, batch_size, current_batch, total, processed, failed, ignored, error, started_at, finished_at, updated_at) with a new queued one.

    Only where the stage has no queued or running run; else runs stay as they are, which the caller can tell by the missing id.
    """
    row = {"run_id": F.lit(run), "stage": F.lit(stage), "status": F.lit(QUEUED), "batch_size": F.lit(size), "total": F.lit(total), "current_batch": F.lit(0), "processed": F.lit(0), "failed": F.lit(0), "ignored": F.lit(0), "updated_at": now}
    kinds = dict(runs.dtypes)
    active = runs.agg(F.count_if((F.col("stage") == stage) & F.col("status").isin(QUEUED, RUNNING)).alias("n")).where("n = 0")
    return runs.unionByName(active.select(*[(row.get(c, F.lit(None))).cast(kinds[c]).alias(c) for c in runs.columns]))


def count_batches(runs: DataFrame, batches: DataFrame, now: Column) -> DataFrame:
    """runs with the batches (run_id, batch, processed, failed, ignored) added to their counters: running from the first one on, at the greatest batch."""
    sums = batches.groupBy("run_id").agg(F.max("batch").alias("_batch"), *[F.sum(c).alias(f"_{c}") for c in ("processed", "failed", "ignored")])
    new = {c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in ("processed", "failed", "ignored")}
    new |= {"current_batch": F.greatest("current_batch", "_batch"), "started_at": F.coalesce("started_at", now), "status": F.when(F.col("status") == QUEUED, RUNNING).otherwise(F.col("status")), "updated_at": now}
    return runs.join(sums, "run_id", "left").select(*[F.when(F.col("_batch").isNotNull(), new[c]).otherwise(F.col(c)).cast(dict(runs.dtypes)[c]).alias(c) if c in new else F.col(c) for c in runs.columns])


def end_runs(runs: DataFrame, now: Column, despite_failures: bool = False) -> DataFrame:
    """runs with those at their end ended: failed, keeping what's done, as soon as a row failed, else completed once all rows are counted. With despite_failures a run completes whatever failed."""
    done = F.col("processed") + F.col("failed") + F.col("ignored") >= F.col("total")
    bad = F.lit(False) if despite_failures else F.col("failed") > 0
    ends = (F.col("status") == RUNNING) & (done | bad)
    new = {"status": F.when(bad, FAILED).otherwise(COMPLETED), "finished_at": now, "updated_at": now, "error": F.when(bad, F.concat(F.col("failed").cast("string"), F.lit(" rows failed"))).otherwise(F.col("error"))}
    return runs.select(*[F.when(ends, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in runs.columns])


def distinct_texts(df: DataFrame, column: str) -> DataFrame:
    """The distinct non-null values of a text column; of other types none counts."""
    return df.select(column).where(F.col(column).isNotNull()).distinct() if dict(df.dtypes)[column] == "string" else df.select(column).limit(0)


def like_components(old: Column, new: Column, may_grow: Column) -> Column:
    """Whether a record's components (array of keys) may replace the old ones: there were none, they are the same, in any order and as often; or, where it may grow, none is missing."""
    none = F.array().cast("array<string>")
    o, n = F.coalesce(old, none), F.coalesce(new, none)
    return (F.size(o) == 0) | (F.array_sort(o) == F.array_sort(n)) | (may_grow & (F.size(F.array_except(o, n)) == 0))


def obsolete_singles(groups: DataFrame, prefix: str = "ccv1|single|") -> DataFrame:
    """(key): the keys of single candidates that groups (group_key, member_key) of two or more have taken up, but for a group's own key."""
    size = groups.distinct().groupBy("group_key").agg(F.count("*").alias("n")).where("n > 1").select("group_key")
    return groups.join(size, "group_key", "left_semi").select("group_key", F.concat(F.lit(prefix), F.col("member_key")).alias("key")).where("key <> group_key").select("key").distinct()


def release_metrics(hotels: DataFrame, version: int) -> DataFrame:
    """One row of a release's figures over hotels (datasetversion, verification, has_point): total, verified, manually_checked, without_geo."""
    v = hotels.where(F.col("datasetversion") == version)
    checked = F.coalesce(F.col("verification") != "unreviewed", F.lit(True))
    return v.agg(F.count("*").alias("total"), F.count_if(F.col("verification") == "location_verified").alias("verified"), F.count_if(checked).alias("manually_checked"), F.count_if(~F.col("has_point")).alias("without_geo"))


def first_release(datasets: dict[str, DataFrame], version: int, column: str = "datasetversion") -> tuple[dict[str, DataFrame], DataFrame]:
    """(the datasets with the version where rows have none, (dataset, version, status, total) of each): the same again when run again."""
    stamped = {n: df.withColumn(column, F.coalesce(column, F.lit(version))) for n, df in datasets.items()}
    rows = [df.where(F.col(column) == version).agg(F.lit(n).alias("dataset"), F.lit(version).alias("version"), F.lit("published").alias("status"), F.count("*").alias("total")) for n, df in stamped.items()]
    return stamped, reduce(DataFrame.unionByName, rows)
