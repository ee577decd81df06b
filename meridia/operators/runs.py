"""Work tables and runs: leases, progress, rollback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lease(df: DataFrame, key: str, n: int, run: str, now: Column, pending: Column) -> DataFrame:
    """df with the first n pending rows by key leased to a run (run_id, claimed_at); a top-n, not a sort of the table."""
    taken = df.where(pending).select(key).orderBy(key).limit(n).withColumn("_t", F.lit(True))
    j = df.join(taken, key, "left")
    return j.withColumn("run_id", F.when(F.col("_t"), run).otherwise(F.col("run_id"))).withColumn("claimed_at", F.when(F.col("_t"), now).otherwise(F.col("claimed_at"))).drop("_t")


def expired(claimed_at: Column, now: Column, minutes: int = 30) -> Column:
    return F.coalesce(claimed_at < now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes)), F.lit(False))


def progress(done: Column, total: Column, completed: Column) -> Column:
    """Percent with one decimal, at most 99.9 before completion; a completed run of nothing is at 100."""
    p = F.floor(done / F.greatest(total, F.lit(1)) * 1000) / 10
    return F.when(completed, F.when(total == 0, 100.0).otherwise(p)).otherwise(F.least(p, F.lit(99.9)))


def latest_run(df: DataFrame, run: str, time: Column) -> DataFrame:
    """One row: the run with the latest time; ids without a time are ignored, equal ones go to the lesser id."""
    return df.where(time.isNotNull()).agg(F.min_by(F.col(run), F.struct((-F.unix_micros(time)).alias("t"), F.col(run).alias("r"))).alias(run))


def rollback(sources: DataFrame, targets: DataFrame, source_run: str, target_run: str, run: Column) -> tuple[DataFrame, DataFrame]:
    """Sources of a run with it unset, and the targets it didn't make."""
    reset = F.when(F.col(source_run) == run, F.lit(None)).otherwise(F.col(source_run))
    return sources.withColumn(source_run, reset), targets.where(~F.coalesce(F.col(target_run) == run, F.lit(False)))
