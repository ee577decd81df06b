"""Incremental upserts: files that arrived since the last call, in bounded micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.operators.dedupe import keep_last
from meridia.operators.merge import upsert

#: Key-hash buckets of a target. A batch rewrites those it touches only.
BUCKETS = 16


def versions(spark: SparkSession, target: str, below: int | None = None) -> dict[int, int]:
    """{bucket: number of the last batch that wrote it}, of finished batches, below a number where one is given.

    A batch has finished when its folder bears Spark's mark of success, so what
    a failed one left behind is never read.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return {}
    last: dict[int, int] = {}
    for folder in fs.listStatus(path):
        name = folder.getPath().getName()
        if not name.startswith("v=") or not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{name}/_SUCCESS")):
            continue
        number = int(name[2:])
        if below is not None and number >= below:
            continue
        for part in fs.listStatus(folder.getPath()):
            if part.getPath().getName().startswith("bucket="):
                bucket = int(part.getPath().getName()[7:])
                last[bucket] = max(number, last.get(bucket, -1))
    return last


def held(spark: SparkSession, target: str, at: dict[int, int]) -> DataFrame | None:
    """The rows of the given buckets at the given batches; None for none."""
    parts = [f"{target}/v={number}/bucket={bucket}" for bucket, number in sorted(at.items())]
    return spark.read.parquet(*parts) if parts else None


def stream_upsert(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: list[str], order: str, files_per_batch: int = 64, buckets: int = BUCKETS) -> int:
    """Take all new files of a folder into the table at target and stop; gives the number of the last batch the table holds, -1 for none.

    Of each batch the last row of a key by order wins. A batch reads and writes
    only the key-hash buckets it touches, as new folders v=<batch>/bucket=<b>;
    untouched ones stay where they are, so its cost goes with what arrived. A
    repeated batch after a failure gives the same folders, and a path is never
    read while it's written. Late rows, older by order than what the table
    holds, change nothing.
    """

    def take(batch: DataFrame, number: int) -> None:
        last = keep_last(batch, keys, order).withColumn("bucket", F.pmod(F.hash(*keys), F.lit(buckets))).persist()
        touched = {r.bucket for r in last.select("bucket").distinct().collect()}
        old = held(spark, target, {b: n for b, n in versions(spark, target, number).items() if b in touched})
        rows = last.drop("bucket")
        if old is not None:
            newer = rows.alias("n").join(old.select(*keys, F.col(order).alias("_seen")), keys, "left").where(F.col("_seen").isNull() | (F.col(order) >= F.col("_seen"))).drop("_seen")
            rows = upsert(old, newer, keys)
        placed = rows.withColumn("bucket", F.pmod(F.hash(*keys), F.lit(buckets)))
        placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/v={number}")
        last.unpersist()

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return max(versions(spark, target).values(), default=-1)


def latest(spark: SparkSession, target: str, batch: int | None = None) -> DataFrame:
    """The table as of a batch, or of the last one; an error where there's none yet."""
    df = held(spark, target, versions(spark, target, None if batch is None else batch + 1))
    if df is None:
        raise FileNotFoundError(f"no finished batch at {target}")
    return df


def compact(spark: SparkSession, target: str, keep: int) -> None:
    """Drop the folders no reader of the batches from keep on needs: those that a later one, up to keep, has replaced."""
    at = versions(spark, target, keep + 1)
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in fs.listStatus(path):
        name = folder.getPath().getName()
        if name.startswith("v=") and int(name[2:]) <= keep:
            for part in fs.listStatus(folder.getPath()):
                p = part.getPath().getName()
                if p.startswith("bucket=") and at.get(int(p[7:]), -1) > int(name[2:]):
                    fs.delete(part.getPath(), True)
