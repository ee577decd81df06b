"""Upserts by hash, stale marks, versions and publication; each gives a new snapshot to write, none changes a path it reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INSERTED, UPDATED, UNCHANGED, MISSING = "INSERTED", "UPDATED", "UNCHANGED", "MISSING"


def hash_diff(old: DataFrame, new: DataFrame, keys: list[str], hashes: list[str]) -> DataFrame:
    """(keys.., action): INSERTED, UPDATED, UNCHANGED, and MISSING for what the new rows no longer have.

    Both sides' keys must be unique; nulls in hashes equal each other and nothing else. One join on the keys.
    """
    hashed = lambda df, name: df.select(*keys, F.xxhash64(*[x for c in hashes for x in (F.col(c).isNull(), F.col(c))]).alias(name))
    o, n = hashed(old, "_o"), hashed(new, "_n")
    action = F.when(F.col("_o").isNull(), INSERTED).when(F.col("_n").isNull(), MISSING).when(F.col("_o") == F.col("_n"), UNCHANGED).otherwise(UPDATED)
    return o.join(n, keys, "full").select(*keys, action.alias("action"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] = ()) -> DataFrame:
    """The next snapshot: new rows replace old ones but for the columns in keep, old rows without a new one stay."""
    cols = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(*cols).alias("_o"))
    n = new.select(*keys, F.struct(*[c for c in new.columns if c not in keys]).alias("_n"))
    have = {c for c in new.columns if c not in keys}
    pick = lambda c: F.col(f"_o.{c}") if c not in have else F.when(F.col("_n").isNull() | (F.col("_o").isNotNull() & F.lit(c in keep)), F.col(f"_o.{c}")).otherwise(F.col(f"_n.{c}"))
    return o.join(n, keys, "full").select(*keys, *[pick(c).alias(c) for c in cols])


def mark_stale(old: DataFrame, seen: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """old with stale_since set where its key isn't among the seen, kept where it was set, and cleared where it's seen again."""
    s = seen.select(*keys).distinct().withColumn("_seen", F.lit(True))
    since = F.when(F.col("_seen"), F.lit(None)).otherwise(F.coalesce("stale_since", at))
    return old.join(s, keys, "left").withColumn("stale_since", since).drop("_seen")


def action_counts(diff: DataFrame, failed: int = 0) -> DataFrame:
    """One row: read, inserted, updated, unchanged, marked_stale, failed."""
    count = lambda a: F.count_if(F.col("action") == a)
    return diff.agg((F.count_if(F.col("action") != MISSING) + failed).alias("read"), count(INSERTED).alias("inserted"), count(UPDATED).alias("updated"), count(UNCHANGED).alias("unchanged"), count(MISSING).alias("marked_stale"), F.lit(failed).cast("long").alias("failed"))


def fill_merge(old: DataFrame, new: DataFrame, key: str, old_first: list[str], new_first: list[str]) -> DataFrame:
    """Both sides' rows by key; of each column the first non-null value, from the old side for old_first, from the new one for new_first."""
    j = old.alias("o").join(new.alias("n"), key, "full")
    return j.select(key, *[F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in old_first], *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in new_first])


def next_version(versions: DataFrame, dataset: str, now: Column) -> DataFrame:
    """versions (dataset, version, status, created_at, published_at) with the dataset's next number as a draft."""
    new = versions.where(F.col("dataset") == dataset).agg(F.coalesce(F.max("version"), F.lit(0)).alias("m")).select(F.lit(dataset).alias("dataset"), (F.col("m") + 1).cast("int").alias("version"), F.lit("draft").alias("status"), now.alias("created_at"), F.lit(None).cast("timestamp").alias("published_at"))
    return versions.unionByName(new)


def publish_version(versions: DataFrame, dataset: str, version: int, now: Column) -> DataFrame:
    """A draft becomes published; other states stay."""
    hit = (F.col("dataset") == dataset) & (F.col("version") == version) & (F.col("status") == "draft")
    return versions.withColumn("published_at", F.when(hit, now).otherwise(F.col("published_at"))).withColumn("status", F.when(hit, "published").otherwise(F.col("status")))


def stamp(df: DataFrame, version: int, column: str = "datasetversion") -> DataFrame:
    """All rows, stale ones too, as of a version."""
    return df.withColumn(column, F.lit(version).cast("int"))


def choose_release(releases: DataFrame, key: str | None = None, version: int | None = None) -> DataFrame:
    """The release of a key, else of a version, else the latest published by (published_at, version)."""
    if key is not None:
        return releases.where(F.col("release_key") == key)
    if version is not None:
        return releases.where(F.col("version") == version)
    return releases.where("status = 'published'").orderBy(F.desc("published_at"), F.desc("version")).limit(1)


def resolve_targets(records: DataFrame, known: DataFrame, facts: list[str], lists: list[str]) -> DataFrame:
    """(rid, kid, how): the known record each new one belongs to: 'exact' by key; else 'alike', the only one of the same name and kind that shares a fact; 'ambiguous' (kid null) if there are several, 'new' if none.

    records: rid, key, name, kind, the facts (texts) and lists (arrays of
    texts); known: kid and the same. Null and empty facts are shared with none,
    null names and kinds belong to no other. Several known records of one key
    are ambiguous too. A shared fact is a join key of its own, so a frequent
    name is no nested loop.
    """
    exact = known.groupBy("key").agg(F.min("kid").alias("_k"), F.count_distinct("kid").alias("_n"))
    by_key = records.select("rid", "key").join(exact, "key").select("rid", F.when(F.col("_n") == 1, F.col("_k")).alias("kid"), F.when(F.col("_n") == 1, "exact").otherwise("ambiguous").alias("how"))

    def shared(df: DataFrame, ident: str) -> DataFrame:
        tokens = [F.when(F.col(f) != "", F.array(F.concat(F.lit(f"{f}:"), F.col(f)))) for f in facts]
        tokens += [F.transform(F.filter(F.col(x), lambda v: v != ""), lambda v: F.concat(F.lit("list:"), v)) for x in lists]
        none = F.array().cast("array<string>")
        return df.select(ident, "name", "kind", F.explode(F.array_distinct(F.concat(*[F.coalesce(t, none) for t in tokens]))).alias("_t"))

    rest = records.join(by_key.select("rid"), "rid", "left_anti")
    met = shared(rest, "rid").join(shared(known, "kid"), ["name", "kind", "_t"]).groupBy("rid").agg(F.min("kid").alias("_lo"), F.max("kid").alias("_hi"))
    one = F.col("_lo") == F.col("_hi")
    by_fact = rest.select("rid").join(met, "rid", "left").select("rid", F.when(one, F.col("_lo")).alias("kid"), F.when(F.col("_lo").isNull(), "new").when(one, "alike").otherwise("ambiguous").alias("how"))
    return by_key.unionByName(by_fact)
