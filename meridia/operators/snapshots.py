"""What changed between consecutive full snapshots.

Keys and rows become 64-bit hashes, hash-bucketed; in each bucket the arrays
are sorted in numpy, and searchsorted gives the set differences of neighbouring
snapshots. Full keys are fetched only for what differs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADDED, REMOVED, CHANGED = "added", "removed", "changed"
ROWS_PER_BUCKET = 250_000
_DIFF = "series long, ord int, bucket int, kh long, kind string"


def written(*cols: Column) -> Column:
    """One string that tells any two different lists of values apart; null isn't the empty text."""
    return F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cols)]), {"ignoreNullFields": "false"})


def json_value(text: Column) -> Column:
    """A JSON text in one form for each value: sorted keys, no blanks, escapes resolved. Malformed text stays as it is; null stays null."""
    return F.when(text.isNull(), F.lit(None)).otherwise(F.coalesce(F.to_json(F.try_parse_json(text)), F.concat(F.lit("malformed:"), text)))


def _mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser, so that sums of row hashes stay apart."""
    h = h.astype(np.uint64)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def diff_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """The differences within one bucket; rows: series, ord, last, kh, rh, distinct. A key of several rows is compared by the set of them."""
    series, at, last, kh, rh = (rows[c].to_numpy() for c in ("series", "ord", "last", "kh", "rh"))
    order = np.lexsort((kh, at, series))
    series, at, last, kh, rh = series[order], at[order], last[order], kh[order], _mixed(rh[order])
    first = np.ones(len(kh), bool)
    first[1:] = (series[1:] != series[:-1]) | (at[1:] != at[:-1]) | (kh[1:] != kh[:-1])
    begins = np.flatnonzero(first)
    with np.errstate(over="ignore"):
        rh = np.add.reduceat(rh, begins)
    series, at, last, kh = series[begins], at[begins], last[begins], kh[begins]
    cut = np.flatnonzero(np.r_[True, (series[1:] != series[:-1]) | (at[1:] != at[:-1])])
    ends = np.r_[cut[1:], len(kh)]
    out: list[tuple[int, int, np.ndarray, str]] = []
    for g, (b, e) in enumerate(zip(cut, ends)):
        s, t = series[b], at[b]
        keys, values = kh[b:e], rh[b:e]
        if t > 0:
            p = cut[g - 1] if g and series[cut[g - 1]] == s and at[cut[g - 1]] == t - 1 else None
            old, old_values = (kh[p : ends[g - 1]], rh[p : ends[g - 1]]) if p is not None else (kh[:0], rh[:0])
            if len(old):
                place = np.minimum(np.searchsorted(old, keys), len(old) - 1)
                there = old[place] == keys
                out.append((s, t, keys[there & (old_values[place] != values)], CHANGED))
                place = np.minimum(np.searchsorted(keys, old), len(keys) - 1)
                out.append((s, t, old[keys[place] != old], REMOVED))
            else:
                there = np.zeros(len(keys), bool)
            out.append((s, t, keys[~there], ADDED))
        followed = g + 1 < len(cut) and series[cut[g + 1]] == s and at[cut[g + 1]] == t + 1
        if not followed and t < last[b]:
            out.append((s, t + 1, keys, REMOVED))
    if not out:
        return pd.DataFrame({"series": [], "ord": [], "kh": [], "kind": []})
    return pd.DataFrame(
        {
            "series": np.concatenate([np.full(len(k), s) for s, _, k, _ in out]),
            "ord": np.concatenate([np.full(len(k), t) for _, t, k, _ in out]),
            "kh": np.concatenate([k for _, _, k, _ in out]),
            "kind": np.concatenate([np.full(len(k), w, object) for _, _, k, w in out]),
        }
    )


def _bucket_job(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    return diff_bucket(rows).assign(bucket=key[0])[["series", "ord", "bucket", "kh", "kind"]]


def snapshot_changes(rows: DataFrame, snapshots: DataFrame, buckets: int) -> DataFrame:
    """(series, snapshot_id, record_key, change_kind) between consecutive snapshots of each series.

    rows: series, snapshot_id, record_key, content (string), one per delivered
    record; snapshots: series, snapshot_id, rank_by, every snapshot, those
    without rows too, ordered by rank_by, then snapshot_id. Nothing comes out
    for a series' first snapshot. Repeated rows count once; where one key has
    several contents in a snapshot, the sets of contents are compared. Rows with
    a null key, series or snapshot, and of snapshots not listed, are left out;
    null content is a content of its own. An empty table gives an empty result.

    Buckets are by key hash alone, so no series, however large, meets in one
    task, and repeated rows are made distinct before they're bucketed. A key is
    told apart by 64 bits and its bucket's number.
    """
    listed = snapshots.where(F.col("series").isNotNull() & F.col("snapshot_id").isNotNull())
    listed = listed.groupBy("series", "snapshot_id").agg(F.min("rank_by").alias("rank_by"))
    numbered = listed.groupBy("series").agg(F.sort_array(F.collect_list(F.struct("rank_by", "snapshot_id"))).alias("all"))
    order = numbered.select("series", F.xxhash64("series").alias("sh"), (F.size("all") - 1).alias("last"), F.posexplode("all").alias("ord", "one")).select("series", "sh", "last", "ord", F.col("one.snapshot_id").alias("snapshot_id"))
    hashed = rows.where(F.col("record_key").isNotNull()).select(
        "series",
        "snapshot_id",
        F.xxhash64("record_key").alias("kh"),
        F.pmod(F.hash(F.lit("bucket"), "record_key"), F.lit(buckets)).cast("int").alias("bucket"),
        F.xxhash64(F.coalesce("content", F.lit("null content"))).alias("rh"),
    )
    placed = hashed.join(order, ["series", "snapshot_id"]).select(F.col("sh").alias("series"), "ord", "last", "bucket", "kh", "rh").distinct()
    found = placed.groupBy("bucket").applyInPandas(_bucket_job, _DIFF)
    later = order.select(F.col("sh"), F.col("ord"), "snapshot_id", "series")
    wanted = found.select(F.col("series").alias("sh"), "ord", "bucket", "kh", "kind")
    #: keys are fetched for what differs alone, and each once, however many snapshots and rows hold it
    keys = rows.where(F.col("record_key").isNotNull()).select(F.xxhash64("record_key").alias("kh"), F.pmod(F.hash(F.lit("bucket"), "record_key"), F.lit(buckets)).cast("int").alias("bucket"), "record_key")
    differing = keys.join(wanted.select("bucket", "kh").distinct(), ["bucket", "kh"], "left_semi").groupBy("bucket", "kh").agg(F.min("record_key").alias("record_key"))
    full = wanted.join(differing, ["bucket", "kh"]).select("sh", "ord", "kind", "record_key").distinct()
    return full.join(later, ["sh", "ord"]).select("series", "snapshot_id", "record_key", F.col("kind").alias("change_kind"))


def bucket_count(rows: int) -> int:
    """Buckets by which none holds more than about ROWS_PER_BUCKET rows."""
    return max(8, -(-rows // ROWS_PER_BUCKET))


def file_date(filename: Column) -> Column:
    """The date D.M.YYYY within a file's name, null without a valid one."""
    part = lambda i: F.regexp_extract(filename, r"(?<!\d)(\d{1,2})\.(\d{1,2})\.(\d{4})(?!\d)", i)
    return F.try_to_date(F.concat_ws("-", part(3), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0")), "yyyy-MM-dd")


