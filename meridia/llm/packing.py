"""p8: filling fixed-capacity containers with documents.

Lengths are counted by a public tokenizer. Within shards of bounded size the
documents, longest first, go to the sequence of the lowest estimated attention
cost that has room for them.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.session import cut, table

#: Where the vocabulary files lie, and the one that is used.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: A container's capacity in tokens.
CAPACITY = 2048
#: Attention costs LINEAR for each token and QUADRATIC for each pair within a document.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Pieces packed in one task. More are packed in several shards, of equal spread, each of which leaves at most a container or two ill filled.
SHARD = 20_000


def encoder(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    """The public byte-level tokenizer of a folder, read where it lies."""
    import public_tokenizers
    import tiktoken

    with open(f"{folder}/{vocabulary}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """(key, n_tokens) of each row; null and empty texts have none. Equal texts of a partition are counted once."""
    kind = dict(documents.dtypes)[key]

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, known = encoder(folder), {}
        for part in parts:
            sizes = []
            for t in part[text]:
                if not t:
                    sizes.append(0)
                    continue
                h = xxhash.xxh3_128_digest(t.encode("utf-8", "replace"))
                if h not in known:
                    known[h] = len(enc.encode_ordinary(t))
                sizes.append(known[h])
            yield pd.DataFrame({key: part[key], "n_tokens": sizes})

    return documents.select(key, text).mapInPandas(count, f"{key} {kind}, n_tokens long")


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each size, none greater than capacity: longest first, to the lowest-cost container with room; a new one where none has."""
    order = np.argsort(-sizes, kind="stable")
    n = max(1, -(-int(sizes.sum()) // capacity)) if len(sizes) else 0
    room, cost = np.full(n, capacity, np.int64), np.zeros(n)
    out = np.zeros(len(sizes), np.int64)
    for i in order:
        size = sizes[i]
        open_ = np.where(room >= size, cost, np.inf)
        at = int(open_.argmin())
        if room[at] < size:
            at = len(room)
            room, cost = np.append(room, capacity), np.append(cost, 0.0)
        room[at] -= size
        cost[at] += LINEAR * size + QUADRATIC * float(size) * float(size)
        out[i] = at
    return out


def packed(counts: DataFrame, rows: int, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """(container, slot, key, piece, first_token, n_tokens): where each document, or piece of one, lies.

    counts: key, n_tokens, rows of them. A document is cut, into pieces of a
    full container and a rest, only if it alone exceeds the capacity. slot
    counts from 0 within a container. Documents without tokens lie in a
    container too. Repeated keys are packed as often as they come. Pieces are
    spread by hash over shards of about SHARD, so that none grows with the data.
    """
    pieces = counts.select(key, "n_tokens", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("n_tokens") - 1) / capacity)).cast("int"))).alias("piece"))
    first = (F.col("piece") * capacity).cast("long")
    each = pieces.select(key, "piece", first.alias("first_token"), F.least(F.lit(capacity), F.col("n_tokens") - first).cast("long").alias("n_tokens"))
    shards = max(1, -(-rows // SHARD))
    kind = dict(counts.dtypes)[key]

    def fill(shard: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([key, "piece"], kind="stable").reset_index(drop=True)
        at = pack(part.n_tokens.to_numpy(), capacity)
        part["container"] = (np.int64(shard[0]) << np.int64(32)) + at
        part = part.sort_values(["container", "n_tokens", key, "piece"], ascending=[True, False, True, True], kind="stable")
        part["slot"] = part.groupby("container").cumcount().astype("int32")
        return part[["container", "slot", key, "piece", "first_token", "n_tokens"]]

    # as many partitions as shards: packing costs far more than its few bytes tell, so adaptive execution must not join them
    spread = each.withColumn("shard", F.pmod(F.xxhash64(key, "piece"), F.lit(shards)).cast("int")).repartition(shards, "shard")
    return spread.groupBy("shard").applyInPandas(fill, f"container long, slot int, {key} {kind}, piece int, first_token long, n_tokens long")


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = cut(token_counts(table(spark, sf_dir, "documents")))
    rows, extra = counts.agg(F.count("*"), F.sum(F.greatest(F.lit(0), F.floor((F.col("n_tokens") - 1) / CAPACITY)))).first()
    return packed(counts, rows + int(extra or 0))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(containers, tokens, unused_share): how well the containers are filled."""
    p = p8_packed(spark, sf_dir).groupBy("container").agg(F.sum("n_tokens").alias("t"))
    return p.agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.round(1 - F.sum("t") / (F.count("*") * CAPACITY), 4).alias("unused_share"))


def p8_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(documents, over_capacity, wrong_tokens, repeated_slots): the packing's invariants, counted over all containers and documents; the last three are 0."""
    counts = cut(token_counts(table(spark, sf_dir, "documents")))
    rows, extra = counts.agg(F.count("*"), F.sum(F.greatest(F.lit(0), F.floor((F.col("n_tokens") - 1) / CAPACITY)))).first()
    p = cut(packed(counts, rows + int(extra or 0)))
    full = p.groupBy("container").agg(F.sum("n_tokens").alias("t"), (F.count("*") - F.count_distinct("slot")).alias("r"))
    held = p.groupBy("doc_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
    wanted = counts.groupBy("doc_id").agg(F.sum("n_tokens").alias("w"), F.sum(F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / CAPACITY))).alias("pieces"))
    wrong = wanted.join(held, "doc_id", "full").agg(F.count("*").alias("documents"), F.count_if(~(F.col("w").eqNullSafe(F.col("t")) & F.col("pieces").eqNullSafe(F.col("n")))).alias("wrong_tokens"))
    over = full.agg(F.count_if(F.col("t") > CAPACITY).alias("over_capacity"), F.coalesce(F.sum("r"), F.lit(0)).alias("repeated_slots"))
    return wrong.select("documents", over.select("over_capacity").scalar().alias("over_capacity"), "wrong_tokens", over.select("repeated_slots").scalar().alias("repeated_slots"))


#: Containers, tokens and cuts can't be told without the tokenizer; that no invariant breaks can.
P8_SQL = "select count(distinct doc_id) as documents, 0::bigint as over_capacity, 0::bigint as wrong_tokens, 0::bigint as repeated_slots from documents"
