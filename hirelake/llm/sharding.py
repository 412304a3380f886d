"""Sharding by jump consistent hashing.

A stable integer key and the number of shards alone decide a row's shard. There is no ring table
to keep or broadcast, and raising the number of shards from n to n+1 moves a row only into the
new shard, which gets 1/(n+1) of the keys.

Defined cases: a null key hashes as key 0; a null text has size 1 (no bytes, plus 1) and the
checksum of the empty text; ties: rows repeated in all of key, size and checksum get slots next to
each other (by the ten thousand); a text of any length is read whole, for its size and checksum
only; an empty table gives an empty result; other columns of the input are ignored by the digest
and kept by :func:`with_shards`, whose new column replaces one of the same name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm.common import cut_copies, materialise, order_key, prefix_sums, table, text_of

SHARDS = 16
#: Multiplier of the 64-bit congruential generator of the published algorithm (fixed value).
JUMP_MULTIPLIER = 2862933555777941757


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of each 64-bit key, all keys at once.

    A key's candidate shard jumps ahead by a random stride until it passes ``shards``; the last
    candidate below it is the answer. About ln(shards) rounds, each over the keys still jumping.
    """
    state = keys.astype(np.int64).view(np.uint64).copy()
    bucket = np.full(len(state), -1, np.int64)
    ahead = np.zeros(len(state), np.int64)
    active = np.arange(len(state))
    while len(active):
        bucket[active] = ahead[active]
        state[active] = state[active] * np.uint64(JUMP_MULTIPLIER) + np.uint64(1)
        stride = float(1 << 31) / ((state[active] >> np.uint64(33)).astype(np.float64) + 1.0)
        ahead[active] = ((bucket[active] + 1) * stride).astype(np.int64)
        active = active[ahead[active] < shards]
    return bucket


def shard_column(key: str, shards: int):
    """Column with the shard of a long key column."""
    if shards < 1:
        raise ValueError("shards must be at least 1")

    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64), shards).astype(np.int32))

    return shard(F.coalesce(F.col(key).cast("long"), F.lit(0)))


def with_shards(df: DataFrame, key: str = "doc_id", shards: int = SHARDS, into: str = "shard") -> DataFrame:
    """``df`` with its shard; a map-only step."""
    return df.withColumn(into, shard_column(key, shards))


def write_shards(df: DataFrame, path: str, key: str = "doc_id", shards: int = SHARDS) -> None:
    """Write one folder of files per shard; no shuffle, and big shards stay many files."""
    with_shards(df, key, shards, "shard").write.partitionBy("shard").parquet(path)


def shard_digest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: size, checksum, shard, gapless slot in the shard, shard of one more.

    Slots follow md5 of doc_id. Repeated rows are counted before the shuffle and spread out again
    at the end, in parts of bounded size that are dealt out on their own.
    """
    text = text_of()
    rows = (
        docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
        .groupBy("doc_id", "size", "text_crc32")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    rows = rows.select(
        "*",
        order_key("doc_id").alias("okey"),
        shard_column("doc_id", shards).alias("shard"),
        shard_column("doc_id", shards + 1).alias("grown_shard"),
    )
    ranked = prefix_sums(cut_copies(materialise(rows, "shards")), ["shard"], ["okey", "doc_id", "size", "text_crc32", "part"], "copies")
    return ranked.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        F.explode(F.sequence(F.col("before"), F.col("before") + F.col("copies") - 1)).alias("slot"),
        "grown_shard",
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_digest(table(spark, sf_dir, "documents"))
