"""Sharding by jump consistent hashing (Lamping and Veach, 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Groups of rows in a shard that are numbered apart; bounds the offsets table to shards * BLOCKS rows.
BLOCKS = 256


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key; a key moves only into a shard that is appended."""
    key = keys.astype(np.uint64)
    shard = np.zeros(len(key), np.int64)
    ahead = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        shard[live] = ahead[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1)
        ahead[live] = ((shard[live] + 1) * step).astype(np.int64)
        live = live[ahead[live] < shards]
    return shard.astype(np.int32)


def assign_shards(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard and slot of every row under the law `key`.

    Returns key, size (UTF-8 bytes of the text plus 1), text_crc32, law, shard,
    slot (0, 1, ... within the shard) and grown_shard (with one more shard).
    A null text has size 1 and a null text_crc32; a null key hashes as the
    largest long. Rows with one key share its shard, each with its own slot,
    ordered by a hash of the row, then key, checksum and size; equal rows are
    interchangeable. An empty table gives an empty result.
    """

    @F.pandas_udf("shard int, grown_shard int")
    def places(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for ids in batches:
            k = ids.to_numpy(np.int64).view(np.uint64)
            yield pd.DataFrame({"shard": jump_hash(k, shards), "grown_shard": jump_hash(k, shards + 1)})

    rows = docs.select(
        F.col(key).cast("long").alias(key),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.col(text).cast("binary")).alias("text_crc32"),
    )
    rows = rows.withColumn("at", places(F.coalesce(F.col(key), F.lit(2**63 - 1)))).select(
        key, "size", "text_crc32", F.lit("key").alias("law"), "at.shard", "at.grown_shard",
        F.pmod(F.xxhash64(key, "text_crc32", "size"), F.lit(BLOCKS)).cast("int").alias("_block"),
    )
    block = W.partitionBy("shard", "_block").orderBy(F.col(key).asc_nulls_first(), "text_crc32", "size")
    before = W.partitionBy("shard").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    # (shards * BLOCKS rows at most, whatever the input.)
    starts = rows.groupBy("shard", "_block").count().select(
        "shard", "_block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start")
    )
    return (
        rows.withColumn("_row", F.row_number().over(block))
        .join(F.broadcast(starts), ["shard", "_block"])
        .select(key, "size", "text_crc32", "law", "shard", (F.col("_start") + F.col("_row") - 1).cast("long").alias("slot"), "grown_shard")
    )
