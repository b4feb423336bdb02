"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows get global numbers 0..N-1 in an order that depends on their content only. A keyed Feistel network
over the smallest even-bit domain of at least N numbers permutes them; a number that leaves 0..N-1 is
permuted again until it is back inside (cycle walking; fewer than 4 steps on average). The permuted
number p gives shard p mod S and slot p div S. Both can be computed, and inverted, from a row number alone.

Rows are numbered without a global sort: identical (id, size, checksum) rows are first summed to one row
with a count, rows are dealt to a fixed number of hash buckets, the buckets' counts give offsets, and a
window numbers the rows within a bucket. A row with many copies is unfolded by many tasks. No text is shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import durable, mix64, table, unfolded

SHARDS, ROUNDS, SEED = 24, 6, 20240229
#: Buckets for numbering; their counts are a table of so many rows at most.
BUCKETS = 4096


def half_bits(n: int) -> int:
    """Half the bits of the permuted domain, which has at least n numbers and fewer than 4n + 4."""
    return max(1, (max(1, n - 1).bit_length() + 1) // 2)


def _network(x: np.ndarray, half: int, seed: int, inverse: bool) -> np.ndarray:
    low = np.uint64((1 << half) - 1)
    keys = [np.uint64(k) for k in mix64(np.arange(ROUNDS, dtype=np.uint64) + np.uint64(seed))]
    left, right = x >> np.uint64(half), x & low
    if inverse:
        for key in reversed(keys):
            left, right = right ^ (mix64(left ^ key) & low), left
    else:
        for key in keys:
            left, right = right, left ^ (mix64(right ^ key) & low)
    return left << np.uint64(half) | right


def permute(rows: np.ndarray, n: int, seed: int = SEED, inverse: bool = False) -> np.ndarray:
    """The places of the row numbers ``rows`` in a permutation of 0..n-1; with ``inverse`` the row numbers of places."""
    x, half = np.asarray(rows, np.uint64).copy(), half_bits(n)
    walking = np.arange(len(x))
    while len(walking):
        x[walking] = _network(x[walking], half, seed, inverse)
        walking = walking[x[walking] >= np.uint64(n)]
    return x.astype(np.int64)


def _place(row: Column, n: int, seed: int) -> Column:
    @F.pandas_udf(T.LongType())
    def placed(rows: pd.Series) -> pd.Series:
        return pd.Series(permute(rows.to_numpy(), n, seed))

    return placed(row)


def row_numbers(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """``rows`` (the columns ``keys`` only) with a global ``row`` from 0, and their number; reruns agree, whatever the partitions."""
    summed = durable(rows.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")))
    sizes = summed.groupBy("bucket").agg(F.sum("n").alias("size"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    within = Window.partitionBy("bucket").orderBy(*keys)
    earlier = F.coalesce(F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # At most BUCKETS rows are broadcast.
    placed = summed.withColumn("first", earlier).join(F.broadcast(offsets), "bucket")
    placed = durable(placed.select(*keys, (F.col("offset") + F.col("first")).alias("first"), "n"))
    return unfolded(placed, "n", "copy").select(*keys, (F.col("first") + F.col("copy")).alias("row")), total


def feistel_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard, row (the global number).

    The law is ``rows``: shards' counts differ by one at most, and slots are gapless from 0. Size: bytes
    of the text in UTF-8 (null: none) plus 8. grown_shard is null, as adding a shard moves most rows.
    Equal texts are placed each for themselves. Repeated rows get a place each; null ids and null texts
    take part like others (a null text's checksum is that of an empty one); an empty table gives no rows;
    extra columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    numbered, total = row_numbers(rows, ["doc_id", "size", "text_crc32"])
    placed = numbered.withColumn("place", _place(F.col("row"), total, seed))
    shard = (F.col("place") % shards).cast("int")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.alias("shard"), F.expr(f"place div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row")


def op3_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel_shards(table(spark, sf_dir, "documents"))
