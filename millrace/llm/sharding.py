"""Sharding by a Feistel permutation of global row numbers.

Rows get the numbers 0 to n - 1 in the order of (bucket, id, crc32, size), where the bucket is a hash of these three: the
numbers depend on the rows alone, not on files or partitions, and no global sort is needed; a bucket holds about a million rows at
most, but for rows that repeat. A Feistel network over the smallest
even number of bits that holds n, walked along its cycles until it lands below n, permutes the numbers; position p lies in shard
p mod shards, at slot p div shards. So shard sizes differ by one at most, slots have no gaps, and either can be computed from a
number (``feistel``) or a number from them (``feistel_inverse``) without the table.

Defined results: a null text has no bytes (size 1, crc32 0); a null id sorts first; repeated rows get a number each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import NULL_ID, copies, materialize

_ROUNDS = 6


def _mix(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _network(x: np.ndarray, half: int, seed: int, order: range) -> np.ndarray:
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> shift, x & mask
    back = order.step < 0
    for r in order:
        key = np.uint64((seed * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % 2**64)
        if back:
            left, right = right ^ (_mix(left + key) & mask), left
        else:
            left, right = right, left ^ (_mix(right + key) & mask)
    return (left << shift) | right


def _walk(numbers: np.ndarray, n: int, seed: int, order: range) -> np.ndarray:
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    x = _network(np.asarray(numbers).astype(np.uint64), half, seed, order)
    while (out := x >= np.uint64(n)).any():
        x[out] = _network(x[out], half, seed, order)
    return x.astype(np.int64)


def feistel(numbers: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Positions of row numbers under the permutation of range(n)."""
    return _walk(numbers, n, seed, range(_ROUNDS))


def feistel_inverse(positions: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Row numbers at positions."""
    return _walk(positions, n, seed, range(_ROUNDS - 1, -1, -1))


def shard(
    docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", seed: int = 0, buckets: int = 1024, bucket_rows: int = 1 << 20
) -> DataFrame:
    """A row per input row: id, size (UTF-8 bytes and 1), text_crc32, row_number, shard, slot."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    facts = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc")
    )
    # Rows that agree in all three are interchangeable: they are counted, and numbered as a range.
    rows = materialize(facts.groupBy("id", "crc", "size").agg(F.count("*").alias("n")), "shard-rows")
    # Beyond buckets * bucket_rows rows there are more buckets, so that the sort of one does not grow.
    buckets = max(buckets, 1 << (rows.count() // bucket_rows).bit_length())
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "crc", "size"), F.lit(buckets)))
    counts = sorted(tuple(r) for r in rows.groupBy("bucket").agg(F.sum("n")).collect())  # a row a bucket, that is for a million rows or more
    starts, total = [], 0
    for b, k in counts:
        starts.append((b, total))
        total += k
    offsets = docs.sparkSession.createDataFrame(starts, "bucket long, start long")
    before = Window.partitionBy("bucket").orderBy("id", "crc", "size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = (
        rows.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(F.broadcast(offsets), "bucket")
        .transform(lambda df: copies(df, "n", "copy"))
        .withColumn("row_number", F.col("start") + F.col("first") + F.col("copy"))
    )

    def position(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for numbers in batches:
            yield pd.Series(feistel(numbers.to_numpy(), total, seed))

    pos = F.pandas_udf(position, "long")(F.col("row_number"))
    return numbered.withColumn("_pos", pos).select(
        F.when(F.col("id") != NULL_ID, F.col("id")).alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        "row_number",
        F.pmod("_pos", F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"_pos div {shards}").alias("slot"),
    )
