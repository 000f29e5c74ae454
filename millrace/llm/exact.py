"""Exact dedup: a tree merge of sorted digest runs.

Rows are dealt into 2**levels runs by a hash of their id. A run is sorted by digest and holds one entry a digest: the smallest id,
the largest id, and the count. In round r the runs whose numbers agree but for the r-th group of bits exchange their entries by
digest, up to 2**fan_bits runs at a time, and are merged into one: entries come sorted, are merged in order, and equal neighbours
become one entry, which retains the smallest (and largest) identifier. They are equal only if the SHA-256, the length and a second
hash of the text agree; that is the verification, at every level. After the last round one run is left, parted by digest.

A round's plan is Sort, SortAggregate (partial), Exchange, Sort, SortAggregate: identifiers travel as structs, which Spark aggregates
in order and not by hashing. Its sort stands for the multiway merge: Spark does not use that what it fetches is sorted already, but
merges its own spilled runs.

The decisions then flow back down: the last run is joined with the entries of the first level, of which a digest has at most one a
run, and these with the rows of their run; so no key has more than its run's share of a group in a join. There are 64 runs at
least, and as many more as keep a run under ``run_rows`` rows, so that this share does not grow with the data.

Defined results: null text is empty text; a null id is taken as the smallest id in comparisons and returned as null; repeated
rows count each time in group_size and all carry the same decision; an empty table gives no rows; other columns are ignored. Ids
are longs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import NULL_ID, ascii_lower, materialize

_DIGEST = ["digest", "size", "check"]


def _sorted_run(entries: DataFrame, run: Column, low: Column, high: Column, n: Column) -> DataFrame:
    """One entry a run and digest, in order of the digest."""
    # Structs: what Spark cannot update in place it aggregates in the order of the keys.
    return entries.groupBy(run.alias("run"), *_DIGEST).agg(F.min(F.struct(low.alias("id"))).alias("low"), F.max(F.struct(high.alias("id"))).alias("high"), F.sum(n).alias("n"))


def merge_runs(runs: DataFrame, bits: int, fan_bits: int = 3) -> DataFrame:
    """Merges the runs of entries (run, digest, size, check, low, high, n) into one."""
    while bits > 0:
        step = min(fan_bits, bits)
        bits -= step
        runs = _sorted_run(runs, F.shiftright("run", step), F.col("low.id"), F.col("high.id"), F.col("n"))
    return runs


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", least_levels: int = 6, run_rows: int = 1 << 22, normalise: Column | None = None
) -> DataFrame:
    """A row per input row: id, keep_id, group_size, kept, text_sha256 (lowercase hex of the normalised text).

    keep: "smallest" or "largest" id of a group stays. normalise: the text as it is compared; default: A-Z lower-cased.
    """
    text = F.coalesce(ascii_lower(F.col(text_col)) if normalise is None else normalise, F.lit(""))
    # One pass over the texts; all that follows reads some 60 bytes a row.
    rows = materialize(
        docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), text.alias("text")).select(
            "id", F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").alias("size"), F.xxhash64("text").alias("check")
        ),
        "digests",
    )
    levels = max(least_levels, (rows.count() // run_rows).bit_length())
    rows = rows.withColumn("run", F.pmod(F.xxhash64("id"), F.lit(1 << levels)).cast("int"))
    runs = materialize(_sorted_run(rows, F.col("run"), F.col("id"), F.col("id"), F.lit(1)), "digest-runs")
    final = merge_runs(runs, levels).select(*_DIGEST, F.col("low.id" if keep == "smallest" else "high.id").alias("keep"), F.col("n").alias("group_size"))
    decided = runs.select("run", *_DIGEST).join(final, _DIGEST)
    out = rows.join(decided, ["run", *_DIGEST])
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(
        real("id").alias(id_col),
        real("keep").alias("keep_id"),
        "group_size",
        (F.col("id") == F.col("keep")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
