"""Line dedup: lines whose key occurs in several documents stay in one of them only.

A text is split at \\n; a line's key is the line without white space at its ends and with A-Z lower-cased. The keys of at least
``min_chars`` code points are hashed (128 bits) and written once as (id, text hash, position, key hash). Per hash the distinct
documents are counted, first in runs of documents and then over the runs; hashes at or over ``min_docs`` drop all their lines but
those in the document with the smallest id. Only (id, position) pairs travel back to the texts, and only texts that may lose a line are shuffled to
meet them; rows that repeat one text under one id meet there in one key, which adaptive execution parts.

For two documents the smallest and the largest id tell as much as a count of distinct ones, and are kept in its place; for more
the distinct ids are counted. An id has one run, so counts of runs add up. Both ways are held against the same plain version.

Defined results: null or empty text is one empty line and comes back as empty text; a null id sorts before all others; rows with
the same id are one document for counting, and each is returned; lines without a key that long always stay; an empty table gives
no rows; columns of the input that have the names of the counts are replaced (``counts`` names them otherwise). A very long text is split
into one array, and takes time in proportion to its length. Ids are longs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import NULL_ID, SPACES, ascii_lower, free_name, marked_maybe, materialize


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2, runs: int = 64,
    counts: tuple[str, str] = ("n_lines", "n_dropped"),
) -> DataFrame:
    """The columns of docs with the text reduced to the lines that stay, and the counts of lines before and of those dropped."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)), F.xxhash64(text)
    # Named first: beside the generator they would be worked out for each line.
    named = docs.select(ident[0].alias("__id"), ident[1].alias("__hash"), F.split(text, "\n", -1).alias("__parts"))
    lines = named.select("__id", "__hash", F.posexplode("__parts").alias("__pos", "__line")).withColumn("__line", line_key(F.col("__line")))
    keys = materialize(
        lines.where(F.length("__line") >= min_chars).select("__id", "__hash", "__pos", F.unhex(F.md5("__line")).alias("__key")), "line-keys"
    )
    # An id has one run, so documents counted in runs add up; and a frequent key comes back to its lines in as many parts as there are runs.
    run = F.pmod(F.xxhash64("__id"), F.lit(runs)).alias("__run")
    count = F.count_distinct("__id") if min_docs > 2 else F.max("__id")
    by_run = keys.groupBy(run, "__key").agg(F.min("__id").alias("__first"), count.alias("__more"))
    # Two documents hold a key if its smallest and largest id differ.
    enough = F.sum("__more") >= min_docs if min_docs > 2 else F.min("__first") < F.max("__more")
    held = by_run.groupBy("__key").agg(F.min("__first").alias("__first"), enough.alias("__held")).where("__held").select("__key", "__first")
    decided = by_run.select("__run", "__key").join(held, "__key")
    drops = (
        keys.withColumn("__run", run)
        .join(decided, ["__run", "__key"])
        .where("__id != __first")
        .groupBy("__id", "__hash")
        .agg(F.collect_set("__pos").alias("__drops"))
    )
    i, h, d, maybe, parts = (free_name(docs, x) for x in ("__id", "__hash", "__drops", "__maybe", "__parts"))
    drops = materialize(drops.toDF(i, h, d), "line-drops")
    # Only texts that may lose a line meet the drops; a bitmap of ids tells them apart.
    rows = marked_maybe(docs.select("*", ident[0].alias(i)), drops.select(i), i, maybe)
    losing = rows.where(maybe).withColumn(h, ident[1]).join(drops, [i, h], "left").drop(h)
    out = losing.unionByName(rows.where(~F.col(maybe)).withColumn(d, F.lit(None).cast("array<int>")))
    # A column of its own: inside the lambda the text would be split for each line.
    out = out.withColumn(parts, F.split(text, "\n", -1))
    dropped, lines_of = F.col(d), F.col(parts)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines_of) - 1), dropped)
    kept = F.when(dropped.isNull(), text).otherwise(F.array_join(F.transform(stay, lambda n: F.get(lines_of, n)), "\n"))
    out = out.withColumns({text_col: kept, counts[0]: F.size(lines_of).cast("long"), counts[1]: F.coalesce(F.size(dropped), F.lit(0)).cast("long")})
    return out.drop(i, d, maybe, parts)
