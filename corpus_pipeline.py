"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the docs of the next.
All stages but the last return the columns of documents.

Defined results: a row without doc_id is a document of its own, told from others by all its columns, and rows that agree in all of
them are one; rows with one doc_id are one document and are kept or dropped together; null and empty texts are scored, linked with
nothing, match nothing and are packed as the end id; an empty table gives no rows; columns of other names stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontam, lines, neardup, packing, quality
from millrace.llm.common import free_name, materialize
from millrace.llm.queries import table, tokenizer_path


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a column that names each, and that column's name."""
    key = free_name(docs, "key")
    # A hash of 64 bits is no other document's id but by chance of rows / 2^64.
    return docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.struct(*(F.col(f"`{c}`") for c in docs.columns))))), key


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score(model, F.col("text")) >= quality.KEEP_FROM)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents share stay in one of them; every document stays, though its text may be left empty."""
    keyed, key = _keyed(docs)
    counts = free_name(docs, "n_lines"), free_name(docs, "n_dropped")
    return lines.line_dedup(keyed, id_col=key, counts=counts).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    # Of equal rows without an id one stays; the scan for them skips row groups without nulls.
    keyed, key = _keyed(docs.where("doc_id IS NOT NULL").unionByName(docs.where("doc_id IS NULL").dropDuplicates()))
    gone = neardup.near_dedup(keyed, percent=80, id_col=key).where("not kept").select(key).distinct()
    return keyed.join(gone, key, "left_anti").select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    keyed, key = _keyed(docs)
    found = decontam.decontaminate(keyed, table(spark, sf_dir, "benchmark"), id_col=key).select(key).distinct()
    return keyed.join(found, key, "left_anti").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: Learnt scores, sketches and tokens are beyond SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
