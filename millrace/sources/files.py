"""Readers and writers of files: JSON, JSON lines, CSV, markdown, run folders."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY_FILE = r"(?:^|/)(?:MEMORY|\d{4}-\d{2}-\d{2})\.md$"
RUN_FILE = r"^[A-Za-z0-9._-]+\.jsonl$"


def read_json_array(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Rows of files that hold one JSON array each (S01); several files are put together."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def union_sources(*parts: DataFrame) -> DataFrame:
    """All rows of several datasets, columns by name, missing ones null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read_jsonl_strict(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """JSON lines where a broken one is an error; rows lacking a required column go."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    for c in required:
        rows = rows.where(F.col(c).isNotNull())
    return rows


def numbered_lines(spark: SparkSession, path: str, blank: bool = True, within_file: bool = True) -> DataFrame:
    """Lines of text files with their numbers from 1: file_path, line, text (S04, S10, S11). A carriage return before the end of a line goes.

    Files are read in Spark's byte ranges, a large one in many tasks. A task numbers the lines of each range; what comes before a range is the sum of
    the counts of the earlier ones, which are one row a range. blank: lines of white space alone count and are returned. within_file: numbers start
    again in each file; else the files follow each other in the order of their paths.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("start"), F.lit(1).cast("long").alias("line"), F.regexp_replace("value", "\r$", "").alias("text")
    )
    if not blank:
        lines = lines.where(F.trim("text") != "")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            spots = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            numbers = []
            for spot in spots:
                n = n + 1 if spot == last else 1
                last = spot
                numbers.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(numbers, pa.int64()), batch.column(3)], batch.schema.names)

    ranges = lines.groupBy("file_path", "start").agg(F.count("*").alias("n"))
    order = Window.partitionBy("file_path").orderBy("start") if within_file else Window.orderBy("file_path", "start")
    ranges = ranges.select("file_path", "start", (F.sum("n").over(order) - F.col("n")).alias("before"))
    out = lines.mapInArrow(number, lines.schema).join(ranges, ["file_path", "start"])
    return out.select("file_path", (F.col("line") + F.col("before")).alias("line"), "text")


def read_lines(spark: SparkSession, path: str, first: int = 1, count: int = 2000) -> DataFrame:
    """A range of lines of each file: file_path, line, text."""
    return numbered_lines(spark, path).where(F.col("line").between(first, first + count - 1))


def read_jsonl_lenient(spark: SparkSession, path: str, schema: str, limit: int = 500) -> tuple[DataFrame, DataFrame]:
    """The first lines of a JSONL file, broken ones among them left out (S04): rows, and one row with total and truncated.

    The limit (1 to 2000) counts lines that are not blank, broken ones too, and so does total. Several files follow each other by path.
    """
    limit = max(1, min(2000, limit))
    lines = numbered_lines(spark, path, blank=False, within_file=False)
    head = lines.where(F.col("line") <= limit)
    rows = head.where(F.try_parse_json("text").isNotNull()).select(F.from_json("text", schema).alias("r"), "line").orderBy("line").select("r.*")
    total = spark.read.option("lineSep", "\n").text(path).where(F.trim(F.regexp_replace("value", "\r$", "")) != "")
    return rows, total.agg(F.count("*").alias("total"), (F.count("*") > limit).alias("truncated"))


EVENT_SCHEMA = "type string, timestamp timestamp, content string, toolName string, args string, result string"


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """Event log entries with a type and a time; broken lines are dropped, args and result stay JSON or text."""
    rows = spark.read.schema(EVENT_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.col("type").isNotNull() & F.col("timestamp").isNotNull())


def append_jsonl(df: DataFrame, path: str) -> None:
    """Appends rows as JSON lines (S06); error rows are ones with id and error alone."""
    df.write.mode("append").json(path)


def read_qa_csv(spark: SparkSession, path: str) -> DataFrame:
    """Question and answer of a CSV whose quoted cells may span lines (S07); rows without a question go."""
    rows = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path)
    a, b = rows.columns[:2]
    return rows.select(F.col(a).alias("question"), F.col(b).alias("answer")).where(F.col("answer").isNotNull() & (F.trim("question") != ""))


def read_markdown(spark: SparkSession, path: str, pattern: str = DAY_FILE) -> DataFrame:
    """Whole memory files by name: file_path, name, text, modified."""
    files = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("text"))
    return files.where(F.col("file_path").rlike(pattern)).withColumn("name", F.element_at(F.split("file_path", "/"), -1)).orderBy("name")


def appended(text: str, more: str):
    """A text with another one after it, on a line of its own."""
    return F.concat(F.col(text), F.when((F.col(text) == "") | F.col(text).endswith("\n"), "").otherwise("\n"), F.col(more))


def list_runs(spark: SparkSession, path: str) -> DataFrame:
    """Run files of a folder, newest first (S27): name, modified, bytes. Contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(path).select("path", "modificationTime", "length")
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))
    return named.where(F.col("name").rlike(RUN_FILE)).orderBy(F.desc("modified"), F.desc("name"))


def latest_run(spark: SparkSession, path: str) -> str | None:
    """Name of the newest run file."""
    row = list_runs(spark, path).first()
    return row["name"] if row else None


def front_matter(files: DataFrame) -> DataFrame:
    """Name, description and body of markdown files with a front matter (S37): file_path, source, name, description, body."""
    head = F.regexp_extract("text", r"(?s)^---\r?\n(.*?)\r?\n---", 1)
    field = lambda k: F.nullif(F.trim(F.regexp_extract(head, rf"(?m)^{k}:[ \t]*(.*)$", 1)), F.lit(""))
    body = F.regexp_replace("text", r"(?s)^---\r?\n.*?\r?\n---\r?\n?", "")
    return files.select("file_path", "source", field("name").alias("name"), field("description").alias("description"), F.trim(body).alias("body")).where("name is not null")


def override(skills: DataFrame, tiers: list[str]) -> DataFrame:
    """One row a name: that of the last tier that has it."""
    rank = F.array_position(F.array(*map(F.lit, tiers)), F.col("source"))
    return skills.withColumn("_rn", F.row_number().over(Window.partitionBy("name").orderBy(rank.desc(), "file_path"))).where("_rn = 1").drop("_rn")


def seed_table(df: DataFrame, path: str, force: bool = False) -> None:
    """Writes a dataset as a table of texts once; force: over again."""
    from millrace.operators.ingest import flattened

    flattened(df).write.mode("overwrite" if force else "ignore").parquet(path)


def write_annotations(df: DataFrame, path: str) -> None:
    """Annotations as JSON lines; millrace.sources.post sends them to an endpoint."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("append").text(path)


def write_traces(df: DataFrame, path: str, attributes: str = "attributes") -> None:
    """Spans with their attributes redacted."""
    from millrace.operators.guard import redact_attributes

    redact_attributes(df, attributes).write.mode("append").parquet(path)


def write_dashboard(aggregates: dict[str, DataFrame], path: str) -> None:
    """Aggregates of a report as JSON tables under a folder, for a page to show."""
    for name, df in aggregates.items():
        df.coalesce(1).write.mode("overwrite").json(f"{path}/{name}")
