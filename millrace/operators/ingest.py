"""Pages and posts into text tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as X

MAX_CHARS = 50_000


def extracted(pages: DataFrame, html: str = "html", header: Column | None = None, most: int = MAX_CHARS) -> DataFrame:
    """Pages with title, text, extractor, truncated, raw_length and wrapped_length (S29, F22, F25; pages come as a table)."""
    body, extractor = X.extract_page(F.col(html), F.lit(None).cast("string") if header is None else header)
    out = pages.withColumns({"_text": body, "extractor": extractor, "title": X.html_title(F.col(html))})
    cut, was_cut = X.wrap_within(F.col("_text"), most, notice=False)
    out = out.withColumns({"text": cut, "truncated": was_cut, "raw_length": F.length("_text")})
    return out.withColumn("wrapped_length", F.length("text")).drop("_text")


def flagged(df: DataFrame, text: str) -> DataFrame:
    """Rows with the patterns of injection in a text (P20)."""
    return df.withColumn("flags", X.injection_flags(F.col(text)))


def flattened(df: DataFrame, null: str = "null") -> DataFrame:
    """Every column as text, nested ones as JSON, nulls as a word."""
    nested = ("struct", "array", "map")
    cols = [F.to_json(c) if t.startswith(nested) else F.col(c).cast("string") for c, t in df.dtypes]
    return df.select(*(F.coalesce(x, F.lit(null)).alias(c) for x, c in zip(cols, df.columns, strict=True)))


def unflattened(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """The inverse of flattened(), with the types of the columns; what cannot be read is null."""
    nested = ("struct", "array", "map")
    cols = [F.from_json(F.nullif(c, F.lit("null")), t) if t.startswith(nested) else F.nullif(c, F.lit("null")).try_cast(t) for c, t in schema.items()]
    return df.select(*(x.alias(c) for x, c in zip(cols, schema, strict=True)))
