"""What can be plugged in: evaluators, formatters, detectors, models; and functions for SQL.

Models are interfaces only: a judge's answers and embeddings come as columns, or from a function of the caller that runs in batches.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import finance, pii
from millrace.operators import evals, guard

OPERATORS = ("gt", "gte", "lt", "lte", "eq", "in")


def evaluators() -> dict[str, Callable[[], Column]]:
    """Evaluators by name, over the columns level, answer, low, high, required_tool, expected_ticker, calls, plan and the judges' verdict_*.

    Each gives a struct of score, label and explanation, or null where it does not apply.
    """
    c = F.col
    return {
        "factual_accuracy": lambda: evals.factual_accuracy(c("level"), c("answer"), c("low"), c("high")),
        "tool_correctness": lambda: evals.tool_correctness(c("level"), c("required_tool"), c("expected_ticker"), c("calls")),
        "groundedness": lambda: evals.groundedness(c("calls"), c("verdict_groundedness")),
        "refusal": lambda: evals.refusal(c("level"), c("verdict_refusal")),
        "plan_quality": lambda: evals.plan_quality(c("plan"), c("verdict_plan")),
    }


def evaluate(df: DataFrame, names: list[str]) -> DataFrame:
    """df with a column for each evaluator named (dispatch by name)."""
    known = evaluators()
    return df.withColumns({n: known[n]() for n in names})


def formatter(name: str) -> Callable[[DataFrame, list[str]], DataFrame]:
    """Renderer of a data set by name (F02 and F05 formats, dispatch F06)."""
    return finance.formatters()[name]


def filters_of(text: str) -> tuple[list[dict], int]:
    """Filters and limit of a screener request in JSON, checked (P02, P03). How a question becomes one is up to a model outside."""
    request = json.loads(text)
    filters = request.get("filters", [])
    for f in filters:
        if set(f) != {"field", "operator", "value"} or f["operator"] not in OPERATORS or (f["operator"] == "in") != isinstance(f["value"], list):
            raise ValueError(f"not a filter: {f!r}")
    return filters, int(request.get("limit") or 5)


def with_model(df: DataFrame, inputs: list[str], output: str, kind: str, model: Callable[[pd.DataFrame], list], batch: int = 64) -> DataFrame:
    """df with a column that a function of the caller gives for batches of rows (R13 for vectors, E03, E05, E06, E09 for judges, D19 for verdicts).

    The function runs in Python workers and must be picklable; its failures fail the task, which Spark tries again.
    """

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for rows in batches:
            parts = [model(rows.iloc[i : i + batch]) for i in range(0, len(rows), batch)]
            yield pd.Series([x for p in parts for x in p], dtype=object)

    return df.withColumn(output, run(F.struct(*inputs)))


def merged_spans(*spans: Column) -> Column:
    """Spans of several detectors put together and their overlaps settled."""

    @F.pandas_udf(f"array<{guard.SPAN}>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([[s._asdict() for s in pii.resolve(pii.Span(**(x if isinstance(x, dict) else x.asDict())) for x in row)] for row in rows], dtype=object)

    return run(F.concat(*(F.coalesce(s, F.array().cast(f"array<{guard.SPAN}>")) for s in spans)))


def distinct_names(calls: Column) -> Column:
    """Names of the tools called, each once, in order."""
    return F.array_distinct(F.transform(calls, lambda c: c["name"]))


def merged_streams(*streams: DataFrame) -> DataFrame:
    """Several streams as one (ST07, without its cap: partitions run side by side up to the cores there are)."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


class SpanTable:
    """Table function over a text: a row for each span."""

    def eval(self, text: str):
        for s in pii.detect(text or ""):
            yield tuple(s)


def register(spark: SparkSession) -> None:
    """Functions for SQL: pii_mask(text), formula(text), and the table function pii_table(text)."""

    @F.pandas_udf("string")
    def pii_mask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: pii.mask(t, pii.detect(t)), na_action="ignore")

    @F.pandas_udf("double")
    def formula(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(f: str | None) -> float | None:
            try:
                return evals.arithmetic(f) if f else None
            except (ValueError, SyntaxError, ArithmeticError, RecursionError, TypeError):
                return None

        for texts in batches:
            yield texts.map(one).astype("float64")

    spark.udf.register("pii_mask", pii_mask)
    spark.udf.register("formula", formula)
    spark.udtf.register("pii_table", F.udtf(SpanTable, returnType="type: string, start: int, end: int, match: string, confidence: double"))
