"""Aggregate expressions of evaluation reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The outcome classes of a detection run.
OUTCOMES = ("TP", "FP", "FN", "TN", "PARTIAL")
#: Lower bounds of the latency bins in milliseconds; each ends where the next begins.
LATENCY_BINS = (0, 1, 100, 500, 1000, 2000, 3000)


def floor_percentile(col: str, p: float, past_end: str = "last") -> Column:
    """The value at index floor(p * n) of the sorted values (G04). past_end: "last" or "zero", for an index of n; null if there are no values and "last"."""
    values = F.sort_array(F.collect_list(col))
    n = F.size(values)
    at = F.floor(F.lit(p) * n).cast("int")
    if past_end == "last":
        return F.when(n > 0, F.get(values, F.least(at, n - 1)))
    return F.coalesce(F.get(values, at), F.lit(0))


def floor_percentile_distributed(df, keys: list[str], col: str, ps: dict[str, float], buckets: int = 256):
    """floor_percentile for groups of any size (G04), exact. A row per group: keys and, for each name in ps, the value at floor(p * n), or the last.

    Equal values are counted first, on the map side. Each group's values are then dealt to ranges between those of its values whose hashes
    are smallest (the same ones in every run), the ranges' counts say which range holds an index, and only such ranges are sorted: a task
    sorts about one in ``buckets`` of a group's distinct values, never the group. A group without values has nulls.
    """
    from pyspark.sql import Window

    names = [f"_k{i}" for i in range(len(keys))]
    every = df.groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col(col).alias("_v")).agg(F.count("*").alias("_c"))
    counts = every.where("_v IS NOT NULL")

    def beside(left, right, on: list[str], how: str = "inner"):
        """Join in which a null is a key as well."""
        right = right.withColumnsRenamed({n: f"_r{n}" for n in on})
        same = F.lit(True)
        for n in on:
            same = same & F.col(n).eqNullSafe(F.col(f"_r{n}"))
        return left.join(right, same, how).drop(*(f"_r{n}" for n in on))

    # Spark drops rows beyond the rank in each task before the shuffle (WindowGroupLimit).
    few = F.row_number().over(Window.partitionBy(*names).orderBy(F.xxhash64("_v"), "_v"))
    cuts = counts.withColumn("_few", few).where(F.col("_few") < max(buckets, 2)).groupBy(*names).agg(F.collect_list("_v").alias("_cuts"))
    dealt = beside(counts, cuts, names).withColumn("_b", F.size(F.filter("_cuts", lambda x: x <= F.col("_v")))).drop("_cuts")
    group = Window.partitionBy(*names)
    sizes = dealt.groupBy(*names, "_b").agg(F.sum("_c").alias("_n"))
    sizes = sizes.withColumns({"_before": F.sum("_n").over(group.orderBy("_b")) - F.col("_n"), "_all": F.sum("_n").over(group)})
    index = {name: F.least(F.floor(F.lit(p) * F.col("_all")), F.col("_all") - 1) for name, p in ps.items()}
    inside = F.lit(False)
    for i in index.values():
        inside = inside | ((i >= F.col("_before")) & (i < F.col("_before") + F.col("_n")))
    found = beside(dealt, sizes.where(inside), [*names, "_b"])
    high = F.col("_before") + F.sum("_c").over(Window.partitionBy(*names, "_b").orderBy("_v"))
    found = found.withColumn("_high", high)
    picks = [F.max(F.when((i < F.col("_high")) & (i >= F.col("_high") - F.col("_c")), F.col("_v"))).alias(name) for name, i in index.items()]
    out = beside(every.select(*names).distinct(), found.groupBy(*names).agg(*picks), names, "left")
    return out.withColumnsRenamed(dict(zip(names, keys, strict=True)))


def outcome_counts(col: str = "outcome") -> list[Column]:
    """Counts over the fixed domain, zero-filled."""
    return [F.count_if(F.col(col) == o).alias(o.lower()) for o in OUTCOMES]


def precision(tp: Column, fp: Column, partial: Column | None = None, empty: float = 1.0) -> Column:
    """Partial outcomes count as found; empty: the value for an empty denominator, 1 in reports (G02) and 0 in stage checks."""
    hit = tp if partial is None else tp + partial
    return F.coalesce(F.try_divide(hit.cast("double"), (hit + fp).cast("double")), F.lit(float(empty)))


def recall(tp: Column, fn: Column, partial: Column | None = None, empty: float = 1.0) -> Column:
    hit = tp if partial is None else tp + partial
    return F.coalesce(F.try_divide(hit.cast("double"), (hit + fn).cast("double")), F.lit(float(empty)))


def f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column, partial: Column | None = None, empty: float = 1.0) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; without any outcome at all F1 is 0, though the other two are 1."""
    p, r = precision(tp, fp, partial, empty), recall(tp, fn, partial, empty)
    hit = tp if partial is None else tp + partial
    return p, r, F.when(hit + fp + fn == 0, F.lit(0.0)).otherwise(f1(p, r))


def mean_or_zero(col: Column) -> Column:
    """Mean of the scores that are there; 0 without any."""
    return F.coalesce(F.avg(col), F.lit(0.0))


def hallucination_rate(col: Column) -> Column:
    """1 - mean of factual accuracy, so 1 without any."""
    return 1 - mean_or_zero(col)


def latency_bin(ms: Column) -> Column:
    """Number of the half-open latency bin (G16); null below 0."""
    out = F.lit(None).cast("int")
    for i, low in enumerate(LATENCY_BINS):
        out = F.when(ms >= low, F.lit(i)).otherwise(out)
    return out


def throughput(tokens: Column, ms: Column) -> Column:
    """Tokens a second; null when there is no time or no token."""
    return F.try_divide(F.nullif(tokens.cast("double"), F.lit(0.0)), F.nullif(ms.cast("double"), F.lit(0.0)) / 1000)


def min_max(col: Column, low: Column, high: Column) -> Column:
    """Scaled to 0..1; 1 if all are equal."""
    return F.coalesce(F.try_divide(col - low, high - low), F.lit(1.0))


def delta_pp(before: Column, after: Column) -> Column:
    """Change in percentage points, as a number."""
    return (after - before) * 100


def delta_label(before: Column, after: Column, digits: int = 1) -> Column:
    """The change as text with an arrow."""
    d = delta_pp(before, after)
    arrow = F.when(d > 0, "▲").when(d < 0, "▼").otherwise("—")
    return F.concat(arrow, F.lit(" "), F.when(d >= 0, "+").otherwise(""), F.format_string(f"%.{digits}f", d.cast("double")), F.lit("pp"))
