"""Context windows over message and event logs.

Logs are rows with a stream key, an ordinal and their content. Sizes are in code points, tokens are estimated from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import vector as V

# Limits and marks of context management.
COUNT_TRIGGER, KEEP_RECENT, TOKEN_TRIGGER = 8, 4, 80_000
TURN_BUDGET, PERSISTED_SIZE = 200_000, 2_500
CLEARED = "[Old tool result cleared]"
LAST_TURNS, FULL_TURNS = 10, 3
SPILL_CHARS, PREVIEW_CHARS = 50_000, 2_000


def drop_consecutive_duplicates(df: DataFrame, key: str, order: str, col: str) -> DataFrame:
    """Rows that repeat the one before them go."""
    before = F.lag(col).over(Window.partitionBy(key).orderBy(order))
    first = F.row_number().over(Window.partitionBy(key).orderBy(order)) == 1
    return df.withColumns({"_b": before, "_f": first}).where(F.col("_f") | ~F.col("_b").eqNullSafe(F.col(col))).drop("_b", "_f")


def greedy_pack(df: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """Walks the rows of a key in order and takes each that still fits, passing over those that do not (W03): taken and used before.

    A running sum would stop at the first row that does not fit; this is a fold over one array of sizes a key.
    """
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("s"))))
    step = lambda acc, x: F.struct(
        (acc["used"] + F.when(acc["used"] + x["s"] <= budget, x["s"]).otherwise(F.lit(0))).alias("used"),
        F.concat(acc["out"], F.array(F.struct(x["o"].alias("o"), (acc["used"] + x["s"] <= budget).alias("taken"), acc["used"].alias("used_before")))).alias("out"),
    )
    kind = dict(df.dtypes)[order]
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<struct<o:{kind},taken:boolean,used_before:bigint>>").alias("out"))
    out = df.groupBy(key).agg(F.aggregate(items, start, step)["out"].alias("rows")).select(key, F.explode("rows").alias("r"))
    return out.select(key, F.col("r.o").alias(order), F.col("r.taken").alias("taken"), F.col("r.used_before").alias("used_before"))


def microcompact(df: DataFrame, key: str, order: str, content: str, compactable: Column) -> DataFrame:
    """Clears all but the newest results of a stream once there are more than eight, or they exceed the token limit.

    Adds trigger (count, token or null), cleared, tokens_saved, and replaces the content of cleared rows by a mark.
    """
    live = compactable & F.col(content).isNotNull() & (F.col(content) != CLEARED)
    whole = Window.partitionBy(key)
    n = F.sum(F.col("_live").cast("int")).over(whole)
    tokens = F.sum(F.when(F.col("_live"), V.token_estimate(F.col(content))).otherwise(0)).over(whole)
    age = F.row_number().over(Window.partitionBy(key, "_live").orderBy(F.desc(order)))
    trigger = F.when(F.col("_n") > COUNT_TRIGGER, "count").when((F.col("_tokens") > TOKEN_TRIGGER) & (F.col("_n") > KEEP_RECENT), "token")
    cleared = F.col("_live") & F.col("trigger").isNotNull() & (F.col("_age") > KEEP_RECENT)
    out = df.withColumn("_live", live).withColumns({"_n": n, "_tokens": tokens, "_age": age}).withColumn("trigger", trigger).withColumn("cleared", cleared)
    out = out.withColumn("tokens_saved", F.when(F.col("cleared"), V.token_estimate(F.col(content))).otherwise(F.lit(0)).cast("long"))
    return out.withColumn(content, F.when(F.col("cleared"), CLEARED).otherwise(F.col(content))).drop("_live", "_n", "_tokens", "_age")


def rounds(df: DataFrame, key: str, order: str, starts: Column) -> DataFrame:
    """Number of the round of each row; rows before the first start have round 0."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("round", F.sum(starts.cast("int")).over(w))


def last_rounds(df: DataFrame, key: str, order: str, starts: Column, keep: int) -> DataFrame:
    """Rows of the last rounds, and those before the first one."""
    numbered = rounds(df, key, order, starts).withColumn("_last", F.max("round").over(Window.partitionBy(key)))
    return numbered.where((F.col("round") == 0) | (F.col("round") > F.col("_last") - keep)).drop("_last")


def strip_old_calls(df: DataFrame, key: str, order: str, content: str, has_calls: Column, keep: int = 2) -> DataFrame:
    """Empties the content of all but the last rows that carry tool calls."""
    age = F.row_number().over(Window.partitionBy(key, "_calls").orderBy(F.desc(order)))
    out = df.withColumn("_calls", has_calls).withColumn("_age", age)
    return out.withColumn(content, F.when(F.col("_calls") & (F.col("_age") > keep), "").otherwise(F.col(content))).drop("_calls", "_age")


def recent_turns(df: DataFrame, key: str, order: str, answer: str, summary: str, last: int = LAST_TURNS, full: int = FULL_TURNS) -> DataFrame:
    """The last completed turns; older than the last three with their summary in place of the answer."""
    age = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    out = df.where(F.col(answer).isNotNull()).withColumn("age", age).where(F.col("age") <= last)
    return out.withColumn("shown", F.when(F.col("age") <= full, F.col(answer)).otherwise(F.coalesce(summary, answer)))


def call_batches(df: DataFrame, key: str, order: str, safe: str) -> DataFrame:
    """Number of the batch of each call: neighbouring safe calls share one, others stand alone."""
    w = Window.partitionBy(key).orderBy(order)
    new = ~(F.col(safe) & F.coalesce(F.lag(safe).over(w), F.lit(False)))
    return df.withColumn("_new", new.cast("int")).withColumn("batch", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def spill_to_budget(df: DataFrame, key: str, order: str, size: str, cap: int = TURN_BUDGET, stub: int = PERSISTED_SIZE) -> DataFrame:
    """Marks the largest results of a turn as persisted until what is left fits (W11, G31); each leaves a stub. Adds total, persisted."""
    ranked = Window.partitionBy(key).orderBy(F.desc(size), order)
    before = F.coalesce(F.sum(F.col(size) - stub).over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(size).over(Window.partitionBy(key))
    left = df.withColumn("total", total).withColumn("_left", F.col("total") - before)
    low = F.min("_left").over(ranked.rowsBetween(Window.unboundedPreceding, 0))
    return left.withColumn("persisted", low > cap).drop("_left")


def spill(df: DataFrame, col: str, path: Column, cap: int = SPILL_CHARS, shown: int = PREVIEW_CHARS) -> tuple[DataFrame, DataFrame]:
    """Results over the cap replaced by a preview (S39), and the table (path, content) to write for them."""
    big = F.length(col) > cap
    name = F.regexp_replace(path, "[^A-Za-z0-9_.-]", "_")
    note = F.concat(F.lit("[Result stored in "), name, F.lit(", "), F.length(col).cast("string"), F.lit(" chars]\n"), F.substring(col, 1, shown))
    return df.withColumn(col, F.when(big, note).otherwise(F.col(col))), df.where(big).select(name.alias("path"), F.col(col).alias("content"))


def live_after(df: DataFrame, key: str, order: str, boundary: str, cleared: str, content: str) -> DataFrame:
    """Rows after a compaction boundary, cleared ordinals as placeholders (W14, ST11)."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    rows = df.withColumn("ordinal", n).where(F.col("ordinal") > F.coalesce(F.col(boundary), F.lit(0)))
    return rows.withColumn(content, F.when(F.array_contains(cleared, F.col("ordinal")), CLEARED).otherwise(F.col(content)))


def correlate_calls(starts: DataFrame, ends: DataFrame, key: str = "call_id") -> DataFrame:
    """Starts of tool calls with their end or error, arguments from either (J05, ST12)."""
    e = ends.select(key, F.col("args").alias("_args"), "result", "error", F.col("ts").alias("end_ts"))
    both = starts.join(e, key, "left")
    return both.withColumn("args", F.coalesce("args", "_args")).withColumn("duration_ms", F.unix_millis("end_ts") - F.unix_millis("ts")).drop("_args")


def results_in_order(calls: DataFrame, results: DataFrame, key: str = "call_id") -> DataFrame:
    """Each call with its result, Skipped where there is none."""
    return calls.join(results.select(key, "result"), key, "left").na.fill("Skipped", ["result"])


def similar_queries(df: DataFrame, key: str, order: str, query: str, least: float = 0.7) -> DataFrame:
    """Queries that resemble an earlier one of their tool: the first such (J18, U05). Queries without words resemble none.

    Queries of one word set are one, with the first of them, since a query's first likeness is that of its set or comes no earlier. Sets are
    joined on their rarest words, as many as two sets over the threshold cannot both do without sharing one; a pair is made at its first
    shared word only.
    """
    words = df.select(key, F.col(order).alias("o"), F.array_sort(V.query_tokens(F.col(query))).alias("w")).where(F.size("w") > 0)
    sets = words.groupBy(key, "w").agg(F.min("o").alias("o"))
    each = sets.select(key, "w", "o", F.explode("w").alias("t"))
    often = each.groupBy(key, "t").agg(F.count("*").alias("df"))
    n = F.size("w")
    rare = each.join(often, [key, "t"]).groupBy(key, "w", "o").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("r"))
    rare = rare.select(key, "w", "o", n.alias("n"), F.slice(F.transform("r", lambda x: x["t"]), F.lit(1), (n - F.ceil(n * least - 1e-9) + 1).cast("int")).alias("p"))
    rare = rare.withColumn("t", F.explode("p"))
    a, b = rare.alias("a"), rare.alias("b")
    near = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.t") == F.col("b.t")) & (F.col("b.o") < F.col("a.o"))
    sizes = F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * least - 1e-9
    pairs = a.join(b, near & sizes & (F.array_intersect("a.p", "b.p")[0] == F.col("a.t")))
    common = F.size(F.array_intersect("a.w", "b.w"))
    scored = pairs.select(F.col(f"a.{key}").alias(key), F.col("a.w").alias("w"), F.col("b.o").alias("earlier"), (common / (F.col("a.n") + F.col("b.n") - common)).alias("similarity"))
    own = sets.select(key, "w", F.col("o").alias("earlier"), F.lit(1.0).alias("similarity"))
    first = scored.where(F.col("similarity") >= least).unionByName(own).groupBy(key, "w").agg(F.min_by(F.struct("earlier", "similarity"), "earlier").alias("x"))
    return words.join(first, [key, "w"]).where(F.col("x.earlier") < F.col("o")).select(key, F.col("o").alias(order), "x.earlier", "x.similarity")


def tool_usage(df: DataFrame, tool: str, order: str, query: str, most: int) -> DataFrame:
    """Calls of each tool, how many are left, and the last three queries."""
    # Spark drops all but three rows of a tool in each task before the shuffle (WindowGroupLimit); calls are counted apart.
    age = F.row_number().over(Window.partitionBy("_tool").orderBy(F.desc("o")))
    last = df.select(F.col(tool).alias("_tool"), F.col(order).alias("o"), F.col(query).alias("q")).withColumn("_age", age).where(F.col("_age") <= 3)
    last = last.groupBy("_tool").agg(F.array_sort(F.collect_list(F.struct("o", "q"))).alias("_q"))
    calls = df.groupBy(tool).agg(F.count("*").alias("calls"))
    remaining = F.greatest(F.lit(0), F.lit(most) - F.col("calls")).alias("remaining")
    return calls.join(last, F.col(tool).eqNullSafe(F.col("_tool"))).select(tool, "calls", remaining, F.transform("_q", lambda x: x["q"]).alias("last_queries"))


def token_totals(df: DataFrame, keys: list[str], tokens: str, ms: str) -> DataFrame:
    """Tokens and tokens a second."""
    from millrace.functions.stats import throughput

    return df.groupBy(*keys).agg(F.sum(tokens).alias("tokens"), throughput(F.sum(tokens), F.sum(ms)).alias("tokens_per_s"))


def last_log_lines(df: DataFrame, key: str, order: str, n: int = 50) -> DataFrame:
    """The newest rows of each log (ST13)."""
    return df.withColumn("_age", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_age") <= n).drop("_age")


def event_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Entries by type."""
    return df.where(F.col("type").isNotNull() & F.col("timestamp").isNotNull()).groupBy(*keys, "type").agg(F.count("*").alias("n"))


def joined_text(df: DataFrame, key: str, order: str, col: str, separator: str = "\n\n", most: int | None = None) -> DataFrame:
    """Texts of a key in order with a separator, cut to a number of signs."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(col).alias("t")))), lambda x: x["t"]), separator)
    return df.groupBy(key).agg((F.substring(text, 1, most) if most else text).alias(col))


def chat_pairs(df: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Turns by role to (user_message, agent_response) rows: an answer belongs to the last user message before it."""
    w = Window.partitionBy(conv).orderBy(turn)
    after = df.withColumn("next_role", F.lead("role").over(w)).withColumn("next_text", F.lead("text").over(w))
    return after.where("role = 'user'").select(conv, turn, F.col("text").alias("user_message"), F.when(F.col("next_role") == "assistant", F.col("next_text")).alias("agent_response"))
