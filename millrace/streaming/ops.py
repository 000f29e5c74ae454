"""Operators over message streams.

Each keyed fold is a plain Python state machine (``Fold``) that a stream runs with state and a batch runs over sorted rows; so the
batch twin of an operator gives what the stream gives, and both are tested against each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from millrace.functions import timefns as TF

# Limits of the message streams.
DEDUPE_TTL, DEDUPE_KEYS = "20 minutes", 5_000
RING_SIZE, RING_GROUPS = 50, 200
DUPLICATE_S, CAPTURE_TTL_S = 24 * 3600, 30 * 60


def dedupe_stream(messages: DataFrame, ts: str = "ts", keys: tuple[str, ...] = ("account_id", "chat_id", "id"), ttl: str = DEDUPE_TTL) -> DataFrame:
    """First message of each key within a time to live, by event time (ST01). State is bounded by the watermark; ordered.bounded_dedupe() also bounds the number of keys."""
    return messages.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(list(keys))


def dedupe_batch(messages: DataFrame, ts: str = "ts", keys: tuple[str, ...] = ("account_id", "chat_id", "id"), ttl_s: int = 1200, order: str = "ord") -> DataFrame:
    """A message goes if an earlier one of its key that stayed is younger than the time to live (ST01). The time runs from the one that stayed.

    Rows are sorted by key and time (spilling) and passed through in Arrow batches, with only the last message that stayed in memory; one
    exchange. Null keys are keys too; messages without a time stay; those that agree in key, time and ordinal stay or go together.
    """
    span = ttl_s * 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, at = None, None, None
        for batch in batches:
            keep = []
            values = [batch.column(c).to_pylist() for c in keys]
            for k, t, o in zip(zip(*values, strict=True), batch.column("__t").to_pylist(), batch.column(order).to_pylist(), strict=True):
                if k != key:
                    key, last, at = k, None, None
                stays = t is None or last is None or t - last >= span
                if stays and t is not None:
                    last, at = t, o
                keep.append(stays or (t == last and o == at))
            yield batch.filter(pa.array(keep, pa.bool_())).drop_columns(["__t"])

    timed = messages.withColumn("__t", F.unix_micros(F.col(ts).cast("timestamp")))
    return timed.repartition(*keys).sortWithinPartitions(*keys, "__t", order).mapInArrow(run, messages.schema)


class Fold:
    """A keyed state machine: start() gives a state; step(state, row) gives the next state and rows to emit.

    A state is a tuple of plain values, or else what load() makes of one and dump() makes one of.
    """

    def __init__(self, start: Callable, step: Callable[[Any, dict], tuple[Any, list[dict]]], state: str, output: str, order: str, load: Callable = lambda s: s, dump: Callable = lambda s: s):
        self.start, self.step, self.state, self.output, self.order, self.load, self.dump = start, step, state, output, order, load, dump

    def run(self, state, rows: pd.DataFrame) -> tuple[Any, list[dict]]:
        out = []
        for row in rows.sort_values(self.order, kind="stable").to_dict("records"):
            state, more = self.step(state, row)
            out += more
        return state, out


def _columns(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def fold_stream(df: DataFrame, key: str, fold: Fold, ttl_ms: int | None = None) -> DataFrame:
    """Runs a fold over a stream, its state kept a key, rows in the order of their batches (ordered.fold_ordered waits for late ones); ttl_ms: state without news for so long is dropped (ST10); with it a query does not end by
    itself under the trigger availableNow, since Spark goes on running batches for times that run out."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches))
        current, out = fold.run(fold.load(tuple(state.get)) if state.exists else fold.start(), rows)
        state.update(fold.dump(current))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(out, columns=_columns(fold.output))

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return df.groupBy(key).applyInPandasWithState(run, fold.output, fold.state, "append", timeout)


def fold_batch(df: DataFrame, key: str, fold: Fold) -> DataFrame:
    """Runs a fold over each key's rows in order.

    Rows are sorted by key and order (spilling) and folded an Arrow batch at a time, so a key of any size takes the memory of its state.
    """
    schema = to_arrow_schema(StructType.fromDDL(fold.output))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if state is None or row[key] != now:
                    now, state = row[key], fold.start()
                state, more = fold.step(state, row)
                out += more
            yield pa.RecordBatch.from_pylist(out, schema)

    return df.repartition(key).sortWithinPartitions(key, fold.order).mapInArrow(run, fold.output)


def ring_buffer(size: int = RING_SIZE) -> Fold:
    """Keeps a group's last messages; a trigger reads and clears them (ST02). Rows: group_id, ord, sender, body, trigger. Emits the context of each trigger."""

    def step(state: tuple, row: dict) -> tuple[tuple, list[dict]]:
        lines = list(state[0])
        if not row["trigger"]:
            return ([*lines, f"{row['sender']}: {row['body']}"][-size:],), []
        return ([],), [{"group_id": row["group_id"], "ord": row["ord"], "n": len(lines), "context": "\n".join(lines)}]

    return Fold(lambda: ([],), step, "lines array<string>", "group_id long, ord long, n int, context string", "ord")


def ring_context(df: DataFrame, group: str = "group_id", order: str = "ord", size: int = RING_SIZE) -> DataFrame:
    """The batch twin of ring_buffer() in built-ins (ST02): messages between triggers are an island, of which the last ones count."""
    w = Window.partitionBy(group).orderBy(order)
    island = F.coalesce(F.sum(F.col("trigger").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = df.withColumn("island", island)
    line = F.when(~F.col("trigger"), F.struct(F.col(order).alias("o"), F.concat("sender", F.lit(": "), "body").alias("t")))
    # Islands are cut to their last rows before their texts are gathered.
    late = F.row_number().over(Window.partitionBy(group, "island", "trigger").orderBy(F.desc(order)))
    rows = rows.withColumn("_late", late).where(F.col("trigger") | (F.col("_late") <= size))
    out = rows.groupBy(group, "island").agg(F.max(F.when(F.col("trigger"), F.col(order))).alias(order), F.array_sort(F.collect_list(line)).alias("l"))
    return out.where(F.col(order).isNotNull()).select(group, order, F.size("l").alias("n"), F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("context"))


def alert_suppressor(window_s: int = DUPLICATE_S) -> Fold:
    """Emits an alert unless the last one emitted had the same text less than a day ago (ST06). Rows: job_id, ord, ts_s, text."""

    def step(state: tuple, row: dict) -> tuple[tuple, list[dict]]:
        same = state[1] >= 0 and row["text"] == state[0] and row["ts_s"] - state[1] < window_s
        out = {"job_id": row["job_id"], "ord": row["ord"], "emitted": not same}
        return (state if same else (row["text"], int(row["ts_s"]))), [out]

    return Fold(lambda: ("", -1), step, "text string, at long", "job_id long, ord long, emitted boolean", "ord")


def busy_gate() -> Fold:
    """Messages while a session runs are merged into one follow-up (ST05). Rows: session_id, ord, kind (message or done), text. Emits what runs next."""

    def step(state: tuple, row: dict) -> tuple[tuple, list[dict]]:
        busy, waiting = state[0], list(state[1])
        emit = lambda text: [{"session_id": row["session_id"], "ord": row["ord"], "text": text}]
        if row["kind"] == "message":
            return ((True, [*waiting, row["text"]]), []) if busy else ((True, []), emit(row["text"]))
        return ((True, []), emit("\n\n".join(waiting))) if waiting else ((False, []), [])

    return Fold(lambda: (False, []), step, "busy boolean, waiting array<string>", "session_id long, ord long, text string", "ord")


def late_filter(messages: DataFrame, connected: Column, grace_s: int = 30, ts: str = "ts") -> DataFrame:
    """Marks messages that are read but not answered: replayed batches, and those older than the connection by the grace (ST04)."""
    old = F.unix_seconds(F.col(ts).cast("timestamp")) < F.unix_seconds(connected.cast("timestamp")) - grace_s
    return messages.withColumn("answered", ~(old | (F.col("upsert_type") == "append")))


def latest_names_stream(messages: DataFrame) -> DataFrame:
    """Running last name of each member (ST03); for update or complete output."""
    return messages.groupBy("group_id", "member_id").agg(F.max_by("name", "ts").alias("name"), F.max("ts").alias("ts"))


def correlate_stream(starts: DataFrame, ends: DataFrame, within: str = "1 hour") -> DataFrame:
    """Starts of calls with their ends, both sides bounded by watermarks; a start without an end comes out once its time is over (J05, ST12)."""
    s = starts.withWatermark("ts", within)
    e = ends.select(F.col("call_id").alias("end_id"), "result", "error", F.col("ts").alias("end_ts")).withWatermark("end_ts", within)
    near = (F.col("call_id") == F.col("end_id")) & F.col("end_ts").between(F.col("ts"), F.col("ts") + F.expr(f"INTERVAL {within}"))
    return s.join(e, near, "left_outer").drop("end_id")


def aligned_windows(df: DataFrame, ts: str, every_s: int, anchor_s: int = 0) -> DataFrame:
    """Start and end of the period of each row, periods aligned to an anchor (ST14)."""
    end = TF.next_every(F.unix_millis(F.col(ts).cast("timestamp")), F.lit(every_s * 1000), F.lit(anchor_s * 1000))
    return df.withColumn("period_end", F.timestamp_millis(end)).withColumn("period_start", F.timestamp_millis(end - every_s * 1000))


def windowed_counts(events: DataFrame, ts: str, size: str, late: str, keys: list[str], slide: str | None = None) -> DataFrame:
    """Counts and sums of windows with a bound on lateness; an addition to the operators of the message streams."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def watch_files(spark, path: str, schema: str, each: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1500 milliseconds"):
    """Runs a function over new JSON files of a folder, gathered for a while (S20, S36); sources.watch tells edits too. Returns the query."""
    return spark.readStream.schema(schema).json(path).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
