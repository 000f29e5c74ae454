"""Folds over streams whose rows come in any order (ST05, ST06, ST10), and folds that hold a bounded number of keys (ST01, ST02).

``fold_ordered`` keeps what came in a list of the key's state until the watermark says that nothing older will come, then sorts it by event time and
folds it; so batches that are shuffled give what the batch twin (``fold_batch`` over sorted rows) gives. Rows older than the watermark are
late and dropped, as Spark does elsewhere. State is kept by transformWithState, which needs the RocksDB state store
(``ROCKSDB`` under spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from millrace.streaming.ops import DEDUPE_KEYS, RING_GROUPS, RING_SIZE, Fold

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Fixed value: how long a message is remembered, in milliseconds.
DEDUPE_TTL_MS = 20 * 60_000


def _fields(schema: StructType, row) -> tuple:
    return tuple(row[f.name] for f in schema)


class _Ordered(StatefulProcessor):
    """Holds rows until the watermark passes them, then folds them in order of event time."""

    def __init__(self, fold: Fold, rows: StructType, state: StructType, output: StructType, ttl_ms: int | None):
        self.fold, self.rows, self.schema, self.output, self.ttl_ms = fold, rows, state, output, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.rows)
        self.state = handle.getValueState("state", self.schema)
        self.last = handle.getValueState("last", StructType([StructField("at", LongType())]))

    def _wake(self, at: int) -> None:
        """One timer a key, at the earliest time that is waited for."""
        set_at = list(self.handle.listTimers())
        if not set_at or min(set_at) > at:
            for old in set_at:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [_fields(self.rows, r) for r in rows]
        self.waiting.appendList(new)
        self._wake(min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.waiting.get()]
        due, later = [r for r in held if r[0] <= now], [r for r in held if r[0] > now]
        names = [f.name for f in self.rows]
        due = sorted((dict(zip(names, r, strict=True)) for r in due), key=lambda r: (r["__at"], r[self.fold.order]))
        current = self.fold.load(tuple(self.state.get())) if self.state.exists() else self.fold.start()
        out = []
        for row in due:
            current, more = self.fold.step(current, row)
            out += more
        self.waiting.clear()
        if later:
            self.waiting.appendList(later)
        last = max([r["__at"] for r in due] + ([self.last.get()[0]] if self.last.exists() else []))
        if self.ttl_ms is not None and not later and last + self.ttl_ms <= now:
            self.state.clear()
            self.last.clear()
        else:
            self.state.update(self.fold.dump(current))
            self.last.update((last,))
            if later:
                self._wake(min(r[0] for r in later))
            elif self.ttl_ms is not None:
                self._wake(last + self.ttl_ms)
        names = [f.name for f in self.output]
        return iter([Row(**{n: r[n] for n in names}) for r in out])

    def close(self) -> None:
        pass


def fold_ordered(df: DataFrame, key: str, fold: Fold, ts: str = "ts", delay: str = "10 minutes", ttl_ms: int | None = None) -> DataFrame:
    """A fold over a stream in order of event time, ties by the fold's order (ST05, ST06).

    delay: how long rows may come late. ttl_ms: state of a key without rows for so long, by event time, is dropped (ST10).
    """
    columns = [f for f in df.schema if f.name not in (key, ts)]
    rows = StructType([StructField("__at", LongType()), *columns, df.schema[key]])
    timed = df.withWatermark(ts, delay).withColumn("__at", F.unix_millis(F.col(ts).cast("timestamp")))
    output = StructType.fromDDL(fold.output)
    processor = _Ordered(fold, rows, StructType.fromDDL(fold.state), output, ttl_ms)
    return timed.groupBy(key).transformWithState(processor, output, "Append", "EventTime")


def bounded_dedupe(ttl_ms: int = DEDUPE_TTL_MS, keys: int = DEDUPE_KEYS) -> Fold:
    """Marks messages whose key came within the time to live, among the last keys that were remembered (ST01).

    Rows: account_id (the fold's key), ord, ts_ms, id. A key is remembered from when it was new; the oldest goes when it is over its time,
    or when there are more than ``keys``. Emits each message with ``repeated``.
    """

    def step(seen: OrderedDict, row: dict) -> tuple[OrderedDict, list[dict]]:
        now = row["ts_ms"]
        while seen and (next(iter(seen.values())) < now - ttl_ms or len(seen) > keys):
            seen.popitem(last=False)
        repeated = row["id"] in seen
        if not repeated:
            seen[row["id"]] = now
        return seen, [{"account_id": row["account_id"], "ord": row["ord"], "repeated": repeated}]

    return Fold(
        OrderedDict, step, "ids array<string>, times array<long>", "account_id long, ord long, repeated boolean", "ord",
        load=lambda s: OrderedDict(zip(s[0], s[1], strict=True)), dump=lambda seen: (list(seen), list(seen.values())),
    )


def bounded_history(size: int = RING_SIZE, groups: int = RING_GROUPS) -> Fold:
    """Keeps the last messages of an account's groups; a trigger reads and clears its group's (ST02).

    Rows: account_id (the fold's key), group_id, ord, sender, body, trigger. A new group beyond ``groups`` takes the place of the one that was
    recorded first. Emits the context of each trigger.
    """

    def step(held: OrderedDict, row: dict) -> tuple[OrderedDict, list[dict]]:
        group = row["group_id"]
        if row["trigger"]:
            lines = held.pop(group, [])
            return held, [{"account_id": row["account_id"], "group_id": group, "ord": row["ord"], "n": len(lines), "context": "\n".join(lines)}]
        if group not in held:
            if len(held) >= groups:
                held.popitem(last=False)
            held[group] = []
        held[group] = [*held[group], f"{row['sender']}: {row['body']}"][-size:]
        return held, []

    return Fold(
        OrderedDict, step, "ids array<long>, lines array<array<string>>", "account_id long, group_id long, ord long, n int, context string", "ord",
        load=lambda s: OrderedDict((g, list(x)) for g, x in zip(s[0], s[1], strict=True)), dump=lambda held: (list(held), list(held.values())),
    )
