"""Filter interaction audit: what each of five filters removes, and how that depends on their order.

Each text gets a mask of the filters it fails: a (under 50 words), b (under 65 distinct words in a hundred), c (over five A-Z in a hundred
code points), d (holds one of #$%&*|), e (the same text under a smaller id anywhere in the table). Words are runs of anything but
U+0020 and U+0009 to U+000D, and are told apart by case.

One pass over the texts writes a row of facts a document: id, part, mask of a to d, xxhash64 of the text. Only texts whose fingerprint several ids
have may fail e; a bitmap of such fingerprints (8 MB at any size, passing some others too) picks them, and a fingerprint-routed RDD settles
them. A task first goes through its own rows with a table of collision chains (fingerprint to texts, each with its smallest id) and sends a text on
once, so a text that a third of all rows have leaves a task once. Rows are partitioned by fingerprint and sorted by (fingerprint, id) on
their way, so that one chain is open at a time: it stores each of its texts in full with the smallest id, which comes first, and
compares texts, not hashes. What the RDD emits are the ids that are not the smallest of their text.

The masks meet these and the labels by id, and combineByKey merges count vectors (32 masks by rows, good rows and toxic rows) by part. All
figures of a part follow from its vector.

Defined results: a null text is an empty one (no words, fails a; equal to other empty ones); a null source is the part of the empty string; a null
id is smaller than all others and has no label; rows with the same id never make each other fail e; repeated rows each count; where an
id has several labels it is good (toxic) if one of them says so; an empty table gives no rows; other columns are ignored. A very long text
is held once in a task, and its words a mebibyte at a time, with its distinct words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count, permutations

import numpy as np
import pyarrow as pa
from pyspark import RDD, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import textkernel as tk
from millrace.llm.common import NULL_ID, materialize, maybe_in

FILTERS = "ABCDE"
_E = 1 << FILTERS.index("E")
_UPPER = bytes(range(65, 91))
_MARKS = re.compile("[#$%&*|]")
#: Bytes of text that a task's own chains hold before they are sent on, and bytes of words at a time.
HELD_BYTES, STEP = 8 << 20, 1 << 20
#: Counts a mask: rows, good rows, toxic rows.
_WIDTH = 3 << len(FILTERS)


def _words(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    at = 0
    while at < len(data):
        stop = at + STEP
        while stop < len(data) and data[stop] not in b" \t\n\x0b\x0c\r":
            stop += 1
        # Without an argument bytes.split() parts at exactly these six bytes.
        yield data[at:stop].split()
        at = stop


def text_mask(text: str) -> int:
    """The filters a to d that a text fails."""
    data = text.encode("utf-8", "surrogatepass")
    n, distinct = 0, set()
    for words in _words(data):
        n += len(words)
        distinct.update(words)
    upper = len(data) - len(data.translate(None, _UPPER))
    return (n < 50) | (100 * len(distinct) < 65 * n) << 1 | (100 * upper > 5 * len(text)) << 2 | bool(_MARKS.search(text)) << 3


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tk.slices(batch, 3):
            masks = pa.array([text_mask(t) for t in part.column(3).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*part.columns[:3], masks], ["fingerprint", "id", "part", "mask"])


def _settle(rows: Iterator[tuple[int, int, str]]) -> Iterator[tuple]:
    """Rows (fingerprint, id, text) to ((fingerprint, id), text) of the smallest id of each text, as far as a task has seen them, and
    ((any number, id), fingerprint) of the others: these need not travel with their text."""
    chains: dict[int, dict[str, list[int]]] = {}  # to a text: its smallest id, and how many rows had it
    held, spread = 0, count(TaskContext.get().partitionId())
    for fingerprint, ident, text in rows:
        chain = chains.setdefault(fingerprint, {})
        known = chain.get(text)
        if known is None:
            chain[text] = [ident, 1]
            held += len(text) + 200
        else:
            known[1] += 1
            if ident != known[0]:
                yield (next(spread), max(ident, known[0])), fingerprint
                known[0] = min(ident, known[0])
        if held > HELD_BYTES:
            # Texts that came more than once may come again; the others go on.
            often = sum(len(t) + 200 for chain in chains.values() for t, (_, n) in chain.items() if n > 1)
            keep, held = {}, 0
            for f, chain in chains.items():
                for t, (low, n) in chain.items():
                    if n > 1 and often <= HELD_BYTES // 2:
                        keep.setdefault(f, {})[t] = [low, n]
                        held += len(t) + 200
                    else:
                        yield (f, low), t
            chains = keep
    for f, chain in chains.items():
        for t, (low, _) in chain.items():
            yield (f, low), t


def _resolve(rows: Iterator[tuple]) -> Iterator[tuple[int, int]]:
    """Sorted by (fingerprint, id): one chain of full texts at a time, in which the first of a text has its smallest id. Emits (id, fingerprint) of the others."""
    fingerprint, chain = None, []
    for (route, ident), what in rows:
        if not isinstance(what, str):
            yield ident, what
            continue
        if route != fingerprint:
            fingerprint, chain = route, []
        low = next((i for t, i in chain if t == what), None)
        if low is None:
            chain.append((what, ident))
        elif low < ident:
            yield ident, fingerprint


def _route(key: tuple[int, int]) -> int:
    return key[0]


def repeats(texts: DataFrame, tasks: int) -> DataFrame:
    """(fingerprint, id, text) to (id, fingerprint), each once, of the rows whose text a smaller id has too."""
    routed: RDD = texts.rdd.map(tuple).mapPartitions(_settle).repartitionAndSortWithinPartitions(tasks, _route)
    return texts.sparkSession.createDataFrame(routed.mapPartitions(_resolve), "id long, fingerprint long").distinct()


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", tasks: int | None = None) -> DataFrame:
    """(id, part, mask, n): the filters that documents fail, as bits in the order of FILTERS; n rows agree in the rest.

    tasks: partitions by fingerprint; by default as many as the input has, or the session's number of shuffle partitions, whichever is more.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.xxhash64(text).alias("fingerprint"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        text.alias("text"),
    )
    facts = rows.mapInArrow(_masks, "fingerprint long, id long, part string, mask int").groupBy("fingerprint", "id", "part", "mask").agg(F.count("*").alias("n"))
    facts = materialize(facts, "filter-facts")
    shared = facts.groupBy("fingerprint").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("fingerprint")
    some = maybe_in(rows.select("fingerprint", "id", "text"), shared, "fingerprint")
    tasks = tasks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), some.rdd.getNumPartitions())
    gone = repeats(some, tasks).withColumn("gone", F.lit(_E))
    return facts.join(gone, ["id", "fingerprint"], "left").select("id", "part", F.col("mask").bitwiseOR(F.coalesce("gone", F.lit(0))).alias("mask"), "n")


def _vector(value: tuple[int, int, int, int]) -> np.ndarray:
    return _add(np.zeros(_WIDTH, np.int64), value)


def _add(vector: np.ndarray, value: tuple[int, int, int, int]) -> np.ndarray:
    mask, n, good, toxic = value
    vector[3 * mask : 3 * mask + 3] += (n, n * good, n * toxic)
    return vector


def figures(vector: np.ndarray) -> Iterator[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of a part, 600 rows."""
    rows, good, toxic = vector.reshape(-1, 3).T
    masks = np.arange(len(rows))
    out, share = [], dict.fromkeys(FILTERS, 0)
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            fails, alive = (masks & bit) > 0, (masks & before) == 0
            gone = fails & alive
            removed = int(rows[gone].sum())
            share[name] += removed
            out.append(("".join(order), step, int(rows[alive & ~fails].sum()), removed, int(rows[fails & ~alive].sum()), int(rows[bit]), int(good[gone].sum()), int(toxic[gone].sum())))
            before |= bit
    for row in out:
        yield (*row, share[row[0][row[1] - 1]])


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """A row a part, order of the five filters (120) and step (1 to 5): part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley. labels: (id, quality, toxic)."""
    failed = materialize(failures(docs, id_col, text_col, part_col), "filter-masks")
    flags = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    marked = failed.join(flags, "id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    vectors = marked.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(_vector, _add, np.add)
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in "kept removed redundant unique_fails good_lost toxic_lost shapley".split())
    return docs.sparkSession.createDataFrame(vectors.flatMap(lambda kv: ((kv[0], *row) for row in figures(kv[1]))), schema)
