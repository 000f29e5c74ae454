"""MinHash near-dedup.

A document's set holds its distinct five-word shingles. One hash a shingle fills the bins of a one-permutation sketch; empty bins
borrow from a bin that a hash of (bin, attempt) names (optimal densification). Bands of the sketch are buckets.

Texts with equal sets form classes, and only the smallest id of a class goes on, so copies never meet in a bucket. In a bucket all
members are linked as candidates with one centre, a star: the member that shares most places with others. Candidates
are confirmed on full sets, links give components. Then, in the group of each centre (all that share a bucket with it), members
outside the centre's component are compared with the members of other components, block by block: first sketches (those that agree
in fewer bins than five standard deviations under the threshold are passed over; texts of few shingles fill few bins, and their
deviation counts those alone), then full sets. So no link is lost to the choice of the centre. A task keeps a
forest of what it has linked and passes over pairs that are in one tree, so it emits fewer links than it meets components; the step takes
time with the number of members outside times the members of the group where they are not linked. A block has a bounded number of rows
and bytes, and the pairs of blocks of a centre are dealt to as many tasks as they need. A text goes into a block once; a centre's text goes to each
block of its star's members, not to each member.

Only the number of documents a band shares bounds the recall: with five rows in 28 bands, a pair at similarity 0.85 is missed
with a probability of 7e-8, at 0.8 of 1.5e-5.

Defined results: null or empty text, or white space alone, has an empty set, is linked with nothing and is kept; a null id sorts
first; rows with the same id are one document (their sets are linked); repeated rows are each returned; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import textkernel as tk
from millrace.llm.common import NULL_ID, copies, materialize, maybe_in, spread_join
from millrace.llm.components import components

U = np.uint64
_RUNS = 64
#: Rows and bytes of a block, and pairs of blocks a task, about.
BLOCK_ROWS, BLOCK_BYTES, TASK_PAIRS = 256, 8 << 20, 64


def densify(sketch: np.ndarray, filled: np.ndarray) -> None:
    """Fills the empty bins of each row in place; a row without any filled bin stays as it is."""
    bins = filled.shape[1]
    rows, empty = np.nonzero(~filled & filled.any(axis=1)[:, None])
    attempt = 0
    while len(rows):
        attempt += 1
        donor = (tk.mix(empty.astype(U) * U(0x9E3779B1) + U(attempt << 32)) % U(bins)).astype(np.int64)
        ok = filled[rows, donor]
        sketch[rows[ok], empty[ok]] = sketch[rows[ok], donor[ok]]
        rows, empty = rows[~ok], empty[~ok]


def sketches(values: np.ndarray, first: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted distinct hashes: the band keys and the low byte of each bin."""
    n, bins = len(first) - 1, bands * rows
    doc = np.repeat(np.arange(n), np.diff(first))
    with np.errstate(over="ignore"):
        spot = doc * bins + (((values >> U(32)) * U(bins)) >> U(32)).astype(np.int64)
        lowest = np.ones(len(spot), bool)
        lowest[1:] = spot[1:] != spot[:-1]
        sketch, filled = np.zeros(n * bins, U), np.zeros(n * bins, bool)
        sketch[spot[lowest]], filled[spot[lowest]] = values[lowest], True
        sketch, filled = sketch.reshape(n, bins), filled.reshape(n, bins)
        densify(sketch, filled)
        keys = np.tile(np.arange(bands, dtype=U), (n, 1))
        for j in range(rows):
            keys = keys * U(0xD1342543DE82EF95) + sketch[:, j::rows]
    return tk.mix(keys).astype(np.int64), (sketch & U(255)).astype(np.uint8)


def sketch_documents(docs: DataFrame, bands: int, rows: int, size: int) -> DataFrame:
    """(id, text) to id, n (set size), digest (of the set), low (a byte a bin), keys (a bucket a band; none for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, 1):
                values, first = tk.distinct(*tk.shingles(tk.words(part.column(1)), size))
                n = np.diff(first)
                keys, low = sketches(values, first, bands, rows)
                digests = [hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(first[:-1], first[1:], strict=True)]
                ends = np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[n > 0].ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array([x.tobytes() for x in low], pa.binary()), lists], ["id", "n", "digest", "low", "keys"]
                )

    return docs.mapInArrow(run, "id long, n long, digest binary, low binary, keys array<long>")


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Of sorted distinct hashes."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common > 0 and 100 * common >= percent * (len(a) + len(b) - common)


def _dealt(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows (key, id, size, ..) with the block of each, and the number of blocks of each key (key, blocks).

    Counted in runs first, so that a key with many rows is spread over them on the way back.
    """
    run = F.pmod(F.xxhash64("id"), F.lit(_RUNS))
    rows = rows.withColumn("run", run)
    runs = rows.groupBy(key, "run").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    blocks = runs.groupBy(key).agg(F.greatest(F.ceil(F.sum("n") / BLOCK_ROWS), F.ceil(F.sum("size") / BLOCK_BYTES)).alias("blocks"))
    decided = runs.select(key, "run").join(blocks, key)
    return rows.join(decided, [key, "run"]).withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks"))).drop("run", "blocks"), blocks


def _blocks(rows: DataFrame, key: str, columns: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Gathers rows (key, id, size, ..) into blocks (key, block, name) of about that many rows and bytes at most; and the number of blocks of each key."""
    dealt, blocks = _dealt(rows, key)
    return dealt.groupBy(key, "block").agg(F.collect_list(F.struct(*columns)).alias(name)), blocks


def confirm(pairs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough; texts: (id, text, size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                members = batch.column(2)[i].values
                u, v = batch.column(0)[i].as_py(), members.field("id").to_numpy()
                left, _ = tk.distinct(*tk.shingles(tk.words(batch.column(1).slice(i, 1)), size))
                right, first = tk.distinct(*tk.shingles(tk.words(members.field("text")), size))
                ok = v[[_similar(left, right[a:b], percent) for a, b in zip(first[:-1], first[1:], strict=True)]]
                yield pa.RecordBatch.from_arrays([pa.array([u] * len(ok), pa.int64()), pa.array(ok, pa.int64())], ["u", "v"])
            tk.release()

    # The members of a star in blocks, and the centre's text for each block.
    members = pairs.join(texts.select(F.col("id").alias("v"), "text", "size"), "v").withColumnRenamed("v", "id")
    blocks, number = _blocks(members, "u", ["id", "text"], "members")
    centres = number.join(texts.select(F.col("id").alias("u"), F.col("text").alias("u_text")), "u").transform(lambda df: copies(df, "blocks", "block")).drop("blocks")
    return blocks.join(centres, ["u", "block"]).select("u", "u_text", "members").mapInArrow(run, "u long, v long")


def _least(n: np.ndarray, percent: int, bins: int) -> np.ndarray:
    """Bins that the sketches of two sets share, five standard deviations under the threshold; n: size of the smaller set."""
    share = percent / 100
    # Bins that the smaller set fills by itself; the others repeat them.
    filled = bins * (1 - (1 - 1 / bins) ** n)
    return (share - 5 * np.sqrt(share * (1 - share) / filled)) * bins


def _between_components(group: DataFrame, percent: int, size: int, bins: int) -> DataFrame:
    """Links between rows of a centre's group that lie in different components: those outside the centre's with all, block by block.

    group: (centre, id, label, main, low, text, size)
    """

    def unpack(rows: pa.StructArray) -> tuple:
        low = np.frombuffer(b"".join(rows.field("low").to_pylist()), np.uint8).reshape(-1, bins)
        sets, first = tk.distinct(*tk.shingles(tk.words(rows.field("text")), size))
        return rows.field("id").to_numpy(), rows.field("label").to_numpy(), low, sets, first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest: dict[int, int] = {}

        def root(label: int) -> int:
            while (up := forest.get(label, label)) != label:
                forest[label] = forest.get(up, up)
                label = up
            return label

        for batch in batches:
            found: list[tuple[int, int]] = []
            for i in range(batch.num_rows):
                ids, labels, low, sets, first = unpack(batch.column(0)[i].values)
                ids2, labels2, low2, sets2, first2 = unpack(batch.column(1)[i].values)
                roots2 = np.array([root(x) for x in labels2.tolist()])
                n, n2 = np.diff(first), np.diff(first2)
                for a in range(len(ids)):
                    mine = root(int(labels[a]))
                    # What this task has linked with the row's component needs no comparison more.
                    others = np.flatnonzero(roots2 != mine)
                    least = _least(np.minimum(n2[others], n[a]), percent, bins)
                    alike = others[(low2[others] == low[a]).sum(axis=1) >= least]
                    for b in alike.tolist():
                        if roots2[b] != mine and _similar(sets[first[a] : first[a + 1]], sets2[first2[b] : first2[b + 1]], percent):
                            found.append((min(ids[a], ids2[b]), max(ids[a], ids2[b])))
                            forest[int(roots2[b])] = mine
                            roots2[roots2 == roots2[b]] = mine
            u, v = zip(*found, strict=True) if found else ([], [])
            tk.release()
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    columns = ["id", "label", "low", "text"]
    near, near_blocks = _blocks(group, "centre", columns, "near")
    far, far_blocks = _blocks(group.where("label != main"), "centre", columns, "far")
    # Each task of a centre has some of its far blocks and meets all its near ones.
    tasks = far_blocks.toDF("centre", "f").join(near_blocks.toDF("centre", "n"), "centre")
    tasks = tasks.select("centre", F.col("f"), "n", F.least("f", F.ceil(F.col("f") * F.col("n") / TASK_PAIRS)).alias("tasks"))
    far = far.join(copies(tasks, "f", "block").select("centre", "block", "tasks"), ["centre", "block"])
    near = near.join(copies(tasks, "n", "block").select("centre", "block", "tasks"), ["centre", "block"])
    far = far.select("centre", F.pmod("block", "tasks").alias("task"), "far")
    near = copies(near, "tasks", "task").select("centre", "task", "near")
    return far.join(near, ["centre", "task"]).select("far", "near").mapInArrow(run, "u long, v long").distinct()


def near_dedup(
    docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", size: int = 5, bands: int = 28, rows: int = 5
) -> DataFrame:
    """A row per input row: id, n_shingles, component_id, kept. Documents are linked at 100 * intersection >= percent * union."""
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(text_col).alias("text"))
    sketched = materialize(sketch_documents(docs, bands, rows, size), "sketches").withColumn("run", F.pmod(F.xxhash64("id"), F.lit(_RUNS)))
    # Classes of equal sets: counted in runs first, so that a large class is spread over them on the way back.
    runs = sketched.where("n > 0").groupBy("run", "digest").agg(F.min("id").alias("low_id"))
    classes = runs.groupBy("digest").agg(F.min("low_id").alias("head"))
    decided = runs.select("run", "digest").join(classes, "digest")
    member = materialize(
        sketched.select("id", "n", "run", "digest").join(decided, ["run", "digest"], "left").select("id", "n", F.coalesce("head", "id").alias("head")), "classes"
    )
    heads = materialize(
        sketched.join(classes.select("digest", F.col("head").alias("id")), ["digest", "id"], "left_semi").select("id", "n", "low", "keys").distinct(), "heads"
    )
    placed = heads.select("id", F.explode("keys").alias("key"))
    shared = placed.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("places")).where("lo < hi")
    shared = materialize(shared.select("key", "places"), "shared")
    # Most keys are nobody else's; a bitmap leaves them where they are.
    buckets = materialize(spread_join(maybe_in(placed, shared, "key"), shared, ["key"], F.col("id")), "buckets")
    score = buckets.groupBy("id").agg(F.sum("places").alias("score"))
    scored = buckets.select("key", "id").join(score, "id")
    centre = scored.groupBy("key").agg(F.max(F.struct("score", (-F.col("id")).alias("id"))).alias("c")).select("key", (-F.col("c.id")).alias("centre"))
    stars = materialize(spread_join(buckets, centre, ["key"], F.col("id")).where("id != centre").select(F.col("centre").alias("u"), F.col("id").alias("v")).distinct(), "stars")
    same = member.groupBy("id").agg(F.min("head").alias("u"), F.max("head").alias("v")).where("u < v")
    same = member.join(same.select("id", "u"), "id").select("u", F.col("head").alias("v")).where("u != v").distinct()
    needed = stars.select(F.col("u").alias("id")).union(stars.select("v")).distinct()
    # An inner join: a semi-join would be moved below the filter, and all texts be shuffled.
    texts = materialize(maybe_in(docs, needed, "id").join(needed, "id").withColumn("size", F.octet_length("text").cast("long")), "texts")
    labels = components(materialize(confirm(stars, texts, percent, size).unionByName(same), "links"))
    # What the stars may have missed: links between the components in the group of a centre.
    group = stars.select(F.col("u").alias("centre"), F.col("v").alias("id")).union(stars.select("u", "u").distinct())
    group = group.join(labels, F.col("id") == F.col("node"), "left").select("centre", "id", F.coalesce("component", "id").alias("label"))
    # What is known of a centre comes back to its rows in runs, as above.
    group = materialize(group.withColumn("run", F.pmod(F.xxhash64("id"), F.lit(_RUNS))), "members")
    facts = [F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("main").alias("main")]
    by_run = group.withColumns({"lo": F.col("label"), "hi": F.col("label"), "main": F.when(F.col("id") == F.col("centre"), F.col("label"))})
    by_run = by_run.groupBy("centre", "run").agg(*facts)
    mixed = by_run.groupBy("centre").agg(*facts).where("lo < hi").select("centre", "main")
    group = group.where("id != centre").join(by_run.select("centre", "run").join(mixed, "centre"), ["centre", "run"]).drop("run")
    group = materialize(group.join(heads.select("id", "low"), "id").join(texts, "id"), "groups")
    late = materialize(_between_components(group, percent, size, bands * rows), "links")
    if not late.isEmpty():
        labels = components(labels.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(late))
    out = member.join(labels, member["head"] == labels["node"], "left").select("id", "n", F.coalesce("component", "head").alias("component"))
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(real("id").alias(id_col), F.col("n").alias("n_shingles"), real("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
