"""Approximate nearest neighbours by shifted space-filling curves.

Vectors that are equal form one entry with their k + 1 smallest ids, more than which no query can be given; so a vector that a third of all rows
have is met once. An entry is projected by several random matrices, shifted, and gets its place on a Hilbert curve for each of
them. The entries of a curve are ordered by ranges and cut into blocks of neighbouring keys. A query meets, on each curve, the blocks that its window
of places to either side touches; what the curves find is merged and ranked by the distance of the original vectors.

How far curves keep neighbours together depends on the vectors, so the window is fitted: for a bounded sample of queries (``sample``, by a hash of
the id) the true neighbours are found by an exact pass over all entries, in blocks, and the window is the smallest that reaches a share of
``recall`` of them. It covers all rows where nothing less does; nothing is cut off at a fixed size. Vectors that have a structure need
narrow windows; on random directions in 64 dimensions they have to be wide.

Defined results: a vector that is null, zero or empty or holds null or non-finite components takes no part, nor does a row without an id; repeated
rows are one; an id with several vectors is several queries and candidates, never of itself; vectors of different lengths are never
compared; a query without candidates gives no rows; an empty table gives none; other columns are ignored. Ids are longs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialize, running_sums, spread_join

#: Numbers a block of neighbouring keys holds, about, and the bounds of its rows.
BLOCK_NUMBERS, LEAST_ROWS, MOST_ROWS = 1 << 17, 16, 2048
#: A curve's vectors of one length lie in one lane: curve * LANE + length.
LANE = 1 << 32
#: Places to either side that a window has at least.
LEAST_WINDOW = 512


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of cells (n, dims) with that many bits a dimension; dims * bits under 64. After Skilling's transposed form."""
    x = [c.astype(np.int64) for c in cells.T]
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(len(x)):
            upper = (x[i] & bit) > 0
            swapped = np.where(upper, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(upper, low, swapped)
            x[i] ^= swapped
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1, (1 << level) - 1, 0)
    place = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for c in x:
            place = (place << 1) | (((c ^ turn) >> level) & 1)
    return place


@dataclass(frozen=True)
class Curves:
    """Random projections and shifts, the same for all vectors of a length. dims * bits is under 64."""

    number: int = 4
    dims: int = 6
    bits: int = 10
    seed: int = 0

    def places(self, vectors: np.ndarray) -> np.ndarray:
        """(n, length) to (n, curves) places. Projections of unit vectors lie within the cube almost always; others are put on its side."""
        length = vectors.shape[1]
        rng = np.random.default_rng([self.seed, length])
        norm = np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
        # The length of a vector bends its direction's coordinates only slightly, so that equal directions stay near.
        scaled = vectors / norm * np.sqrt(length) * (1 + 0.1 * np.tanh(np.log(norm)))
        out = []
        for _ in range(self.number):
            planes = np.linalg.qr(rng.normal(size=(length, min(self.dims, length))))[0]
            shift = rng.random(planes.shape[1])
            unit = ((scaled @ planes) / 8 + 0.5 + shift) / 2
            out.append(hilbert(np.clip(unit * (1 << self.bits), 0, (1 << self.bits) - 1).astype(np.int64), self.bits))
        return np.stack(out, axis=1)


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix."""
    n = len(vectors)
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) if n else np.zeros((0, 1))


def nearest(queries: np.ndarray, rows: np.ndarray, ids: list[np.ndarray], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each query the ids of its k nearest rows, ties to smaller ids, their distances and their rows. Each row has some ids."""
    a, b = (queries**2).sum(axis=1), (rows**2).sum(axis=1)
    rough = a[:, None] + b[None, :] - 2 * (queries @ rows.T)
    of, every = np.repeat(np.arange(len(rows)), [len(x) for x in ids]), np.concatenate(ids)
    first = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    for i in range(len(queries)):
        # Products place a row within rounding; differences decide.
        edge = np.partition(rough[i], k - 1)[k - 1] if len(rows) > k else np.inf
        near = np.flatnonzero(rough[i] <= edge + 1e-9 * (a[i] + b.max()))
        distance = np.sqrt(((rows[near] - queries[i]) ** 2).sum(axis=1))
        spots = np.concatenate([np.arange(first[r], first[r + 1]) for r in near])
        distance = np.repeat(distance, first[near + 1] - first[near])
        best = np.lexsort((every[spots], distance))[:k]
        yield every[spots[best]], distance[best], of[spots[best]]


def entries(rows: DataFrame, id_col: str, vector_col: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Distinct vectors (entry, length, vector, ids: the k smallest), and (id, entry) of the rows that take part."""
    v = F.col("vector")
    fit = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    fit = fit.where(F.col("id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    # -0.0 is 0.0: their distance is.
    fit = fit.withColumn("vector", F.transform(v, lambda x: x + F.lit(0.0)))
    fit = fit.withColumn("entry", F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(i), v)), 16, "0") for i in (1, 2))))
    members = materialize(fit.select("id", "entry").distinct(), "vector-members")
    low = members.withColumn("rank", F.row_number().over(Window.partitionBy("entry").orderBy("id"))).where(F.col("rank") <= k)
    low = low.groupBy("entry").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    vectors = fit.groupBy("entry").agg(F.any_value("vector").alias("vector"))
    return materialize(vectors.join(low, "entry").select("entry", F.size("vector").cast("long").alias("length"), "vector", "ids"), "vector-entries"), members


def on_curves(found: DataFrame, curves: Curves) -> DataFrame:
    """(entry, length) and where on each curve it lies: (lane, entry, length, pos from 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            for length in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == length))
                places = curves.places(_matrix(part.column("vector")))
                for c in range(curves.number):
                    fixed = [pa.array(np.full(part.num_rows, x)) for x in (c * LANE + length, length, 1)]
                    yield pa.RecordBatch.from_arrays([fixed[0], pa.array(places[:, c]), part.column("entry"), fixed[1], fixed[2]], ["lane", "place", "entry", "length", "pos"])

    placed = found.select("entry", "length", "vector").mapInArrow(run, "lane long, place long, entry string, length long, pos long")
    return running_sums(placed, "lane", [F.asc("place"), F.asc("entry")], ["pos"], "curves").select("lane", "entry", "length", "pos")


def true_neighbours(found: DataFrame, queries: list[tuple[str, list[float]]], k: int) -> DataFrame:
    """(query, entry, id, score): the k nearest ids of some queries (entry, vector) by an exact pass over all entries, block by block."""
    by_length: dict[int, list[tuple[str, list[float]]]] = {}
    for entry, vector in queries:
        by_length.setdefault(len(vector), []).append((entry, vector))
    sets = {n: ([e for e, _ in x], np.array([v for _, v in x])) for n, x in by_length.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, list[tuple[float, int, str]]] = {}
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            for length, (names, matrix) in sets.items():
                part = batch.filter(pa.array(lengths == length))
                if part.num_rows:
                    entry = part.column("entry").to_pylist()
                    for name, (ids, scores, at) in zip(names, nearest(matrix, _matrix(part.column("vector")), _lists(part.column("ids")), k), strict=True):
                        both = [*best.get(name, []), *zip(scores.tolist(), ids.tolist(), [entry[r] for r in at], strict=True)]
                        best[name] = sorted(both)[:k]
        rows = [(name, e, i, s) for name, x in best.items() for s, i, e in x]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, _FOUND, strict=True)], ["query", "entry", "id", "score"])

    near = found.select("entry", "length", "vector", "ids").mapInArrow(run, "query string, entry string, id long, score double")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("score", "id"))).where(F.col("rank") <= k).drop("rank")


_FOUND = (pa.string(), pa.string(), pa.int64(), pa.float64())


def _lists(ids: pa.Array) -> list[np.ndarray]:
    flat, offsets = ids.values.to_numpy(), ids.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def fit_windows(found: DataFrame, places: DataFrame, asked: DataFrame, k: int, recall: float, sample: int) -> dict[int, int]:
    """Places to either side, by length of the vectors, within which some curve has a share of ``recall`` of the true neighbours of the sample.

    asked: (entry) of the queries, of which ``sample`` are taken by a hash. A length that the sample lacks is not in the result.
    """
    chosen = asked.orderBy(F.xxhash64("entry"), "entry").limit(sample)
    queries = [tuple(r) for r in found.join(F.broadcast(chosen), "entry").select("entry", "vector").collect()]
    if not queries:
        return {}
    near = true_neighbours(found, queries, k).select("query", "entry", "id")
    theirs = places.join(F.broadcast(near), "entry")
    own = places.join(F.broadcast(chosen), "entry").select(F.col("entry").alias("query"), "lane", F.col("pos").alias("own"))
    apart = theirs.join(F.broadcast(own), ["query", "lane"]).groupBy("query", "id", "length").agg(F.min(F.abs(F.col("pos") - F.col("own"))).alias("apart"))
    by_length: dict[int, list[int]] = {}
    for r in apart.collect():  # at most sample * k rows
        by_length.setdefault(r["length"], []).append(r["apart"])
    # The nearest of all is the query itself, which is no evidence.
    return {n: max(LEAST_WINDOW, int(np.quantile(sorted(x)[len(x) // k :] or [0], recall, method="higher"))) for n, x in by_length.items()}


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spot, rows, ids, pending = None, [], [], None
        for batch in batches:
            lane, block, asked = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("lane", "block", "asked"))
            change = np.flatnonzero((lane[1:] != lane[:-1]) | (block[1:] != block[:-1]) | (asked[1:] != asked[:-1])) + 1
            for a, b in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows], strict=True):
                if b == a:
                    continue
                part = batch.slice(a, b - a)
                if (lane[a], block[a]) != spot:
                    spot, rows, ids, pending = (lane[a], block[a]), [], [], None
                vectors = _matrix(part.column("vector"))
                if not asked[a]:
                    rows.append(vectors)
                    ids += _lists(part.column("ids"))
                    pending = None
                elif rows:
                    pending = np.concatenate(rows) if pending is None else pending
                    names = part.column("entry").to_pylist()
                    for at in range(0, len(names), 256):
                        out = [(n, i, s) for n, (i, s, _) in zip(names[at : at + 256], nearest(vectors[at : at + 256], pending, ids, k), strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([n for n, i, _ in out for _ in range(len(i))], pa.string()), pa.array(np.concatenate([i for _, i, _ in out])), pa.array(np.concatenate([s for _, _, s in out]))], ["entry", "id", "score"]
                        )

    return run


def neighbours(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10, curves: Curves | None = None, recall: float = 0.95, sample: int = 256
) -> DataFrame:
    """The k nearest found of each row whose id is divisible by ``every``: query_id, rank (from 1), vec_id, score (Euclidean distance).

    recall: share of the true neighbours of a sample of at most ``sample`` queries that the window has to reach.
    """
    found, members = entries(rows, id_col, vector_col, k + 1)
    asking = members.where(F.col("id") % every == 0)
    asked = materialize(asking.select("entry").distinct(), "vector-queries")
    places = on_curves(found, curves or Curves())
    windows = fit_windows(found, places, asked, k + 1, recall, sample)
    # Lengths that were not in the sample are rare; their windows take in all.
    window = F.coalesce(F.element_at(F.create_map(*(F.lit(x).cast("long") for kv in windows.items() for x in kv)), F.col("length")), F.col("rows")) if windows else F.col("rows")
    block_rows = F.greatest(F.lit(LEAST_ROWS), F.least(F.lit(MOST_ROWS), F.floor(F.lit(BLOCK_NUMBERS) / F.col("length")))).cast("long")
    ordered = places.join(found.drop("length"), "entry").withColumns({"size": block_rows}).withColumn("block", F.expr("(pos - 1) div size"))
    lanes = found.groupBy("length").agg(F.count("*").alias("rows"))
    asks = ordered.join(asked, "entry").join(lanes, "length").withColumn("window", window)
    asks = asks.withColumn("reach", F.expr("sequence(greatest(pos - 1 - window, 0) div size, least(pos - 1 + window, rows - 1) div size)"))
    asks = asks.select("lane", F.explode("reach").alias("block"), F.lit(True).alias("asked"), "entry", "vector", F.lit(None).cast("array<long>").alias("ids"))
    met = ordered.select("lane", "block", F.lit(False).alias("asked"), "entry", "vector", "ids").unionByName(asks)
    met = met.repartition("lane", "block").sortWithinPartitions("lane", "block", "asked").mapInArrow(_search(k + 1), "entry string, id long, score double")
    best = met.repartition("entry").groupBy("entry", "id").agg(F.min("score").alias("score"))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("entry").orderBy("score", "id"))).where(F.col("rank") <= k + 1)
    lists = best.groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("score", "id"))).alias("near"))
    own = spread_join(asking, lists, ["entry"], F.col("id")).withColumnRenamed("id", "query_id")
    own = own.select("query_id", F.posexplode(F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)).alias("rank", "hit"))
    return own.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.score").alias("score"))
