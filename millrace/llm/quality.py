"""Quality classifier over random-indexing word vectors.

Every token has a fixed sparse ternary index vector. One pass over all documents adds, to the context vector of each hashed
token, the index vectors of its neighbours; tasks emit their sums compressed, and the sums are merged in a tree. A token's word
vector is its normalised context vector plus its own index vector. A document is the mean of its tokens' vectors. A network of two
layers, written in numpy, is trained on a bounded sample of labelled documents; its logits are divided by a temperature that is
fitted on a part of the sample that it was not trained on.

Two tokens stand for a word between white space: the word itself, hashed into ``VOCABULARY`` slots, and its form (which kinds of
bytes it has, its length in steps, and whether it repeats the word before it).

Bounds: the model holds (VOCABULARY + FORMS) x DIMENSIONS numbers whatever the corpus; ``sample`` bounds the labelled rows.
Labels, language, source and ids are never inputs of a score.

Defined results: a null or empty text has the zero vector and the score the network gives to it; rows with a null label or id are
not trained on; if the sample lacks one of the labels, every score is 0.5; repeated rows are each scored; an empty table gives no
rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import textkernel as tk

U = np.uint64
VOCABULARY, FORMS, DIMENSIONS, NONZEROS = 1 << 14, 1 << 11, 32, 2
ROWS = VOCABULARY + FORMS
_BLOCKS, _FAN = 8, 64
KEEP_FROM = 0.3


def _kinds() -> np.ndarray:
    kind = np.full(256, 128, np.uint8)
    kind[65:91], kind[97:123], kind[48:58], kind[128:] = 1, 2, 4, 8
    for bit, marks in ((16, b".,;:'\"-()"), (32, b"!?"), (64, b"|/\\<>=_")):
        kind[list(marks)] = bit
    return kind


_KIND = _kinds()


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word its slot and the slot of its form; and the first word of each text (one more at the end)."""
    w = tk.words(texts)
    if not len(w.hash):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), w.first
    word = (w.hash % U(VOCABULARY)).astype(np.int64)
    # w.data is lower-cased; the raw bytes tell the kinds. Bytes between words are no part of any.
    raw, _ = tk._buffers(texts)
    bounds = np.column_stack([w.start, w.end]).ravel()
    if bounds[-1] == len(raw):
        bounds = bounds[:-1]
    kinds = np.bitwise_or.reduceat(_KIND[raw], bounds)[::2].astype(np.int64)
    length = np.minimum(np.log2(w.end - w.start).astype(np.int64), 3)
    again = np.zeros(len(word), np.int64)
    again[1:] = w.hash[1:] == w.hash[:-1]
    again[w.first[:-1][w.first[:-1] < len(word)]] = 0
    return word, VOCABULARY + kinds * 8 + length * 2 + again, w.first


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Dimensions and signs of the nonzero places of each slot's index vector."""
    h = tk.mix(np.arange(ROWS * NONZEROS, dtype=U) + U(0x5EED)).reshape(ROWS, NONZEROS)
    return (h % U(DIMENSIONS)).astype(np.int64), np.where(h >> U(63), 1.0, -1.0)


def contexts(texts: pa.Array, place: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """Sums of the index vectors of the neighbours of each slot's tokens, as ROWS x DIMENSIONS."""
    word, form, first = tokens(texts)
    out = np.zeros(ROWS * DIMENSIONS)
    if len(word) < 2:
        return out.reshape(ROWS, DIMENSIONS)
    near = np.ones(len(word) - 1, bool)
    near[first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(word))] - 1] = False
    left, right = np.flatnonzero(near), np.flatnonzero(near) + 1
    for own in (word, form):
        for of in (word, form):
            for a, b in ((left, right), (right, left)):
                for k in range(NONZEROS):
                    out += np.bincount(own[a] * DIMENSIONS + place[of[b], k], sign[of[b], k], ROWS * DIMENSIONS)
    return out.reshape(ROWS, DIMENSIONS)


def _pack(total: np.ndarray) -> bytes:
    return zlib.compress(total.astype(np.int64).astype("<i4" if np.abs(total).max(initial=0) < 2**31 else "<i8").tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    raw, n = zlib.decompress(data), ROWS // _BLOCKS * DIMENSIONS
    return np.frombuffer(raw, "<i4" if len(raw) == 4 * n else "<i8").astype(np.int64)


def context_sums(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Context vectors of all slots over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place, sign = index_vectors()
        total = np.zeros((ROWS, DIMENSIONS))
        for batch in batches:
            for part in tk.slices(batch, 0):
                total += contexts(part.column(0), place, sign)
        if total.any():
            data = [_pack(x) for x in total.reshape(_BLOCKS, -1)]
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([task] * _BLOCKS, pa.int64()), pa.array(range(_BLOCKS), pa.int32()), pa.array(data, pa.binary())], ["task", "block", "data"])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(ROWS // _BLOCKS * DIMENSIONS, np.int64)
        for x in rows["data"]:
            total += _unpack(x)
        return pd.DataFrame({"task": rows["task"].iloc[:1], "block": rows["block"].iloc[:1], "data": [_pack(total)]})

    schema = "task long, block int, data binary"
    texts = docs.select(F.col(text_col).alias("text"))
    parts = texts.rdd.getNumPartitions()
    sums = texts.mapInArrow(run, schema)
    while True:  # at most _FAN sums meet in a task
        sums = sums.withColumn("task", F.expr(f"task div {_FAN}")).groupBy("task", "block").applyInPandas(merge, schema)
        parts = -(-parts // _FAN)
        if parts <= 1:
            break
    out = np.zeros((_BLOCKS, ROWS // _BLOCKS * DIMENSIONS))
    for r in sums.collect():  # _BLOCKS rows
        out[r["block"]] += _unpack(bytes(r["data"]))
    return out.reshape(ROWS, DIMENSIONS)


def word_vectors(sums: np.ndarray) -> np.ndarray:
    place, sign = index_vectors()
    out = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    for k in range(NONZEROS):
        np.add.at(out, (np.arange(ROWS), place[:, k]), sign[:, k])
    return out.astype(np.float32)


def pool(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean vectors of the words and of the forms of each text, side by side."""
    word, form, first = tokens(texts)
    n = np.diff(first)
    out = np.zeros((len(n), 2 * DIMENSIONS), np.float32)
    full = n > 0
    if full.any():
        for i, slots in enumerate((word, form)):
            out[full, i * DIMENSIONS : (i + 1) * DIMENSIONS] = np.add.reduceat(vectors[slots], first[:-1][full], axis=0) / n[full, None]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Network:
    """Two layers and a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, batch: int = 256, seed: int = 7) -> Network | None:
    """Trains on the rows with index mod 6 > 0 and fits the temperature on the others. None if a label is missing."""
    held = np.arange(len(y)) % 6 == 0
    if len({*y[~held].tolist()}) < 2:
        return None
    rng = np.random.default_rng(seed)
    a, b = x[~held].astype(np.float64), y[~held].astype(np.float64)
    net = Network(a.mean(axis=0), a.std(axis=0) + 1e-3, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), 0.0)
    a = (a - net.mean) / net.scale
    parameters = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, v, step = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters], 0
    for _ in range(epochs):
        order = rng.permutation(len(b))
        for at in range(0, len(b), batch):
            i = order[at : at + batch]
            h = np.tanh(a[i] @ parameters[0] + parameters[1])
            d = (_sigmoid(h @ parameters[2] + parameters[3][0]) - b[i]) / len(i)
            back = np.outer(d, parameters[2]) * (1 - h * h)
            grads = [a[i].T @ back + 1e-4 * parameters[0], back.sum(axis=0), h.T @ d + 1e-4 * parameters[2], np.array([d.sum()])]
            step += 1
            for p, g, mm, vv in zip(parameters, grads, m, v, strict=True):  # Adam
                mm += 0.1 * (g - mm)
                vv += 0.001 * (g * g - vv)
                p -= 0.003 * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
    net.b2 = float(parameters[3][0])
    if held.any():
        logits, z = net.logits(x[held].astype(np.float64)), y[held]
        options = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        loss = [np.logaddexp(0, np.where(z == 1, -logits, logits) / t).mean() for t in options]
        net.temperature = float(options[int(np.argmin(loss))])
    return net


@dataclass
class QualityModel:
    vectors: np.ndarray
    network: Network | None

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), 0.5)
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        return np.concatenate([np.zeros(0), *(self.network.scores(pool(p.column(0), self.vectors).astype(np.float64)) for p in tk.slices(batch, 0, 1 << 20))])


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 20_000) -> QualityModel:
    """Word vectors from all docs; the network from at most ``sample`` labelled rows that are not held out."""
    vectors = word_vectors(context_sums(docs, text_col))
    chosen = (
        labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
        .where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
        .groupBy("id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, 2, 1 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in pool(part.column(2), vectors)], pa.binary())], ["id", "y", "x"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # The sample is bounded by its limit, so it may be broadcast and its vectors collected. Of texts with one id the smallest vector (as
    # bytes) is taken, whatever order they come in.
    rows = texts.join(F.broadcast(chosen), "id").select("id", "y", "text").mapInArrow(run, "id long, y int, x binary").groupBy("id", "y").agg(F.min("x").alias("x")).collect()
    rows.sort(key=lambda r: zlib.crc32(str(r["id"]).encode()) * 2**64 + r["id"])
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows], np.float32).reshape(-1, 2 * DIMENSIONS)
    return QualityModel(vectors, train(x, np.array([r["y"] for r in rows], np.int64)))


def score(model: QualityModel, text: Column) -> Column:
    """The probability that a text is of quality 1."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(model.score(texts), pa.float64())

    return F.arrow_udf(run, "double")(text)
