"""Benchmark decontamination.

Words are runs of bytes other than white space and ASCII punctuation, A-Z lower-cased. For each benchmark item, windows of the
item's length slide over a document word by word. A window and an item are compared by the weighted similarity of their five-word
shingles: the sum of the smaller multiplicities by the sum of the larger ones.

A window that shares no shingle with any item of its length has similarity 0, so only windows that touch a shingle of one are
fingerprinted (an exact test: the shingles of all items are in a sorted table, with the lengths of the items). Fingerprints are 64-bit SimHashes of the window's shingles, kept as
running sums over the words. The fingerprints of the items are indexed by four blocks of 16 bits: two fingerprints within
radius 19 agree up to 4 bits in one block at least. Those 4 bits are shared out: the index of a block lists the items for each value
within some bits of theirs, and a window looks up each value within the others of its own; so all items within the radius are
found. The more items, the fewer bits are on the index's side, so that its size is bounded. Only items of the window's length are
looked up. At similarity 0.8 the fingerprints of a window and an item differ in 10 bits on average (standard deviation 3).
Candidates are then verified on the words themselves.

The benchmark is broadcast, and the documents are passed over once and never shuffled. A benchmark of more than ``block_words`` words or
``block_items`` items is dealt by a hash to blocks of about that size, with one pass for each, so that what the driver holds (the words of
a block) and a task (some 30 bytes a word, and an index of 100 MB or 50 bytes an item) is bounded. A window is only looked at if
it touches a shingle of an item of its own length.

Defined results: a document or item that is null, empty or without words matches nothing; an item of fewer than five words is one
shingle of its own length; a document shorter than an item is one window; an item that occurs several times counts once, at its
best and then first window; null ids stay null; repeated documents and items are each reported; other columns are ignored; an empty table gives no rows. Ids are
longs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import textkernel as tk

U = np.uint64
SIZE, RADIUS, BLOCKS, BITS = 5, 19, 4, 16
_BIT = np.arange(64, dtype=U)


def bag(words: tuple[bytes, ...], size: int = SIZE) -> Counter:
    """Shingles with their multiplicities."""
    size = min(size, len(words))
    return Counter(words[i : i + size] for i in range(len(words) - size + 1)) if words else Counter()


def weighted_similarity(a: Counter, b: Counter) -> float:
    common = sum(min(n, b[k]) for k, n in a.items())
    union = a.total() + b.total() - common
    return common / union if union else 0.0


def signs(hashes: np.ndarray) -> np.ndarray:
    """Each hash as 64 steps of 1 and -1."""
    return (((hashes[:, None] >> _BIT) & U(1)).astype(np.int32) << 1) - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(U) << _BIT).sum(axis=1, dtype=U)


def _flips(bits: int) -> np.ndarray:
    """All ways to flip at most that many bits of a block."""
    return np.array([sum(1 << b for b in c) for k in range(bits + 1) for c in combinations(range(BITS), k)], np.int64)


class HammingIndex:
    """Finds all indexed fingerprints of the same group (a number under 2**32) within RADIUS."""

    def __init__(self, prints: np.ndarray, groups: np.ndarray | None = None, most: int = 1 << 21):
        """most: entries of a block's list, unless there are more items."""
        self.prints = prints
        groups = np.zeros(len(prints), np.int64) if groups is None else groups.astype(np.int64)
        within = RADIUS // BLOCKS
        own = max((k for k in range(within + 1) if len(prints) * len(_flips(k)) <= most), default=0)
        flips, self.flips = _flips(own), _flips(within - own)
        self.lists = []
        for b in range(BLOCKS):
            keys = ((groups << BITS)[:, None] + (self._block(prints, b)[:, None] ^ flips)).ravel()
            order = np.argsort(keys, kind="stable")
            self.lists.append((keys[order], (order // len(flips)).astype(np.int32)))

    @staticmethod
    def _block(prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> U(BITS * b)) & U((1 << BITS) - 1)).astype(np.int64)

    def search(self, prints: np.ndarray, group: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """All (position in prints, item) within the radius."""
        found = [np.zeros(0, np.int64)]
        step = max(1, (1 << 20) // len(self.flips))
        for start in range(0, len(prints), step):
            some = prints[start : start + step]
            for b, (keys, items) in enumerate(self.lists):
                value = ((group << BITS) + (self._block(some, b)[:, None] ^ self.flips)).ravel()
                first = np.searchsorted(keys, value, "left")
                n = np.searchsorted(keys, value, "right") - first
                at = np.repeat(np.arange(len(value)) // len(self.flips), n)
                item = items[np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
                near = np.bitwise_count(some[at] ^ self.prints[item]) <= RADIUS
                found.append(np.unique((at[near] + start) * len(self.prints) + item[near]))
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.prints), pairs % len(self.prints)


class Benchmark:
    """The items of one block, ready to be searched for."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.text = w = tk.words(pa.array(texts, pa.string()), tk.WHITE_AND_MARKS)
        n = np.diff(w.first)
        held = np.flatnonzero(n)
        self.ids = [ids[i] for i in held]
        self.first = w.first[:-1][held]
        hashes, first = tk.shingles(w, SIZE)
        prints = np.zeros(len(held), U)
        for at in range(0, len(held), 4096):
            some = held[at : at + 4096]
            a, b = first[some[0]], first[some[-1] + 1]
            total = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(signs(hashes[a:b]), axis=0, dtype=np.int32)])
            prints[at : at + 4096] = fingerprints(total[first[some + 1] - a] - total[first[some] - a])
        # An index of all items, grouped by length in words; and by shingle size the sorted table of all shingles.
        self.length = n[held]
        self.lengths = np.unique(self.length).tolist()
        self.index = HammingIndex(prints, self.length)
        self.shingles = {}
        for size in range(1, SIZE + 1):
            of_size = (n == size) if size < SIZE else (n >= SIZE)
            if of_size.any():
                # Each shingle with the lengths of the items that hold it: windows of other lengths have nothing to find there.
                counts = np.diff(first)
                pairs = np.unique(np.array([hashes[np.repeat(of_size, counts)], np.repeat(n, counts)[np.repeat(of_size, counts)].astype(U)]), axis=1)
                table, at = np.unique(pairs[0], return_index=True)
                self.shingles[size] = table, np.append(at, pairs.shape[1]), pairs[1].astype(np.int64)
        self.bag = lru_cache(4096)(self._bag)

    def _bag(self, item: int) -> Counter:
        """The shingles of an item, when it is a candidate."""
        return bag(self.text.text(self.first[item], self.first[item] + self.length[item]))


_last: tuple[Broadcast, Benchmark] | None = None


def _prepared(sent: Broadcast) -> Benchmark:
    """The benchmark, kept for the next task of this Python worker."""
    global _last
    if _last is None or _last[0] is not sent:
        _last = sent, Benchmark(*sent.value)
    return _last[1]


def _held(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values the sorted table holds; a bitmap of their upper bits settles most."""
    bits = max(16, len(table).bit_length() + 6)
    seen = np.zeros(1 << bits, bool)
    seen[(table >> U(64 - bits)).astype(np.int64)] = True
    maybe = np.flatnonzero(seen[(values >> U(64 - bits)).astype(np.int64)])
    at = np.minimum(np.searchsorted(table, values[maybe]), len(table) - 1)
    out = np.zeros(len(values), bool)
    out[maybe[table[at] == values[maybe]]] = True
    return out


def find(texts: pa.Array, bench: Benchmark, threshold: float) -> Iterator[tuple[int, int, float, int, int]]:
    """(text, item, similarity, first word, words) of the best window for each text and item at or over the threshold."""
    w = tk.words(texts, tk.WHITE_AND_MARKS)
    n_words = np.diff(w.first)
    for size, (table, edges, lengths) in bench.shingles.items():
        # Hash of the shingle that starts at each word; those that run over the end of a text are never looked at.
        starts = len(w.hash) - size + 1
        if starts <= 0:
            continue
        every = tk._combine([w.hash[k : k + starts] for k in range(size)])
        hit = np.flatnonzero(_held(every, table))
        if not len(hit):
            continue
        text_of = np.searchsorted(w.first, hit, "right") - 1
        inside = hit + size <= w.first[text_of + 1]
        hit, text_of = hit[inside], text_of[inside]
        for spots in np.split(hit, np.flatnonzero(np.diff(text_of)) + 1) if len(hit) else []:
            text = int(np.searchsorted(w.first, spots[0], "right") - 1)
            # Each spot with each length that its shingle asks for, by length.
            known = np.searchsorted(table, every[spots])
            n = edges[known + 1] - edges[known]
            needs = lengths[np.repeat(edges[known] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            order = np.argsort(needs, kind="stable")
            needs, spots = needs[order], np.repeat(spots, n)[order]
            best: dict[int, tuple[float, int, int]] = {}
            for some in np.split(np.arange(len(needs)), np.flatnonzero(np.diff(needs)) + 1):
                _find_in(w, every, spots[some], text, int(n_words[text]), size, int(needs[some[0]]), bench, threshold, best)
            for m, (s, p, k) in best.items():
                yield text, m, s, p, k


def _find_in(w: tk.Words, every: np.ndarray, spots: np.ndarray, text: int, length: int, size: int, need: int, bench: Benchmark, threshold: float, best: dict) -> None:
    """The best windows of a text, for items of a length, that touch the spots: into best."""
    base, spots = int(w.first[text]), spots - w.first[text]
    take = min(need, length)
    span = take - size + 1  # shingles in a window
    # Windows that touch a spot, as ranges of starts that lie apart.
    low, high = np.maximum(spots - span + 1, 0), np.minimum(spots, length - take)
    ok = low <= high
    low, high = low[ok], high[ok]
    if not len(low):
        return
    new = np.r_[True, low[1:] > high[:-1] + 1]
    for first, last in zip(low[new].tolist(), high[np.r_[new[1:], True]].tolist(), strict=True):
        for at in range(first, last + 1, STEP):
            starts = np.arange(at, min(at + STEP, last + 1))
            total = np.zeros((len(starts) + span, 64), np.int32)
            np.cumsum(signs(every[base + at : base + at + len(starts) + span - 1]), axis=0, out=total[1:])
            which, item = bench.index.search(fingerprints(total[span:] - total[:-span]), need)
            for p, m in zip(starts[which].tolist(), item.tolist(), strict=True):
                s = weighted_similarity(bag(w.text(base + p, base + p + take)), bench.bag(m))
                if s >= threshold and (m not in best or s > best[m][0]):
                    best[m] = (s, p, take)


#: Starts of windows whose running sums are made at a time.
STEP = 8192


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", block_words: int = 4_000_000, block_items: int = 250_000,
) -> DataFrame:
    """A row per document and item found in it: id, item id, similarity, start_word, n_words."""
    # Block by block of the benchmark, so that what the driver and a task hold is bounded however large the benchmark is.
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t"))
    size = F.size(F.split(F.coalesce("t", F.lit("")), " ")).cast("long")
    n, words = items.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).head()
    blocks = max(1, -(-n // block_items), -(-words // block_words))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = f"{id_col} long, {item_col} long, similarity double, start_word long, n_words long"
    out = None
    for number in range(blocks):
        block = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == number).orderBy("i", "t").collect()
        # A broadcast lies in a file on the driver, and is fetched once by an executor.
        sent = docs.sparkSession.sparkContext.broadcast(([r["i"] for r in block], [r["t"] for r in block]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            bench = _prepared(sent)
            for batch in batches:
                for part in tk.slices(batch, 1):
                    docs_of = part.column(0).to_pylist()
                    found = [(docs_of[t], bench.ids[m], s, p, k) for t, m, s, p, k in find(part.column(1), bench, threshold)]
                    columns = list(zip(*found, strict=True)) or [[]] * 5
                    types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [id_col, item_col, "similarity", "start_word", "n_words"])

        part = texts.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out
