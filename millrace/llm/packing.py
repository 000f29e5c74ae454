"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

A piece of length l belongs to class k = capacity div l, and a sequence of class k takes exactly k pieces. Documents may be cut, so
lengths are chosen to suit the classes: whole sequences first, then the rest by a table that weighs what its pieces leave empty
against their number. No piece is shorter than ``LEAST`` unless its document is. Pieces are dealt to workers by a
hash; each worker fills the sequences of its classes on its own. What is left of a class (fewer than k pieces; in all less than
capacity tokens a class) a worker packs by best fit, longest pieces first.

A sequence's number holds the worker (31 bits), the class (12 bits; 0 for what is left of classes) and the number within the
class (20 bits): room for 2^31 workers of 2^22 tokens. Rows that repeat are dealt by their place in the batch too, so that
they do not meet in one worker.

Tokens come from a word cache: ids of a text are those of its words between white space, one after another, since the tokenizer
drops white space and no rule reaches across it; nor across a letter with a stop behind it. Texts that may hold special tokens
("<|") are encoded whole.

Defined results: a null or empty text has the end id alone; repeated rows are packed each; a null id is returned as null; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import os
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import textkernel as tk
from millrace.llm.common import NULL_ID, materialize

CAPACITY = 2048
END_ID = 1
LEAST = 64
_CLASS_BITS, _BIN_BITS = 12, 20
_CACHE_WORDS = 600_000
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?)")] = True


def _cuts(data: np.ndarray) -> np.ndarray:
    """Where a stop or the like follows a letter of ASCII or Latin-1: the tokenizer always parts them."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    mark = np.flatnonzero(_MARK[data[2:]]) + 2
    before, lead = data[mark - 1], data[mark - 2]
    latin = (lead == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)
    return mark[((before >= 97) & (before <= 122)) | latin]


class WordEncoder:
    """Encodes texts by way of a bounded cache of words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        # Known hashes in order, and for each its row in the ids.
        self.known, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.first = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _encode(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word. Words of letters are encoded as one text, for their last tokens tell where they end."""
        out: list = [None] * len(words)
        letters = [i for i, w in enumerate(words) if w.isalpha()]
        for at in range(0, len(letters), 20_000):
            some = letters[at : at + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words[i] for i in some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(some):
                for i, x in zip(some, np.split(ids, ends[:-1]), strict=True):
                    out[i] = x
        others = [i for i, x in enumerate(out) if x is None]
        for at in range(0, len(others), 2_000):
            some = others[at : at + 2_000]
            for i, e in zip(some, self.tokenizer.encode_batch_fast([words[i] for i in some], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, "<u4")
        return out

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; a few megabytes of text a call at most are wise."""
        if len(self.known) > _CACHE_WORDS:
            self._clear()
        w = tk.words(texts, cuts=_cuts)
        known, inverse = np.unique(w.hash, return_inverse=True)
        place = np.searchsorted(self.known, known)
        rows = np.full(len(known), -1)
        held = np.flatnonzero(np.append(self.known, np.uint64(0))[place] == known) if len(self.known) else np.zeros(0, np.int64)
        held = held[place[held] < len(self.known)]
        rows[held] = self.row[place[held]]
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            sample = np.empty(len(known), np.int64)
            sample[inverse] = np.arange(len(inverse))
            at = sample[missing]
            data = w.data.tobytes()
            new = self._encode([data[a:b].decode() for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)])
            rows[missing] = len(self.known) + np.arange(len(missing))
            self.row = np.insert(self.row, place[missing], rows[missing])
            self.known = np.insert(self.known, place[missing], known[missing])
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum([len(x) for x in new])])
            self.ids = np.concatenate([self.ids, *new])
        row = rows[inverse]
        size = self.first[row + 1] - self.first[row]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.first[row] - total[:-1], size) + np.arange(total[-1])]
        out = np.split(ids, total[w.first[1:-1]])[: len(texts)]
        # Special tokens are told from the text as it is, before A-Z are lower-cased and across words.
        raw, off = tk._buffers(texts)
        special = np.flatnonzero((raw[:-1] == ord("<")) & (raw[1:] == ord("|")))
        for i in np.unique(np.searchsorted(off, special, "right") - 1).tolist():
            out[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4")
        return out


def _empty(length: int, capacity: int) -> float:
    """What a piece of this length leaves empty in a sequence of its class."""
    return capacity / (capacity // length) - length


@cache
def _rests(capacity: int, least: int, piece_cost: float) -> list[tuple[int, ...]]:
    """For each length under capacity + least the lengths of its pieces, the least in sum of what they leave empty and a cost a piece."""
    cost, pieces = [0.0], [()]
    sizes = sorted({capacity // k for k in range(2, capacity // least + 1)}, reverse=True)
    for n in range(1, capacity + least):
        cost.append(_empty(n, capacity) + piece_cost if n <= capacity else math.inf)
        pieces.append((n,))
        for size in sizes:
            if n - size >= least and cost[n - size] + _empty(size, capacity) + piece_cost < cost[n]:
                cost[n], pieces[n] = cost[n - size] + _empty(size, capacity) + piece_cost, (size, *pieces[n - size])
    return pieces


def cut(length: int, capacity: int = CAPACITY, least: int = LEAST, piece_cost: float = 16.0) -> list[int]:
    """Lengths of the pieces of a document."""
    least = min(least, capacity // 2)
    # A sequence less where little would be left.
    whole = length // capacity - (length > capacity and 0 < length % capacity < least)
    return [capacity] * whole + list(_rests(capacity, least, piece_cost)[length - whole * capacity])


def tokenised_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents: id (NULL_ID for null), start, length, ids_crc32, doc_tokens, again (rows of that id before it in its batch)."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer)
        end = np.array([END_ID], "<u4")
        for batch in batches:
            for part in tk.slices(batch, 1):
                rows: tuple[list, ...] = ([], [], [], [], [], [])
                seen: Counter = Counter()
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1)), strict=True):
                    ids = memoryview(np.concatenate([ids, end]).view(np.uint8))
                    start, n = 0, len(ids) // 4
                    for size in cut(n, capacity):
                        for col, v in zip(rows, (doc, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), n, seen[doc]), strict=True):
                            col.append(v)
                        start += size
                    seen[doc] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], ["id", "start", "length", "ids_crc32", "doc_tokens", "again"])

    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long, again long"
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(text_col).alias("text")).mapInArrow(pieces, schema)


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int]]:
    """Bin and offset of each length; longest first, into the fullest bin that has room."""
    free: list[tuple[int, int]] = []
    bins, offsets, n = [0] * len(lengths), [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        j = bisect.bisect_left(free, (lengths[i], -1))
        room, b = free.pop(j) if j < len(free) else (capacity, n)
        n = max(n, b + 1)
        bins[i], offsets[i] = b, capacity - room
        if room > lengths[i]:
            bisect.insort(free, (room - lengths[i], b))
    return bins, offsets


def sequence_number(worker: Column, k: Column, number: Column) -> Column:
    """The three as one long; fails rather than name two sequences alike."""
    fits = (worker < (1 << 31)) & (k < (1 << _CLASS_BITS)) & (number < (1 << _BIN_BITS))
    packed = F.shiftleft(worker.cast("long"), _CLASS_BITS + _BIN_BITS) + F.shiftleft(k.cast("long"), _BIN_BITS) + number
    return F.when(fits, packed).otherwise(F.raise_error(F.lit("too many sequences in a worker")).cast("long"))


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, worker_tokens: int = 1 << 22) -> DataFrame:
    """A row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = materialize(tokenised_pieces(docs, tokenizer, id_col, text_col, capacity), "pieces")
    tokens = pieces.agg(F.sum("length")).head()[0] or 0
    workers = -(-tokens // worker_tokens) or 1
    order = ["id", "start", "length", "ids_crc32"]
    dealt = pieces.withColumns({"worker": F.pmod(F.xxhash64("id", "start", "again"), F.lit(workers)), "k": F.expr(f"{capacity} div length")})
    ranked = dealt.withColumn("rn", F.row_number().over(Window.partitionBy("worker", "k").orderBy(*order)) - 1).withColumn(
        "in_class", F.count("*").over(Window.partitionBy("worker", "k"))
    )
    ranked = ranked.withColumn("bin", F.expr("rn div k"))
    full = F.col("rn") < F.col("in_class") - F.col("in_class") % F.col("k")
    number = sequence_number(F.col("worker"), F.col("k"), F.col("bin"))
    before = Window.partitionBy("worker", "k", "bin").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
    columns = [F.when(F.col("id") != NULL_ID, F.col("id")).alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    filled = ranked.where(full).withColumns({"sequence_id": number, "offset": F.coalesce(F.sum("length").over(before), F.lit(0).cast("long"))})

    def leftovers(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", *order], ignore_index=True)
        bins, offsets = best_fit(rows["length"].tolist(), capacity)
        base = rows["worker"] * (1 << (_CLASS_BITS + _BIN_BITS))
        return rows.assign(sequence_id=base + pd.Series(bins, dtype="int64"), offset=pd.Series(offsets, dtype="int64"))

    # Fewer than k pieces of each class k, so a worker has a bounded number of them.
    rest = ranked.where(~full).select("worker", *order, "doc_tokens")
    rest = rest.groupBy("worker").applyInPandas(leftovers, "worker long, id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return filled.select(*columns).unionByName(rest.select(*columns))
