"""Neighbour search: curves, edges, and recall against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import ann
from millrace.llm import queries as Q

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, every=100, k=10):
    rows = sorted({(i, tuple(np.float32(x) for x in v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)})
    out = {}
    for q, a in rows:
        if q % every == 0:
            near = {}
            for i, b in rows:
                if i != q and len(a) == len(b):
                    d = float(np.sqrt(((np.array(a, float) - np.array(b, float)) ** 2).sum()))
                    near[i] = min(d, near.get(i, d))
            out[q] = sorted((d, i) for i, d in near.items())[:k]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    assert all(sorted(x) == list(range(1, len(x) + 1)) for x in out.values())
    return {q: [x[i] for i in sorted(x)] for q, x in out.items()}


def same(a, b):
    assert {q: [i for _, i in x] for q, x in a.items()} == {q: [i for _, i in x] for q, x in b.items() if x}
    assert all(abs(s - t) < 1e-12 for q in a for (s, _), (t, _) in zip(a[q], b[q], strict=True))


def test_edges(spark):
    """Vectors that take no part, other lengths, copies by the hundred, repeated rows and ids; few rows, so windows take in all."""
    rng = np.random.default_rng(5)
    vector = lambda n=6: [float(np.float32(x)) for x in rng.normal(size=n)]
    one = vector()
    rows = [(i, vector()) for i in range(0, 500, 7)] + [(i, one) for i in range(1000, 1300)] + [(2000 + i, vector(3)) for i in range(0, 101, 50)]
    rows += [(100, vector()), (3000, None), (3100, []), (3200, [0.0] * 6), (3300, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (3400, [float("nan")] * 6), (3500, [float("inf")] + one[1:]), (None, one)]
    rows += [(4000, one), (4000, one), (4100, one), (4100, vector()), (4200, vector(9)), (-100, vector()), (5000, [-0.0] + one[1:]), (5100, [0.0] + one[1:])]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("id", "vector", "entry", "lane", "rank", "label")}).repartition(5)
    want = brute(rows)
    # An id with two vectors is two queries; the plain version has one list for it.
    got = ann.neighbours(frame).where("query_id not in (100, 4100)")
    same(found(got), {q: x for q, x in want.items() if q not in (100, 4100)})
    assert ann.neighbours(frame).where("query_id = 4100").count() == 20
    assert ann.neighbours(spark.createDataFrame([], SCHEMA)).count() == 0
    assert ann.neighbours(spark.createDataFrame([(0, [1.0])], SCHEMA)).count() == 0


def test_windows_follow_the_vectors(spark, monkeypatch):
    """Vectors near a curved sheet need narrow windows and keep their recall; in random directions the windows widen until they have it."""
    monkeypatch.setattr(ann, "LEAST_WINDOW", 8)
    monkeypatch.setattr(ann, "BLOCK_NUMBERS", 16 * 24)
    rng = np.random.default_rng(1)
    at = rng.random((6000, 2))
    sheet = np.concatenate([np.cos(at * 3), np.sin(at * 3), np.cos(at * 2 + 1), rng.normal(scale=1e-3, size=(6000, 18))], axis=1)
    windows = {}
    for name, vectors in (("sheet", sheet), ("random", rng.normal(size=(3000, 24)))):
        rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
        fit = ann.fit_windows
        monkeypatch.setattr(ann, "fit_windows", lambda *a, name=name: windows.setdefault(name, fit(*a)))
        got = found(ann.neighbours(spark.createDataFrame(rows, SCHEMA)))
        monkeypatch.setattr(ann, "fit_windows", fit)
        want = brute(rows)
        hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
        assert set(got) == set(want) and all(len(x) == 10 for x in got.values()) and hits >= 0.9 * 10 * len(want)
    assert windows["sheet"][24] < 300 < windows["random"][24]


def test_hilbert_is_one_path_through_all_cells():
    for dims, bits in ((2, 4), (3, 3), (5, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        place = ann.hilbert(cells, bits)
        assert sorted(place) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("k", [1, 3, 50])
def test_nearest_breaks_ties_by_id(k):
    rows = np.array([[1.0, 0], [0, 1.0], [1.0, 0], [5, 5]])
    ids = [np.array([9, 11]), np.array([3]), np.array([4]), np.array([1])]
    ((got, scores, at),) = ann.nearest(np.array([[0.0, 0.0]]), rows, ids, k)
    assert got.tolist() == [3, 4, 9, 11, 1][:k] and at.tolist() == [1, 2, 0, 0, 3][:k]


def test_op13(spark, data):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    same(found(Q.op13_neighbours(spark, data)), brute(rows))
