"""The registered queries over the smallest tables: against SQL where there is some, else against plain versions."""

import collections
import zlib

import duckdb
import numpy as np
import pytest

from millrace.llm import decontam, licenses, packing
from millrace.llm import queries as Q
from tests.llm.helpers import lower, shingle_set
from tests.llm.test_documents import components_of, plain_words


@pytest.fixture(scope="module")
def texts(spark, data):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_against_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("conversations", "pages", "documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df, want = Q.QUERIES[name](spark, data), con.sql(Q.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [list(want.columns).index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)


def test_op4(spark, data, texts):
    got = sorted(map(tuple, Q.op4_near_dedup(spark, data).collect()))
    assert got == sorted(components_of([(i, t) for i, t in texts.items()], 85))
    assert all(n == len(shingle_set(texts[i])) for i, n, _, _ in got)


def test_op5(spark, data, texts):
    rows = Q.op5_shard(spark, data).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts.items())
    counts = collections.Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n)) for s, n in counts.items())
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}


def test_op6(spark, data, texts):
    items = [(r["item_id"], plain_words(r["text"])) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    want = set()
    for i, t in texts.items():
        w = plain_words(t)
        have = set(zip(*(w[k:] for k in range(5)), strict=False))
        for j, x in items:
            bag = decontam.bag(x)
            n = min(len(x), len(w))
            if not have.isdisjoint(bag):
                if max(decontam.weighted_similarity(decontam.bag(w[s : s + n]), bag) for s in range(len(w) - n + 1)) >= 0.8:
                    want.add((i, j))
    got = Q.op6_decontaminate(spark, data).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want) > 0


def test_op7(spark, data, texts):
    known = {n: lower(" ".join(w.decode() for w in licenses.Templates({n: t}).words[0])) for n, t in licenses.TEMPLATES.items()}
    want = {(i, n) for i, t in texts.items() for n, x in known.items() if f" {x} " in f" {' '.join(w.decode() for w in plain_words(t))} "}
    got = {(r["doc_id"], r["license"]) for r in Q.op7_license_scan(spark, data).collect()}
    assert got == want and want


def test_op9(spark, data, texts):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    rows = Q.op9_quality(spark, data).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    # Only on rows that were not learnt from; those that were tell nothing of it.
    seen = [r for r in rows if r["doc_id"] in labels and r["held_out"]]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in seen) >= 0.9 * len(seen) > 0


def test_op10(spark, data, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(Q.tokenizer_path())
    rows = Q.op10_pack(spark, data).collect()
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in texts.items()}
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        x = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(x) and r["ids_crc32"] == zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes())
    for i, x in ids.items():
        assert sorted((r["start"], r["length"]) for r in by[i])[0][0] == 0 and sum(r["length"] for r in by[i]) == len(x)
    for pieces in sequences.values():
        ends = [o + n for o, n in sorted(pieces)]
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= packing.CAPACITY
    assert sum(map(len, ids.values())) >= 0.97 * packing.CAPACITY * len(sequences)
