import collections
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from millrace.llm import decontam, quality
from tests.llm.helpers import SCHEMA, edge_documents, empty_documents, lower, prose, shingle_set


def test_stages_as_plain_versions(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], data).cache())
    rows = [{r["doc_id"]: r for r in s.collect()} for s in seen]
    assert all(s.columns == columns for s in seen[1:-1])
    # Quality: what goes is what the classifier rejects.
    model = quality.fit(docs, spark.read.parquet(f"{data}/labels.parquet"))
    kept = {r["doc_id"] for r in docs.select("doc_id", quality.score(model, docs["text"]).alias("s")).collect() if r["s"] >= quality.KEEP_FROM}
    assert set(rows[1]) == kept
    # Lines.
    first = {}
    for i in sorted(rows[1]):
        for line in (texts[i] or "").split("\n"):
            first.setdefault(lower(line.strip(" \t\n\x0b\x0c\r")), i)
    holders = {}
    for i in rows[1]:
        for line in (texts[i] or "").split("\n"):
            holders.setdefault(lower(line.strip(" \t\n\x0b\x0c\r")), set()).add(i)
    for i in rows[1]:
        keys = [(x, lower(x.strip(" \t\n\x0b\x0c\r"))) for x in (texts[i] or "").split("\n")]
        want = "\n".join(x for x, k in keys if len(k) < 10 or len(holders[k]) < 2 or first[k] == i)
        assert rows[2][i]["text"] == want and rows[2][i]["n_chars"] == len(want)
    # Near copies: what stays has no similar document with a smaller id in its component; what goes has a link.
    sets = {i: shingle_set(r["text"]) for i, r in rows[2].items()}

    def linked(a, b):
        common = len(sets[a] & sets[b])
        return common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common)

    gone = set(rows[2]) - set(rows[3])
    assert all(any(linked(i, j) for j in sets if j != i) for i in gone)
    assert not any(linked(a, b) for a in rows[3] for b in rows[3] if a < b)
    # Benchmark.
    items = [decontam.bag(tuple(w.encode() for w in lower(r["text"]).replace(",", " ").replace(".", " ").split())) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    for i, r in rows[3].items():
        whole = decontam.bag(tuple(w.encode() for w in lower(r["text"]).replace(",", " ").replace(".", " ").split()))
        inside = any(sum(min(n, whole[k]) for k, n in item.items()) >= 0.9 * item.total() for item in items)
        assert inside == (i not in rows[4])
    # Packing: every document that is left, whole.
    assert {r["doc_id"] for r in seen[5].collect()} == set(rows[4])
    total = seen[5].groupBy("doc_id").sum("length").collect()
    tokens = {r["doc_id"]: r["doc_tokens"] for r in seen[5].collect()}
    assert all(tokens[r[0]] == r[1] for r in total)


def test_registered():
    q = __spark_entry__.queries()
    assert "pipeline" in q and {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in q}
    assert set(__spark_entry__.oracle_sql()) <= set(q)


STAGES = dict(corpus_pipeline.STAGES)
CLASHES = ("key", "key_", "n_lines", "n_dropped", "__score", "id", "kept", "component_id", "n_shingles", "item_id", "similarity", "start", "length", "worker", "k", "__id", "u")


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_take_edges(spark, data, name):
    """Nulls, empty and very long texts, ties, repeated rows, an empty table, and columns with the names that stages use."""
    docs = edge_documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    docs = docs.unionByName(spark.createDataFrame([(500, "word " * 60_000, "en", "s", 1), (None, None, None, None, None)], SCHEMA))
    docs = docs.withColumns({c: F.lit("x") for c in CLASHES})
    out = STAGES[name](spark, docs, data)
    rows = out.collect()
    if name == "packing":
        assert sum(r["length"] for r in rows if r["start"] == 0) > 0
        assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    else:
        assert out.columns == docs.columns
        assert all(r[c] == "x" for r in rows for c in CLASHES)
        ids = collections.Counter(r["doc_id"] for r in docs.select("doc_id").collect())
        kept = collections.Counter(r["doc_id"] for r in rows)
        assert kept <= ids
        if name == "line_dedup":
            assert kept == ids
        if name == "near_dedup":
            assert {1, 4, 5, 6, 7, 10, 12, 13, 100, 500} <= set(kept) and not {3, 11, 101} & set(kept)
        if name == "decontamination":
            assert kept == ids
    assert STAGES[name](spark, empty_documents(spark), data).count() == 0


def test_documents_without_id_are_dropped_where_others_are(spark, data):
    rng = random.Random(4)
    text = prose(rng, 80)
    item = next(r["text"] for r in spark.read.parquet(f"{data}/benchmark.parquet").collect() if len(r["text"].split()) > 20)
    near = text.split()
    near[40] = "changed"
    rows = [(None, text, "en", "s", 1), (None, " ".join(near), "en", "s", 1), (None, prose(rng, 80), "en", "s", 1), (7, text, "en", "s", 1)]
    rows += [(None, f"{prose(rng, 30)} {item} {prose(rng, 30)}", "en", "s", 1), (None, "short", "en", "s", 1), (None, "short", "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    left = corpus_pipeline.near_stage(spark, docs, data).collect()
    assert len(left) == 4 and sum(r["text"] in (rows[0][1], rows[1][1]) for r in left) == 1
    left = corpus_pipeline.benchmark_stage(spark, docs, data).collect()
    assert collections.Counter(r["text"] for r in left) == collections.Counter(r[1] for r in rows if item not in r[1])
    # A line that two of them hold stays in one.
    shared = [(None, "a line that stands in both\n" + prose(rng, 5), "en", "s", 1) for _ in range(2)]
    left = corpus_pipeline.line_stage(spark, spark.createDataFrame(shared, SCHEMA), data).collect()
    assert sum("stands in both" in r["text"] for r in left) == 1
