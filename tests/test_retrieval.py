import collections
import datetime as dt
import math
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import vector as V
from millrace.operators import keyword_index as K
from millrace.operators import retrieval as R
from millrace.operators import substring_index as B
from millrace.operators import vector_index as VI


def one(spark, col):
    return spark.range(1).select(col).head()[0]


def vec(*x):
    return F.array(*(F.lit(float(v)).cast("float") for v in x))


def test_cosine(spark):
    assert abs(one(spark, V.cosine(vec(1, 2), vec(2, 4))) - 1) < 1e-9
    for a, b in ((vec(0, 0), vec(1, 1)), (vec(1), vec(1, 1)), (F.array().cast("array<float>"), F.array().cast("array<float>"))):
        assert one(spark, V.cosine(a, b)) == 0


def test_jaccard_and_tokens(spark):
    empty = F.array().cast("array<string>")
    assert one(spark, V.jaccard(empty, empty)) == 1 and one(spark, V.jaccard(empty, empty, 0)) == 0 and one(spark, V.jaccard(empty, F.array(F.lit("a")))) == 0
    assert one(spark, V.ascii_tokens(F.lit("한글 A_b a_B 1"))) == ["a_b", "1"]
    assert one(spark, V.word_tokens(F.lit("한글 a-b"))) == ["한글", "a", "b"]
    assert one(spark, V.query_tokens(F.lit("The, of THE market!"))) == ["the", "market"]
    assert V.char_budget(400) == 1400 and V.char_budget(0) == 1 and V.normalised_weights(0, 0) == (0.7, 0.3)
    assert V.auto_compact_threshold(200_000) == 167_000


def test_ages(spark):
    now, t = F.lit("2024-03-01 00:00:00").cast("timestamp"), F.lit("2024-02-29 00:00:00").cast("timestamp")
    ages = {p: one(spark, V.age_days(F.lit(p), t, now)) for p in ("2024-02-20.md", "2026-02-30.md", "MEMORY.md", "sessions/x", "d/2024-02-28.md")}
    assert ages == {"2024-02-20.md": 10.0, "2026-02-30.md": None, "MEMORY.md": None, "sessions/x": 1.0, "d/2024-02-28.md": 2.0}
    assert abs(one(spark, V.decay(F.lit(30.0), 30)) - 0.5) < 1e-9 and one(spark, V.decay(F.lit(9.0), 0)) == 1 and one(spark, V.decay(F.lit(-9.0), 30)) == 1


def test_snippets(spark):
    assert one(spark, V.snippet(F.lit(" a \n b "))) == "a b"
    assert one(spark, V.snippet(F.lit("x" * 800))) == "x" * 700 + "..."


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=12), max_size=12), st.integers(1, 30), st.integers(0, 20))
def test_chunks_cover_all_and_move_on(texts, budget, overlap):
    parts = [(i, i, t) for i, t in enumerate(texts)]
    chunks = R.pack_paragraphs(parts, budget, overlap)
    assert sorted({n for a, b, _ in chunks for n in range(a, b + 1)}) == list(range(len(texts)))
    assert all(x[0] < y[0] and x[1] <= y[1] for x, y in zip(chunks[:-1], chunks[1:], strict=True))
    for a, b, text in chunks:
        assert text == "\n\n".join(texts[a : b + 1])
        assert len(text) <= budget or a == b or len("\n\n".join(texts[a:b])) < budget
    for (_, b, _), (a, _, _) in zip(chunks[:-1], chunks[1:], strict=True):
        assert sum(map(len, texts[a : b + 1])) <= overlap


def test_chunk_lines(spark):
    text = "one\ntwo\n\n \nthree\n\nfour"
    got = R.chunk(spark.createDataFrame([(1, text), (2, " \n\n"), (3, None)], "id int, t string"), "id", "t", 3, 0).collect()
    assert [(r["id"], r["start_line"], r["end_line"], r["content"]) for r in got] == [(1, 1, 2, "one\ntwo"), (1, 5, 5, "three"), (1, 7, 7, "four")]
    para = R.paragraphs(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t").orderBy("ord").collect()
    assert [(r["start_line"], r["end_line"], r["text"]) for r in para] == [(1, 2, "one\ntwo"), (5, 5, "three"), (7, 7, "four")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0.1, 0.5, 0.5, 0.9]), st.sets(st.sampled_from("abcd"))), max_size=8), st.sampled_from([0.0, 0.3, 0.7, 1.0, 2.0]))
def test_mmr_as_a_plain_loop(items, weight):
    scores, sets = [s for s, _ in items], [w for _, w in items]
    lam = min(1, max(0, weight))
    spread = max(scores, default=0) - min(scores, default=0)

    def similar(a, b):
        return 1.0 if not a and not b else 0.0 if not a or not b else len(a & b) / len(a | b)

    left, want = list(range(len(items))), []
    while left:
        def value(i):
            near = max((similar(sets[i], sets[j]) for j in want), default=0.0)
            scaled = (scores[i] - min(scores)) / spread if spread else 1.0
            return (lam * scaled - (1 - lam) * near, scores[i], -i) if lam < 1 else (scores[i], -i)

        best = max(left, key=value)
        left.remove(best)
        want.append(best)
    assert R.mmr_order(list(range(len(items))), scores, sets, weight) == want


def test_hybrid_sources_and_weights(spark):
    v = spark.createDataFrame([(1, 10, 0.9), (1, 11, -0.2), (2, 10, 0.5)], "query_id long, chunk_id long, score double")
    k = spark.createDataFrame([(1, 11, 1.0), (1, 12, 1.0), (3, 10, 1.0)], "query_id long, chunk_id long, score double")
    got = {(r["query_id"], r["chunk_id"]): (round(r["score"], 3), r["source"]) for r in R.merge_scores(v, k).collect()}
    assert got == {(1, 10): (0.63, "vector"), (1, 11): (0.16, "keyword"), (1, 12): (0.3, "keyword"), (2, 10): (0.5, "vector"), (3, 10): (1.0, "keyword")}


def test_keyword_search_needs_all_words(spark):
    c = spark.createDataFrame([(1, "Apple pie"), (2, "apple"), (3, "pie apple pie")], "chunk_id long, content string")
    q = spark.createDataFrame([(1, "apple PIE"), (2, "!!"), (3, "missing")], "query_id long, text string")
    index = R.inverted_index(c)
    assert {(r["query_id"], r["chunk_id"], r["score"]) for r in R.keyword_topk(index, q, 9).collect()} == {(1, 1, 1.0), (1, 3, 1.0)}
    whole = sorted(map(tuple, R.keyword_topk(index, q, 9, "bm25").collect()))
    assert all(0 < r[2] < 1 for r in whole)
    # An index of the queries' terms alone gives the same, with the totals of the corpus.
    assert sorted(map(tuple, R.keyword_topk(R.inverted_index(c, queries=q), q, 9, "bm25", R.corpus_totals(c)).collect())) == whole


def test_index_changes(spark):
    schema = "file_path string, content_hash string, embedding array<float>, updated_at timestamp"
    t0, t1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    old = spark.createDataFrame([("a.md", "h1", [1.0], t0), ("b.md", "h2", [2.0], t0)], schema)
    new = spark.createDataFrame([("c.md", "h1", None, t1), ("d.md", "h3", None, t1)], schema)
    got = {r["content_hash"]: (r["file_path"], r["embedding"], r["updated_at"]) for r in R.upsert_chunks(old, new).collect()}
    assert got == {"h1": ("c.md", [1.0], t0), "h2": ("b.md", [2.0], t0), "h3": ("d.md", None, t1)}
    lossy = {r["content_hash"]: r["embedding"] for r in R.upsert_chunks(old, new, keep_vectors=False, touch=True).collect()}
    assert lossy["h1"] is None
    assert R.checked_fingerprint(old, "p:m", "p", "m").where("embedding is null").count() == 0
    assert R.checked_fingerprint(old, "p:m", "p", "m2").where("embedding is not null").count() == 0
    files = spark.createDataFrame([("a.md", "hello there")], "file_path string, text string")
    h = files.select(V.content_hash(F.col("text"))).head()[0]
    chunks = spark.createDataFrame([("a.md", "stale", None, t0), ("gone.md", "h9", None, t0)], schema)
    cache = spark.createDataFrame([(h, [3.0])], "content_hash string, embedding array<float>")
    out, counts = R.sync_index(chunks, files, cache)
    rows = out.collect()
    assert [(r["file_path"], r["content_hash"], r["embedding"]) for r in rows] == [("a.md", h, [3.0])]
    assert {k: c.head()[0] for k, c in counts.items()} == {"removed": 2, "added": 1, "missing": 0}
    assert [r[0] for r in R.vanished_files(chunks, files).collect()] == ["gone.md"]
    # A chunk that keeps the vector it had lacks none, though the cache does.
    out, counts = R.sync_index(out, files, cache.limit(0))
    assert [r["embedding"] for r in out.collect()] == [[3.0]] and counts["missing"].head()[0] == 0
    assert R.sync_index(out.withColumn("embedding", F.lit(None).cast("array<float>")), files, cache.limit(0))[1]["missing"].head()[0] == 1


def test_searches_take_each_hundredth_row(spark, data):
    """The query set grows with the tables; documents without a vector are searched by their words alone."""
    from millrace.plans.registry import QUERIES

    ids = lambda t, c: {r[0] for r in spark.read.parquet(f"{data}/{t}.parquet").where(f"{c} % 100 = 0").select(c).collect()}
    vectors, documents = ids("embeddings", "vec_id"), ids("documents", "doc_id")
    assert len(vectors) > 3
    got = {n: {r[0] for r in QUERIES[n](spark, data).select("query_id").distinct().collect()} for n in ("vector_topk", "mmr_rerank", "memory_search")}
    assert got["vector_topk"] == got["mmr_rerank"] == vectors and vectors <= got["memory_search"] <= vectors | documents
    q = spark.createDataFrame([(1, None), (2, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert [r["query_id"] for r in R.vector_topk(q.withColumnRenamed("query_id", "chunk_id"), q, 3).collect()] == [2]


def test_upsert_keeps_one_row_a_key(spark):
    old = spark.createDataFrame([("k", 0, 9), ("o", 0, 9), (None, 0, 9)], "key string, v int, ord int")
    new = spark.createDataFrame([("k", 1, 1), ("k", 2, 0), ("n", 3, 0), (None, 4, 0)], "key string, v int, ord int")
    assert {tuple(r)[:2] for r in R.latest_wins(old, new, "key").collect()} == {("k", 2), ("o", 0), ("n", 3), (None, 4)}
    assert {tuple(r)[:2] for r in R.latest_wins(old, new, "key", "ord").collect()} == {("k", 1), ("o", 0), ("n", 3), (None, 4)}


def plain_cosine(a, b):
    na, nb = np.linalg.norm(a), np.linalg.norm(b)
    return float(np.dot(a, b) / (na * nb)) if len(a) == len(b) and na and nb else 0.0


def plain_topk(rows, queries, k, digits):
    ok = lambda v: v is not None and None not in v and np.isfinite(v).all()
    out = {}
    for q, a in queries:
        if ok(a):
            scored = sorted((-round(plain_cosine(a, b), digits) + 0.0, i) for i, b in rows if ok(b))[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


def test_vector_search_is_exact(spark, monkeypatch):
    """Clusters, copies, opposite, zero, odd and other-length vectors; small blocks, so that rings have several."""
    monkeypatch.setattr(VI, "BLOCK_NUMBERS", 8 * 20)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + rng.normal(scale=0.05, size=8)).tolist()) for i in range(1200)]
    rows += [(2000 + i, centres[0].tolist()) for i in range(60)] + [(3000 + i, rng.normal(size=3).tolist()) for i in range(5)] + [(3100, [1.0])]
    rows += [(-5, [0.0] * 8), (-4, []), (-3, None), (-2, [float("nan")] * 8), (-1, [None] * 8), (4000, (-centres[1]).tolist())]
    queries = [(i, v) for i, v in rows if i % 50 == 0 or i < 0 or i >= 3000]
    schema = "{} long, embedding array<double>"
    chunks, asked = spark.createDataFrame(rows, schema.format("chunk_id")).repartition(5), spark.createDataFrame(queries, schema.format("query_id"))
    for k in (1, 12):
        got = {}
        for r in R.vector_topk(chunks, asked, k, digits=5).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["chunk_id"], r["score"]))
        assert got == plain_topk(rows, queries, k, 5)
    # Rows of 12 clusters: a query meets its own and little else.
    assert VI.pairs_left_out(chunks.where("chunk_id between 0 and 1199"), asked.where("query_id between 0 and 1199"), 10) > 0.8


def test_vector_search_of_nothing(spark):
    none = spark.createDataFrame([], "chunk_id long, embedding array<float>")
    one = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert R.vector_topk(none, one, 3).count() == 0
    assert R.vector_topk(one.withColumnRenamed("query_id", "chunk_id"), none.withColumnRenamed("chunk_id", "query_id"), 3).count() == 0
    assert R.vector_topk(one.withColumnRenamed("query_id", "chunk_id"), one, 3).collect() == [(1, 1, 1.0, 1)]


# A stored index of words


def talk(seed, n):
    rng = random.Random(seed)
    common, rare = [f"w{i}" for i in range(6)], [f"r{i}" for i in range(60)]
    return [(i * 7 - 900, " ".join([rng.choice(common) for _ in range(rng.randint(0, 40))] + rng.sample(rare, rng.randint(0, 3)))) for i in range(n)]


def plain_bm25(rows, queries, k, digits):
    docs = [(i, re.findall(r"\w+", (t or "").lower())) for i, t in rows]
    docs = [(i, w) for i, w in docs if w]
    n, mean = len(docs), sum(len(w) for _, w in docs) / max(1, len(docs))
    df = collections.Counter(t for _, w in docs for t in set(w))
    out = {}
    for q, text in queries:
        terms = set(re.findall(r"\w+", (text or "").lower()))
        hits = []
        for i, w in docs:
            if terms and terms <= set(w):
                hits.append((-round(sum(math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in terms), digits), i))
        if hits:
            out[q] = [(i, -s) for s, i in sorted(hits)[:k]]
    return out


def test_stored_index(spark, tmp_path, monkeypatch):
    rows = talk(2, 900) + [(5000, None), (5001, ""), (5002, "!!"), (5003, "Ünï 한글 w1"), (None, "w1 w2")]
    queries = [(1, "w1"), (2, "w1 w2"), (3, "r5"), (4, "r5 w3 w3"), (5, "w0 w1 w2 w3"), (6, "absent w1"), (7, ""), (8, None), (9, "한글"), (10, "R7, w2!"), (11, "r1 r2")]
    chunks = spark.createDataFrame(rows, "chunk_id long, content string").repartition(4)
    asked = spark.createDataFrame(queries, "query_id long, text string")
    path = str(tmp_path / "index")
    K.build_index(chunks, path, block_chunks=16)
    want = plain_bm25([r for r in rows if r[0] is not None], queries, 7, 6)
    K.build_index(chunks.where("chunk_id is not null"), path + "2", block_chunks=16)
    for pushed in (1024, 0):
        monkeypatch.setattr(K, "PUSHED_TERMS", pushed)
        got = {}
        for r in K.bm25_topk(spark, path + "2", asked, 7, digits=6).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["chunk_id"], r["bm25"]))
        assert got == want
    hits = {r["query_id"]: r["score"] for r in K.search(spark, path, asked, 1).collect()}
    assert set(hits) == set(want) and set(hits.values()) == {1.0}
    assert all(0 < r["score"] < 1 for r in K.search(spark, path, asked, 3, "bm25").collect())
    # Blocks that cannot reach the seventh score stay closed.
    opened, held = K.opened_blocks(spark, path, asked.where("query_id = 1"), 3)
    assert opened < held


def test_stored_index_reads_the_terms_of_its_queries(spark, tmp_path):
    path = str(tmp_path / "index")
    K.build_index(spark.createDataFrame(talk(3, 200), "chunk_id long, content string"), path)
    asked = spark.createDataFrame([(1, "r5 w1")], "query_id long, text string")
    plan = K._of_terms(K._table(spark, path, "postings"), K.query_terms(asked))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [" in plan and "(term, [" in plan, plan
    K.build_index(spark.createDataFrame([], "chunk_id long, content string"), path + "0")
    assert K.search(spark, path + "0", asked, 3).count() == 0


def test_substring_index(spark, tmp_path, monkeypatch):
    """Against a scan: terms of all lengths, whatever their case, signs beyond 16 bits, nulls, several blocks, named and joined trigrams."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcAB é한😀 .") for _ in range(n))
    texts = [(i, word(rng.randint(0, 80))) for i in range(400)] + [(1000, None), (None, "abc"), (1001, "x" * 5000 + "needle" + "x" * 5000)]
    terms = [(i, word(rng.randint(1, 6))) for i in range(60)] + [(100, "NEEDLE"), (101, ""), (102, None), (103, "not there at all"), (104, "xxx"), (105, texts[7][1])]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(terms, "query_id long, term string")
    want = sorted((q, i) for q, t in terms if t for i, x in texts if i is not None and x is not None and t.lower() in x.lower())
    monkeypatch.setattr(B, "BLOCK_TEXTS", 50)
    path = str(tmp_path / "index")
    B.build_index(frame, path, "doc_id", "text")
    for named in (1024, 0):
        monkeypatch.setattr(B, "PUSHED", named)
        got = B.search(frame.where("doc_id is not null"), path, asked, "doc_id", "text").collect()
        assert sorted(map(tuple, got)) == want and len(want) > 200
    # Few texts are read for a long term.
    assert B.candidates(spark, path, asked.where("query_id = 100").selectExpr("query_id AS query", "lower(term) AS term")).count() == 1
    B.build_index(frame.limit(0), path + "0", "doc_id", "text")
    assert B.search(frame.limit(0), path + "0", asked, "doc_id", "text").count() == 0


def test_substring_hits_shuffle_no_pairs_whatever_the_number_of_passes(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    texts = [(i, "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 60)))) for i in range(300)]
    terms = [(i, texts[i % 40][1][3 : 3 + n]) for i, n in enumerate([5, 9, 2, 3] * 30)]
    frame, asked = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(terms, "query_id long, term string")
    want = sorted((q, i) for q, t in terms if t for i, x in texts if t in x)
    monkeypatch.setattr(B, "BLOCK_TEXTS", 32)
    path = str(tmp_path / "index")
    B.build_index(frame, path, "doc_id", "text")
    plan = B.candidates(spark, path, asked.where("length(term) > 2").selectExpr("query_id AS query", "term"))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(places" not in plan and "RepartitionByExpression [block" in plan, plan
    for sent, part, rows in ((2 << 20, 512, 1 << 16), (1500, 3, 5)):
        for name, value in (("SENT_SIGNS", sent), ("SLICE", part), ("ROWS", rows)):
            monkeypatch.setattr(B, name, value, raising=False)
        assert sorted(map(tuple, B.search(frame, path, asked, "doc_id", "text").collect())) == want and len(want) > 500


def test_substring_search_scans_texts_once_for_all_terms_and_shuffles_no_hits(spark, tmp_path, monkeypatch):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("ab é😀\0") for _ in range(n))
    texts = [(i, word(rng.randint(0, 90))) for i in range(200)] + [(900, "ab" * 40)]
    terms = [(i, texts[i][1][2 : 2 + n]) for i, n in enumerate([1, 2, 3, 4, 9, 16, 17, 30] * 9)] + [(500 + i, "ab" * 12 + "b" * (i % 2)) for i in range(4)]
    frame, asked = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(terms, "query_id long, term string")
    want = sorted((q, i) for q, t in terms if t for i, x in texts if t in x)
    monkeypatch.setattr(B, "BLOCK_TEXTS", 64)
    monkeypatch.setattr(B, "PART_SIGNS", 300)
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    B.build_index(frame.mapInArrow(counted, frame.schema), f"{tmp_path}/i", "doc_id", "text")
    assert reads.value == len(texts)
    for scan in (0, 10**9):
        monkeypatch.setattr(B, "SCAN", scan)
        hits = B.search(frame, f"{tmp_path}/i", asked, "doc_id", "text")
        assert sorted(map(tuple, hits.collect())) == want and len(want) > 1000
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        hits = B.search(frame, f"{tmp_path}/i", asked, "doc_id", "text")
        plan = hits._jdf.queryExecution().executedPlan().toString()
        hit_side = plan[: plan.index("MapInArrow")]
        assert "SortMergeJoin" not in hit_side and "contains" not in plan.lower() and "NestedLoop" not in plan, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    # Texts that are not among those given are in no hits.
    part = frame.where("doc_id % 2 = 0")
    assert sorted(map(tuple, B.search(part, f"{tmp_path}/i", asked, "doc_id", "text").collect())) == [(q, i) for q, i in want if i % 2 == 0]


def test_heads_of_terms_are_found_as_by_a_plain_look():
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abé😀") for _ in range(n))
    texts = [word(rng.randint(0, 40)) for _ in range(80)] + [None, ""]
    terms = sorted({word(rng.randint(4, 20)) for _ in range(60)} | {t[3:9] for t in texts if t and len(t) > 9})
    heads = B._Heads(terms)
    got = set(heads.found(texts).tolist())
    assert got == {int(h) * len(texts) + i for h, t in zip(heads.of, terms, strict=True) for i, x in enumerate(texts) if x and t[: B.WINDOW] in x} and len(got) > 50


def test_packed_places():
    rng = np.random.default_rng(0)
    for size, n in ((1, 1), (4096, 3), (4096, 300), (4096, 4096), (17, 5)):
        places = np.sort(rng.choice(size, n, replace=False))
        data = B.packed(places, size)
        assert B.unpacked(data).tolist() == places.tolist() and len(data) <= 1 + min(2 * n, -(-size // 8)) + 1


def test_keyword_hits_shuffle_no_pairs_and_need_not_know_how_queries_are_sent(spark, tmp_path, monkeypatch):
    texts = [f"w{i % 3} w{i % 5} w{i % 7} w{i % 11}" for i in range(300)]
    K.build_index(spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string"), f"{tmp_path}/i", block_chunks=16)
    asked = spark.createDataFrame([(0, "w1"), (1, "w1 w2"), (2, "w2 W1"), (3, "w4 w6 w10"), (4, "w1 missing"), (5, ""), (6, None)], "query_id long, text string")
    want = sorted((q, i) for q, ws in enumerate([{"w1"}, {"w1", "w2"}, {"w1", "w2"}, {"w4", "w6", "w10"}]) for i, t in enumerate(texts) if ws <= set(t.split()))
    every = K.hits(spark, f"{tmp_path}/i", asked)
    assert sorted((r["query_id"], r["chunk_id"]) for r in every.collect()) == want
    plan = every._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan and "RepartitionByExpression [block" in plan
    best = lambda: sorted(map(tuple, K.bm25_topk(spark, f"{tmp_path}/i", asked, 4, digits=6).select("query_id", "rank", "chunk_id", "bm25").collect()))
    once = best()
    scores = {(r["query_id"], r["chunk_id"]): round(r["bm25"], 6) for r in every.collect()}
    for q in range(4):
        ranked = sorted((-s, c) for (x, c), s in scores.items() if x == q)[:4]
        assert [(c, s) for x, _, c, s in once if x == q] == [(c, -s) for s, c in ranked]
    monkeypatch.setattr(K, "SENT_WORDS", 2)
    assert best() == once


def test_hits_are_merged_with_vectors_without_a_shuffle_of_hits(spark, tmp_path, monkeypatch):
    texts = [f"w{i % 3} w{i % 5} w{i % 7} w{i % 11}" for i in range(300)]
    K.build_index(spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string"), f"{tmp_path}/i", block_chunks=16)
    asked = spark.createDataFrame([(0, "w1"), (1, "w1 w2"), (2, "w2 W1"), (3, "w4 w6 w10"), (4, "w1 missing"), (5, ""), (6, "w0"), (9, "w1")], "query_id long, text string")
    rng = random.Random(4)
    # Query 6 and 9 have no vectors, 4 and 5 no hits, 7 is no keyword query; scores of 0 and below, chunks beyond the table.
    rows = [(q, c, round(rng.uniform(-0.5, 1), 5)) for q in (0, 1, 2, 3, 4, 5, 7) for c in rng.sample(range(320), 12)] + [(0, 1, 0.0), (1, 22, 0.9)]
    near = spark.createDataFrame(list({r[:2]: r for r in rows}.values()), "query_id long, chunk_id long, score double")
    want = sorted(map(tuple, R.merge_scores(near, K.hits(spark, f"{tmp_path}/i", asked).select("query_id", "chunk_id", F.lit(1.0).alias("score"))).collect()))
    assert len(want) > 200 and {r[3] for r in want} == {"both", "vector", "keyword"}
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for sent in (K.SENT_ROWS, 40):
            monkeypatch.setattr(K, "SENT_ROWS", sent)
            got = K.merged_with_vectors(spark, f"{tmp_path}/i", asked, near)
            assert sorted(map(tuple, got.collect())) == want
            # Above the tasks that find hits are joins with what was sent to them, and nothing else.
            node, above = got._jdf.queryExecution().optimizedPlan().toString().splitlines(), []
            for i, line in enumerate(node):
                if "MapInArrow" in line:
                    depth, j = len(line) - len(line.lstrip(" :+-")), i
                    while j >= 0 and "Union" not in node[j]:
                        if len(node[j]) - len(node[j].lstrip(" :+-")) < depth:
                            above.append(node[j].strip(" :+-"))
                            depth = len(node[j]) - len(node[j].lstrip(" :+-"))
                        j -= 1
            assert above and all(x.startswith(("Project", "Filter")) or "rightHint=(strategy=broadcast)" in x for x in above), above
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_postings_are_packed_before_the_shuffle(spark, tmp_path):
    """A row of the shuffle has a block's terms of one bucket; unpacked, terms, places, lengths and bounds are those of the texts."""
    texts = [(i, f"w{i % 3} w{i % 3} é{i % 7} only{i}") for i in range(40)] + [(90, "...")]
    chunks = spark.createDataFrame(texts, "chunk_id long, content string")
    words = chunks.select(F.col("chunk_id").alias("id"), V.word_tokens(F.lower("content")).alias("ws")).select("id", F.size("ws").alias("len"), "ws").where("len > 0")
    packed = words.coalesce(1).mapInArrow(K._packed_postings(1024, 1 << 20), "bucket int, data binary")
    assert packed.count() <= K.BUCKETS
    got = {r["term"]: r for r in packed.mapInArrow(K._unpacked_postings(4.0), K._TABLES["postings"]).collect()}
    assert len(got) == 3 + 7 + 40 and all(r["n"] == len(r["entries"]) for r in got.values())
    assert [tuple(e) for e in got["w1"]["entries"]] == [(i, 2, 4) for i in range(1, 40, 3)] and abs(got["w1"]["top"] - 4.4 / 3.2) < 1e-12
    named = spark.createDataFrame([(t,) for t in got], "term string").select("term", K._bucket(F.col("term")).alias("b")).collect()
    assert all(got[r["term"]]["bucket"] == r["b"] for r in named)
