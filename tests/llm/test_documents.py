"""Operators over documents, held against plain versions on rows with every kind of edge."""

import collections
import hashlib
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import components as graph
from millrace.llm import decontam, exact, licenses, lines, neardup, packing, quality, sharding
from millrace.llm import textkernel as tk
from millrace.llm.common import materialize
from millrace.llm.queries import tokenizer_path
from tests.llm.helpers import SCHEMA, edge_documents, edge_rows, empty_documents, lower, prose, shingle_set, words_of


# Exact dedup


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(spark, keep):
    groups = collections.defaultdict(list)
    for r in edge_rows():
        groups[lower(r[1])].append(r[0])
    order = lambda i: -(2**63) if i is None else i
    want = []
    for text, ids in groups.items():
        best = (min if keep == "smallest" else max)(ids, key=order)
        want += [(i, best, len(ids), i == best, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    for least, rows in ((3, 1 << 22), (0, 1), (0, 1 << 22)):
        got = exact.exact_dedup(edge_documents(spark), keep=keep, least_levels=least, run_rows=rows).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert exact.exact_dedup(empty_documents(spark)).count() == 0


def test_exact_dedup_merges_sorted_runs(spark):
    plan = exact.exact_dedup(edge_documents(spark))._jdf.queryExecution().executedPlan().toString()
    # Two rounds of eight runs, each in order before and after its exchange.
    assert plan.count("SortAggregate(") == 4 and "HashAggregate(" not in plan


# Line dedup


@pytest.mark.parametrize("min_docs", [2, 3])
def test_line_dedup(spark, min_docs):
    def key(line):
        return lower(line.strip(" \t\n\x0b\x0c\r"))

    order = lambda i: -(2**63) if i is None else i
    holders = collections.defaultdict(set)
    for r in edge_rows():
        for line in (r[1] or "").split("\n"):
            holders[key(line)].add(order(r[0]))
    want = []
    for r in edge_rows():
        parts = (r[1] or "").split("\n")
        kept = [x for x in parts if len(key(x)) < 10 or len(holders[key(x)]) < min_docs or min(holders[key(x)]) == order(r[0])]
        want.append((r[0], "\n".join(kept), len(parts), len(parts) - len(kept)))
    out = lines.line_dedup(edge_documents(spark), min_docs=min_docs)
    assert set(edge_documents(spark).columns) < set(out.columns)
    assert sorted(map(tuple, out.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=str) == sorted(want, key=str)
    assert lines.line_dedup(empty_documents(spark)).count() == 0


# Near-dedup


def test_components_make_a_round_only_where_edges_are_not_flat_and_send_no_side_to_the_driver(spark, monkeypatch):
    """Each round is planned and kept by the driver; a broadcast's rows pass through it."""
    made = []
    keep = lambda df, name: made.append(df) or materialize(df, name)
    monkeypatch.setattr(graph, "materialize", keep)
    found = lambda edges: dict(map(tuple, graph.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert found([(5, 2), (2, 7), (9, 8), (8, 8), (2, 5)]) == {2: 2, 5: 2, 7: 2, 8: 8, 9: 8} and len(made) == 1
    assert found([]) == {} and len(made) == 2
    chain = [(i, i + 1) for i in range(40)]
    assert found(chain + [(60, 50), (60, 51)]) == dict.fromkeys(range(41), 0) | dict.fromkeys((50, 51, 60), 50)
    rounds = [df._jdf.queryExecution().executedPlan() for df in made[3:]]
    for plan in rounds:
        plan.executeCollect()
        assert "Broadcast" not in plan.toString() and "SortMergeJoin" in plan.toString()
    assert rounds


def components_of(rows, percent):
    order = lambda i: -(2**63) if i is None else i
    sets = [(order(r[0]), shingle_set(r[1])) for r in rows]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            common = len(a & b)
            if common and 100 * common >= percent * (len(a) + len(b) - common):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    real = lambda i: None if i == -(2**63) else i
    return [(real(i), len(s), real(find(i)), i == find(i)) for i, s in sets]


@pytest.mark.parametrize("percent", [85, 80])
def test_near_dedup_edges(spark, percent):
    got = neardup.near_dedup(edge_documents(spark), percent=percent).collect()
    assert sorted(map(tuple, got), key=str) == sorted(components_of(edge_rows(), percent), key=str)
    assert neardup.near_dedup(empty_documents(spark)).count() == 0


def test_near_dedup_chains_and_hubs(spark):
    """Copies that are linked with an original only, and chains whose ends are far apart."""
    rng = random.Random(9)
    rows = []
    for g in range(4):
        original = prose(rng, 150).split()
        for k in range(25):
            copy = list(original)
            for _ in range(2 if k else 0):
                copy[rng.randrange(len(copy))] = f"w{rng.random()}"
            rows.append((1000 * g + 500 - 7 * k, " ".join(copy), "en", "s", 1))
        chain = prose(rng, 90).split()
        for k in range(12):
            chain[(7 * k) % 90] = f"c{g}{k}"
            rows.append((1000 * g + 900 + k, " ".join(chain), "en", "s", 1))
    rows += [(9000 + k, prose(rng, rng.randint(1, 60)), "en", "s", 1) for k in range(60)]
    got = neardup.near_dedup(spark.createDataFrame(rows, SCHEMA), percent=85).collect()
    assert sorted(map(tuple, got)) == sorted(components_of(rows, 85))


def test_near_dedup_of_a_group_most_of_which_its_centre_misses(spark, monkeypatch):
    """A large group in many blocks and tasks: texts that keep half of one original in pairs of near copies."""
    for name, value in (("BLOCK_ROWS", 5), ("TASK_PAIRS", 3)):
        monkeypatch.setattr(neardup, name, value)
    rng = random.Random(19)
    original, rows = prose(rng, 120).split(), []
    for k in range(60):
        own = [w if i % 3 else f"g{k}x{i}" for i, w in enumerate(original)] if k % 2 else original[: 60 + k] + prose(rng, 10).split()
        for j in range(3):
            copy = list(own)
            copy[7 + 11 * j] = f"c{k}{j}"
            rows.append((3 * k + j, " ".join(copy), "en", "s", 1))
    for percent in (85, 80):
        got = neardup.near_dedup(spark.createDataFrame(rows, SCHEMA), percent=percent).collect()
        assert sorted(map(tuple, got)) == sorted(components_of(rows, percent))


@pytest.mark.parametrize("percent", [80, 85])
def test_pairs_at_the_threshold_share_a_band_and_pass_the_sketch_filter(percent):
    """Random sets of 13 to 100 shingles whose similarity is at the threshold or just over it."""
    rng = np.random.default_rng(percent)
    bands, rows, lost, filtered, n = 28, 5, 0, 0, 4000
    for _ in range(n // 200):
        values, sizes, least = [], [], []
        for _ in range(200):
            union = int(rng.integers(15, 110))
            common = -(-union * percent // 100)
            only = union - common
            left = int(rng.integers(0, only + 1))
            x = rng.integers(0, 2**64, union, dtype=np.uint64)
            a, b = x[: common + left], np.concatenate([x[:common], x[common + left :]])
            values += [np.sort(a), np.sort(b)]
            sizes += [len(a), len(b)]
            least.append(min(len(a), len(b)))
        keys, low = neardup.sketches(np.concatenate(values), np.concatenate([[0], np.cumsum(sizes)]), bands, rows)
        lost += int((~(keys[::2] == keys[1::2]).any(axis=1)).sum())
        filtered += int(((low[::2] == low[1::2]).sum(axis=1) < neardup._least(np.array(least), percent, bands * rows)).sum())
    # At 0.8 itself 1.5e-5 of all pairs are expected to share no band.
    assert lost <= 1 and filtered == 0


def test_densification_fills_and_agrees():
    rng = np.random.default_rng(1)
    sketch, filled = rng.integers(1, 2**63, (50, 140)).astype(np.uint64), rng.random((50, 140)) < 0.05
    filled[0], sketch[~filled] = False, 0
    neardup.densify(sketch, filled)
    assert (sketch[0] == 0).all() and (sketch[1:][filled[1:].any(axis=1)] > 0).all()


# Sharding


def test_shards(spark):
    rows = edge_rows()
    got = sharding.shard(edge_documents(spark), shards=4, buckets=3).collect()
    want = collections.Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    counts = collections.Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    for s, k in counts.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(k))
    for r in got:  # shard and slot follow from the number alone
        p = int(sharding.feistel(np.array([r["row_number"]]), len(rows))[0])
        assert (p % 4, p // 4) == (r["shard"], r["slot"])
    again = sharding.shard(edge_documents(spark).repartition(5), shards=4, buckets=3).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)
    assert sharding.shard(empty_documents(spark)).count() == 0


def test_shards_of_a_row_that_repeats(spark):
    df = spark.range(200_000).select((F.col("id") % 3).alias("doc_id"), F.lit("same").alias("text"))
    got = sharding.shard(df, shards=4, buckets=1, bucket_rows=1).groupBy("shard").agg(F.count("*"), F.count_distinct("slot"), F.max("slot")).collect()
    assert sorted(map(tuple, got)) == [(s, 50_000, 50_000, 49_999) for s in range(4)]


@pytest.mark.parametrize("n", [1, 2, 3, 1000, 4097])
def test_feistel_is_a_permutation(n):
    p = sharding.feistel(np.arange(n), n, seed=5)
    assert sorted(p.tolist()) == list(range(n))
    assert (sharding.feistel_inverse(p, n, seed=5) == np.arange(n)).all()


# Decontamination


def plain_words(text):
    import re

    return tuple(w.encode() for w in re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", lower(text)))


def test_decontamination(spark):
    rng = random.Random(5)
    items = [(i, prose(rng, rng.randint(6, 40))) for i in range(30)] + [(30, None), (31, " .,! "), (32, "just three words"), (33, "one")]
    docs = []
    for d in range(60):
        words = prose(rng, rng.randint(3, 200)).split()
        if d % 3 == 0:
            item = items[d % 30][1].split()
            if d % 2:
                item[rng.randrange(len(item))] = "other"
            at = rng.randrange(len(words))
            words[at:at] = [w.upper() + "," if d % 4 else w for w in item]
        docs.append((d, " ".join(words), "en", "s", 1))
    docs += [(100, items[3][1], "en", "s", 1), (100, items[3][1], "en", "s", 1), (101, " ".join(items[4][1].split()[:-1]), "en", "s", 1), (102, "so just, THREE words here", "en", "s", 1)]
    docs += [(103, None, None, None, None), (104, "", "", "", 0), (None, items[5][1], "en", "s", 1), (105, "two words", "en", "s", 1)]
    want = []
    for d, t, *_ in docs:
        w = plain_words(t)
        for i, x in items:
            item = decontam.bag(plain_words(x))
            n = min(len(plain_words(x)), len(w))
            if item and n and len(item and next(iter(item))) <= n:
                best = max((decontam.weighted_similarity(decontam.bag(w[s : s + n], len(next(iter(item)))), item), -s) for s in range(len(w) - n + 1))
                if best[0] >= 0.8:
                    want.append((d, i, round(best[0], 9), -best[1], n))
    df = spark.createDataFrame(docs, SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (10**6, 100):
        got = decontam.decontaminate(df, bench, block_words=block).collect()
        assert sorted(((r[0], r[1], round(r[2], 9), r[3], r[4]) for r in got), key=str) == sorted(want, key=str)
    assert decontam.decontaminate(empty_documents(spark), bench).count() == 0
    assert decontam.decontaminate(df, bench.limit(0)).count() == 0


def test_hamming_index_finds_all_within_radius():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 2**63, 200).astype(np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in rng.integers(0, 25, 400)], np.uint64)
    query = prints[rng.integers(0, 200, 400)] ^ flips
    at, item = decontam.HammingIndex(prints).search(query)
    near = np.bitwise_count(query[:, None] ^ prints[None]) <= decontam.RADIUS
    want = sorted(zip(*(x.tolist() for x in np.nonzero(near)), strict=True))
    assert sorted(zip(at.tolist(), item.tolist(), strict=True)) == want
    # However the four bits are shared out between index and query; and by groups.
    groups = rng.integers(1, 2**31, 3)[rng.integers(0, 3, 200)]
    for most in (0, 200 * 17, 200 * 137, 200 * 697):
        index = decontam.HammingIndex(prints, groups, most)
        assert len(index.lists[0][0]) <= max(most, 200)
        found = []
        for g in np.unique(groups).tolist():
            at, item = index.search(query, g)
            assert (groups[item] == g).all()
            found += zip(at.tolist(), item.tolist(), strict=True)
        assert sorted(found) == want


def test_decontamination_of_long_texts_among_many_items(spark):
    """One pass, an index of bounded size, and columns with clashing names."""
    rng = random.Random(15)
    vocabulary = [prose(rng, 1) for _ in range(4000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30)))) for i in range(4000)]
    long = [rng.choice(vocabulary) for _ in range(60_000)]
    planted = [i for i, t in items if len(t.split()) > 12][:40]
    for k, i in enumerate(planted):
        long[1000 * k : 1000 * k] = items[i][1].split()
    df = spark.createDataFrame([(1, " ".join(long))], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("id", "item_id", "similarity", "start_word", "i", "t")})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("i", F.lit("x"))
    out = decontam.decontaminate(df, bench)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {r["item_id"]: r["similarity"] for r in out.collect()}
    assert {i for i in planted if got.get(i) == 1.0} == set(planted)
    assert all(i in planted or len(items[i][1].split()) <= 5 for i in got)


def test_decontamination_by_items_of_many_lengths(spark, monkeypatch):
    """Two thousand lengths, windows over the edges of the pieces that sums are made for; as exact as pieces of one size."""
    rng = random.Random(21)
    vocabulary = [prose(rng, 1) for _ in range(3000)]
    items = [(n, " ".join(rng.choice(vocabulary) for _ in range(n))) for n in range(1, 2001)]
    texts = []
    for d in range(6):
        words = [rng.choice(vocabulary) for _ in range(3000)]
        for n in rng.sample(range(6, 900), 4):
            item = items[n - 1][1].split()
            item[rng.randrange(n)] = "other"
            at = rng.randrange(len(words))
            words[at:at] = item
        texts.append(" ".join(words))
    bench = decontam.Benchmark([i for i, _ in items], [t for _, t in items])
    whole = sorted(decontam.find(pa.array(texts), bench, 0.8))
    assert len({i for _, i, *_ in whole if i > 29}) >= 15
    monkeypatch.setattr(decontam, "STEP", 137)
    assert sorted(decontam.find(pa.array(texts), bench, 0.8)) == whole


def test_line_dedup_of_a_long_document(spark):
    """Time in proportion to the lines: a hundred thousand of them, some dropped."""
    lines_of = [f"line number {i} of a long document" for i in range(100_000)]
    rows = [(1, lines_of[7]), (2, "\n".join(lines_of))]
    began = time.time()
    out = lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 2").head()
    assert time.time() - began < 60
    assert out["text"] == "\n".join(lines_of[:7] + lines_of[8:]) and (out["n_lines"], out["n_dropped"]) == (100_000, 1)


def test_near_dedup_emits_a_forest(spark):
    """Members that are all linked with each other, and not with their group's centre, give fewer links than there are of them."""
    rng = random.Random(4)
    centre = prose(rng, 200).split()
    other = centre[:110] + prose(rng, 90).split()
    rows = [(0, " ".join(centre), 0, 0)]
    for k in range(1, 61):
        copy = list(other)
        copy[3 * k] = f"x{k}"
        rows.append((k, " ".join(copy), k, 0))
    sketched = neardup.sketch_documents(spark.createDataFrame(rows, "id long, text string, label long, main long").select("id", "text"), 28, 5, 5)
    group = spark.createDataFrame(rows, "id long, text string, label long, main long").join(sketched.select("id", "low"), "id")
    group = group.withColumns({"centre": F.lit(0).cast("long"), "size": F.octet_length("text").cast("long")}).where("id > 0")
    found = neardup._between_components(group, 80, 5, 140).collect()
    assert len(found) == 59
    assert len({c for _, _, c, _ in components_of([(r[0], r[1]) for r in rows[1:]], 80)}) == 1


# Licenses


def test_licenses(spark):
    rng = random.Random(6)
    mit, gpl = licenses.TEMPLATES["mit-text"], licenses.TEMPLATES["gpl-3.0"]
    broken = mit.split()
    broken[10:12], broken[50:50] = ["strange"], ["inserted", "words"]
    docs = [
        (1, f"{prose(rng, 50)}\n{gpl.upper()}.\n{prose(rng, 50)}"),
        (2, f"{prose(rng, 20)} {' '.join(broken)} {prose(rng, 20)}"),
        (3, "\n".join([f"{gpl} {prose(rng, 60)}"] * 3)),
        (4, "Licensed under CC BY-NC 4.0"),
        (5, " ".join(mit.split()[: len(mit.split()) // 2])),
        (6, prose(rng, 500)),
        (7, None),
        (8, ""),
        (None, "Released under the MIT License. Licensed under the Apache License, Version 2.0."),
    ]
    got = licenses.license_scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["license"], r["regions"]) for r in got), key=str) == sorted(
        [(1, "gpl-3.0", 1), (2, "mit-text", 1), (3, "gpl-3.0", 3), (4, "cc-by-nc-4.0", 1), (None, "mit", 1), (None, "apache-2.0", 1)], key=str
    )
    assert licenses.license_scan(empty_documents(spark)).count() == 0


def edited(rng, words, threshold):
    """The words, as many left out and strange ones put in as the threshold allows, apart from each other where there is room."""
    n = len(words)
    missing = max(m for m in range(n + 1) if m == 0 or (n - m) / n >= threshold)
    strange = int(n / threshold) - (n - missing)
    places = rng.sample(range(1, n - 1), min(n - 2, missing + strange))
    gone, after = set(places[:missing]), set(places[missing:])
    return [x for i, w in enumerate(words) for x in ([] if i in gone else [w]) + ([f"strange{i}"] if i in after else [])]


def test_licenses_are_not_lost_before_alignment():
    """Edited notices, against alignment of the whole text."""
    rng = random.Random(8)
    known = licenses.Templates(licenses.TEMPLATES)
    texts, want = ["This work is hereby licensed under GNU General Public License, version 3"], {(0, "gpl-3.0")}
    for name, words in zip(known.names, known.words, strict=True):
        for _ in range(40):
            text = prose(rng, 30).split() + edited(rng, [w.decode() for w in words], 0.9) + prose(rng, 30).split()
            places = [q for _, q in licenses.patience(words, [w.encode() for w in text])]
            if licenses._densest(places, len(words), int(len(words) / 0.9))[0] >= 0.9:
                want.add((len(texts), name))
            texts.append(" ".join(text))
    assert len(want) > 300
    assert want <= {(t, name) for t, name, *_ in licenses.scan(pa.array(texts), known, 0.9)}


@pytest.mark.parametrize("between", [0, 1, 2, 3, 8, 40])
def test_licenses_next_to_each_other(between):
    rng = random.Random(9)
    known = licenses.Templates(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES.items():
        gap = f" {prose(rng, between)} " if between else " "
        row = f"{prose(rng, 5)} {gap.join([text] * 4)} {prose(rng, 5)}"
        got = {r[1]: r[2:] for r in licenses.scan(pa.array([row]), known, 0.9)}
        n = len(known.words[known.names.index(name)])
        assert got[name] == (1.0, 5, n, 4), (name, got[name])


def test_patience_is_a_common_subsequence():
    rng = random.Random(7)
    for _ in range(300):
        a, b = ([rng.randrange(12) for _ in range(rng.randint(0, 15))] for _ in range(2))
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs[:-1], pairs[1:], strict=True))
    assert len(licenses.patience(list(range(30)), list(range(30)))) == 30
    assert [x for x in licenses.longest_increasing([3, 1, 2, 5, 4])] in ([1, 2, 4], [1, 2, 3])


# Quality


def test_quality_learns_and_scores_all(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(700):
        good = rng.random() < 0.7
        text = prose(rng, rng.randint(20, 120))
        docs.append((i, text if good else " | ".join(text.split()), "en", "s", 1))
        labels.append((i, int(good), 0))
    edge = [(r[0] and r[0] + 10_000, *r[1:]) for r in edge_rows()]
    df = spark.createDataFrame(docs + edge, SCHEMA)
    model = quality.fit(df, spark.createDataFrame([*labels, (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int"))
    out = df.select("doc_id", quality.held_out(df["doc_id"]).alias("held_out"), quality.score(model, df["text"]).alias("score")).collect()
    assert len(out) == len(docs) + len(edge) and all(0 <= r["score"] <= 1 for r in out)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum((r["score"] >= quality.KEEP_FROM) == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    one_sided = quality.fit(df, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    assert {r[0] for r in df.select(quality.score(one_sided, df["text"])).collect()} == {0.5}
    none = empty_documents(spark)
    assert none.select(quality.score(model, none["text"])).count() == 0


def test_quality_is_calibrated_and_reproducible(spark):
    """Labels that the text tells with some error only; ids that repeat with other texts."""
    rng = random.Random(3)
    docs, labels, chance = [], [], {}
    for i in range(3000):
        bars = rng.randint(0, 4)
        text = prose(rng, rng.randint(30, 80)).split()
        for _ in range(bars * 4):
            text.insert(rng.randrange(len(text)), "|")
        chance[i] = 0.05 + 0.9 * (4 - bars) / 4
        docs.append((i, " ".join(text), "en", "s", 1))
        labels.append((i, int(rng.random() < chance[i]), 0))
    docs += [(i, "another text of the same id", "en", "s", 1) for i in range(0, 3000, 7)]
    labels_df = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(docs, SCHEMA)
    model, again = quality.fit(df, labels_df), quality.fit(df.repartition(5), labels_df)
    assert all(np.array_equal(getattr(model.network, k), getattr(again.network, k)) for k in ("w1", "b1", "w2", "mean")) and model.network.temperature == again.network.temperature
    out = df.where("text != 'another text of the same id'").select("doc_id", quality.score(model, df["text"]).alias("score")).where(quality.held_out(F.col("doc_id"))).collect()
    truth = {i: q for i, q, _ in labels}
    # Expected calibration error over ten bins, on rows that were not trained on.
    bins = collections.defaultdict(list)
    for r in out:
        bins[min(9, int(r["score"] * 10))].append((r["score"], truth[r["doc_id"]]))
    error = sum(abs(sum(s - y for s, y in b)) for b in bins.values()) / len(out)
    assert len(out) > 500 and error < 0.08
    assert quality.fit(empty_documents(spark), labels_df).network is None
    clashing = df.withColumns({c: F.lit("x") for c in ("id", "y", "x", "task", "block", "data", "score")})
    assert np.array_equal(quality.fit(clashing, labels_df).network.w1, model.network.w1)


def test_context_sums_do_not_depend_on_partitions(spark):
    df = edge_documents(spark)
    assert (quality.context_sums(df.repartition(1)) == quality.context_sums(df.repartition(7))).all()


def test_contexts_as_brute_force():
    texts = ["a b a", "", None, "A!! a!! x", "b"]
    place, sign = quality.index_vectors()
    word, form, first = quality.tokens(pa.array(texts))
    want = np.zeros((quality.ROWS, quality.DIMENSIONS))
    for t in range(len(texts)):
        for i in range(first[t], first[t + 1]):
            for j in (i - 1, i + 1):
                if first[t] <= j < first[t + 1]:
                    for own in (word[i], form[i]):
                        for other in (word[j], form[j]):
                            for k in range(quality.NONZEROS):
                                want[own, place[other, k]] += sign[other, k]
    assert (quality.contexts(pa.array(texts), place, sign) == want).all()


# Packing


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    for worker_tokens in (1 << 24, 3000):
        got = packing.pack(edge_documents(spark), tokenizer_path(), worker_tokens=worker_tokens).collect()
        ids = [(r[0], np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")) for r in edge_rows()]
        want = collections.Counter()
        for doc, x in ids:
            start = 0
            for size in packing.cut(len(x)):
                want[(doc, start, size, zlib.crc32(x[start : start + size].tobytes()), len(x))] += 1
                start += size
            assert start == len(x)
        assert collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
        sequences = collections.defaultdict(list)
        for r in got:
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        for pieces in sequences.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= packing.CAPACITY
    assert packing.pack(empty_documents(spark), tokenizer_path()).count() == 0


def test_word_cache_encodes_as_the_tokenizer():
    rng = random.Random(11)
    encoder = packing.WordEncoder(tokenizer_path())
    parts = ["a", "B", "é", "ñ", ".", ",", "'", "'s", "'LL", "|", "<|endoftext|>", "<|ENDOFTEXT|>", "…", " ", "\n", "\xa0", "\x1c", "1", "İ", "Σ", "中", "×", "!?", "can't", "ﬁ", "🙂", "-"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000)] + [None, ""]
    got = [x for p in tk.slices(pa.record_batch([pa.array(texts)], ["t"]), 0, 20_000) for x in encoder.encode(p.column(0))]
    assert [x.tolist() for x in got] == [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_harmonic_cuts_leave_little_padding():
    lengths = range(1, 2049)
    for n in [*lengths, *range(2049, 9000, 13)]:
        pieces = packing.cut(n)
        assert sum(pieces) == n and len(pieces) <= n // packing.CAPACITY + 4
        assert min(pieces) >= min(packing.LEAST, n)
    # All lengths as often: what full sequences leave empty, and pieces a document.
    pieces = [p for n in lengths for p in packing.cut(n)]
    assert sum(packing._empty(p, packing.CAPACITY) for p in pieces) <= 0.006 * sum(pieces)
    assert len(pieces) <= 2.2 * len(lengths)
    assert sum(p < packing.LEAST for p in pieces) < packing.LEAST


def test_sequence_numbers_do_not_meet_or_overflow(spark):
    parts = [(w, k, b) for w in (0, 1, 2**21, 2**31 - 1) for k in (0, 1, 2048) for b in (0, 1, 2**20 - 1)]
    df = spark.createDataFrame(parts, "w long, k long, b long")
    got = [r[0] for r in df.select(packing.sequence_number(F.col("w"), F.col("k"), F.col("b"))).collect()]
    assert len(set(got)) == len(parts) and min(got) >= 0
    with pytest.raises(Exception, match="too many"):
        spark.createDataFrame([(0, 1, 2**20)], "w long, k long, b long").select(packing.sequence_number(F.col("w"), F.col("k"), F.col("b"))).collect()


def test_repeated_rows_are_dealt_to_many_workers(spark):
    df = spark.createDataFrame([(1, "one text many times " * 20, "en", "s", 1)] * 400, SCHEMA)
    got = packing.pack(df, tokenizer_path(), worker_tokens=2000).collect()
    assert len({r["sequence_id"] >> 32 for r in got}) > 10 and len(got) == 400 * len(packing.cut(got[0]["doc_tokens"]))


def test_best_fit():
    bins, offsets = packing.best_fit([1024, 1024, 2000, 48, 500])
    assert max(bins) == 2 and offsets.count(0) == 3


# Text kernel


def test_words_and_shingles_as_plain_ones():
    texts = [r[1] for r in edge_rows()] + ["x", " x ", "é É", "a" * 3000]
    w = tk.words(pa.array(texts))
    values, first = tk.distinct(*tk.shingles(w))
    assert np.diff(w.first).tolist() == [len(words_of(t)) for t in texts]
    assert np.diff(first).tolist() == [len(shingle_set(t)) for t in texts]
    seen = {}
    for i, t in enumerate(texts):
        for h, x in zip(w.hash[w.first[i] : w.first[i + 1]], words_of(t), strict=True):
            assert seen.setdefault(h, x) == x
