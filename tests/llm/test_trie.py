"""The prefix trie, against a plain one, and running sums over ranges."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import queries as Q
from millrace.llm import trie
from millrace.llm.common import running_sums

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    talks = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            talks.setdefault(c, []).append((-(2**63) if t is None else t, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest(), r, x))
    talks = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in talks.items()}
    built = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 6
        donor = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = talks.get(donor, [])[:h] + own[h:]
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for prefix, members in nodes.items():
        below = [p for p in nodes if p[: len(prefix)] == prefix]
        children = [p for p in below if len(p) == len(prefix) + 1]
        leaves = sum(not any(q[: len(p)] == p and len(q) > len(p) for q in below) for p in below)
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in members if len(built[c]) == len(prefix))))
        out.append((min(members), len(prefix), min(nodes[prefix[:-1]]) if prefix else None, len(members), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def built_trie(rows):
    conv = F.col("conv")
    convs, turns = trie.rebuilt(trie.turns_in_order(rows), conv - conv % 100, F.pmod(F.crc32(conv.cast("string")), F.lit(6)), most=5)
    return sorted(map(tuple, trie.prefix_trie(convs, turns).collect()), key=str)


def varied_rows():
    rng = random.Random(8)
    rows = []
    for c in [*range(0, 40), *range(100, 130), 257, 258, 300, -3, -100, -101]:
        first = rng.choice(["hello", "hi", None])
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", None]) if t else "user", first if t == 0 else rng.choice(["yes", "no", "", "a longer answer é"])))
    rows += [(500 + i, t, "user", "the same") for i in range(30) for t in range(7)]  # copies of one conversation
    rows += [(7, None, "user", "without a turn"), (7, 3, "user", "tie"), (7, 3, "user", "tie"), (7, 3, "assistant", "tie"), (None, 0, "user", "nobody's")]
    rows += [(700, t, "user", f"turn {t}") for t in range(60)] + [(701, t, "user", f"turn {t}") for t in range(30)]
    return rows


def test_trie(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 5)
    rows = varied_rows()
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("conv", "pos", "depth", "run", "digest", "n")}).repartition(6)
    assert built_trie(frame) == plain_trie(rows)


def test_trie_of_nested_conversations(spark):
    """Each conversation is one turn longer than the next: chains that hang from each other as deep as there are conversations."""
    turns = [(1000 - n, d, hashlib.sha256(b"%d" % d).digest(), 2) for n in range(1, 20) for d in range(1, n + 1)]
    frame = spark.createDataFrame(turns, "conv long, depth long, digest binary, chars long")
    got = sorted(map(tuple, trie.prefix_trie(frame.select("conv").distinct(), frame).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens").collect()))
    # Depth d is had by all that are at least so long; its owner is the longest one, which has the smallest id.
    want = [(981, d, 981 if d else None, 20 - max(d, 1), int(d < 19), 1, sum(2 * (19 - e) for e in range(max(d, 1), 20))) for d in range(20)]
    assert got == sorted(want, key=lambda r: r[:2])


def test_trie_of_nothing(spark):
    assert built_trie(spark.createDataFrame([], SCHEMA)) == []
    assert built_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)) == []
    # A conversation without turns of its own: the root alone.
    rows = [(c, 0, "user", "x") for c in range(401, 420)]
    assert built_trie(spark.createDataFrame(rows, SCHEMA)) == plain_trie(rows)


def test_trie_on_the_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, Q.op12_prefix_trie(spark, data).collect()), key=str) == plain_trie(rows)


@pytest.mark.parametrize("tasks", [1, 7])
def test_running_sums(spark, tasks):
    """Groups that span tasks, one group in all of them, and sums beyond 64 bits."""
    rng = random.Random(tasks)
    rows = [(g, i, rng.randrange(-(2**63), 2**63), 1) for g, n in ((1, 3), (2, 400), (3, 1), (-4, 90)) for i in range(n)]
    want, total = [], {}
    for g, i, a, b in rows:
        x, y = total.get(g, (0, 0))
        total[g] = (x + a + 2**63) % 2**64 - 2**63, y + b
        want.append((g, i, *total[g]))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.createDataFrame(rows, "g long, i long, a long, b long").repartition(5)
        assert sorted(map(tuple, running_sums(frame, "g", [F.asc("i")], ["a", "b"], "sums").collect())) == sorted(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
