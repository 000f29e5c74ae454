"""The filter audit, against plain loops over all orders."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import audit
from tests.llm.helpers import SCHEMA, edge_documents, edge_rows, empty_documents, prose

LABELS = "doc_id long, quality int, toxic int"


def fails_of(rows):
    order = lambda i: -(2**63) if i is None else i
    low = {}
    for r in rows:
        t = r[1] or ""
        low[t] = min(low.get(t, order(r[0])), order(r[0]))
    out = []
    for r in rows:
        t = r[1] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append((
            len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), order(r[0]) > low[t],
        ))
    return out


def plain_audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    fails, out = fails_of(rows), {}
    for part in {r[3] or "" for r in rows}:
        mine = [(r, f) for r, f in zip(rows, fails, strict=True) if (r[3] or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            alive = list(mine)
            for step, name in enumerate(order, 1):
                k = "ABCDE".index(name)
                gone = [(r, f) for r, f in alive if f[k]]
                alive = [(r, f) for r, f in alive if not f[k]]
                total[name] += len(gone)
                out[part, "".join(order), step] = [
                    len(alive), len(gone), sum(f[k] for _, f in mine) - len(gone), sum(f[k] and sum(f) == 1 for _, f in mine), sum(r[0] in good for r, _ in gone), sum(r[0] in toxic for r, _ in gone),
                ]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return sorted((*k, *v) for k, v in out.items())


def varied_rows():
    rng = random.Random(4)
    rows = list(edge_rows())
    for i in range(200, 260):
        words = prose(rng, rng.choice([3, 49, 50, 80])).split()
        words += rng.choice([[], words[:2] * 20, ["UPPER", "CASE"] * 5, ["100%", "#tag"]])
        rows.append((i, rng.choice([" ", "\n", "\x0b \x0c", "\x1c "]).join(words), "en", rng.choice(["a", "b", None, ""]), 1))
    rows += [(300 - i, rows[20 + i % 3][1], "en", rng.choice(["a", None]), 1) for i in range(40)]
    # The smallest id more than once, in two parts, and under another text too.
    return rows + [(-5, "the same text for many", "fr", "x", 1), (-5, "the same text for many", "fr", "y", 1), (-5, "other", "fr", "x", 1)]


@pytest.mark.parametrize("held", [1, 8 << 20])
def test_audit(spark, monkeypatch, held):
    """Also where a task can hold next to no text, so that all is settled after the exchange."""
    rows = varied_rows()
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 300, 2)] + [(12, None, None), (None, 1, 1), (4, 0, 1), (4, 1, 0)]
    monkeypatch.setattr(audit, "HELD_BYTES", held)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("id", "part", "fingerprint", "mask", "n", "good")}).repartition(5)
    got = audit.audit(docs, spark.createDataFrame(labels, LABELS).withColumn("part", F.lit(1)))
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, labels)


def test_audit_of_edges_and_nothing(spark):
    got = audit.audit(edge_documents(spark), spark.createDataFrame([], LABELS)).collect()
    assert sorted(map(tuple, got)) == plain_audit(edge_rows(), [])
    assert audit.audit(empty_documents(spark), spark.createDataFrame([], LABELS)).count() == 0


def test_texts_whose_fingerprints_collide(monkeypatch):
    """Chains compare texts: one fingerprint for all gives the same answer, however little a task holds."""

    class Context:
        get = staticmethod(lambda: Context)
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(audit, "TaskContext", Context)
    rows = [(7, i, t) for i, t in ((3, "a"), (1, "b"), (2, "a"), (5, "b"), (4, "c"), (2, "a"), (1, "c"))]
    for held in (0, 500, 1 << 20):
        monkeypatch.setattr(audit, "HELD_BYTES", held)
        sent = sorted(audit._settle(iter(rows)), key=lambda kv: kv[0])
        assert sorted(audit._resolve(iter(sent))) == [(3, 7), (4, 7), (5, 7)]


def test_words_of_long_texts(monkeypatch):
    rng = random.Random(2)
    text = prose(rng, 500)
    whole = audit.text_mask(text)
    monkeypatch.setattr(audit, "STEP", 7)
    assert audit.text_mask(text) == whole
    assert [w for part in audit._words(text.encode()) for w in part] == text.encode().split()
