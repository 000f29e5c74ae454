import base64
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import pii
from millrace.operators import guard as G

SALT = "salt of a test"


def kinds(text):
    return [(s.type, s.match) for s in pii.detect(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("call 010-1234-5678 now", [("phone_kr", "010-1234-5678")]),
        ("번호 0 1 0 1 2 3 4 5 6 7 8", [("phone_kr", "0 1 0 1 2 3 4 5 6 7 8")]),
        ("전화 공일공 일이삼사 오육칠팔로", [("phone_kr", "공일공 일이삼사 오육칠팔")]),
        ("a b c @ d e . c o m", [("email", "a b c @ d e . c o m")]),
        ("거꾸로 전화 87654321010", [("phone_kr", "87654321010")]),
        ("강남구 역삼동 사는 35세 김씨 남성", [("demographic", "강남구 역삼동 사는 35세 김씨 남성")]),
        ("시가총액 3050000000000 원", []),
        ("ISIN US0378331005", []),
        ("token MDEwLTEyMzQtNTY3OA==", [("phone_kr", "MDEwLTEyMzQtNTY3OA==")]),
        ("see 010%2D1234%2D5678", [("phone_kr", "010%2D1234%2D5678")]),
        ("휴대폰 零一零一二三四五六七八", [("phone_kr", "零一零一二三四五六七八")]),
        ("생년월일 900101 뒤 7자리 1234567", [("rrn", "900101 뒤 7자리 1234567")]),
        ("john dot doe at example dot com", [("email", "john dot doe at example dot com")]),
        ("phone zero one zero one two three four five six seven eight", [("phone_kr", "zero one zero one two three four five six seven eight")]),
        ("plain words about markets", []),
        ("git@github.com:me/repo.git", []),
    ],
)
def test_detectors(text, want):
    assert kinds(text) == want


def test_confidence_and_card_checksum():
    assert pii.direct("4111-1111-1111-1111")[0].confidence == 0.85
    assert pii.direct("카드 4111-1111-1111-1111")[0].confidence == pytest.approx(0.95)
    assert [s.type for s in pii.direct("4111-1111-1111-1112")] != ["credit_card"]
    assert any(s.type == "credit_card" and s.confidence == pytest.approx(0.55) for s in pii.direct("카드 4111-1111-1111-1112"))
    assert pii.luhn("4111 1111 1111 1111") and not pii.luhn("4111111111111112") and not pii.luhn("42")


def test_overlaps_are_settled_against_the_first():
    s = lambda t, a, b, c=0.9: pii.Span(t, a, b, "x", c)
    assert pii.resolve([s("bank_acct", 0, 10), s("rrn", 5, 12)]) == [s("rrn", 5, 12)]
    assert pii.resolve([s("email", 0, 10), s("phone_kr", 5, 12, 0.95)]) == [s("phone_kr", 5, 12, 0.95)]
    # Each span meets what the ones before it left.
    assert pii.resolve([s("bank_acct", 0, 4), s("rrn", 6, 9), s("credit_card", 3, 7)]) == [s("rrn", 6, 9)]
    assert pii.resolve([s("email", 0, 5), s("email", 3, 9), s("email", 20, 25)]) == [s("email", 3, 9), s("email", 20, 25)]


def test_masks_run_from_right_to_left(spark):
    text = "a@b.co, 010-1234-5678"
    spans = pii.detect(text)
    assert pii.mask(text, spans) == "[REDACTED_EMAIL], [REDACTED_PHONE_KR]"
    df = spark.createDataFrame([(text, [s._asdict() for s in spans])], f"t string, s array<{G.SPAN}>")
    assert df.select(G.mask_spans(F.col("t"), F.col("s"))).head()[0] == pii.mask(text, spans)


def test_guard_actions():
    assert pii.guard("nothing here")["action"] == "allow"
    assert pii.guard("a@b.co", salt=SALT)["action"] == "mask"
    leak = pii.guard("it is 01012345678", seed="phone: 010-1234-5678", salt=SALT)
    assert leak["action"] == "block" and len(leak["leaked"][0]) == 16 and "1234" not in leak["masked_text"]
    assert pii.guard("a@b.co", seed="phone: 010-1234-5678", salt=SALT)["action"] == "mask"
    two = pii.guard("010-1234-5678, a@b.co", seed="p: 010-1234-5678, e: a@b.co", salt=SALT)
    assert len(two["leaked"]) == 2
    late = pii.guard("계좌 얘기와 ① 만", stage2="force", strict=True, timed_out=True)
    assert late["action"] == "block" and late["reasons"] == ["stage2-timeout-high-risk"]
    assert pii.guard("token MDEwLTEyMzQtNTY3OA==", stage2="skip")["action"] == "allow"
    assert pii.fingerprint("공일공 1234 5678", SALT) == pii.fingerprint("010-1234-5678", SALT)
    assert pii.fingerprint("--", SALT) == ""


def test_model_verdicts():
    found = pii.adjudicate("mail a@b.co", [{"type": "EMAIL", "match": "a@b.co"}, {"type": "email", "match": "a@b.co", "confidence": 2}, {"type": "X", "match": "a"}, {"type": "EMAIL", "match": "gone"}])
    assert found == [pii.Span("email", 5, 11, "a@b.co", 0.7)]


def test_columns_agree_with_plain_functions(spark):
    texts = ["010-1234-5678", "a@b.co 카드 4111111111111111", None, "", "역순 전화 87654321010", "공일공 일이삼사 오육칠팔"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r[0]: r[1] for r in df.select("i", G.pii_spans(F.col("t"))).collect()}
    for i, t in enumerate(texts):
        assert (got[i] is None) if t is None else [tuple(s) for s in got[i]] == [tuple(s) for s in pii.detect(t)]
    prints = df.where("t is not null").select("t", G.fingerprint(F.col("t"), SALT), G.fingerprint_sql(F.col("t"), SALT)).collect()
    assert all(a == b == pii.fingerprint(t, SALT) for t, a, b in prints)
    for r in df.where("t is not null").select("t", G.may_hold_pii(F.col("t")).alias("m")).collect():
        assert r["m"] or not pii.detect(r["t"])
    long = "k" * 100
    assert df.limit(1).select(G.fingerprint_sql(F.lit("a1"), long)).head()[0] == pii.fingerprint("a1", long)


def test_output_guard_and_attributes(spark):
    df = spark.createDataFrame([("it is 010-1234-5678", "p: 01012345678"), ("fine", None)], "answer string, seed string")
    a, b = G.output_guard(df, "answer", "seed", SALT).collect()
    assert a["blocked"] and a["leaked_tokens"][0].startswith("fp:") and not b["blocked"] and b["masked_output"] == "fine"
    spans = spark.createDataFrame([({"input.value": "a@b.co", "tool.name": "a@b.co", "llm.input_messages.0": "x"},), ({"k": "v"},)], "attributes map<string,string>")
    a, b = (r[0] for r in G.redact_attributes(spans).collect())
    assert a == {"input.value": "[REDACTED_EMAIL]", "tool.name": "a@b.co", "llm.input_messages.0": "x", "pii.redacted.count": "1"} and b == {"k": "v"}


def test_nested_values_are_sanitised(spark):
    df = spark.createDataFrame([((["a@b.co", None], {"k": "010-1234-5678"}, 3),)], "v struct<a:array<string>,m:map<string,string>,n:int>")
    v = G.sanitise(df).head()[0]
    assert v["a"] == ["[REDACTED_EMAIL]", None] and v["m"] == {"k": "[REDACTED_PHONE_KR]"} and v["n"] == 3


def test_leaks_by_join(spark):
    out = spark.createDataFrame([(1, "it is 01012345678"), (1, "nothing"), (2, "it is 01012345678")], "k int, text string")
    seeds = spark.createDataFrame([(1, "010-1234-5678"), (2, "other value")], "k int, value string")
    assert [(r[0], r[1]) for r in G.seeded_leaks(out, seeds, "k", SALT).collect()] == [(1, "it is 01012345678")]
    assert pii.seed_values("name: Kim , plain,x:") == ["Kim", "plain"]


def test_outcomes(spark):
    rows = [(True, True, True), (True, True, False), (True, False, False), (False, True, False), (False, False, False)]
    df = spark.createDataFrame(rows, "c boolean, d boolean, m boolean")
    assert [r[0] for r in df.select(G.outcome(F.col("c"), F.col("d"), F.col("m"))).collect()] == ["TP", "PARTIAL", "FN", "FP", "TN"]
    t = spark.createDataFrame([(True, None), (True, 1), (True, 2), (False, 1)], "c boolean, s int")
    assert [r[0] for r in t.select(G.stage1_truth(F.col("c"), F.col("s"))).collect()] == [True, True, False, False]


def test_seeds_without_digits_are_not_passed_over(spark):
    df = spark.createDataFrame([("her name is Kim", "name: Kim"), ("nobody", "name: Kim"), ("nothing here", None), (None, "name: Kim")], "answer string, seed string")
    out = G.output_guard(df.withColumn("_look", F.lit(1)), "answer", "seed", SALT).collect()
    assert [(r["blocked"], r["leaked_tokens"], r["masked_output"]) for r in out] == [
        (g["action"] == "block", [f"fp:{x}" for x in g["leaked"]], g["masked_text"]) for g in (pii.guard(r["answer"] or "", r["seed"], salt=SALT) for r in df.collect())
    ]
    assert [r["blocked"] for r in out] == [True, False, False, False]


def test_many_seeds_in_many_texts(spark, monkeypatch):
    """Automata against a nested loop: seeds of several blocks, texts of several parts, a key with most rows, overlaps, marks alone, nulls."""
    monkeypatch.setattr(G, "SEED_BLOCK", 7)
    monkeypatch.setattr(G, "TEXT_PART", 300)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abAB1é ") for _ in range(rng.randint(1, 4)))
    key = lambda: rng.choice([1, 1, 1, 1, 2, 3, None])
    seeds = [(key(), word()) for _ in range(80)] + [(2, "010-1234-5678"), (9, "unused"), (1, None), (1, "--"), (1, "")]
    texts = [(key(), "".join(word() for _ in range(rng.randint(0, 12)))) for _ in range(150)] + [(2, "call 01012345678 now"), (1, None), (4, "a")]
    got = G.seeded_leaks(spark.createDataFrame(texts, "k long, text string"), spark.createDataFrame(seeds, "k long, value string"), "k", SALT)
    want = set()
    for k, t in texts:
        spans = {pii.fingerprint(s.match, SALT) for s in pii.detect(t)} if t is not None else set()
        for j, v in seeds:
            if k is not None and k == j and v is not None and t is not None and (f := pii.fingerprint(v, SALT)) and (v in t or f in spans):
                want.add((k, t, f))
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(want) and len(want) > 100 and any(k == 2 and t.startswith("call") for k, t, _ in want)
    none = spark.createDataFrame([], "k long, value string")
    assert G.seeded_leaks(spark.createDataFrame(texts, "k long, text string"), none, "k", SALT).count() == 0


def disguised(rng, n):
    bits = ["zero", "oh", "o", "ONE", "two", "three", "four", "five", "six", "seven", "eight", "nine", " ", ", ", "-", "/", "at", " dot ", "period", "kim", "example", "com", "@", ".", "010", "1234"]
    bits += ["한글", "전화", "주민", "계좌", "kyc ", "RRN ", "%30%31%30", "Internationale", "abcdefghijklmnop", "\n", "é", "​", "공일공", "１２３", "거꾸로", "김씨", "35세", "역삼동", "다니는", "\x1c"]
    for _ in range(n):
        text = "".join(rng.choice(bits) + rng.choice(["", "", " "]) for _ in range(rng.randint(1, 20)))
        if rng.random() < 0.3:
            token = base64.b64encode(rng.choice(["01012345678", "a@b.com", "900101-1234567", "plain"]).encode()).decode()
            text += " " + (token.rstrip("=") if rng.random() < 0.5 else token) + " "
        if rng.random() < 0.2:
            text += " ".join(rng.choice(bits[:12]) for _ in range(rng.randint(8, 13)))
        yield text


def test_what_is_passed_over_holds_nothing(spark):
    """Texts that do not go to Python, and detectors that are not tried, have nothing to find."""
    rng = random.Random(11)
    texts = list(disguised(rng, 3000)) + ["".join(rng.choice("wxyzabMNODEQ013") for _ in range(rng.randint(10, 26))) for _ in range(2000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", G.may_hold_pii(F.col("t")).alias("may")).collect()
    held = {r["i"] for r in rows if r["may"]}
    found = {i for i, t in enumerate(texts) if pii.detect(t)}
    assert found <= held and len(found) > 500 and len(held) < len(texts)
    for t in texts:
        assert pii._may_count(t) or not pii._ENGLISH_RUN.search(t)
        assert pii._may_speak(t) or not pii._SPOKEN.search(t)
        passed = {m[0] for m in pii._BASE64.finditer(t)} - {m[0] for m in pii._base64_runs(t)}
        assert not any((plain := pii._from_base64(x)) and pii._decoded_type(plain, t) for x in passed)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_spans_are_looked_for_without_patterns_of_java(spark, data):
    from millrace.plans.registry import QUERIES

    assert "RLIKE" not in plan(QUERIES["guard_spans"](spark, data))
    assert "RLIKE" not in plan(G.guarded(spark.createDataFrame([("call 010-1234-5678",)], "text string")))


@pytest.mark.parametrize("name", ["guard_confusion", "guard_disguises", "guard_obfuscated"])
def test_events_are_dealt_to_all_cores_before_the_detectors(spark, data, name):
    from millrace.plans.registry import QUERIES

    assert f"Repartition {4 * spark.sparkContext.defaultParallelism}, true" in plan(QUERIES[name](spark, data))
