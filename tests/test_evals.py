import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import stats
from millrace.operators import evals as E


def one(spark, col):
    return spark.range(1).select(col).head()[0]


def test_numbers(spark):
    cases = {"$1,234.5M and -3B": [1.2345, -3.0], "FY2024 revenue 12조": [2024.0, 12000.0], "5억 3만 2K 7T": [0.5, 0.00003, 0.000002, 7000.0], "none": [], "24.0%": [24.0]}
    for text, want in cases.items():
        assert one(spark, E.numbers(F.lit(text))) == pytest.approx(want)


def test_factual_accuracy(spark):
    call = lambda level, answer, lo=1.0, hi=10.0: one(spark, E.factual_accuracy(F.lit(level), F.lit(answer), F.lit(lo), F.lit(hi)))
    assert call("trap", "8") is None
    assert call("easy", "Reached maximum iterations (8)")["score"] == 0
    assert call("easy", "about 10")["label"] == "correct" and call("easy", "11")["score"] == 0 and call("easy", "no digits")["score"] == 0
    assert "closest was 11.0" in call("easy", "11 or 20")["explanation"]


def test_verdicts(spark):
    v = one(spark, E.parse_verdict(F.lit("broken"), F.lit('{"score": "1.7", "label": "Correct", "reason": "r"}')))
    assert (v["score"], v["label"], v["explanation"]) == (1.0, "correct", "r")
    assert one(spark, E.parse_verdict(F.lit('{"score": 1, "label": "maybe"}')))["label"] == "incorrect"
    none = F.lit(None).cast("struct<score:double,label:string,explanation:string>")
    assert one(spark, E.not_applicable(none)) is None and one(spark, E.not_applicable(none, "skipped"))["score"] == 1
    assert one(spark, E.refusal(F.lit("easy"), F.struct(F.lit(1.0).alias("score")))) is None
    assert one(spark, E.plan_quality(F.lit("  "), none))["score"] == 0.5


def test_empty_report(spark):
    r = E.detection_report(spark.createDataFrame([], "outcome string")).head()
    assert (r["precision"], r["recall"], r["f1"]) == (1.0, 1.0, 0.0)


def test_percentiles_at_the_floor_index(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "x double")
    row = df.agg(stats.floor_percentile("x", 0.95), stats.floor_percentile("x", 1.0), stats.floor_percentile("x", 1.0, "zero"), stats.floor_percentile("x", 0.5)).head()
    assert tuple(row) == (9.0, 9.0, 0.0, 5.0)
    none = df.where("x < 0").agg(stats.floor_percentile("x", 0.5), stats.floor_percentile("x", 0.5, "zero")).head()
    assert tuple(none) == (None, 0.0)
    spread = stats.floor_percentile_distributed(df.withColumn("k", F.lit(1)), ["k"], "x", {"a": 0.95, "b": 1.0, "c": 0.5}).head()
    assert tuple(spread)[1:] == (9.0, 9.0, 5.0)


def test_percentiles_of_ranges(spark):
    """Exact whatever the ranges: ties, nulls, a null key, one value, a group that holds most rows."""
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, float(rng.randrange(12)), rng.gauss(0, 1)])) for _ in range(900)] + [("one", 4.0)]
    ps = {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    df = spark.createDataFrame(rows, "k string, x double")
    want = {}
    for key in {k for k, x in rows if x is not None}:
        values = sorted(x for k, x in rows if k == key and x is not None)
        want[key] = tuple(values[min(int(p * len(values)), len(values) - 1)] for p in ps.values())
    # A group without values has nulls.
    df, want["none"] = df.unionByName(spark.createDataFrame([("none", None)] * 3, "k string, x double")), (None,) * 4
    for buckets in (1, 2, 16, 256):
        got = stats.floor_percentile_distributed(df, ["k"], "x", ps, buckets).collect()
        assert {r["k"]: tuple(r)[1:] for r in got} == want


def test_latency_bins(spark):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.9, 1.0, 99.0, 100.0, 2999.0, 3000.0)], "ms double")
    assert [r[0] for r in df.select(stats.latency_bin(F.col("ms"))).collect()] == [None, 0, 0, 1, 1, 2, 5, 6]


@pytest.mark.parametrize(("formula", "value"), [("(110/100-1)*100", 10.0), ("2**3 - -1", 9.0), ("7 % 4", 3.0)])
def test_arithmetic(formula, value):
    assert E.arithmetic(formula) == pytest.approx(value)


@pytest.mark.parametrize("formula", ["__import__('os')", "a+1", "1 if 1 else 2", "9**9999", "f(1)", "", "'a'*3", "1;2"])
def test_arithmetic_runs_nothing(formula):
    with pytest.raises((ValueError, SyntaxError)):
        E.arithmetic(formula)


def test_dataset_checks(spark):
    schema = ("id string, ord int, category string, input string, contains_pii boolean, pii_types array<string>, expected_masked string, obfuscation_pattern string, requires_stage int, "
              "stage2_only boolean, trap_note string, sensitivity_class string, memory_seed string, expected_response_blocks_pii boolean, injection_type string, source_basis string")
    good = ("F001", 1, "clean", "hi", False, [], "hi", None, None, None, "n", "clean", None, None, None, "synthetic")
    bad = ("F009", 2, "obfuscated", "hi", True, ["EMAIL"], "x", None, 1, None, None, "s", None, None, None, "internal log")
    faults = [r["fault"] for r in E.dataset_faults(spark.createDataFrame([good, bad], schema)).collect()]
    assert len(faults) == 8 and "duplicate input" in faults and "id is not sequential" in faults
    lint = "id string, level string, category string, low double, high double, formula string, required_tool string, answer string"
    rows = [("a", "easy", "x", 1.0, 2.0, "3*1", "get_financials", ""), ("b", "easy", "margin", 2.0, 1.0, None, None, ""), ("c", "trap", "advice", None, None, None, None, "조회 불가: x"), ("d", "easy", "x", 1.0, 9.0, "a", "nope", "")]
    got = {(r["id"], r["message"]) for r in E.dataset_lint(spark.createDataFrame(rows, lint)).collect()}
    assert got == {("a", "the formula lies outside the range"), ("a", "the range is very wide"), ("b", "the range is inverted"), ("b", "a ratio without a formula"), ("b", "a question without a tool"), ("d", "the formula cannot be read"), ("d", "the range is very wide"), ("d", "an unknown tool")}


def test_stage_reports(spark):
    span = "array<struct<type:string,start:int,end:int>>"
    schema = f"id int, stage2_only boolean, detections struct<stage1:{span},deterministic:{span},stage2:{span},combined:{span}>, output_guard struct<blocked:boolean,expected_blocked:boolean>"
    s = [("email", 0, 3)]
    rows = [(1, True, ([], [], s, s), (True, True)), (2, True, ([], [], [], []), (False, True)), (3, True, (s, [], [], s), None), (4, None, (s, s, [], s), (False, False))]
    df = spark.createDataFrame(rows, schema)
    assert tuple(E.stage2_audit(df).head()) == (1, 1, 1, 0.5)
    assert tuple(E.output_guard_report(df).head()) == (3, 1, 1)
    assert E.stage1_share(df).head()[0] == 2
    assert tuple(E.stage_totals(df).head()) == (2, 1, 1, 3)


def test_annotations_and_samples(spark):
    v = "struct<score:double,label:string,explanation:string>"
    df = spark.createDataFrame([("s1", (1.0, "correct", "x"), None), ("s2", None, None)], f"span_id string, fact {v}, tool {v}")
    assert [(r["span_id"], r["name"], r["score"]) for r in E.annotations_long(df, ["fact", "tool"]).collect()] == [("s1", "fact", 1.0)]
    ids = spark.range(100).withColumnRenamed("id", "id")
    a, b = ({r[0] for r in E.sample_rows(ids, 10, s).collect()} for s in (1, 1))
    assert a == b and len(a) == 10
    assert E.sample_rows(ids, 10, 2).collect() != E.sample_rows(ids, 10, 1).collect()
    label = spark.createDataFrame([(0.2, 0.05), (0.1, 0.4), (0.1, 0.1)], "a double, b double").select(stats.delta_label(F.col("a"), F.col("b")))
    assert [r[0] for r in label.collect()] == ["▼ -15.0pp", "▲ +30.0pp", "— +0.0pp"]


def test_search_looks_through_the_whole_text(spark, tmp_path):
    from millrace.plans.registry import QUERIES

    spark.createDataFrame([(1, "x" * 500 + " Src1", "en", "web"), (2, "y" * 500, "en", "web"), (3, "Src1", "de", "web")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r["doc_id"] for r in QUERIES["search_facets"](spark, str(tmp_path)).collect()] == [1]
