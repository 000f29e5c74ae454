import pytest
from pyspark.sql import functions as F

from millrace.functions import registry as R
from millrace.operators import guard as G


def test_sql_functions(spark):
    R.register(spark)
    assert spark.sql("SELECT pii_mask('to: a@b.co!'), formula('2*(3+4)'), formula('x')").head() == ("to: [REDACTED_EMAIL]!", 14.0, None)
    got = spark.sql("SELECT * FROM VALUES ('a@b.co, 010-1234-5678'), ('none') AS t(x), LATERAL pii_table(x)").collect()
    assert [(r["type"], r["match"]) for r in got] == [("email", "a@b.co"), ("phone_kr", "010-1234-5678")]


def test_evaluators_by_name(spark):
    v = "struct<score:double,label:string,explanation:string>"
    schema = f"level string, answer string, low double, high double, required_tool string, expected_ticker string, calls array<struct<name:string,args:string,result:string>>, plan string, verdict_groundedness {v}, verdict_refusal {v}, verdict_plan {v}"
    df = spark.createDataFrame([("easy", "about 5", 1.0, 9.0, "get_financials", "AAPL", [("get_financials", "{}", "Apple")], "p", (0.7, "partial", ""), None, (0.9, "correct", ""))], schema)
    r = R.evaluate(df, list(R.evaluators())).head()
    assert (r["factual_accuracy"]["score"], r["tool_correctness"]["score"], r["groundedness"]["score"], r["refusal"], r["plan_quality"]["score"]) == (1, 1, 0.7, None, 0.9)
    assert df.select(R.distinct_names(F.col("calls"))).head()[0] == ["get_financials"]


def test_filters():
    assert R.filters_of('{"filters": [{"field": "pe", "operator": "gt", "value": 1}]}')[1] == 5
    for bad in ('{"filters": [{"field": "pe", "operator": "like", "value": 1}]}', '{"filters": [{"field": "pe", "operator": "in", "value": 1}]}', "[]x"):
        with pytest.raises(ValueError):
            R.filters_of(bad)


def test_models_and_spans(spark):
    df = spark.createDataFrame([("a b",), ("",)], "text string")
    out = R.with_model(df, ["text"], "n", "array<double>", lambda rows: [[float(len(t))] for t in rows["text"]], batch=1)
    assert [r["n"] for r in out.collect()] == [[3.0], [0.0]]
    text = F.lit("역순 전화 87654321010, a@b.co")
    spans = spark.range(1).select(R.merged_spans(G.pii_spans(text, "direct"), G.pii_spans(text, "reversed_numbers"), F.lit(None).cast(f"array<{G.SPAN}>"))).head()[0]
    assert [s["type"] for s in spans] == ["phone_kr", "email"]
    assert R.merged_streams(df, df).count() == 4 and callable(R.formatter("news"))
