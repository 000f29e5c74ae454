from pyspark.sql import functions as F

from millrace.operators import finance as O
from millrace.plans.registry import QUERIES


def test_combined_results(spark, data):
    rows = [("a", "x", 1, "old", None, ["u", "v"]), ("a", "x", 3, "new", None, ["v", "w"]), ("b", None, 2, None, "failed", ["u"]), ("c", "y", 4, None, "late", None), ("c", "y", 0, "z", None, [])]
    df = spark.createDataFrame(rows, "tool string, ticker string, ord int, data string, error string, urls array<string>")
    got = O.combine_results(df).head()
    assert got["data"] == {"a_x": "new"} and got["source_urls"] == ["u", "v", "w"]
    assert [tuple(x) for x in got["_errors"]] == [(2, "b", None, "failed"), (4, "c", "y", "late")]
    none = O.combine_results(df.limit(0)).head()
    assert none["data"] == {} and none["_errors"] == [] and none["source_urls"] == []


def test_combined_results_of_all_events(spark, data):
    e = spark.read.parquet(f"{data}/events.parquet").where("event_type <> 'error'")
    want = {f"{r[0]}_{r[1]}": r[2] for r in e.groupBy("event_type", F.col("user_id") % 3).agg(F.max_by("props", "event_id")).collect()}
    assert {r["key"]: r["data"] for r in QUERIES["combined_results"](spark, data).collect()} == want


def test_grid_of_every_customer(spark, data):
    customers = spark.read.parquet(f"{data}/orders.parquet").select("o_custkey").distinct().count()
    got = QUERIES["dcf_grid"](spark, data)
    assert got.count() == 9 * customers and got.where("o_custkey >= 100").count() > 0
