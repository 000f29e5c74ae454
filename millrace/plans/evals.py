"""Queries of evaluation reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import stats
from millrace.operators import evals as E
from millrace.operators import substring_index as B
from millrace.operators.guard import outcome
from millrace.plans.registry import Tables, query
from millrace.session import scratch_folder

_OUT_SQL = """outcomes AS (
  SELECT d.doc_id, d.lang, d.source, l.toxic, CASE
    WHEN l.quality = 0 AND (contains(text, '!!') OR contains(text, ' | ')) AND d.lang = 'en' THEN 'TP'
    WHEN l.quality = 0 AND (contains(text, '!!') OR contains(text, ' | ')) THEN 'PARTIAL'
    WHEN l.quality = 0 THEN 'FN' WHEN contains(text, '!!') OR contains(text, ' | ') THEN 'FP' ELSE 'TN' END AS outcome
  FROM documents d JOIN labels l USING (doc_id))"""
_COUNTS = "count(*) AS n, count(*) FILTER (outcome = 'TP') AS tp, count(*) FILTER (outcome = 'FP') AS fp, count(*) FILTER (outcome = 'FN') AS fn, count(*) FILTER (outcome = 'TN') AS tn, count(*) FILTER (outcome = 'PARTIAL') AS partial"
_PRF = """CASE WHEN tp + partial + fp = 0 THEN 1.0 ELSE (tp + partial)::DOUBLE / (tp + partial + fp) END AS p,
  CASE WHEN tp + partial + fn = 0 THEN 1.0 ELSE (tp + partial)::DOUBLE / (tp + partial + fn) END AS r"""
_F1 = "round(p, 6) AS precision, round(r, 6) AS recall, CASE WHEN tp + partial + fp + fn = 0 OR p + r = 0 THEN 0.0 ELSE round(2 * p * r / (p + r), 6) END AS f1"


def _outcomes(spark, sf):
    t = Tables(spark, sf)
    d = t.documents.join(t.labels, "doc_id")
    found = F.col("text").contains("!!") | F.col("text").contains(" | ")
    return d.select("doc_id", "lang", "source", "toxic", outcome(F.col("quality") == 0, found, F.col("lang") == "en").alias("outcome"))


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(f"WITH {_OUT_SQL}, c AS (SELECT {_COUNTS} FROM outcomes), x AS (SELECT *, {_PRF} FROM c) SELECT n, tp, fp, fn, tn, partial, {_F1} FROM x")
def outcome_confusion(spark, sf):
    """Confusion of a junk detector, partial hits counted as found."""
    return _rounded(E.detection_report(_outcomes(spark, sf)))


@query(f"""WITH {_OUT_SQL}, dim(ord, lang) AS (VALUES (0, 'en'), (1, 'fr'), (2, 'xx')), c AS (SELECT lang, {_COUNTS} FROM outcomes GROUP BY lang),
j AS (SELECT dim.ord, dim.lang, coalesce(n, 0) AS n, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, coalesce(tn, 0) AS tn, coalesce(partial, 0) AS partial FROM dim LEFT JOIN c USING (lang)),
x AS (SELECT *, {_PRF} FROM j) SELECT ord, lang, n, tp, fp, fn, tn, partial, {_F1} FROM x""")
def prf_by_lang(spark, sf):
    """By a fixed domain of languages, one of which has no rows."""
    return _rounded(E.breakdown_by_domain(_outcomes(spark, sf), "lang", ("en", "fr", "xx")))


@query(f"""WITH {_OUT_SQL}, c AS (SELECT source, count(*) FILTER (outcome = 'TP') AS tp, count(*) FILTER (outcome = 'FP') AS fp, count(*) FILTER (outcome = 'FN') AS fn FROM outcomes GROUP BY source)
SELECT source, round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fn) END, 6) AS recall FROM c""")
def prf_empty_denominator(spark, sf):
    """Stage checks, where an empty denominator gives 0."""
    c = _outcomes(spark, sf).groupBy("source").agg(*(F.count_if(F.col("outcome") == o).alias(o.lower()) for o in ("TP", "FP", "FN")))
    return c.select("source", F.round(stats.precision(F.col("tp"), F.col("fp"), empty=0), 6).alias("precision"), F.round(stats.recall(F.col("tp"), F.col("fn"), empty=0), 6).alias("recall"))


@query(f"WITH {_OUT_SQL} SELECT source AS obfuscation_pattern, min(doc_id) AS first_seen, arg_min(toxic, doc_id) AS stage, {_COUNTS} FROM outcomes GROUP BY source")
def breakdown_pattern(spark, sf):
    """By pattern in order of appearance, with the first row's stage."""
    d = _outcomes(spark, sf).select(F.col("source").alias("obfuscation_pattern"), F.col("toxic").alias("requires_stage"), "doc_id", "outcome")
    return E.breakdown_by_pattern(d, "doc_id")


@query(f"""WITH {_OUT_SQL}, m AS (SELECT unnest(list_distinct([lang, source, lang])) AS member, outcome FROM outcomes),
c AS (SELECT member, {_COUNTS} FROM m GROUP BY member), x AS (SELECT *, {_PRF} FROM c) SELECT member, n, tp, fp, fn, tn, partial, {_F1} FROM x""")
def array_membership_breakdown(spark, sf):
    """A row counts once for each distinct member of its array."""
    d = _outcomes(spark, sf).select(F.array("lang", "source", "lang").alias("members"), "outcome")
    return _rounded(E.breakdown_by_member(d, "members"))


@query(f"""WITH {_OUT_SQL} SELECT lang, {', '.join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in stats.OUTCOMES)} FROM outcomes GROUP BY lang""")
def pivot_outcomes(spark, sf):
    """Languages by outcomes."""
    return E.outcome_pivot(_outcomes(spark, sf), "lang")


@query("SELECT event_type AS bucket, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def bucket_counts(spark, sf):
    """Rows of each value."""
    return E.bucket_counts(Tables(spark, sf).events, "event_type")


@query("""SELECT event_type, CAST(ts AS DATE) AS day, count(*) FILTER (value < 10) AS low, count(*) FILTER (value >= 10 AND value < 100) AS mid, count(*) FILTER (value >= 100) AS high
FROM events GROUP BY ALL""")
def pivot_type_day(spark, sf):
    """Events by type and day, pivoted by size."""
    size = F.when(F.col("value") < 10, "low").when(F.col("value") < 100, "mid").otherwise("high")
    e = Tables(spark, sf).events.select("event_type", F.col("ts").cast("date").alias("day"), size.alias("size"))
    return e.groupBy("event_type", "day").pivot("size", ["low", "mid", "high"]).count().na.fill(0)


@query("""WITH v AS (SELECT event_type, list_sort(list(value)) AS v, count(value) AS n FROM events GROUP BY 1)
SELECT event_type, v[1 + least(floor(0.5 * n)::INT, n - 1)] AS p50, v[1 + least(floor(0.95 * n)::INT, n - 1)] AS p95, v[1 + least(floor(0.99 * n)::INT, n - 1)] AS p99 FROM v""")
def floor_percentiles(spark, sf):
    """Values at the floor index, by event type; ranks by window, so a group may be of any size."""
    return stats.floor_percentile_distributed(Tables(spark, sf).events, ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("""WITH b AS (SELECT event_type, CASE WHEN value * 10 < 0 THEN NULL WHEN value * 10 < 1 THEN 0 WHEN value * 10 < 100 THEN 1 WHEN value * 10 < 500 THEN 2 WHEN value * 10 < 1000 THEN 3 WHEN value * 10 < 2000 THEN 4 WHEN value * 10 < 3000 THEN 5 ELSE 6 END AS b FROM events),
t AS (SELECT DISTINCT event_type FROM events)
SELECT t.event_type, 'b' || r.i AS bin, count(b.b) AS n FROM t CROSS JOIN range(7) r(i) LEFT JOIN b ON b.event_type = t.event_type AND b.b = r.i GROUP BY ALL""")
def latency_histogram(spark, sf):
    """Seven half-open latency bins."""
    e = Tables(spark, sf).events.select("event_type", (F.col("value") * 10).alias("ms"))
    return E.latency_histogram(e, "ms", ["event_type"])


_AB = """runs AS (
  SELECT user_id AS id, event_id % 2 AS half, avg(value) / 97 AS factual_accuracy, CASE WHEN user_id % 7 = 0 THEN NULL ELSE max(value) / 499 END AS groundedness, min(value) AS refusal FROM events GROUP BY user_id, event_id % 2),
long AS (SELECT * FROM (UNPIVOT (SELECT id, half, factual_accuracy, groundedness, refusal FROM runs) ON factual_accuracy, groundedness, refusal INTO NAME metric VALUE v)),
ab AS (SELECT a.id, a.metric, round(a.v, 6) AS before, round(b.v, 6) AS after, round(b.v - a.v, 6) AS delta, CASE WHEN b.v > a.v THEN 'win' WHEN b.v < a.v THEN 'loss' ELSE 'tie' END AS verdict
  FROM long a JOIN long b ON a.id = b.id AND a.metric = b.metric AND a.half = 0 AND b.half = 1)"""


def _runs(spark, sf):
    e = Tables(spark, sf).events
    runs = e.groupBy(F.col("user_id").alias("id"), (F.col("event_id") % 2).alias("half")).agg(
        (F.avg("value") / 97).alias("factual_accuracy"), F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.max("value") / 499).alias("groundedness"), F.min("value").alias("refusal")
    )
    return runs.where("half = 0").drop("half"), runs.where("half = 1").drop("half")


def _compared(spark, sf):
    return E.compare_runs(*_runs(spark, sf)).withColumns({c: F.round(c, 6) for c in ("before", "after", "delta")})


@query(f"WITH {_AB} SELECT * FROM ab")
def ab_compare(spark, sf):
    """Two runs by id and metric."""
    return _compared(spark, sf)


@query(f"WITH {_AB} SELECT * FROM ab WHERE verdict = 'win' ORDER BY delta DESC, id, metric LIMIT 10")
def ab_wins_topk(spark, sf):
    """Ten largest gains."""
    return E.top_wins(_compared(spark, sf))


@query(f"WITH {_AB} SELECT * FROM ab WHERE verdict = 'loss' ORDER BY id, metric LIMIT 10")
def ab_first_losses(spark, sf):
    """First ten losses."""
    return E.first_losses(_compared(spark, sf))


@query("""WITH r AS (SELECT user_id AS id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE avg(value) / 100 END AS factual_accuracy, max(value) / 500 AS groundedness, NULL::DOUBLE AS refusal FROM events GROUP BY user_id)
SELECT round(coalesce(avg(factual_accuracy), 0), 6) AS factual_accuracy, count(factual_accuracy) AS n_factual_accuracy, round(coalesce(avg(groundedness), 0), 6) AS groundedness, count(groundedness) AS n_groundedness,
  coalesce(avg(refusal), 0.0) AS refusal, count(refusal) AS n_refusal, round(1 - coalesce(avg(factual_accuracy), 0), 6) AS hallucination_rate FROM r""")
def metric_means(spark, sf):
    """Means of the scores that are there, and the two rates."""
    r = Tables(spark, sf).events.groupBy(F.col("user_id").alias("id")).agg(F.avg("value").alias("a"), F.max("value").alias("m"))
    r = r.select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("a") / 100).alias("factual_accuracy"), (F.col("m") / 500).alias("groundedness"), F.lit(None).cast("double").alias("refusal"))
    out = E.metric_means(r, ("factual_accuracy", "groundedness", "refusal"))
    return out.withColumns({c: F.round(c, 6) for c in ("factual_accuracy", "groundedness", "hallucination_rate")})


@query("""WITH e(p, expected) AS (VALUES ('1-URGENT', 10), ('2-HIGH', 20), ('9-NONE', 5)), g AS (SELECT o_orderpriority AS p, count(*) AS actual FROM orders GROUP BY 1)
SELECT coalesce(g.p, e.p) AS priority, actual, expected::BIGINT AS expected, CASE WHEN actual IS NULL THEN 'missing' WHEN expected IS NULL THEN 'unexpected' WHEN actual <> expected THEN 'wrong' ELSE 'ok' END AS verdict
FROM g FULL JOIN e ON g.p = e.p""")
def exact_count_reconcile(spark, sf):
    """Counts against expected ones."""
    o = Tables(spark, sf).orders.select(F.col("o_orderpriority").alias("priority"))
    return E.reconcile(o, "priority", {"1-URGENT": 10, "2-HIGH": 20, "9-NONE": 5})


@query("""WITH d(name) AS (VALUES ('click'), ('view'), ('absent')), a AS (SELECT event_type AS name, round(avg(value), 6) AS mean, count(value) AS n FROM events GROUP BY 1)
SELECT d.name, a.mean, coalesce(a.n, 0) AS n FROM d LEFT JOIN a USING (name)""")
def annotation_stats(spark, sf):
    """Mean and number by evaluator, absent ones too."""
    a = Tables(spark, sf).events.select(F.col("event_type").alias("name"), F.col("value").alias("score"))
    return E.annotation_stats(a, ["click", "view", "absent"]).withColumn("mean", F.round("mean", 6))


@query("""WITH t AS (SELECT user_id, sum(value) AS cost, epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000 AS ms FROM events GROUP BY 1)
SELECT count(*) AS traces, round(sum(cost), 4) AS cost, round(quantile_cont(ms::DOUBLE, 0.5), 4) AS p50, round(quantile_cont(ms::DOUBLE, 0.99), 4) AS p99 FROM t""")
def trace_stats(spark, sf):
    """Traces, cost and latency quantiles."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    s = Tables(spark, sf).events.select(F.col("user_id").alias("trace_id"), F.col("value").alias("cost"), ms.alias("start_ms"), ms.alias("end_ms"))
    return E.trace_stats(s).withColumns({c: F.round(c, 4) for c in ("cost", "p50", "p99")})


@query("SELECT count(*) AS n, count(*) FILTER (quality = 1) AS correct, round(avg(quality), 6) AS mean FROM labels")
def correct_counts(spark, sf):
    """Correct rows and mean score."""
    return E.correct_counts(Tables(spark, sf).labels, "quality").withColumn("mean", F.round("mean", 6))


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(concat_ws(' ', lang, source, text)), 'src1') AND lang = 'en'")
def search_facets(spark, sf):
    """Rows that hold a text anywhere, with a facet."""
    return E.search(Tables(spark, sf).documents, "SRC1", ["lang", "source", "text"], {"lang": "en"}).select("doc_id", "lang")


@query("""WITH q AS (SELECT doc_id AS query_id, lower(substr(text, 7, CASE WHEN doc_id % 300 = 0 THEN 2 ELSE 9 END)) AS term FROM documents WHERE doc_id % 100 = 0)
SELECT query_id, doc_id FROM q JOIN documents d ON term <> '' AND contains(lower(d.text), term)""")
def substring_search(spark, sf):
    """Documents that hold a piece of each hundredth document, through a stored index of trigrams; pieces of two signs are scanned for."""
    d = Tables(spark, sf).documents
    path = scratch_folder(spark, "trigrams")
    B.build_index(d, path, "doc_id", "text")
    size = F.when(F.col("doc_id") % 300 == 0, 2).otherwise(9)
    terms = d.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.substring(F.col("text"), F.lit(7), size).alias("term"))
    return B.search(d, path, terms, "doc_id", "text")


@query("SELECT event_id, event_type FROM events WHERE event_id IN (1, 5, 9, 13, 17) AND event_type <> '' ORDER BY event_id LIMIT 3")
def select_rows(spark, sf):
    """Rows by id, the first of them."""
    e = Tables(spark, sf).events.select(F.col("event_id").alias("id"), F.col("event_type").alias("level"))
    return E.select_rows(e, ids=[1, 5, 9, 13, 17], limit=3).select(F.col("id").alias("event_id"), F.col("level").alias("event_type"))


@query("""WITH u AS (SELECT user_id, list(event_type ORDER BY event_id) AS calls, max(value) AS m FROM events GROUP BY 1)
SELECT user_id, CASE WHEN user_id % 5 = 0 THEN (CASE WHEN list_contains(calls, 'error') THEN 0.5 ELSE 1.0 END)::DOUBLE WHEN NOT list_contains(calls, 'signup') THEN 0.0
  WHEN user_id % 3 = 0 THEN 0.5 ELSE 1.0 END AS score FROM u""")
def tool_correctness(spark, sf):
    """Whether a required call was made, about the right company."""
    e = Tables(spark, sf).events
    name = F.when(F.col("event_type") == "error", "read_filings").when(F.col("event_type") == "signup", "search").otherwise(F.col("event_type"))
    call = F.struct(name.alias("name"), F.when(F.col("user_id") % 3 == 0, "{}").otherwise('{"q": "Apple revenue"}').alias("args"), F.lit("").alias("result"))
    u = e.groupBy("user_id").agg(F.collect_list(call).alias("calls"))
    level = F.when(F.col("user_id") % 5 == 0, "trap").otherwise("easy")
    return u.select("user_id", E.tool_correctness(level, F.lit("search"), F.lit("AAPL"), F.col("calls"))["score"].alias("score"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL WHEN l_extendedprice / 1000 BETWEEN 20 AND 40 THEN 1.0::DOUBLE ELSE 0.0 END AS score FROM lineitem""")
def factual_accuracy(spark, sf):
    """Numbers of an answer against a range."""
    li = Tables(spark, sf).lineitem
    level = F.when(F.col("l_linenumber") == 7, "trap").otherwise("easy")
    answer = F.concat(F.lit("It was $"), (F.col("l_extendedprice") / 1000).cast("string"), F.lit("B in all"))
    return li.select("l_orderkey", "l_linenumber", E.factual_accuracy(level, answer, F.lit(20.0), F.lit(40.0))["score"].alias("score"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 0.0 ELSE least(1.0, value / 100) END AS score, CASE WHEN event_type = 'error' THEN 'incorrect' ELSE 'partial' END AS label FROM events""")
def judge_verdicts(spark, sf):
    """Judge answers read, malformed ones scored 0, scores clamped."""
    e = Tables(spark, sf).events
    raw = F.when(F.col("event_type") == "error", "no json").otherwise(F.concat(F.lit('{"score": '), (F.col("value") / 100).cast("string"), F.lit(', "label": "PARTIAL", "reason": "x"}')))
    v = E.parse_verdict(raw)
    return e.select("event_id", v["score"].alias("score"), v["label"].alias("label"))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def stage_totals(spark, sf):
    """Sizes of arrays of spans summed by key."""
    e = Tables(spark, sf).events.groupBy("user_id", "event_type").agg(F.collect_list("event_id").alias("s"))
    d = e.select("user_id", "event_type", F.struct(*(F.col("s").alias(c) for c in ("stage1", "deterministic", "stage2", "combined"))).alias("detections"))
    return E.stage_totals(d, ["user_id", "event_type"]).select("user_id", "event_type", F.col("combined").alias("n"))
