"""Queries of audits: stages of the guard, datasets and their faults, judges, nested values, caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import registry as Y
from millrace.functions import stats
from millrace.operators import evals as E
from millrace.operators import guard as G
from millrace.operators import messaging as M
from millrace.plans.registry import Tables, query
from millrace.sources import stores


def _events(spark, sf):
    return Tables(spark, sf).events


def _spans(size, first=None):
    """That many spans, one after another."""
    start = F.lit(0) if first is None else first
    return F.transform(F.filter(F.sequence(F.lit(1), F.lit(4)), lambda i: i <= size), lambda i: F.struct((start + i).cast("int").alias("start"), (start + i + 1).cast("int").alias("end")))


def _reports(spark, sf):
    """Events as rows of a guard's report: 0 to 2 spans of each stage, combined those of both."""
    u, e = F.col("user_id"), F.col("event_id")
    one, two = _spans(u % 3), _spans(e % 3, F.lit(1))
    d = F.struct(one.alias("stage1"), _spans(F.lit(0)).alias("deterministic"), two.alias("stage2"), F.array_union(one, two).alias("combined"))
    blocked = F.struct((u % 2 == 0).alias("blocked"), (e % 2 == 0).alias("expected_blocked"))
    return _events(spark, sf).select("event_id", d.alias("detections"), (F.col("event_type") == "view").alias("stage2_only"), F.when(F.col("event_type") != "click", blocked).alias("output_guard"))


@query("""SELECT count(*) FILTER (event_type <> 'click') AS tested, count(*) FILTER (event_type <> 'click' AND user_id % 2 = 0) AS blocked,
  count(*) FILTER (event_type <> 'click' AND event_id % 2 = 0 AND user_id % 2 <> 0) AS leaked FROM events""")
def output_guard_counts(spark, sf):
    """Answers tested, blocked and leaked."""
    return E.output_guard_report(_reports(spark, sf))


@query("""WITH c AS (SELECT count(*) FILTER (user_id % 3 = 0 AND event_id % 3 > 0) AS caught, count(*) FILTER (user_id % 3 = 0 AND event_id % 3 = 0) AS missed, count(*) FILTER (user_id % 3 > 0) AS leaked_earlier FROM events WHERE event_type = 'view')
SELECT *, round(CASE WHEN caught + missed > 0 THEN caught / (caught + missed) ELSE 0 END, 9) AS recall FROM c""")
def second_stage_audit(spark, sf):
    """What only the second stage should find."""
    return E.stage2_audit(_reports(spark, sf)).withColumn("recall", F.round("recall", 9))


@query("""WITH s AS (SELECT event_id, unnest(list_filter([1, 2], lambda i: i <= user_id % 3)) AS s FROM events), t AS (SELECT event_id, 1 + unnest(list_filter([1, 2], lambda i: i <= event_id % 3)) AS s FROM events)
SELECT count(*) AS stage1_only FROM s ANTI JOIN t USING (event_id, s)""")
def first_stage_share(spark, sf):
    """Spans that the second stage did not find."""
    return E.stage1_share(_reports(spark, sf))


@query("""SELECT event_id, event_type = 'error' AND (user_id % 3 = 0 OR user_id % 3 = 1) AS truth FROM events""")
def first_stage_truth(spark, sf):
    """Whether the first stage alone should find something."""
    stage = F.when(F.col("user_id") % 3 > 0, F.col("user_id") % 3)
    return _events(spark, sf).select("event_id", G.stage1_truth(F.col("event_type") == "error", stage).alias("truth"))


_SCALED = """WITH w AS (SELECT event_id, event_type, value, min(value) OVER (PARTITION BY event_type) AS low, max(value) OVER (PARTITION BY event_type) AS high FROM events)"""


@query(f"{_SCALED} SELECT event_id, round(CASE WHEN high > low THEN (value - low) / (high - low) ELSE 1 END, 9) AS scaled, round((high - value) * 100, 6) AS pp, CASE WHEN high > value THEN '▲' WHEN high < value THEN '▼' ELSE '—' END AS arrow FROM w")
def scaled_scores(spark, sf):
    """Scores scaled within their kind, and the change up to the best of it."""
    e = _events(spark, sf)
    bounds = e.groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    v, high = F.col("value"), F.col("high")
    j = e.join(bounds, "event_type")
    return j.select("event_id", F.round(stats.min_max(v, F.col("low"), high), 9).alias("scaled"), F.round(stats.delta_pp(v, high), 6).alias("pp"), F.substring(stats.delta_label(v, high), 1, 1).alias("arrow"))


_CATEGORY = "['clean', 'direct', 'obfuscated', 'cross_session', 'prompt_injection'][n % 5 + 1]"
_ROWS = f"""d AS (SELECT doc_id + 1 AS n, doc_id, text, source, lang FROM documents),
r AS (SELECT CASE WHEN source = 'src0' THEN 'F7' WHEN source = 'src1' THEN source || n ELSE 'F' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INT, '0') END AS id, n AS ord, {_CATEGORY} AS category,
  text AS input, n % 5 > 0 AS contains_pii, CASE WHEN n % 5 > 0 AND source <> 'src2' THEN ['EMAIL'] ELSE [] END AS pii_types,
  CASE WHEN source = 'src3' THEN 'plain' WHEN n % 5 > 0 OR source = 'src4' THEN '[REDACTED_EMAIL]' ELSE text END AS expected_masked, CASE WHEN source <> 'src5' THEN 'note' END AS trap_note,
  CASE WHEN n % 5 = 0 AND source <> 'src6' THEN 'clean' END AS sensitivity_class, CASE WHEN (n % 5 = 2) <> (source = 'src7') THEN 'spaced' END AS obfuscation_pattern, (n % 5 = 2) <> (source = 'src8') AS stage2_only,
  CASE WHEN source = 'src9' THEN NULL WHEN n % 5 = 2 THEN 2 ELSE 1 END AS requires_stage, CASE WHEN n % 5 > 2 AND source <> 'src10' THEN 'seed' END AS memory_seed, source <> 'src11' AS expected_response_blocks_pii,
  CASE WHEN n % 5 = 4 AND source <> 'src12' THEN 'system_tag' END AS injection_type, CASE WHEN source = 'src13' THEN 'an internal log' ELSE 'made up' END AS source_basis FROM d)"""
_RULES = [
    ("id <> 'F' || lpad(ord::VARCHAR, greatest(3, length(ord::VARCHAR))::INT, '0')", "id is not sequential"), ("contains_pii AND len(pii_types) = 0", "personal data without types"),
    ("contains_pii AND len(pii_types) > 0 AND expected_masked <> '[REDACTED_EMAIL]'", "a type has no redaction tag"), ("contains_pii AND expected_masked <> '[REDACTED_EMAIL]'", "personal data without redaction"),
    ("NOT contains_pii AND len(pii_types) > 0", "types without personal data"), ("NOT contains_pii AND expected_masked = '[REDACTED_EMAIL]'", "redaction without personal data"),
    ("NOT contains_pii AND expected_masked <> input", "a clean row is changed by its mask"), ("category = 'clean' AND trap_note IS NULL", "a clean row needs a note"),
    ("category = 'clean' AND sensitivity_class IS DISTINCT FROM 'clean'", "a clean row has another class"), ("category = 'direct' AND obfuscation_pattern IS NOT NULL", "a direct row names a pattern"),
    ("category = 'direct' AND stage2_only", "a direct row is for stage 2 only"), ("category = 'direct' AND requires_stage IS NULL", "a direct row needs a stage"),
    ("category = 'obfuscated' AND obfuscation_pattern IS NULL", "an obfuscated row needs a pattern"), ("category = 'obfuscated' AND requires_stage IS DISTINCT FROM 2", "an obfuscated row requires stage 2"),
    ("category = 'obfuscated' AND NOT stage2_only", "an obfuscated row is for stage 2 only"), ("category IN ('cross_session', 'prompt_injection') AND memory_seed IS NULL", "a seed is missing"),
    ("category IN ('cross_session', 'prompt_injection') AND NOT expected_response_blocks_pii", "the answer must be blocked"), ("category = 'prompt_injection' AND injection_type IS NULL", "the kind of injection is missing"),
    ("source_basis = 'an internal log'", "the source is real data"), ("row_number() OVER (PARTITION BY id ORDER BY ord) > 1", "duplicate id"), ("row_number() OVER (PARTITION BY input ORDER BY ord) > 1", "duplicate input"),
]


def _dataset(spark, sf):
    """Documents as rows of a dataset, numbered by id, with faults by source."""
    d = Tables(spark, sf).documents.withColumn("n", F.col("doc_id") + 1)
    m, src = F.col("n") % 5, F.col("source")
    key = F.when(src == "src0", "F7").when(src == "src1", F.concat(src, F.col("n").cast("string"))).otherwise(F.format_string("F%03d", F.col("n")))
    text = F.col("text")
    category = F.element_at(F.array(*map(F.lit, ("clean", "direct", "obfuscated", "cross_session", "prompt_injection"))), (m + 1).cast("int"))
    return d.select(
        key.alias("id"), F.col("n").alias("ord"), category.alias("category"), text.alias("input"), (m > 0).alias("contains_pii"),
        F.when((m > 0) & (src != "src2"), F.array(F.lit("EMAIL"))).otherwise(F.array().cast("array<string>")).alias("pii_types"),
        F.when(src == "src3", "plain").when((m > 0) | (src == "src4"), "[REDACTED_EMAIL]").otherwise(text).alias("expected_masked"),
        F.when(src != "src5", "note").alias("trap_note"), F.when((m == 0) & (src != "src6"), "clean").alias("sensitivity_class"),
        F.when((m == 2) != (src == "src7"), "spaced").alias("obfuscation_pattern"), ((m == 2) != (src == "src8")).alias("stage2_only"),
        F.when(src != "src9", F.when(m == 2, 2).otherwise(1)).alias("requires_stage"), F.when((m > 2) & (src != "src10"), "seed").alias("memory_seed"),
        (src != "src11").alias("expected_response_blocks_pii"), F.when((m == 4) & (src != "src12"), "system_tag").alias("injection_type"),
        F.when(src == "src13", "an internal log").otherwise("made up").alias("source_basis"),
    )


@query(f"WITH {_ROWS}, f AS (SELECT id, [{', '.join(f'CASE WHEN {c} THEN {chr(39)}{m}{chr(39)} END' for c, m in _RULES)}] AS fs FROM r), u AS (SELECT id, unnest(fs) AS fault FROM f) SELECT id, fault FROM u WHERE fault IS NOT NULL")
def dataset_faults(spark, sf):
    """Faults of the rows of a dataset."""
    return E.dataset_faults(_dataset(spark, sf))


@query("""WITH q AS (SELECT o_orderkey AS id, ['trap', 'easy', 'hard'][o_orderkey % 3 + 1] AS level, ['margin', 'price_lookup', 'unavailable_price_data', 'growth'][o_custkey % 4 + 1] AS category,
  CASE WHEN o_orderstatus <> 'P' THEN o_custkey || ' / (' || o_orderkey || ' + 1) * 100' END AS formula, CASE WHEN o_orderstatus <> 'P' THEN o_custkey::DOUBLE / (o_orderkey + 1) * 100 END AS v,
  CASE WHEN o_custkey % 5 > 0 THEN 10.0 END AS low, CASE WHEN o_custkey % 5 > 0 THEN 10.0 + (o_orderkey % 7 - 1) * 2 END AS high, CASE WHEN o_orderkey % 5 > 0 THEN 'get_market_data' END AS tool FROM orders),
f AS (SELECT *, (low + high) / 2 AS mid, formula IS NOT NULL AS has FROM q),
w AS (SELECT *, CASE WHEN mid <> 0 THEN (high - low) / abs(mid) * 100 ELSE high - low END AS width FROM f),
r AS (SELECT id, unnest([CASE WHEN has AND low IS NULL THEN 'warn:a formula without a range' END, CASE WHEN has AND low IS NOT NULL AND NOT v BETWEEN low AND high THEN 'error:the formula lies outside the range' END,
  CASE WHEN low >= high THEN 'error:the range is inverted' END, CASE WHEN low < high AND width > 30 THEN 'warn:the range is very wide' END, CASE WHEN low < high AND width < 0.1 THEN 'warn:the range is very tight' END,
  CASE WHEN category = 'price_lookup' AND tool IS NULL THEN 'error:a price needs market data' END, CASE WHEN category = 'unavailable_price_data' AND level <> 'trap' THEN 'error:unavailable data must be a trap' END,
  CASE WHEN category = 'unavailable_price_data' AND level = 'trap' AND tool IS NOT NULL THEN 'error:a trap for unavailable data has a tool' END, CASE WHEN category = 'margin' AND NOT has AND level <> 'trap' THEN 'warn:a ratio without a formula' END,
  CASE WHEN level = 'trap' AND tool IS NOT NULL THEN 'warn:a trap has a tool' END, CASE WHEN level <> 'trap' AND tool IS NULL THEN 'error:a question without a tool' END,
  CASE WHEN level = 'trap' THEN 'warn:a trap''s answer does not refuse' END, CASE WHEN level = 'trap' AND category <> 'unavailable_price_data' THEN 'warn:an unknown kind of trap' END]) AS m FROM w)
SELECT id, split_part(m, ':', 1) AS severity, split_part(m, ':', 2) AS message FROM r WHERE m IS NOT NULL""")
def dataset_warnings(spark, sf):
    """Errors and warnings of a question dataset; formulas are computed."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    q = Tables(spark, sf).orders.select(
        k.alias("id"), pick(("trap", "easy", "hard"), k % 3).alias("level"), pick(("margin", "price_lookup", "unavailable_price_data", "growth"), c % 4).alias("category"),
        F.when(F.col("o_orderstatus") != "P", F.concat_ws(" ", c.cast("string"), F.lit("/ ("), k.cast("string"), F.lit("+ 1) * 100"))).alias("formula"),
        F.when(c % 5 > 0, 10.0).alias("low"), F.when(c % 5 > 0, 10.0 + (k % 7 - 1) * 2).alias("high"), F.when(k % 5 > 0, "get_market_data").alias("required_tool"), F.lit("yes").alias("answer"),
    )
    return E.dataset_lint(q)


@query("""SELECT o_orderkey, round((o_totalprice / (o_custkey + 1) - 1) * 100, 6) AS value FROM orders""")
def formula_values(spark, sf):
    """Formulas computed without running code."""
    f = F.concat(F.lit("("), F.col("o_totalprice").cast("string"), F.lit("/("), F.col("o_custkey").cast("string"), F.lit("+1)-1)*100"))
    return Tables(spark, sf).orders.select("o_orderkey", F.round(E.formula_value(f), 6).alias("value"))


@query("""SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 0.0 ELSE value END AS grounded, CASE WHEN event_type = 'error' THEN value END AS refused, CASE WHEN event_type = 'view' THEN 0.5 ELSE value END AS plan,
  CASE WHEN event_type = 'error' THEN value ELSE 1.0 END AS batch, CASE WHEN user_id % 3 = 0 THEN '' WHEN user_id % 3 = 1 THEN event_type ELSE event_type || ',x' END AS names FROM events""")
def judged_scores(spark, sf):
    """Scores of judges, and what stands in where they do not apply."""
    verdict = F.struct(F.col("value").alias("score"), F.lit("partial").alias("label"), F.lit("").alias("explanation"))
    kind, u = F.col("event_type"), F.col("user_id")
    call = lambda n: F.struct(n.alias("name"), F.lit("").alias("args"), F.lit("r").alias("result"))
    calls = F.filter(F.array(call(kind), call(F.lit("x")), call(kind)), lambda c, i: i < (u % 3) + F.when(u % 3 == 2, 1).otherwise(0))
    refused = E.refusal(F.when(kind == "error", "trap").otherwise("easy"), verdict)
    plan = F.when(kind == "view", " ").otherwise("first, then")
    return _events(spark, sf).select(
        "event_id", E.groundedness(calls, verdict)["score"].alias("grounded"), refused["score"].alias("refused"), E.plan_quality(plan, verdict)["score"].alias("plan"),
        E.not_applicable(refused, "skipped")["score"].alias("batch"), F.array_join(Y.distinct_names(calls), ",").alias("names"),
    )


@query(r"""WITH e AS (SELECT doc_id, coalesce(nullif(regexp_extract(text, '\b[a-z]{3,8}@[a-z]{3,10}\.com\b', 0), ''), 'nobody') AS m FROM documents)
SELECT doc_id, 'to ' || CASE WHEN m <> 'nobody' THEN '[REDACTED_EMAIL]' ELSE m END AS inner_text, CASE WHEN m <> 'nobody' THEN '[REDACTED_EMAIL]' ELSE m END AS sensitive, m AS other, CASE WHEN m <> 'nobody' THEN '1' END AS redacted FROM e""")
def nested_redaction(spark, sf):
    """Texts masked in nested values, and in sensitive span attributes only."""
    mail = F.coalesce(F.nullif(F.regexp_extract("text", r"\b[a-z]{3,8}@[a-z]{3,10}\.com\b", 0), F.lit("")), F.lit("nobody"))
    d = Tables(spark, sf).documents.select("doc_id", mail.alias("m"))
    d = d.select("doc_id", F.struct(F.array(F.struct(F.concat(F.lit("to "), "m").alias("t"), F.lit(1).alias("n"))).alias("a")).alias("nested"), F.create_map(F.lit("input.value"), F.col("m"), F.lit("tool.name"), F.col("m")).alias("attributes"))
    out = G.redact_attributes(G.sanitise(d, ["nested"]))
    at = lambda k: F.try_element_at("attributes", F.lit(k))
    return out.select("doc_id", F.col("nested.a")[0]["t"].alias("inner_text"), at("input.value").alias("sensitive"), at("tool.name").alias("other"), at("pii.redacted.count").alias("redacted"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND epoch_ms(o_orderdate) <= epoch_ms(timestamp '1997-01-01')")
def due_jobs(spark, sf):
    """Enabled jobs whose time has come."""
    j = Tables(spark, sf).orders.select("o_orderkey", (F.col("o_orderstatus") != "P").alias("enabled"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("next_run_ms"))
    return M.due_jobs(j, F.unix_millis(F.lit("1997-01-01 00:00:00").cast("timestamp"))).select("o_orderkey")


@query("SELECT arg_max(event_id, event_id) AS session_key, max(event_id) AS updated_at, arg_max(event_type, event_id) AS last_to FROM events WHERE event_type NOT IN ('error', 'view')")
def last_session(spark, sf):
    """The session updated last that has a target."""
    to = F.when(F.col("event_type") == "view", "").when(F.col("event_type") != "error", F.col("event_type"))
    return M.last_target(_events(spark, sf).select(F.col("event_id").alias("session_key"), F.col("event_id").alias("updated_at"), to.alias("last_to")))


@query("WITH l AS (SELECT lower(event_type) || user_id AS key, max(event_id) AS cached_at FROM events GROUP BY 1) SELECT key, cached_at FROM l ORDER BY cached_at DESC, key LIMIT 100")
def bounded_cache(spark, sf):
    """The newest entries of a cache of a hundred, keys whatever their case."""
    key = F.concat(F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")), F.col("user_id").cast("string"))
    return stores.latest_entries(_events(spark, sf).select(key.alias("key"), F.col("event_id").alias("cached_at"))).select("key", "cached_at")


@query("""SELECT event_id FROM events WHERE event_type <> 'error' AND user_id % 4 > 0 AND epoch_ms(ts) BETWEEN epoch_ms(timestamp '2024-01-30') - 86400000 AND epoch_ms(timestamp '2024-01-30')
  OR event_type <> 'error' AND user_id % 4 > 0 AND ts > timestamp '2024-01-30'""")
def fresh_entries(spark, sf):
    """Cache entries that are well formed and young enough."""
    data = F.when(F.col("user_id") % 4 == 0, "text").otherwise(F.lit(' [1]'))
    c = _events(spark, sf).select("event_id", F.when(F.col("event_type") != "error", "/p/").alias("endpoint"), F.lit("http://a").alias("url"), data.alias("data"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("cached_at"))
    return stores.fresh(c, F.lit("2024-01-30 00:00:00").cast("timestamp"), 86_400).select("event_id")
