"""Queries of context windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import context as C
from millrace.plans.registry import Tables, query


def _events(spark, sf):
    return Tables(spark, sf).events


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS age, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type = 'view')
SELECT event_id, n > 8 AND age > 4 AS cleared, CASE WHEN n > 8 THEN 'count' END AS trigger, (CASE WHEN n > 8 AND age > 4 THEN ceil(length(props) / 3.5) ELSE 0 END)::BIGINT AS tokens_saved FROM l""")
def microcompact(spark, sf):
    """Old results cleared once there are more than eight."""
    e = _events(spark, sf).where("event_type = 'view'").select("event_id", "user_id", "props")
    return C.microcompact(e, "user_id", "event_id", "props", F.lit(True)).select("event_id", "cleared", "trigger", "tokens_saved")


@query("""WITH l AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, age::INT AS age, md5(CASE WHEN age <= 3 THEN text ELSE left(text, 20) END) AS shown_md5 FROM l WHERE age <= 10""")
def last_turns_summary(spark, sf):
    """The last turns, older ones by their summary."""
    c = Tables(spark, sf).conversations.withColumn("summary", F.substring("text", 1, 20))
    return C.recent_turns(c, "conv_id", "turn", "text", "summary").select("conv_id", "turn", "age", F.md5("shown").alias("shown_md5"))


@query("""WITH r AS (SELECT *, sum((role = 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS round FROM conversations), m AS (SELECT *, max(round) OVER (PARTITION BY conv_id) AS last FROM r)
SELECT conv_id, turn, round::BIGINT AS round FROM m WHERE round = 0 OR round > last - 2""")
def rounds_truncate(spark, sf):
    """All but the last two rounds dropped."""
    c = Tables(spark, sf).conversations
    return C.last_rounds(c, "conv_id", "turn", F.col("role") == "assistant", 2).select("conv_id", "turn", "round")


@query("""SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type""")
def consecutive_dedupe(spark, sf):
    """Events that repeat the type before them dropped."""
    return C.drop_consecutive_duplicates(_events(spark, sf), "user_id", "event_id", "event_type").select("event_id")


@query("""WITH s AS (SELECT user_id, event_id, (value * 100)::BIGINT AS size FROM events),
t AS (SELECT *, sum(size) OVER (PARTITION BY user_id) AS total, coalesce(sum(size - 2500) OVER (PARTITION BY user_id ORDER BY size DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s),
u AS (SELECT *, min(total - before) OVER (PARTITION BY user_id ORDER BY size DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS low FROM t)
SELECT event_id, total::BIGINT AS total, low > 200000 AS persisted FROM u""")
def budget_spill(spark, sf):
    """Largest results persisted until the turn fits."""
    e = _events(spark, sf).select("user_id", "event_id", F.round(F.col("value") * 100).cast("long").alias("size"))
    return C.spill_to_budget(e, "user_id", "event_id", "size").select("event_id", "total", "persisted")


@query("""WITH RECURSIVE s AS (SELECT conv_id, turn, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
f AS (SELECT conv_id, turn, n, size <= 600 AS taken, 0::BIGINT AS used_before, (CASE WHEN size <= 600 THEN size ELSE 0 END)::BIGINT AS used FROM s WHERE n = 1
  UNION ALL SELECT s.conv_id, s.turn, s.n, f.used + s.size <= 600, f.used, (f.used + CASE WHEN f.used + s.size <= 600 THEN s.size ELSE 0 END)::BIGINT FROM f JOIN s ON s.conv_id = f.conv_id AND s.n = f.n + 1)
SELECT conv_id, turn, taken, used_before FROM f""")
def greedy_pack(spark, sf):
    """Turns taken while they fit, those too long passed over."""
    c = Tables(spark, sf).conversations.withColumn("size", F.length("text"))
    return C.greedy_pack(c, "conv_id", "turn", "size", 600)


@query("""WITH s AS (SELECT user_id, event_id, event_type IN ('view', 'click') AS safe FROM events), n AS (SELECT *, NOT (safe AND coalesce(lag(safe) OVER (PARTITION BY user_id ORDER BY event_id), false)) AS new FROM s)
SELECT event_id, sum(new::INT) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS batch FROM n""")
def call_batches(spark, sf):
    """Neighbouring safe calls in one batch."""
    e = _events(spark, sf).withColumn("safe", F.col("event_type").isin("view", "click"))
    return C.call_batches(e, "user_id", "event_id", "safe").select("event_id", "batch")


@query("""WITH a AS (SELECT *, event_type = 'click' AS calls, row_number() OVER (PARTITION BY user_id, event_type = 'click' ORDER BY event_id DESC) AS age FROM events)
SELECT event_id, md5(CASE WHEN calls AND age > 2 THEN '' ELSE props END) AS content_md5 FROM a""")
def strip_old_calls(spark, sf):
    """Content of all but the last two calling rows emptied."""
    e = C.strip_old_calls(_events(spark, sf), "user_id", "event_id", "props", F.col("event_type") == "click")
    return e.select("event_id", F.md5("props").alias("content_md5"))


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS age FROM events)
SELECT event_type, count(*) AS calls, greatest(0, 2000 - count(*)) AS remaining, string_agg(props, '|' ORDER BY event_id) FILTER (age <= 3) AS last_queries FROM a GROUP BY 1""")
def tool_usage(spark, sf):
    """Calls of each tool, how many are left, and the last queries."""
    out = C.tool_usage(_events(spark, sf), "event_type", "event_id", "props", 2000)
    return out.withColumn("last_queries", F.array_join("last_queries", "|"))


@query(r"""WITH t AS (SELECT page_id, page_id % 2 AS tool, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS q FROM pages),
w AS (SELECT tool, page_id, list_filter(list_distinct(string_split(trim(regexp_replace(regexp_replace(lower(q), '[^a-z0-9_\s]', ' ', 'g'), '\s+', ' ', 'g')), ' ')), lambda x: length(x) > 2) AS w FROM t),
p AS (SELECT a.tool, a.page_id, b.page_id AS earlier, len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) AS s FROM w a JOIN w b ON a.tool = b.tool AND b.page_id < a.page_id AND len(list_intersect(a.w, b.w)) > 0)
SELECT tool, page_id, min(earlier) AS earlier, round(arg_min(s, earlier), 6) AS similarity FROM p WHERE s >= 0.7 - 1e-9 GROUP BY ALL""")
def similar_queries(spark, sf):
    """Titles of pages as queries of two tools: those that resemble an earlier one of their tool."""
    p = Tables(spark, sf).pages.select("page_id", (F.col("page_id") % 2).alias("tool"), F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("q"))
    return C.similar_queries(p, "tool", "page_id", "q", 0.7).withColumn("similarity", F.round("similarity", 6))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS age FROM events) WHERE age <= 50")
def last_log_lines(spark, sf):
    """The newest fifty rows of each log."""
    return C.last_log_lines(_events(spark, sf), "user_id", "event_id").select("event_id")


@query("""SELECT a.event_id AS call_id, b.props AS result, coalesce(a.props, b.props) AS args, epoch_us(b.ts) // 1000 - epoch_us(a.ts) // 1000 AS duration_ms
FROM (SELECT * FROM events WHERE event_type NOT IN ('purchase', 'error')) a LEFT JOIN (SELECT * FROM events WHERE event_type IN ('purchase', 'error')) b ON b.event_id = a.event_id + 1""")
def tool_event_correlation(spark, sf):
    """Starts of calls with their ends."""
    e = _events(spark, sf)
    s = e.where("event_type NOT IN ('purchase', 'error')").select(F.col("event_id").alias("call_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("props").alias("args"))
    x = e.where("event_type IN ('purchase', 'error')").select((F.col("event_id") - 1).alias("call_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("props").alias("args"), F.col("props").alias("result"), F.lit(None).cast("string").alias("error"))
    return C.correlate_calls(s, x).select("call_id", "result", "args", "duration_ms")


@query("SELECT a.event_id AS call_id, coalesce(b.props, 'Skipped') AS result FROM events a LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') b USING (event_id)")
def results_in_order(spark, sf):
    """Each call with its result or Skipped."""
    e = _events(spark, sf).select(F.col("event_id").alias("call_id"), F.col("props").alias("result"), "event_type")
    return C.results_in_order(e.select("call_id"), e.where("event_type = 'view'"))


@query("""SELECT event_type, sum(floor(value))::BIGINT AS tokens, round(nullif(sum(floor(value)), 0)::DOUBLE / (nullif(sum(event_id % 100), 0) / 1000), 4) AS tokens_per_s FROM events GROUP BY 1""")
def token_totals(spark, sf):
    """Tokens and tokens a second."""
    e = _events(spark, sf).withColumns({"t": F.floor("value").cast("long"), "ms": F.col("event_id") % 100})
    return C.token_totals(e, ["event_type"], "t", "ms").withColumn("tokens_per_s", F.round("tokens_per_s", 4))


@query("""SELECT event_id, ordinal::INT AS ordinal, md5(CASE WHEN list_contains([3, 5, 8], ordinal) THEN '[Old tool result cleared]' ELSE props END) AS content_md5
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS ordinal FROM events) WHERE ordinal > 2""")
def live_after_boundary(spark, sf):
    """Rows after a compaction boundary, cleared ones as placeholders."""
    e = _events(spark, sf).withColumns({"boundary": F.lit(2), "cleared": F.array(F.lit(3), F.lit(5), F.lit(8))})
    return C.live_after(e, "user_id", "event_id", "boundary", "cleared", "props").select("event_id", "ordinal", F.md5("props").alias("content_md5"))


@query("SELECT conv_id, left(string_agg(coalesce(text, ''), chr(10) || '---' || chr(10) ORDER BY turn), 500) AS text FROM conversations GROUP BY 1")
def joined_text(spark, sf):
    """Texts of a conversation in order, cut."""
    return C.joined_text(Tables(spark, sf).conversations.na.fill("", ["text"]), "conv_id", "turn", "text", "\n---\n", 500)


@query("""SELECT conv_id, turn, CASE WHEN length(text) > 200 THEN length('[Result stored in ' || conv_id || '_' || turn || ', ' || length(text) || ' chars]' || chr(10)) + 2000 - greatest(0, 2000 - length(text)) ELSE length(text) END AS shown FROM conversations""")
def result_spill(spark, sf):
    """Long results replaced by a preview."""
    c = Tables(spark, sf).conversations
    shown, _ = C.spill(c, "text", F.concat_ws("/", "conv_id", "turn"), cap=200)
    return shown.select("conv_id", "turn", F.length("text").cast("long").alias("shown"))
