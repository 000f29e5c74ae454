"""Queries of message policies, jobs and streams (batch twins of the streaming operators)."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions import timefns as TF
from millrace.operators import messaging as M
from millrace.plans.registry import Tables, query
from millrace.streaming import ops as S
from millrace.streaming import ordered as O


def _events(spark, sf):
    return Tables(spark, sf).events


@query("""SELECT event_id AS id, CASE WHEN event_type = 'click' AND user_id = 7 THEN 'a_peer' WHEN event_type = 'click' AND event_id % 2 = 0 THEN 'a_acct' WHEN event_type = 'click' THEN 'a_star' WHEN event_type = 'view' THEN 'a_chan' ELSE 'default' END AS agent_id,
CASE WHEN event_type = 'click' AND user_id = 7 THEN 'binding.peer' WHEN event_type = 'click' THEN 'binding.account' WHEN event_type = 'view' THEN 'binding.channel' ELSE 'default' END AS matched_by FROM events""")
def route_priority(spark, sf):
    """Routes by peer, account and channel bindings."""
    e = _events(spark, sf)
    m = e.select(F.col("event_id").alias("id"), F.upper("event_type").alias("channel"), F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd").alias("account_id"), F.lit("user").alias("peer_kind"), F.col("user_id").cast("string").alias("peer_id"))
    rows = [(1, "a_acct", "click", "even", None, None), (2, "a_star", "click", "*", None, None), (3, "a_chan", "View", None, None, None), (4, "a_peer", "click", None, "user", "7")]
    b = spark.createDataFrame(rows, "ord int, agent_id string, channel string, account_id string, peer_kind string, peer_id string")
    return M.route(m, b).select("id", "agent_id", "matched_by")


@query("""WITH m AS (SELECT event_id, user_id, event_type IN ('click', 'view') AS g, user_id % 4 AS gp, event_id % 4 AS dp, event_type = 'error' AS mine, user_id % 6 IN (0, 1) AS listed FROM events)
SELECT event_id, CASE
 WHEN g AND gp NOT IN (0, 1) THEN 'group_policy_not_permissive' WHEN g AND gp = 1 AND NOT (user_id % 6 = 0) THEN 'group_sender_not_allowlisted' WHEN g THEN NULL
 WHEN dp = 3 THEN 'dm_policy_disabled' WHEN mine THEN 'outbound_dm_to_non_self' WHEN dp <> 2 AND NOT listed THEN 'dm_sender_not_allowlisted' END AS reason FROM m""")
def access_policy(spark, sf):
    """Decisions on inbound messages."""
    e = _events(spark, sf)
    phone = F.concat(F.lit("+1 555 "), (F.col("user_id") % 6).cast("string"))
    m = e.select(
        "event_id", F.lit("+999").alias("own"), phone.alias("frm"), phone.alias("sender"), F.col("event_type").isin("click", "view").alias("grp"), (F.col("event_type") == "error").alias("mine"),
        F.element_at(F.array(*map(F.lit, ("pairing", "allowlist", "open", "disabled"))), (F.col("event_id") % 4 + 1).cast("int")).alias("dm"),
        F.element_at(F.array(*map(F.lit, ("open", "allowlist", "disabled", "other"))), (F.col("user_id") % 4 + 1).cast("int")).alias("gp"),
        F.array(F.lit("15550"), F.lit("whatsapp:+1-555-1")).alias("allow"), F.array(F.lit("+15550")).alias("gallow"),
    )
    return m.select("event_id", M.access("own", "frm", "sender", "grp", "mine", "dm", "gp", "allow", "gallow")["reason"].alias("reason"))


@query("""SELECT event_id, dayofweek(t) BETWEEN 1 AND 5 AND strftime(t, '%H:%M') BETWEEN '09:30' AND '16:00' AS active FROM (SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS t FROM events)""")
def active_hours(spark, sf):
    """Whether events lie in New York's trading hours."""
    return _events(spark, sf).select("event_id", TF.active_hours(F.col("ts")).alias("active"))


@query("""SELECT event_id, (CASE WHEN ms < a THEN a ELSE a + (floor((ms - a)::DOUBLE / 900000)::BIGINT + 1) * 900000 END)::BIGINT AS next_ms FROM (SELECT event_id, epoch_us(ts) // 1000 AS ms, 1704067200000 + (user_id % 5) * 86400000 AS a FROM events)""")
def next_run_every(spark, sf):
    """Next runs of periodic jobs with an anchor."""
    e = _events(spark, sf).select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), (F.lit(1704067200000) + (F.col("user_id") % 5) * 86400000).alias("a"))
    return e.select("event_id", TF.next_every(F.col("ms"), F.lit(900_000), F.col("a")).alias("next_ms"))


@query("""SELECT event_id, (CASE WHEN n = 0 THEN 0 ELSE [30000, 60000, 300000, 900000, 3600000][least(n, 5)] END)::INT AS error_ms, least(30000.0, round(2000 * pow(1.8, greatest(n - 1, 0)))) AS reconnect_ms FROM (SELECT event_id, (event_id % 9)::INT AS n FROM events)""")
def backoff_ladder(spark, sf):
    """Waits after errors and lost connections."""
    n = (F.col("event_id") % 9).cast("int")
    return _events(spark, sf).select("event_id", TF.error_backoff_ms(n).alias("error_ms"), TF.reconnect_delay_ms(n).alias("reconnect_ms"))


@query("""SELECT event_id, ['rate_limit', 'context_overflow', 'billing', 'auth', 'timeout', 'overloaded', 'unknown', 'rate_limit'][event_id % 8 + 1] AS class FROM events""")
def error_classify(spark, sf):
    """Classes of error messages."""
    texts = ["HTTP 429 Too Many Requests", "Prompt is too long", "status: 402", "Invalid API-key: 401", "deadline exceeded", "Service Unavailable", "oops", "maximum context length, TPM limit"]
    t = F.element_at(F.array(*map(F.lit, texts)), (F.col("event_id") % 8 + 1).cast("int"))
    return _events(spark, sf).select("event_id", M.error_class(t).alias("class"))


_SENDER = "CASE event_type WHEN 'click' THEN 'whatsapp:++1-' || user_id WHEN 'view' THEN '(1) ' || user_id ELSE '+1' || user_id % 20 || ' ' || event_id % 10 END"
_NUMBER = "'+' || regexp_replace(replace({0}, 'whatsapp:', ''), '[^0-9]', '', 'g')"


def _sender():
    u, e, kind = F.col("user_id"), F.col("event_id"), F.col("event_type")
    return F.when(kind == "click", F.concat(F.lit("whatsapp:++1-"), u.cast("string"))).when(kind == "view", F.concat(F.lit("(1) "), u.cast("string"))).otherwise(
        F.concat(F.lit("+1"), (u % 20).cast("string"), F.lit(" "), (e % 10).cast("string")))


@query(f"""WITH s AS (SELECT event_id, {_NUMBER.format(_SENDER)} AS number, ['1 ' || event_id % 30, '+1-' || user_id % 50 || '0', CASE WHEN event_id % 11 = 0 THEN '*' ELSE '7' END] AS allow FROM events)
SELECT event_id, list_contains(allow, '*') OR len(list_filter(allow, lambda a: a <> '*' AND {_NUMBER.format('a')} = number)) > 0 AS listed, number FROM s""")
def allow_list(spark, sf):
    """Numbers on a list, whatever their spelling, or let in by a star."""
    u, e = F.col("user_id"), F.col("event_id")
    listed = F.array(F.concat(F.lit("1 "), (e % 30).cast("string")), F.concat(F.lit("+1-"), (u % 50).cast("string"), F.lit("0")), F.when(e % 11 == 0, "*").otherwise("7"))
    return _events(spark, sf).select("event_id", M.allowed_phone(_sender(), listed).alias("listed"), X.e164(_sender()).alias("number"))


@query("""WITH m AS (SELECT event_id, [user_id || ':' || event_id % 7 || '@lid', '@lid'] AS ids, [event_id % 40 || '@lid', (user_id + 1) || '@s.whatsapp.net'] AS own, '+1555' || user_id AS phone, 'ask ' || '1555' || (user_id + event_id % 2) || ' now' AS body FROM events),
b AS (SELECT *, list_filter(list_transform(ids, lambda j: split_part(split_part(j, '@', 1), ':', 1)), lambda j: j <> '') AS i, list_transform(own, lambda j: split_part(split_part(j, '@', 1), ':', 1)) AS o FROM m)
SELECT event_id, list_has_any(i, o) OR (length(phone) - 1 >= 7 AND contains(body, substr(phone, 2))) AS mentioned FROM b""")
def mentions(spark, sf):
    """Messages that address the bot, by id or by seven digits or more of its number."""
    u, e = F.col("user_id"), F.col("event_id")
    text = lambda c: c.cast("string")
    ids = F.array(F.concat(text(u), F.lit(":"), text(e % 7), F.lit("@lid")), F.lit("@lid"))
    own = F.array(F.concat(text(e % 40), F.lit("@lid")), F.concat(text(u + 1), F.lit("@s.whatsapp.net")))
    body = F.concat(F.lit("ask 1555"), text(u + e % 2), F.lit(" now"))
    return _events(spark, sf).select("event_id", M.mentioned(ids, own, F.concat(F.lit("+1555"), text(u)), body).alias("mentioned"))


@query("SELECT event_id, ['empty', 'ok-token', 'no-action', 'none', 'ok-token', 'none'][event_id % 6 + 1] AS reason, ['', '', 'No action needed today', 'Sell now', '', 'News'][event_id % 6 + 1] AS cleaned FROM events")
def alert_suppression(spark, sf):
    """Why alerts are held back."""
    texts = [" \n", "**HEARTBEAT_OK**.", "No action needed today", "Sell now HEARTBEAT_OK", "HEARTBEAT_OK HEARTBEAT_OK", "News"]
    t = F.element_at(F.array(*map(F.lit, texts)), (F.col("event_id") % 6 + 1).cast("int"))
    return _events(spark, sf).select("event_id", M.suppression(t).alias("s")).select("event_id", "s.reason", "s.cleaned")


@query("SELECT DISTINCT o_custkey AS group_id, o_orderkey AS member_id FROM orders")
def roster_union(spark, sf):
    """The roster and those participants it lacks."""
    o = Tables(spark, sf).orders.select(F.col("o_custkey").alias("group_id"), F.col("o_orderkey").alias("member_id"), "o_orderstatus")
    return M.roster_union(o.where("o_orderstatus = 'F'").drop("o_orderstatus"), o.drop("o_orderstatus"))


@query("""SELECT user_id AS group_id, event_type AS member_id, arg_max(props, ts) AS name FROM events GROUP BY ALL""")
def latest_names(spark, sf):
    """Last name of each member."""
    e = _events(spark, sf).select(F.col("user_id").alias("group_id"), F.col("event_type").alias("member_id"), F.col("props").alias("name"), "ts")
    return M.latest_names(e).drop("ts")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY (role <> 'user')::INT, turn)::INT AS rank FROM conversations")
def queue_drain(spark, sf):
    """Queued messages by priority and time."""
    c = Tables(spark, sf).conversations
    q = c.select("conv_id", "turn", F.when(F.col("role") == "user", "next").otherwise("later").alias("priority"), F.col("turn").alias("enqueued_at"), F.lit("x").alias("text"))
    return M.drain(q, "conv_id").select("conv_id", "turn", "rank")


@query("SELECT min(o_orderkey) * 1000 AS next_run_ms, least(60000, greatest(0, min(o_orderkey) * 1000 - 500)) AS delay_ms FROM orders WHERE o_orderstatus = 'F'")
def earliest_run(spark, sf):
    """Earliest job and the timer's delay."""
    j = Tables(spark, sf).orders.select((F.col("o_orderstatus") == "F").alias("enabled"), (F.col("o_orderkey") * 1000).alias("next_run_ms"))
    return M.earliest_run(j, F.lit(500).cast("long"))


@query("""WITH j AS (SELECT event_id, event_id % 2 = 0 AS is_at, event_type <> 'error' AS ok, (user_id % 4)::INT AS e, 1000000 + event_id AS nx FROM events),
k AS (SELECT *, CASE WHEN ok THEN 0 ELSE e + 1 END AS errors FROM j)
SELECT event_id, errors::INT AS consecutive_errors, NOT ((ok AND is_at) OR (NOT ok AND is_at AND errors >= 3)) AS enabled,
(CASE WHEN (ok AND is_at) OR (NOT ok AND is_at AND errors >= 3) THEN NULL WHEN ok THEN nx WHEN is_at THEN 1000 + [30000, 60000, 300000, 900000, 3600000][least(errors, 5)] ELSE greatest(nx, 1000 + [30000, 60000, 300000, 900000, 3600000][least(errors, 5)]) END)::BIGINT AS next_run_ms FROM k""")
def job_states(spark, sf):
    """State of jobs after a run."""
    j = _events(spark, sf).select(
        "event_id", F.when(F.col("event_id") % 2 == 0, "at").otherwise("every").alias("kind"), (F.col("event_type") != "error").alias("ok"), (F.col("user_id") % 4).cast("int").alias("consecutive_errors"),
        (F.lit(1_000_000) + F.col("event_id")).alias("next_normal_ms"), F.lit(False).alias("schedule_failed"), F.lit(0).alias("schedule_errors"), F.lit("keep").alias("fulfillment"),
    )
    return M.after_run(j, F.lit(1000).cast("long")).select("event_id", "consecutive_errors", "enabled", "next_run_ms")


@query("SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'agent:a:main' ELSE 'agent:a:' || event_type || ':acc:group:' || user_id END AS session_key FROM events")
def session_keys(spark, sf):
    """Keys of sessions."""
    peer = F.when(F.col("user_id") % 2 == 1, F.concat(F.lit(" "), F.col("user_id").cast("string")))
    return _events(spark, sf).select("event_id", M.session_key(F.lit("a"), F.col("event_type"), F.lit("acc"), F.lit("group"), peer).alias("session_key"))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def dedupe_first_seen(spark, sf):
    """First event of each key."""
    return _events(spark, sf).groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("""WITH RECURSIVE s AS (SELECT event_id, user_id, event_type, epoch_ms(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
f AS (SELECT user_id, n, event_id, false AS repeated, [event_type] AS ids, [t] AS times FROM s WHERE n = 1
  UNION ALL SELECT user_id, n, event_id, list_contains(ids, event_type), CASE WHEN list_contains(ids, event_type) THEN ids ELSE list_append(ids, event_type) END, CASE WHEN list_contains(ids, event_type) THEN times ELSE list_append(times, t) END
  FROM (SELECT user_id, n, event_id, event_type, t, ids[gone + 1:] AS ids, times[gone + 1:] AS times
    FROM (SELECT s.*, f.ids, f.times, greatest(0, len(f.ids) - 2, len(list_filter(f.times, lambda x: x < s.t - 172800000))) AS gone FROM f JOIN s ON s.user_id = f.user_id AND s.n = f.n + 1)))
SELECT user_id AS account_id, event_id AS ord, repeated FROM f""")
def bounded_dedupe(spark, sf):
    """Repeats among the last two kinds of event that a user's cache remembers, within two days."""
    e = _events(spark, sf).select(F.col("user_id").alias("account_id"), F.col("event_id").alias("ord"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("event_type").alias("id"))
    return S.fold_batch(e, "account_id", O.bounded_dedupe(172_800_000, 2))


@query("""WITH RECURSIVE s AS (SELECT event_id, user_id, event_type = 'purchase' AS ends, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id % 3 AS g FROM events),
f AS (SELECT user_id, n, event_id, g, ends, 0 AS found, CASE WHEN ends THEN []::BIGINT[] ELSE [g] END AS ids, CASE WHEN ends THEN []::BIGINT[][] ELSE [[event_id]] END AS lines FROM s WHERE n = 1
  UNION ALL SELECT user_id, n, event_id, g, ends, CASE WHEN ends AND spot > 0 THEN len(lines[spot]) ELSE 0 END,
    CASE WHEN ends THEN list_filter(ids, lambda i: i <> g) WHEN spot > 0 THEN ids ELSE list_append(ids[len(ids):], g) END,
    CASE WHEN ends THEN list_filter(lines, lambda l, i: i <> spot) WHEN spot > 0 THEN list_transform(lines, lambda l, i: CASE WHEN i = spot THEN list_append(l, event_id)[greatest(1, len(l) - 2):] ELSE l END)
      ELSE list_append(lines[len(lines):], [event_id]) END
  FROM (SELECT s.*, f.ids, f.lines, coalesce(list_position(f.ids, s.g), 0) AS spot FROM f JOIN s ON s.user_id = f.user_id AND s.n = f.n + 1))
SELECT user_id AS account_id, g AS group_id, event_id AS ord, found::INT AS n FROM f WHERE ends""")
def bounded_history(spark, sf):
    """Messages that a user's buffer of two groups of four messages holds at each trigger."""
    e = _events(spark, sf).select(F.col("user_id").alias("account_id"), (F.col("event_id") % 3).alias("group_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("sender"), F.col("props").alias("body"), (F.col("event_type") == "purchase").alias("trigger"))
    return S.fold_batch(e, "account_id", O.bounded_history(4, 2)).drop("context")


@query("""WITH RECURSIVE s AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT event_id, user_id, event_type, n, t AS last, true AS kept FROM s WHERE n = 1
  UNION ALL SELECT s.event_id, s.user_id, s.event_type, s.n, CASE WHEN s.t - f.last >= 172800000000 THEN s.t ELSE f.last END, s.t - f.last >= 172800000000 FROM f JOIN s ON s.user_id = f.user_id AND s.event_type = f.event_type AND s.n = f.n + 1)
SELECT event_id FROM f WHERE kept""")
def ttl_dedupe(spark, sf):
    """Repeats within a time to live from the one that stayed dropped."""
    return S.dedupe_batch(_events(spark, sf), "ts", ("user_id", "event_type"), 172_800, "event_id").select("event_id")


@query("""WITH i AS (SELECT *, coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM events),
a AS (SELECT *, row_number() OVER (PARTITION BY user_id, island, event_type = 'purchase' ORDER BY event_id DESC) AS late FROM i)
SELECT user_id AS group_id, max(event_id) FILTER (event_type = 'purchase') AS ord, (count(*) FILTER (event_type <> 'purchase' AND late <= 4))::INT AS n,
  coalesce(string_agg(event_type || ': ' || props, chr(10) ORDER BY event_id) FILTER (event_type <> 'purchase' AND late <= 4), '') AS context
FROM a GROUP BY user_id, island HAVING max(event_id) FILTER (event_type = 'purchase') IS NOT NULL""")
def ring_buffer_context(spark, sf):
    """Last messages before each trigger."""
    e = _events(spark, sf).select(F.col("user_id").alias("group_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("sender"), F.col("props").alias("body"), (F.col("event_type") == "purchase").alias("trigger"))
    return S.ring_context(e, size=4)


@query("""WITH RECURSIVE s AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
f AS (SELECT event_id, user_id, n, event_type AS last, t AS at, true AS emitted FROM s WHERE n = 1
  UNION ALL SELECT s.event_id, s.user_id, s.n, CASE WHEN s.event_type = f.last AND s.t - f.at < 86400 THEN f.last ELSE s.event_type END, CASE WHEN s.event_type = f.last AND s.t - f.at < 86400 THEN f.at ELSE s.t END, NOT (s.event_type = f.last AND s.t - f.at < 86400)
  FROM f JOIN s ON s.user_id = f.user_id AND s.n = f.n + 1)
SELECT user_id AS job_id, event_id AS ord, emitted FROM f""")
def duplicate_suppression(spark, sf):
    """Alerts with the text of the last one emitted, less than a day old, held back."""
    e = _events(spark, sf).select(F.col("user_id").alias("job_id"), F.col("event_id").alias("ord"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts_s"), F.col("event_type").alias("text"))
    return S.fold_batch(e, "job_id", S.alert_suppressor())


@query("""WITH RECURSIVE s AS (SELECT event_id, user_id, event_type AS text, event_type = 'view' AS done, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
f AS (SELECT event_id, user_id, n, NOT done AS busy, ''::VARCHAR AS waiting, CASE WHEN NOT done THEN text END AS ran FROM s WHERE n = 1
  UNION ALL SELECT s.event_id, s.user_id, s.n, NOT s.done OR f.waiting <> '', CASE WHEN s.done OR NOT f.busy THEN '' WHEN f.waiting = '' THEN s.text ELSE f.waiting || chr(10) || chr(10) || s.text END,
    CASE WHEN s.done THEN nullif(f.waiting, '') WHEN NOT f.busy THEN s.text END FROM f JOIN s ON s.user_id = f.user_id AND s.n = f.n + 1)
SELECT user_id AS session_id, event_id AS ord, ran AS text FROM f WHERE ran IS NOT NULL""")
def busy_gate(spark, sf):
    """Messages of a busy session merged into one follow-up."""
    e = _events(spark, sf).select(F.col("user_id").alias("session_id"), F.col("event_id").alias("ord"), F.when(F.col("event_type") == "view", "done").otherwise("message").alias("kind"), F.col("event_type").alias("text"))
    return S.fold_batch(e, "session_id", S.busy_gate())


@query("""SELECT event_id, NOT (epoch_us(ts) // 1000000 < epoch(timestamp '2024-01-10')::BIGINT - 30 OR event_type = 'view') AS answered FROM events""")
def late_messages(spark, sf):
    """Replayed and old messages are read, not answered."""
    e = _events(spark, sf).withColumn("upsert_type", F.when(F.col("event_type") == "view", "append").otherwise("notify"))
    return S.late_filter(e, F.lit("2024-01-10 00:00:00").cast("timestamp")).select("event_id", "answered")


@query("SELECT event_id, time_bucket(INTERVAL 6 HOURS, ts, timestamp '2024-01-01 01:00:00') AS period_start FROM events")
def aligned_windows(spark, sf):
    """Periods aligned to an anchor."""
    out = S.aligned_windows(_events(spark, sf), "ts", 6 * 3600, 1704067200 + 3600 - 10 * 6 * 3600)
    return out.select("event_id", F.col("period_start").cast("timestamp_ntz").alias("period_start"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_counts(spark, sf):
    """Daily counts and sums (an addition: windows with a bound on lateness)."""
    e = _events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    w = S.windowed_counts(e, "ts", "1 day", "1 hour", ["event_type"])
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
