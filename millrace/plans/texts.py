"""Queries of text, file and time functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions import timefns as TF
from millrace.functions import vector as V
from millrace.operators import messaging as M
from millrace.plans.registry import Tables, query


def _documents(spark, sf):
    return Tables(spark, sf).documents


def _events(spark, sf):
    return Tables(spark, sf).events


_LAST = "string_split(text, ' ')[-1]"


@query(f"""WITH t AS (SELECT doc_id, text, {_LAST} AS old, instr(text, {_LAST}) AS pos FROM documents),
c AS (SELECT doc_id, text, old, pos, left(text, (pos - 1)::INT) AS before, substr(text, pos + length(old)) AS after FROM t)
SELECT doc_id, md5(CASE WHEN old = '' OR pos = 0 THEN text ELSE before || '<new>' || after END) AS edited_md5,
  md5(CASE WHEN old <> '' AND pos > 0 THEN regexp_replace(before || after, '\\n{{3,}}', chr(10) || chr(10), 'g') ELSE text END) AS deleted_md5 FROM c""".replace("\\\\", "\\"))
def first_edits(spark, sf):
    """The first occurrence of a document's last word replaced, and taken out."""
    d = _documents(spark, sf).select("doc_id", "text", F.element_at(F.split("text", " "), -1).alias("old"), F.lit("<new>").alias("new"))
    return d.select("doc_id", F.md5(X.edit_first("text", "old", "new")).alias("edited_md5"), F.md5(X.delete_first("text", "old")).alias("deleted_md5"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
p AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total FROM l),
b AS (SELECT *, sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY n) - 1 AS bytes FROM p WHERE n BETWEEN 2 AND 4),
g AS (SELECT doc_id, total, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (bytes <= 51200), '') AS content, count(*) FILTER (bytes <= 51200) + 1 AS last FROM b GROUP BY ALL)
SELECT doc_id, md5(content || CASE WHEN last < total THEN chr(10) || chr(10) || '[Showing lines 2-' || last || ' of ' || total || '. Use offset=' || last + 1 || ' to continue.]' ELSE '' END) AS page_md5 FROM g""")
def file_pages(spark, sf):
    """Three lines of documents from the second on, with a hint where to go on; documents of one line have no such page."""
    d = _documents(spark, sf).select("doc_id", X.page_of_file(F.col("text"), 2, 3).alias("page"))
    return d.where("page is not null").select("doc_id", F.md5("page").alias("page_md5"))


_CR = "CASE WHEN lang = 'en' THEN chr(65279) || replace(text, chr(10), chr(13) || chr(10)) ELSE replace(text, ' ', chr(160)) END"


@query(f"""WITH t AS (SELECT doc_id, {_CR} AS t FROM documents)
SELECT doc_id, CASE WHEN instr(t, chr(10)) > 1 AND substr(t, instr(t, chr(10)) - 1, 1) = chr(13) THEN 'CRLF' ELSE 'LF' END AS ending,
  md5(regexp_replace(regexp_replace(t, '\\r\\n?', chr(10), 'g'), '^' || chr(65279), '')) AS plain_md5,
  instr(regexp_replace(replace(t, chr(160), ' '), '\\r\\n?', chr(10), 'g'), 'a b') > 0 AS found FROM t""".replace("\\\\", "\\"))
def line_endings(spark, sf):
    """Line endings told and levelled, marks of byte order dropped, texts found in spite of special blanks."""
    t = F.when(F.col("lang") == "en", F.concat(F.lit("﻿"), F.replace("text", F.lit("\n"), F.lit("\r\n")))).otherwise(F.replace("text", F.lit(" "), F.lit("\xa0")))
    d = _documents(spark, sf).select("doc_id", t.alias("t"))
    ending = F.when(X.line_ending(F.col("t")) == "\r\n", "CRLF").otherwise("LF")
    return d.select("doc_id", ending.alias("ending"), F.md5(X.strip_bom(X.to_lf(F.col("t")))).alias("plain_md5"), (X.find_loose(F.col("t"), F.lit("a b")) > 0).alias("found"))


@query("""WITH t AS (SELECT o_orderkey, (o_totalprice * (o_orderkey % 40))::BIGINT AS n FROM orders)
SELECT o_orderkey, CASE WHEN n < 1024 THEN n || 'B' WHEN n < 1048576 THEN printf('%.1fKB', floor(n / 1024.0 * 10 + 0.5) / 10) ELSE printf('%.1fMB', floor(n / 1048576.0 * 10 + 0.5) / 10) END AS size FROM t""")
def human_sizes(spark, sf):
    """Sizes for people."""
    n = F.rint(F.col("o_totalprice") * (F.col("o_orderkey") % 40)).cast("long")  # halves to even, as SQL casts
    return Tables(spark, sf).orders.select("o_orderkey", X.human_size(n).alias("size"))


@query(r"""WITH t AS (SELECT doc_id, '**' || lang || '** **' || source || '** ' || text AS t FROM documents)
SELECT doc_id, md5(regexp_replace(regexp_replace(t, '\*\*([^*]+)\*\*', '*\1*', 'g'), '\*([^*]+)\*\s+\*([^*]+)\*', '*\1 \2*', 'g')) AS chat_md5 FROM t""")
def chat_markup(spark, sf):
    """Markdown as messengers write it."""
    t = F.concat(F.lit("**"), "lang", F.lit("** **"), "source", F.lit("** "), "text")
    return _documents(spark, sf).select("doc_id", F.md5(X.chat_markdown(t)).alias("chat_md5"))


_TO = "CASE event_type WHEN 'click' THEN 'whatsapp:+1 (' || user_id || ') ' || event_id WHEN 'view' THEN user_id || ':' || event_id || '@lid' WHEN 'error' THEN event_id || '-' || user_id || '@g.us' ELSE 'name' || user_id || '@s.whatsapp.net' END"


def _to():
    uid, eid = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    kinds = {"click": F.concat(F.lit("whatsapp:+1 ("), uid, F.lit(") "), eid), "view": F.concat(uid, F.lit(":"), eid, F.lit("@lid")), "error": F.concat(eid, F.lit("-"), uid, F.lit("@g.us"))}
    out = F.concat(F.lit("name"), uid, F.lit("@s.whatsapp.net"))
    for kind, value in kinds.items():
        out = F.when(F.col("event_type") == kind, value).otherwise(out)
    return out


_JID = r"""t AS (SELECT *, CASE WHEN ends_with(dest, '@g.us') THEN dest WHEN contains(dest, '@') THEN split_part(split_part(dest, '@', 1), ':', 1) || '@s.whatsapp.net'
  ELSE regexp_replace(replace(dest, 'whatsapp:', ''), '[^0-9]', '', 'g') || '@s.whatsapp.net' END AS jid FROM s),
p AS (SELECT *, CASE WHEN regexp_matches(split_part(split_part(jid, '@', 1), ':', 1), '^[0-9]+$') THEN '+' || split_part(split_part(jid, '@', 1), ':', 1) END AS phone FROM t)"""


@query(f"WITH s AS (SELECT event_id, {_TO} AS dest FROM events), {_JID} SELECT event_id, jid, phone FROM p")
def message_ids(spark, sf):
    """Ids of recipients and their numbers."""
    e = _events(spark, sf).select("event_id", X.to_jid(_to()).alias("jid"))
    return e.select("event_id", "jid", X.jid_phone(F.col("jid")).alias("phone"))


@query(f"""WITH s AS (SELECT event_id, user_id, {_TO} AS dest FROM events), {_JID},
r AS (SELECT event_id, jid, phone, ends_with(jid, '@g.us') AS grp, user_id % 2 = 0 AS closed, user_id % 3 = 0 AS has_list, '+1' || user_id || event_id AS own FROM p)
SELECT event_id, CASE WHEN grp AND closed THEN 'group_destinations_disabled' WHEN grp THEN NULL WHEN phone IS NULL THEN 'invalid_recipient' WHEN NOT has_list THEN 'no_explicit_recipient'
  WHEN phone <> own THEN 'recipient_not_allowlisted' END AS reason, CASE WHEN grp THEN '' ELSE phone END AS recipient FROM r""")
def outbound_policy(spark, sf):
    """Decisions on outbound messages; a star in the list does not count."""
    own = F.concat(F.lit("whatsapp:+1 "), F.col("user_id").cast("string"), F.lit(" "), F.col("event_id").cast("string"))
    allow = F.when(F.col("user_id") % 3 == 0, F.array(F.lit("*"), own)).otherwise(F.array(F.lit("*")))
    out = M.outbound(_to(), F.when(F.col("user_id") % 2 == 0, "disabled").otherwise("open"), allow)
    return _events(spark, sf).select("event_id", out.alias("o")).select("event_id", "o.reason", "o.recipient")


_SUM = "CASE WHEN lang = 'en' THEN '<analysis>' || source || '</analysis> <summary> ' || text || ' </summary> tail' WHEN lang = 'de' THEN '<analysis>x' || chr(10) || '</analysis> ' || text ELSE text END"


@query(rf"""WITH s AS (SELECT doc_id, regexp_replace({_SUM}, '(?s)^(.*?)<analysis>.*?</analysis>', '\1') AS t FROM documents)
SELECT doc_id, md5(trim(CASE WHEN regexp_matches(t, '(?s)<summary>.*?</summary>') THEN regexp_extract(t, '(?s)<summary>(.*?)</summary>', 1) ELSE t END)) AS summary_md5 FROM s""")
def summary_blocks(spark, sf):
    """Summaries between tags, without the analysis before them."""
    t = F.when(F.col("lang") == "en", F.concat(F.lit("<analysis>"), "source", F.lit("</analysis> <summary> "), "text", F.lit(" </summary> tail")))
    t = t.when(F.col("lang") == "de", F.concat(F.lit("<analysis>x\n</analysis> "), "text")).otherwise(F.col("text"))
    return _documents(spark, sf).select("doc_id", F.md5(X.summary_block(t)).alias("summary_md5"))


@query("""SELECT event_id, CASE WHEN event_type IN ('click', 'error') THEN 400 + user_id END::INT AS http_code, CASE WHEN event_type <> 'view' THEN event_type END AS type,
  CASE WHEN event_type <> 'view' THEN 'no ' || user_id END AS message, CASE WHEN event_type = 'click' THEN 'r' || event_id END AS request_id FROM events""")
def api_errors(spark, sf):
    """Error payloads in three shapes, and texts that are none."""
    e, inner = F.col("event_type"), F.struct(F.col("event_type").alias("type"), F.concat(F.lit("no "), F.col("user_id").cast("string")).alias("message"))
    code = (F.col("user_id") + 400).cast("string")
    nested = F.to_json(F.struct(inner.alias("error"), F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("request_id")))
    t = F.when(e == "click", F.concat(F.lit("API error: "), code, F.lit(" "), nested)).when(e == "error", F.concat(code, F.lit(" "), F.to_json(inner)))
    t = t.when(e == "view", F.concat(F.lit("plain "), F.to_json(inner))).otherwise(F.to_json(inner))
    return _events(spark, sf).select("event_id", X.api_error(t).alias("a")).select("event_id", "a.http_code", "a.type", "a.message", "a.request_id")


@query("""WITH t AS (SELECT doc_id, text, split_part(text, chr(10), 1) AS first, len(string_split(text, chr(10))) - 1 AS more, left(text, 81) AS head FROM documents),
c AS (SELECT *, CASE WHEN contains(head, ' ') THEN length(head) - instr(reverse(head), ' ') ELSE -1 END AS blank FROM t)
SELECT doc_id, md5(CASE WHEN length(first) > 60 THEN left(first, 60) || '...' ELSE first END || CASE WHEN more = 0 THEN '' WHEN more = 1 THEN ' [+1 line]' ELSE ' [+' || more || ' lines]' END) AS preview_md5,
  md5(CASE WHEN length(text) <= 80 THEN text WHEN blank > 40 THEN left(text, blank::INT) || '...' ELSE left(text, 80) || '...' END) AS cut_md5 FROM c""")
def previews(spark, sf):
    """First lines of documents, and documents cut at a word."""
    return _documents(spark, sf).select("doc_id", F.md5(X.preview(F.col("text"))).alias("preview_md5"), F.md5(X.truncate_at_word(F.col("text"), 80)).alias("cut_md5"))


@query("""SELECT event_id, 'e' || event_id AS ref, CASE WHEN event_type = 'view' THEN 'link' ELSE 'button' END AS role, event_type AS name, CASE WHEN event_type = 'click' THEN user_id END::INT AS nth FROM events""")
def snapshot_lines(spark, sf):
    """Elements of accessibility snapshots."""
    role = F.when(F.col("event_type") == "view", "link").otherwise("button")
    nth = F.when(F.col("event_type") == "click", F.concat(F.lit(" [nth="), F.col("user_id").cast("string"), F.lit("]"))).otherwise("")
    line = F.concat(F.lit("- text: hello\n  - "), role, F.lit(' "'), F.col("event_type"), F.lit('" [ref=e'), F.col("event_id").cast("string"), F.lit("]"), nth, F.lit("\n- list"))
    return _events(spark, sf).select("event_id", F.explode(X.snapshot_refs(line)).alias("s")).select("event_id", "s.ref", "s.role", "s.name", "s.nth")


@query("""SELECT c_custkey, CASE WHEN starts_with(c_mktsegment, 'AUTO') THEN 'cars' WHEN starts_with(c_mktsegment, 'BUILD') THEN 'houses' WHEN starts_with(c_mktsegment, 'B') THEN 'b' ELSE 'other' END AS provider FROM customer""")
def providers(spark, sf):
    """The first prefix that fits."""
    return Tables(spark, sf).customer.select("c_custkey", X.provider(F.col("c_mktsegment"), [("AUTO", "cars"), ("BUILD", "houses"), ("B", "b")], "other").alias("provider"))


@query("SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn) FILTER (role <> 'system' AND text IS NOT NULL)) AS text_md5 FROM conversations GROUP BY 1 HAVING count(*) FILTER (role <> 'system' AND text IS NOT NULL) > 0")
def block_texts(spark, sf):
    """Texts of content blocks, those of other kinds left out."""
    block = F.struct("turn", F.when(F.col("role") == "system", "image").otherwise("text").alias("type"), "text")
    c = Tables(spark, sf).conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(block)).alias("b"))
    held = F.exists("b", lambda x: (x["type"] == "text") & x["text"].isNotNull())
    return c.where(held).select("conv_id", F.md5(X.block_text(F.col("b"))).alias("text_md5"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN ts - to_minutes(user_id::INT) WHEN 'view' THEN ts - to_hours(user_id::INT) WHEN 'error' THEN ts - to_days(user_id::INT) WHEN 'signup' THEN timestamp '2024-01-05 06:07:08' END AS since,
  strftime(ts, '%Y-%m-%d') || '.md' AS file FROM events""")
def time_spans(spark, sf):
    """Starts of relative spans and ISO times, and names of day files."""
    n, kind = F.col("user_id").cast("string"), F.col("event_type")
    t = F.when(kind == "click", F.concat(n, F.lit("m"))).when(kind == "view", F.concat(n, F.lit("h"))).when(kind == "error", F.concat(n, F.lit("d"))).when(kind == "signup", "2024-01-05T06:07:08Z").otherwise("soon")
    at = F.col("ts").cast("timestamp")
    return _events(spark, sf).select("event_id", TF.since(t, at).cast("timestamp_ntz").alias("since"), TF.day_file(at).alias("file"))


@query("""WITH t AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'x' || user_id WHEN 'view' THEN 'NaN' WHEN 'error' THEN NULL ELSE (user_id - 50)::VARCHAR END AS t FROM events)
SELECT event_id, least(20.0, greatest(-3.0, coalesce(CASE WHEN t <> 'NaN' THEN try_cast(t AS DOUBLE) END, 7.0))) AS value FROM t""")
def finite_numbers(spark, sf):
    """Numbers of texts within bounds, a default for what is none."""
    kind = F.col("event_type")
    t = F.when(kind == "click", F.concat(F.lit("x"), F.col("user_id").cast("string"))).when(kind == "view", "NaN").when(kind != "error", (F.col("user_id") - 50).cast("string"))
    return _events(spark, sf).select("event_id", TF.clamp(TF.finite_or(t, 7.0), -3, 20).alias("value"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN '—' WHEN user_id * 17 < 1000 THEN user_id * 17 || 'ms' ELSE printf('%.1fs', floor(user_id * 17 / 100.0 + 0.5) / 10) END AS latency,
  CASE WHEN event_type = 'error' THEN '—' ELSE printf('$%.4f', user_id / 16.0) END AS cost FROM events""")
def latency_labels(spark, sf):
    """Latency and cost for people."""
    ok = F.col("event_type") != "error"
    return _events(spark, sf).select("event_id", TF.latency_label(F.when(ok, F.col("user_id") * 17)).alias("latency"), TF.cost_label(F.when(ok, F.col("user_id") / 16)).alias("cost"))


_BEAT = "CASE event_type WHEN 'click' THEN '# ' || props || chr(10) || '- ' || chr(10) || ' ' WHEN 'view' THEN '- ' || props WHEN 'error' THEN chr(10) || '*' || repeat(' ', (user_id % 3)::INT) || CASE WHEN user_id % 4 = 0 THEN 'x' ELSE '' END ELSE '##' || event_type END"


@query(rf"""SELECT event_id, len(list_filter(string_split({_BEAT}, chr(10)), lambda x: NOT regexp_matches(trim(regexp_replace(x, '\s', ' ', 'g')), '^$|^#+(\s.*)?$|^[-*]\s*$'))) = 0 AS is_empty FROM events""")
def heartbeat_files(spark, sf):
    """Whether nothing stands in a heartbeat file."""
    kind, u = F.col("event_type"), F.col("user_id")
    t = F.when(kind == "click", F.concat(F.lit("# "), "props", F.lit("\n- \n "))).when(kind == "view", F.concat(F.lit("- "), "props"))
    t = t.when(kind == "error", F.concat(F.lit("\n*"), F.repeat(F.lit(" "), (u % 3).cast("int")), F.when(u % 4 == 0, "x").otherwise(""))).otherwise(F.concat(F.lit("##"), kind))
    return _events(spark, sf).select("event_id", M.heartbeat_empty(t).alias("is_empty"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '{"data":"' || o_orderpriority || '"}' ELSE '{"data":"' || o_orderpriority || '","sourceUrls":["http://a/' || o_custkey || '"]}' END AS envelope,
  o_orderstatus = 'O' AS valid FROM orders""")
def result_envelopes(spark, sf):
    """Tool results with their sources, and the shape of cache entries."""
    urls = F.when(F.col("o_orderstatus") == "F", F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("http://a/"), F.col("o_custkey").cast("string"))))
    data = F.when(F.col("o_orderstatus") == "O", F.lit('{"x":1}')).otherwise("text")
    entry = F.to_json(F.struct(F.lit("/p/").alias("endpoint"), F.lit("http://a").alias("url"), F.col("o_orderdate").cast("string").alias("cachedAt"), data.alias("data")))
    return Tables(spark, sf).orders.select("o_orderkey", X.envelope(F.col("o_orderpriority"), urls).alias("envelope"), X.valid_cache_entry(entry).alias("valid"))


@query("""SELECT r_regionkey, 'name|key' AS headers, string_agg(n_name || '|' || n_nationkey, ';' ORDER BY n_nationkey) AS cells, 'false|true' AS numeric,
  greatest(4, max(length(n_name))) || '|' || greatest(3, max(length(n_nationkey::VARCHAR))) AS widths FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def markdown_tables(spark, sf):
    """Markdown tables read back, with kinds and widths of their columns."""
    line = F.concat(F.lit("| "), "n_name", F.lit(" | "), F.col("n_nationkey").cast("string"), F.lit(" |"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("l")))), lambda x: x["l"]), "\n")
    t = Tables(spark, sf).nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.concat(F.lit("| name | key |\n|---|---:|\n"), rows).alias("t"))
    p = t.select("r_regionkey", X.parse_table(F.col("t")).alias("p"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "|")
    cells = F.array_join(F.transform("p.rows", lambda r: F.array_join(r, "|")), ";")
    return p.select("r_regionkey", text(F.col("p.headers")).alias("headers"), cells.alias("cells"), text(X.numeric_columns(F.col("p"))).alias("numeric"), text(X.column_widths(F.col("p"))).alias("widths"))


@query("""SELECT event_id, user_id * 2000 >= 200000 - 33000 AND event_type <> 'view' AS due FROM events""")
def context_flush(spark, sf):
    """Whether a context is to be flushed before it is compacted."""
    due = V.flush_due(F.col("user_id") * 2000, F.lit(V.auto_compact_threshold(200_000)), F.col("event_type") == "view")
    return _events(spark, sf).select("event_id", due.alias("due"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN NULL WHEN user_id % 5 < 3 THEN 500 * pow(2, user_id % 5) END::BIGINT AS delay_ms FROM events""")
def retry_delays(spark, sf):
    """Waits before a call is tried again: three times, and never for errors that cannot pass."""
    message = F.when(F.col("event_type") == "error", "401 invalid api key").otherwise("connection reset")
    return _events(spark, sf).select("event_id", M.retry_delay_ms((F.col("user_id") % 5).cast("int"), message).alias("delay_ms"))
