"""Queries of pages, posts and caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import ingest as I
from millrace.operators import messaging as M
from millrace.plans.registry import Tables, query

_ENT = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '&nbsp;', ' ', 'gi'), '&amp;', '&', 'gi'), '&quot;', '\"', 'gi'), '&#39;', '''', 'gi'), '&lt;', '<', 'gi'), '&gt;', '>', 'gi')"
_WS = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\r', '', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]{{2,}}', ' ', 'g'), '^\s+|\s+$', '', 'g')"


def _plain(x: str) -> str:
    return _ENT.format(f"regexp_replace({x}, '<[^>]+>', '', 'g')")


@query(rf"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?is)<noscript[^>]*>.*?</noscript>', '', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)<(br|hr)\s*/?>', chr(10), 'g'), '(?i)</(p|div|section|article|header|footer|table|tr|ul|ol|li|h[1-6])>', chr(10), 'g') AS t FROM a)
SELECT page_id, md5({_WS.format(_plain('t'))}) AS text_md5 FROM b""")
def html_to_text(spark, sf):
    """Plain text of pages."""
    return Tables(spark, sf).pages.select("page_id", F.md5(X.html_to_text(F.col("html"))).alias("text_md5"))


@query(rf"""SELECT page_id, CASE WHEN regexp_matches(html, '(?is)<title[^>]*>.*?</title>') THEN {_WS.format(_plain("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))} END AS title FROM pages""")
def title_extract(spark, sf):
    """Titles of pages."""
    return Tables(spark, sf).pages.select("page_id", X.html_title(F.col("html")).alias("title"))


# The main part of these pages is their article, if it holds a block of text; what stands around it is no content.
@query(rf"""WITH a AS (SELECT page_id, html, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS main FROM pages),
f AS (SELECT page_id, html, main, len(list_filter(string_split_regex(main, '(?i)</p>|<p>'), lambda x: length(trim(regexp_replace(regexp_replace(x, '(?s)<h1>.*</h1>', ''), '<[^>]+>', '', 'g'))) >= 25)) > 0 AS found FROM a),
s AS (SELECT page_id, found, regexp_replace(regexp_replace(CASE WHEN found THEN main ELSE html END, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g') AS t FROM f),
b AS (SELECT page_id, found, regexp_replace(regexp_replace(t, '(?i)<(br|hr)\s*/?>', chr(10), 'g'), '(?i)</(p|div|section|article|header|footer|table|tr|ul|ol|li|h[1-6])>', chr(10), 'g') AS t FROM s)
SELECT page_id, coalesce(found, false) AS found, md5({_WS.format(_plain('t'))}) AS text_md5 FROM b""")
def readable_pages(spark, sf):
    """The main part of pages as plain text, found by scores of its blocks."""
    p = Tables(spark, sf).pages.withColumn("main", X.main_html(F.col("html")))
    return p.select("page_id", F.col("main").isNotNull().alias("found"), F.md5(X.html_to_text(F.coalesce("main", "html"))).alias("text_md5"))


@query()
def html_to_markdown(spark, sf):
    """Markdown of pages (rewrites inside links and headings; held against a plain version by tests)."""
    out = I.extracted(Tables(spark, sf).pages)
    return out.select("page_id", "title", "extractor", "truncated", "raw_length", F.md5("text").alias("text_md5"))


@query("SELECT doc_id, CASE WHEN regexp_matches(t, '(?i)rm\\s+-rf') THEN 'rm\\s+-rf' ELSE '' END AS flags FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'RM  -rf ' || text ELSE text END AS t FROM documents)".replace("\\\\", "\\"))
def injection_flags(spark, sf):
    """Patterns of prompt injection in texts."""
    t = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("RM  -rf "), F.col("text"))).otherwise(F.col("text"))
    return Tables(spark, sf).documents.select("doc_id", F.array_join(X.injection_flags(t), "|").alias("flags"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '!\[[^\]]*\]\([^)]+\)', '', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '`([^`]+)`', '\1', 'g'), '(?m)^#{1,6}\s+', '', 'g'), '[ \t]{2,}', ' ', 'g')) AS text_md5
FROM (SELECT doc_id, '# Head' || chr(10) || 'a [link](http://x) `code` ' || text || ' ![img](u) end' AS t FROM documents)""")
def markdown_to_text(spark, sf):
    """Markdown marks taken away."""
    t = F.concat(F.lit("# Head\na [link](http://x) `code` "), F.col("text"), F.lit(" ![img](u) end"))
    return Tables(spark, sf).documents.select("doc_id", F.md5(X.markdown_to_text(t)).alias("text_md5"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
r AS (SELECT *, sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY n) - 1 AS bytes, count(*) OVER (PARTITION BY doc_id) AS total FROM l)
SELECT doc_id, total::INT AS total_lines, (count(*) FILTER (n <= 5 AND bytes <= 2000))::INT AS output_lines, md5(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (n <= 5 AND bytes <= 2000), '')) AS content_md5,
  bool_or(n = 1 AND strlen(line) > 2000) AS first_line_too_big FROM r GROUP BY doc_id, total""")
def truncate_head(spark, sf):
    """Whole lines from the top within limits of lines and bytes."""
    h = X.truncate_head(F.col("text"), 5, 2000)
    return Tables(spark, sf).documents.select("doc_id", h.alias("h")).select("doc_id", "h.total_lines", "h.output_lines", F.md5("h.content").alias("content_md5"), "h.first_line_too_big")


@query("""SELECT doc_id, length(text) > 300 AS truncated, md5('<<<EXTERNAL_UNTRUSTED_CONTENT>>>' || chr(10) || 'Source: Web Fetch' || chr(10) || '---' || chr(10) || left(text, 300) || chr(10) || '<<<END_EXTERNAL_UNTRUSTED_CONTENT>>>') AS wrapped_md5 FROM documents""")
def wrap_external(spark, sf):
    """Content wrapped between markers within a budget."""
    frame = len("<<<EXTERNAL_UNTRUSTED_CONTENT>>>\nSource: Web Fetch\n---\n\n<<<END_EXTERNAL_UNTRUSTED_CONTENT>>>")
    body, cut = X.wrap_within(F.col("text"), 300 + frame, notice=False)
    return Tables(spark, sf).documents.select("doc_id", cut.alias("truncated"), F.md5(body).alias("wrapped_md5"))


@query("""SELECT event_id::VARCHAR AS event_id, coalesce(CASE WHEN user_id % 4 = 0 THEN NULL ELSE event_type END, 'null') AS event_type, '{"k":' || user_id || '}' AS nested FROM events""")
def flattened_rows(spark, sf):
    """Rows as texts, nested values as JSON, nulls as a word."""
    e = Tables(spark, sf).events.select("event_id", F.when(F.col("user_id") % 4 == 0, F.lit(None)).otherwise(F.col("event_type")).alias("event_type"), F.struct(F.col("user_id").alias("k")).alias("nested"))
    return I.flattened(e)


@query("""WITH f AS (SELECT user_id AS id, event_id AS ord, (value * 10)::BIGINT AS likes, event_type = 'error' AS rt FROM (SELECT *, floor(value) AS value FROM events) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1)
SELECT id, likes FROM f WHERE NOT rt AND likes >= 100 ORDER BY likes DESC, ord LIMIT 15""".replace("SELECT *, floor(value) AS value FROM events", "SELECT event_id, user_id, event_type, floor(value) AS value FROM events"))
def select_posts(spark, sf):
    """Distinct posts with enough likes, the best of them."""
    p = Tables(spark, sf).events.select(F.col("user_id").alias("id"), F.col("event_id").alias("ord"), (F.floor("value") * 10).alias("likes"), (F.col("event_type") == "error").alias("is_retweet"))
    return M.select_posts(p, min_likes=100).select("id", "likes")


@query("SELECT o_orderkey AS id, coalesce(c_name, '?') AS name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) ON o_custkey = c_custkey")
def posts_with_users(spark, sf):
    """Posts with their author, a question mark where there is none."""
    t = Tables(spark, sf)
    u = t.customer.where("c_acctbal >= 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.col("c_name").alias("name"))
    return M.posts_with_users(t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("author_id")), u).select("id", "name")


@query("""SELECT o_orderkey, 'prices/T' || (o_custkey % 9) || '_' || substr(md5('/prices/?b=1,2&ticker=t' || (o_custkey % 9)), 1, 12) || '.json' AS cache_key FROM orders""")
def cache_keys(spark, sf):
    """Canonical names of requests."""
    p = F.create_map(F.lit("ticker"), F.array(F.concat(F.lit("t"), (F.col("o_custkey") % 9).cast("string"))), F.lit("b"), F.array(F.lit("2"), F.lit("1")), F.lit("a"), F.lit(None).cast("array<string>"))
    return Tables(spark, sf).orders.select("o_orderkey", X.cache_key(F.lit("/prices/"), p).alias("cache_key"))


@query("""WITH r AS (SELECT event_id, ['http://a/' || user_id % 5, CASE WHEN user_id % 3 = 0 THEN '' ELSE 'http://a/' || event_id % 5 END, 'http://b/' || event_type] AS found, CASE WHEN event_id % 2 = 0 THEN ['http://b/' || event_type, 'http://c'] ELSE [] END AS cited FROM events),
u AS (SELECT event_id, unnest(list_concat(found, cited)) AS url, generate_subscripts(list_concat(found, cited), 1) AS n FROM r), d AS (SELECT event_id, url, min(n) AS n FROM u WHERE url <> '' GROUP BY ALL)
SELECT event_id, string_agg(url, '|' ORDER BY n) AS urls FROM d GROUP BY 1""")
def result_urls(spark, sf):
    """Distinct URLs of search results in two shapes, in order; empty ones left out."""
    u, e, kind = F.col("user_id"), F.col("event_id"), F.col("event_type")
    at = lambda host, c: F.concat(F.lit(f"http://{host}/"), c.cast("string"))
    hits = F.array(*(F.struct(x.alias("url")) for x in (at("a", u % 5), F.when(u % 3 == 0, "").otherwise(at("a", e % 5)), at("b", kind))))
    payload = F.to_json(F.struct(hits.alias("results"), F.when(e % 2 == 0, F.array(at("b", kind), F.lit("http://c"))).alias("citations")))
    return Tables(spark, sf).events.select("event_id", F.array_join(X.result_urls(payload), "|").alias("urls"))


@query("SELECT doc_id, md5(array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10))) AS lines_md5 FROM documents")
def line_ranges(spark, sf):
    """Lines two to four of documents."""
    return Tables(spark, sf).documents.select("doc_id", F.md5(X.line_range(F.col("text"), 2, 3)).alias("lines_md5"))


@query("""SELECT event_id, (user_id % 50)::BIGINT AS input_tokens, (event_id % 70)::BIGINT AS output_tokens, (user_id % 50 + event_id % 70)::BIGINT AS total_tokens FROM events""")
def token_usage(spark, sf):
    """Token counts in either provider's shape."""
    i, o = F.col("user_id") % 50, F.col("event_id") % 70
    a = F.to_json(F.struct(F.struct(i.alias("input_tokens"), o.alias("output_tokens")).alias("usage_metadata")))
    b = F.to_json(F.struct(F.struct(F.struct(i.alias("prompt_tokens"), o.alias("completion_tokens"), (i + o).alias("total_tokens")).alias("usage")).alias("response_metadata")))
    u = X.token_usage(F.when(F.col("event_id") % 2 == 0, a).otherwise(b))
    return Tables(spark, sf).events.select("event_id", u.alias("u")).select("event_id", "u.*")


def _site(url: str, seconds: float) -> tuple[int, dict[str, str], bytes]:
    """A site without a network: /hop/n/x leads to /hop/n-1/x and at last to a page, /loop to itself, all else is not found."""
    parts = url.split("/")[3:]
    if parts[0] == "loop":
        return 302, {"location": "/loop"}, b""
    if parts[0] != "hop":
        return 404, {"content-type": "text/plain"}, b"none"
    if int(parts[1]):
        return 301, {"location": f"../{int(parts[1]) - 1}/{parts[2]}"}, b""
    return 200, {"content-type": "text/html; charset=latin-1"}, f"<p>\xe9 {parts[2]}</p>".encode("latin-1")


@query("""WITH p AS (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'loop' WHEN page_id % 13 = 0 THEN 'none' WHEN page_id % 17 = 0 THEN 'ftp' ELSE 'hop' END AS kind, page_id % 6 AS n FROM pages)
SELECT page_id, CASE kind WHEN 'loop' THEN 'http://site/loop' WHEN 'none' THEN 'http://site/none' WHEN 'hop' THEN 'http://site/hop/' || greatest(n - 3, 0) || '/' || page_id END AS final_url,
  CASE kind WHEN 'loop' THEN 302 WHEN 'none' THEN 404 WHEN 'hop' THEN CASE WHEN n > 3 THEN 301 ELSE 200 END END AS status,
  CASE WHEN kind = 'none' THEN 'none' WHEN kind = 'hop' AND n <= 3 THEN '<p>é ' || page_id || '</p>' END AS body,
  CASE kind WHEN 'loop' THEN 'redirect_loop' WHEN 'none' THEN 'failed' WHEN 'ftp' THEN 'invalid_url' ELSE CASE WHEN n > 3 THEN 'too_many_redirects' END END AS error FROM p""")
def page_fetches(spark, sf):
    """Pages fetched with at most three redirects, from a site that stands in for the network."""
    from millrace.sources.pages import fetched

    i = F.col("page_id")
    url = F.when(i % 11 == 0, "http://site/loop").when(i % 13 == 0, "http://site/none").when(i % 17 == 0, "ftp://site/x")
    pages = Tables(spark, sf).pages.select("page_id", url.otherwise(F.concat_ws("/", F.lit("http://site/hop"), i % 6, i)).alias("url"))
    return fetched(pages, opener=_site).select("page_id", "page.final_url", "page.status", "page.body", "page.error")
