"""The registered queries of this subpackage, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import ann, audit, chat, decontam, exact, licenses, lines, neardup, packing, quality, sharding, trie, urls
from millrace.llm.common import LOWER, UPPER

_CONTROL = "</s>[INST] ok [/INST]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Path of an installed public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the formatted conversations, read back from the formatted text and its loss mask."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", _CONTROL), (-1, 1, "assistant", _CONTROL)], rows.schema)
    events = rows.unionByName(extra).select("conv_id", F.col("turn").alias("seq"), "turn", F.lit("message").alias("kind"), "role", "text")
    out = chat.chat_format(events).withColumn("turns", chat.parse(F.col("formatted")))
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat.unescape(s["text"])), "")
    return out.withColumn("loss", loss).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_REST = chat._REST.replace("'", "''")
OP1_SQL = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{_CONTROL}'), (-1, 1, 'assistant', '{_CONTROL}')),
sized AS (
  SELECT *, length(regexp_replace(role, '([<\[])(\\*)({_REST})', '\1\\\2\3', 'g'))
          + length(regexp_replace(text, '([<\[])(\\*)({_REST})', '\1\\\2\3', 'g')) + {len(chat.OPEN + chat.SEP + chat.CLOSE)} AS chars
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all pages under URL_RULES."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.url_filter(table(spark, sf_dir, "pages"), rules).drop("url")


OP2_SQL = f"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {', '.join(map(str, URL_RULES))}),
parts AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
fits AS (
  SELECT DISTINCT p.page_id, p.url, r.*, row_number() OVER (PARTITION BY p.page_id, p.url ORDER BY length(rule_host || rule_path) DESC) AS rn
  FROM (SELECT DISTINCT * FROM parts) p JOIN rules r
    ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path))
SELECT p.page_id, p.host, p.path, f.rule_host || f.rule_path AS rule, coalesce(f.rule_verdict, 'allow') AS verdict
FROM parts p LEFT JOIN (SELECT * FROM fits WHERE rn = 1) f
  ON p.page_id IS NOT DISTINCT FROM f.page_id AND p.url IS NOT DISTINCT FROM f.url
"""


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of at least ten code points that several documents hold stay in the smallest doc_id only."""
    out = lines.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM split),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM lines),
held AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT k.*, h.key IS NOT NULL AND k.doc_id <> h.first AS dropped FROM keyed k LEFT JOIN held h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of five-word shingles have a similarity of 0.85 or more."""
    return neardup.near_dedup(table(spark, sf_dir, "documents"), percent=85)


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards whose row counts differ by one at most."""
    out = sharding.shard(table(spark, sf_dir, "documents"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark passages found in documents: (doc_id, item_id) and where."""
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses found in documents."""
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of texts that are equal but for the case of A-Z; the largest doc_id stays."""
    return exact.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


OP8_SQL = f"""
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""

def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt from the labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), quality.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.KEEP_FROM).cast("int"))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each source, in all 120 orders."""
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS low FROM d),
f AS (SELECT part, doc_id, [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words),
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text), regexp_matches(text, '[#$%&*|]'), doc_id > low] AS fails FROM w),
m AS (SELECT f.part, fails, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS bad
  FROM f LEFT JOIN labels l ON f.doc_id = l.doc_id GROUP BY ALL),
perms(o) AS (SELECT '' UNION ALL SELECT o || x FROM perms, (SELECT unnest(string_split('ABCDE', '')) AS x) WHERE length(o) < 5 AND NOT contains(o, x)),
steps AS (SELECT o, s::INTEGER AS s, ascii(o[s]) - 64 AS k, list_transform(range(1, s), lambda i: ascii(o[i]) - 64) AS before FROM perms, range(1, 6) r(s) WHERE length(o) = 5),
x AS (SELECT part, o, s, k, n, good, bad, fails[k] AS fail, list_bool_or(list_transform(before, lambda i: fails[i])) IS TRUE AS gone,
    list_sum(list_transform(fails, lambda y: y::INTEGER)) = 1 AS sole FROM m, steps),
g AS (SELECT part, o, s, k, sum(n) FILTER (NOT fail AND NOT gone) AS kept, sum(n) FILTER (fail AND NOT gone) AS removed, sum(n) FILTER (fail AND gone) AS redundant,
    sum(n) FILTER (fail AND sole) AS u, sum(good) FILTER (fail AND NOT gone) AS good, sum(bad) FILTER (fail AND NOT gone) AS bad FROM x GROUP BY ALL)
SELECT part, o AS filter_order, s AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(u, 0)::BIGINT AS unique_fails, coalesce(good, 0)::BIGINT AS good_lost, coalesce(bad, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, k), 0)::BIGINT AS shapley
FROM g
"""


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of conversations that start with turns of another one of their hundred."""
    conv = F.col("conv")
    taken = F.pmod(F.crc32(conv.cast("string")), F.lit(6))
    convs, turns = trie.rebuilt(trie.turns_in_order(table(spark, sf_dir, "conversations")), conv - conv % 100, taken, most=5)
    return trie.prefix_trie(convs, turns)


OP12_SQL = """
WITH turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - c % 100 AS donor,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda r, i: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT c FROM turns)),
built AS (
  SELECT v.c, 0 AS part, pos, role, text FROM convs v JOIN turns t ON t.c = v.donor AND pos <= h
  UNION ALL SELECT v.c, 1, pos, role, text FROM convs v JOIN turns t ON t.c = v.c AND pos > h),
deep AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS d, role, text FROM built),
pre AS (
  SELECT c, d, length(text) AS chars, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d)) AS k FROM deep
  UNION ALL SELECT c, 0, 0, '' FROM convs),
nodes AS (SELECT k, d, any_value(chars) AS chars, min(c) AS owner, count(*) AS n FROM pre GROUP BY k, d),
edges AS (SELECT n.k, any_value(p.k) AS up FROM nodes n JOIN pre x ON x.c = n.owner AND x.d = n.d - 1 JOIN nodes p ON p.k = x.k GROUP BY n.k),
kids AS (SELECT up AS k, count(*) AS n FROM edges GROUP BY up),
facts AS (SELECT n.*, coalesce(kids.n, 0) AS n_children FROM nodes n LEFT JOIN kids USING (k)),
sums AS (SELECT x.k, count(*) FILTER (f.n_children = 0) AS leaves, sum((f.n - 1) * f.chars) AS saved
  FROM facts f JOIN pre x ON x.c = f.owner AND x.d <= f.d GROUP BY x.k),
ends AS (SELECT k, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT c, arg_max(k, d) AS k FROM pre GROUP BY c) GROUP BY k)
SELECT f.owner AS conv_id, f.d AS depth, p.owner AS parent_conv_id, f.n AS n_convs, f.n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens,
  sha256(coalesce(ids, '')) AS ends_sha256
FROM facts f JOIN sums s USING (k) LEFT JOIN ends USING (k) LEFT JOIN edges e ON e.k = f.k LEFT JOIN nodes p ON p.k = e.up
"""


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found of each hundredth one."""
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_url_filter": op2_url_filter,
    "op3_line_dedup": op3_line_dedup,
    "op4_near_dedup": op4_near_dedup,
    "op5_shard": op5_shard,
    "op6_decontaminate": op6_decontaminate,
    "op7_license_scan": op7_license_scan,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_quality": op9_quality,
    "op10_pack": op10_pack,
    "op11_filter_audit": op11_filter_audit,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_neighbours": op13_neighbours,
}

ORACLE_SQL = {
    "op1_chat_format": OP1_SQL,
    "op2_url_filter": OP2_SQL,
    "op3_line_dedup": OP3_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
}
