"""Queries of retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import vector as V
from millrace.operators import keyword_index as K
from millrace.operators import retrieval as R
from millrace.plans.registry import Tables, query
from millrace.session import scratch_folder

_SETUP = """
q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0),
vec AS (SELECT q.query_id, v.vec_id AS chunk_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.e::DOUBLE[]), 5) AS score FROM q CROSS JOIN embeddings v),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM vec QUALIFY rank <= 12)"""


def _queries(spark, sf):
    """The rows whose id is divisible by 100."""
    which = "query_id % 100 = 0"
    t = Tables(spark, sf)
    words = t.documents.select(F.col("doc_id").alias("query_id"), F.substring_index("text", " ", 2).alias("text")).where(which)
    vectors = t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding").where(which)
    return vectors.join(words, "query_id", "full")


def _chunks(spark, sf):
    t = Tables(spark, sf)
    path = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit(".md"))).when(
        F.col("doc_id") % 3 == 1, F.concat(F.lit("sessions/"), F.col("doc_id").cast("string"))).otherwise("MEMORY.md")
    d = t.documents.select(F.col("doc_id").alias("chunk_id"), path.alias("file_path"), F.lit(1).alias("start_line"), F.lit(9).alias("end_line"), F.lit("2024-01-20 00:00:00").cast("timestamp").alias("updated_at"), F.col("text").alias("content"))
    return d.join(t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id", "left")


def _vectors(spark, sf):
    c = Tables(spark, sf).embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding")
    # Rounded before ranks are given, since sums of floats differ in their last bits.
    return R.vector_topk(c, _queries(spark, sf), 12, digits=5)


def _keywords(spark, sf):
    return K.hits(spark, _stored(spark, sf), _queries(spark, sf)).select("query_id", "chunk_id", F.lit(1.0).alias("score"))


@query(f"WITH {_SETUP} SELECT query_id, chunk_id, score, rank::INT AS rank FROM top")
def vector_topk(spark, sf):
    """The twelve nearest vectors of each hundredth vector."""
    return _vectors(spark, sf)


_WORDS = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'))"
_KEY = f"""qw AS (SELECT doc_id AS query_id, {_WORDS.format("array_to_string(list_slice(string_split(text, ' '), 1, 2), ' ')")} AS ws FROM documents WHERE doc_id % 100 = 0),
dw AS (SELECT doc_id AS chunk_id, {_WORDS.format('text')} AS ws FROM documents),
hit AS (SELECT query_id, chunk_id FROM qw JOIN dw ON list_has_all(dw.ws, qw.ws) WHERE len(qw.ws) > 0)"""


@query(f"WITH {_KEY} SELECT query_id, chunk_id, 1.0::DOUBLE AS score FROM hit")
def keyword_and_search(spark, sf):
    """Documents that hold all words of a query, through the stored inverted index."""
    return _keywords(spark, sf).select("query_id", "chunk_id", F.col("score").cast("double").alias("score"))


_BM25 = r"""dt AS (SELECT doc_id AS chunk_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM dt GROUP BY ALL), dl AS (SELECT chunk_id, sum(tf) AS len FROM tf GROUP BY 1),
tot AS (SELECT count(*) AS n, avg(len) AS mean FROM dl), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
bm AS (SELECT query_id, chunk_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS bm25
  FROM hit JOIN qw USING (query_id) JOIN tf USING (chunk_id) JOIN dl USING (chunk_id) JOIN df USING (term), tot WHERE list_contains(qw.ws, term) GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, chunk_id) AS rank FROM bm QUALIFY rank <= 12)"""


def _stored(spark, sf) -> str:
    """The folder of a stored index of all documents."""
    path = scratch_folder(spark, "keyword-index")
    K.build_index(Tables(spark, sf).documents, path, "doc_id", "text")
    return path


@query(f"WITH {_KEY}, {_BM25} SELECT query_id, chunk_id, bm25, rank::INT AS rank FROM best")
def keyword_topk(spark, sf):
    """The twelve best documents that hold all words of a query, through a stored index whose blocks are skipped where they cannot reach them."""
    return K.bm25_topk(spark, _stored(spark, sf), _queries(spark, sf), 12, digits=6)


@query(f"""WITH {_SETUP}, {_KEY}, k AS (SELECT query_id, chunk_id, 1.0 AS k FROM hit),
m AS (SELECT coalesce(t.query_id, k.query_id) AS query_id, coalesce(t.chunk_id, k.chunk_id) AS chunk_id, t.score AS v, k.k AS k FROM top t FULL JOIN k ON t.query_id = k.query_id AND t.chunk_id = k.chunk_id),
w AS (SELECT *, count(v) OVER p > 0 AS hv, count(k) OVER p > 0 AS hk FROM m WINDOW p AS (PARTITION BY query_id)),
s AS (SELECT query_id, chunk_id, coalesce(v, 0) * CASE WHEN hv AND hk THEN 0.7 WHEN hv THEN 1 ELSE 0 END + coalesce(k, 0) * CASE WHEN hv AND hk THEN 0.3 WHEN hv THEN 0 ELSE 1 END AS score,
  CASE WHEN coalesce(v, 0) > 0 AND coalesce(k, 0) > 0 THEN 'both' WHEN coalesce(v, 0) > 0 THEN 'vector' ELSE 'keyword' END AS source FROM w)
SELECT query_id, chunk_id, round(score, 8) AS score, source FROM s WHERE score >= 0.1""")
def hybrid_search(spark, sf):
    """Vector and keyword candidates merged."""
    return K.merged_with_vectors(spark, _stored(spark, sf), _queries(spark, sf), _vectors(spark, sf)).withColumn("score", F.round("score", 8))


@query(f"""WITH {_SETUP}, p AS (SELECT *, CASE WHEN chunk_id % 3 = 0 THEN date '2024-01-01' + (chunk_id % 28)::INT WHEN chunk_id % 3 = 1 THEN date '2024-01-20' END AS since FROM top WHERE chunk_id IN (SELECT doc_id FROM documents))
SELECT query_id, chunk_id, round(CASE WHEN since IS NULL THEN score ELSE score * exp(-ln(2) / 30 * greatest(0, date_diff('day', since, date '2024-02-15'))) END, 5) AS score FROM p""")
def decay_rank(spark, sf):
    """Scores decayed by the age of their file."""
    r = R.with_details(_vectors(spark, sf), _chunks(spark, sf))
    return R.decayed(r, F.lit("2024-02-15 00:00:00").cast("timestamp")).select("query_id", "chunk_id", F.round("score", 5).alias("score"))


@query()
def mmr_rerank(spark, sf):
    """Re-ranked for diversity (each choice depends on those before; held against a plain loop by tests)."""
    return R.mmr(R.with_details(_vectors(spark, sf), _chunks(spark, sf)))


@query()
def memory_search(spark, sf):
    """The whole search: candidates, merge, decay, diversity, top six."""
    c, q = _chunks(spark, sf), _queries(spark, sf)
    out = R.hybrid_search(c, _stored(spark, sf), q, F.lit("2024-02-15 00:00:00").cast("timestamp"))
    return out.withColumn("score", F.round("score", 5)).drop("snippet")


@query(r"""WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS ws FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.ws, b.ws))::DOUBLE / len(list_distinct(list_concat(a.ws, b.ws))), 6) AS similarity
FROM t a JOIN t b ON a.item_id < b.item_id AND len(list_intersect(a.ws, b.ws)) > 0""")
def jaccard_pairs(spark, sf):
    """Similarity of benchmark items that share a word."""
    t = Tables(spark, sf).benchmark.select("item_id", V.ascii_tokens(F.col("text")).alias("ws"))
    each = t.select("item_id", F.explode("ws").alias("w"))
    ids = each.alias("x").join(each.alias("y"), F.col("x.w") == F.col("y.w")).where("x.item_id < y.item_id").select(F.col("x.item_id").alias("a"), F.col("y.item_id").alias("b")).distinct()
    both = ids.join(t.select(F.col("item_id").alias("a"), F.col("ws").alias("wa")), "a").join(t.select(F.col("item_id").alias("b"), F.col("ws").alias("wb")), "b")
    return both.select("a", "b", F.round(V.jaccard(F.col("wa"), F.col("wb")), 6).alias("similarity"))


@query(r"""WITH s AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, md5(CASE WHEN length(t) <= 700 THEN t ELSE trim(left(t, 700)) || '...' END) AS snippet_md5 FROM s""")
def snippets(spark, sf):
    """Snippets of documents."""
    return Tables(spark, sf).documents.select("doc_id", F.md5(V.snippet(F.col("text"))).alias("snippet_md5"))


@query("SELECT sha256(text) AS content_hash, max(doc_id) AS id, count(*) AS n FROM documents GROUP BY 1")
def content_hash_dedupe(spark, sf):
    """One row a content, the last id wins."""
    d = Tables(spark, sf).documents.select(V.content_hash(F.col("text")).alias("content_hash"), "doc_id")
    return d.groupBy("content_hash").agg(F.max("doc_id").alias("id"), F.count("*").alias("n"))


@query("""WITH new AS (SELECT sha256(text) AS content_hash, arg_max(source, doc_id) AS file_path FROM documents WHERE lang IN ('en', 'de') GROUP BY 1), old AS (SELECT sha256(text) AS content_hash, max(source) AS file_path FROM documents WHERE lang IS NULL OR lang NOT IN ('en', 'de') OR source = 'src1' GROUP BY 1)
SELECT content_hash, n.file_path FROM new n UNION ALL SELECT content_hash, o.file_path FROM old o WHERE content_hash NOT IN (SELECT content_hash FROM new)""")
def upsert_by_hash(spark, sf):
    """New rows replace old ones of their key."""
    d = Tables(spark, sf).documents.withColumn("content_hash", V.content_hash(F.col("text")))
    # New rows repeat keys; the last of them stays.
    new = d.where("lang IN ('en', 'de')").select("content_hash", F.col("source").alias("file_path"), "doc_id")
    old = d.where("lang IS NULL OR lang NOT IN ('en', 'de') OR source = 'src1'").groupBy("content_hash").agg(F.max("source").alias("file_path"))
    return R.latest_wins(old, new, "content_hash", "doc_id").select("content_hash", "file_path")


@query("SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en')")
def anti_join_missing(spark, sf):
    """Contents without a cached vector."""
    d = Tables(spark, sf).documents.select("doc_id", "lang", V.content_hash(F.col("text")).alias("content_hash"))
    return R.missing_vectors(d, d.where("lang = 'en'")).select("doc_id")


_TALK = "talk AS (SELECT conv_id, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"


def _talks(spark, sf):
    from millrace.operators.context import joined_text

    return joined_text(Tables(spark, sf).conversations.na.fill("", ["text"]), "conv_id", "turn", "text")


@query(f"""WITH {_TALK}, l AS (SELECT conv_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM talk),
g AS (SELECT *, sum((trim(line) = '')::INT) OVER (PARTITION BY conv_id ORDER BY n) AS run FROM l),
p AS (SELECT conv_id, run, min(n) AS start_line, max(n) AS end_line, sum(length(line)) + count(*) - 1 AS chars FROM g WHERE trim(line) <> '' GROUP BY ALL)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY start_line)::INT AS ord, start_line::INT AS start_line, end_line::INT AS end_line FROM p""")
def paragraph_spans(spark, sf):
    """Paragraphs of conversations and their lines."""
    return R.paragraphs(_talks(spark, sf), "conv_id", "text").drop("text")


@query()
def chunk_conversations(spark, sf):
    """Chunks of conversations (a fold of paragraphs; held against a plain version by tests)."""
    return R.chunk(_talks(spark, sf), "conv_id", "text", 60, 20).drop("content")


@query("""SELECT conv_id, turn, sha256('User: ' || trim(regexp_replace(u, '\\s+', ' ', 'g')) || chr(10) || 'Assistant: ' || trim(regexp_replace(a, '\\s+', ' ', 'g'))) AS content_hash
FROM (SELECT conv_id, turn, role, text AS u, lead(role) OVER w AS next, lead(text) OVER w AS a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE role = 'user' AND next = 'assistant' AND trim(u) <> '' AND trim(a) <> ''""".replace("\\\\", "\\"))
def transcripts(spark, sf):
    """Turns with both sides as searchable entries."""
    from millrace.operators.context import chat_pairs

    pairs = chat_pairs(Tables(spark, sf).conversations).where("agent_response is not null")
    rows = R.transcripts(pairs.select(F.struct("conv_id", "turn").alias("id"), "user_message", "agent_response", F.lit(None).cast("timestamp").alias("timestamp")))
    return rows.select("id.conv_id", "id.turn", "content_hash")


@query("SELECT doc_id, ceil(length(text) / 3.5)::BIGINT AS tokens, substr(md5(text), 1, 12) AS key FROM documents")
def token_estimates(spark, sf):
    """Token estimates and short keys."""
    return Tables(spark, sf).documents.select("doc_id", V.token_estimate(F.col("text")).alias("tokens"), V.short_key(F.col("text")).alias("key"))
