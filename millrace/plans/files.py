"""Queries of readers, writers and keyed stores: tables are written to a scratch folder and read back by the source."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import vector as V
from millrace.operators import retrieval as R
from millrace.plans.registry import Tables, query
from millrace.session import scratch_folder
from millrace.sources import files as S
from millrace.sources import stores


@query("SELECT event_id, user_id, event_type, md5(props) AS props_md5 FROM events WHERE event_type <> 'view' UNION ALL SELECT event_id + 1000000, user_id, 'late', md5(props) FROM events WHERE event_type = 'error'")
def jsonl_appended(spark, sf):
    """Events appended to JSON lines in two goes and read strictly; rows that lack the type go."""
    e = Tables(spark, sf).events.select("event_id", "user_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("event_type"), "props")
    path = scratch_folder(spark, "events-jsonl")
    S.append_jsonl(e, path)
    S.append_jsonl(e.where("event_type = 'error'").withColumns({"event_id": F.col("event_id") + 1_000_000, "event_type": F.lit("late")}), path)
    rows = S.read_jsonl_strict(spark, path, "event_id long, user_id long, event_type string, props string", ["event_type"])
    return rows.select("event_id", "user_id", "event_type", F.md5("props").alias("props_md5"))


@query("""WITH l AS (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS n FROM conversations WHERE role <> 'system')
SELECT conv_id, turn, (SELECT count(*) FROM l) AS total, (SELECT count(*) FROM l) > 300 AS truncated FROM l WHERE n <= 300 AND turn % 5 <> 4""")
def jsonl_first_lines(spark, sf):
    """The first 300 lines of a JSONL file that are not blank, without the broken ones (the limit is the reader's)."""
    line = F.when(F.col("role") == "system", " ").when(F.col("turn") % 5 == 4, "{broken").otherwise(F.to_json(F.struct("conv_id", "turn")))
    c = Tables(spark, sf).conversations
    path = scratch_folder(spark, "lines")
    # Part files by ranges follow each other in the order of their names.
    c.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn").select(line.alias("value")).write.text(path)
    rows, facts = S.read_jsonl_lenient(spark, path, "conv_id long, turn long", 300)
    return rows.join(F.broadcast(facts))


@query("SELECT n_nationkey AS key, n_name AS name, n_regionkey AS region FROM nation UNION ALL SELECT r_regionkey, r_name, NULL FROM region")
def json_arrays(spark, sf):
    """Datasets of one JSON array each, put together by column name."""
    t = Tables(spark, sf)
    parts = []
    for df, schema in (
        (t.nation.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")), "key int, name string, region int"),
        (t.region.select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")), "key int, name string"),
    ):
        path = scratch_folder(spark, "array")
        df.agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("value")).write.text(path)
        parts.append(S.read_json_array(spark, path, schema))
    return S.union_sources(*parts)


@query("SELECT event_type AS type, count(*) AS n, md5(min(props)) AS args_md5 FROM events WHERE event_type <> 'click' AND user_id % 3 > 0 GROUP BY 1")
def event_logs(spark, sf):
    """Event logs whose entries lack a type or a time, or are broken, read leniently and counted by type."""
    e = Tables(spark, sf).events
    stamp = F.when(F.col("user_id") % 3 > 0, F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    entry = F.to_json(F.struct(F.when(F.col("event_type") != "click", F.col("event_type")).alias("type"), stamp.alias("timestamp"), F.col("props").alias("args")))
    path = scratch_folder(spark, "log")
    e.select(entry.alias("value")).unionByName(spark.createDataFrame([('{"type": "cut',)], "value string")).write.text(path)
    return S.read_event_log(spark, path).groupBy("type").agg(F.count("*").alias("n"), F.md5(F.min("args")).alias("args_md5"))


@query("SELECT conv_id, turn, md5(text) AS question_md5 FROM conversations WHERE trim(text) <> ''")
def qa_csv(spark, sf):
    """Questions and answers of a CSV whose quoted cells hold quotes, commas and line ends."""
    path = scratch_folder(spark, "csv")
    c = Tables(spark, sf).conversations.select(F.col("text").alias("question"), F.concat_ws(",", "conv_id", "turn").alias("answer"))
    c.write.options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    at = F.split("answer", ",")
    return S.read_qa_csv(spark, path).select(F.get(at, 0).cast("long").alias("conv_id"), F.get(at, 1).cast("long").alias("turn"), F.md5("question").alias("question_md5"))


_STORE = """v1 AS (SELECT sha256(text) AS content_hash, max(source) AS file_path FROM documents WHERE lang <> 'de' GROUP BY 1),
v2 AS (SELECT sha256(text) AS content_hash, min(source) AS file_path FROM documents WHERE lang = 'de' OR source = 'src3' GROUP BY 1),
v3 AS (SELECT content_hash, file_path, true AS fresh FROM v2 UNION ALL SELECT content_hash, file_path, false FROM v1 WHERE content_hash NOT IN (SELECT content_hash FROM v2)),
v4 AS (SELECT * FROM v3 WHERE file_path <> 'src5')"""


@query(f"WITH {_STORE} SELECT content_hash, file_path, fresh FROM v4")
def store_versions(spark, sf):
    """A keyed store after writes, an upsert, deletes and the loss of its vectors; read back from its last version."""
    d = Tables(spark, sf).documents.withColumn("content_hash", V.content_hash(F.col("text")))
    store = stores.TableStore(spark, scratch_folder(spark, "store"), "content_hash string, file_path string, fresh boolean, embedding array<float>", "content_hash")
    vector = F.array(F.lit(1.0).cast("float"))
    rows = lambda df, pick, fresh: df.groupBy("content_hash").agg(pick("source").alias("file_path")).withColumns({"fresh": F.lit(fresh), "embedding": vector})
    store.write(rows(d.where("lang <> 'de'"), F.max, False))
    store.upsert(rows(d.where("lang = 'de' OR source = 'src3'"), F.min, True))
    store.delete(store.read().where("file_path = 'src5'"))
    store.clear_vectors()
    return store.read().where("embedding is null").drop("embedding")


@query("""WITH d AS (SELECT sha256(text) AS content_hash, source, lang, TRY_CAST(substr(source, 4) AS INT) AS n FROM documents),
k AS (SELECT content_hash, max(source) AS base, max(n) FILTER (n BETWEEN 5 AND 9) AS late, max(n) FILTER (n < 5) AS early, bool_or(lang = 'fr') IS TRUE AS gone FROM d GROUP BY 1)
SELECT content_hash, CASE WHEN late IS NOT NULL THEN 'run ' || late WHEN early IS NOT NULL THEN 'run ' || early ELSE base END AS file_path FROM k WHERE late IS NOT NULL OR NOT gone""")
def store_runs(spark, sf):
    """A keyed store after ten upserts, deletes between them, and the merges of its runs."""
    d = Tables(spark, sf).documents.select(V.content_hash(F.col("text")).alias("content_hash"), "source", "lang")
    store = stores.TableStore(spark, scratch_folder(spark, "store"), "content_hash string, file_path string", "content_hash")
    store.write(d.groupBy("content_hash").agg(F.max("source").alias("file_path")))
    for n in range(10):
        if n == 5:
            store.delete(d.where("lang = 'fr'"))
        store.upsert(d.where(F.col("source") == f"src{n}").select("content_hash", F.lit(f"run {n}").alias("file_path")))
    return store.read()


@query("""WITH d AS (SELECT doc_id, lang, source, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM documents), f AS (SELECT sha256(t) AS h FROM d WHERE t <> '' AND lang IS DISTINCT FROM 'de'),
o AS (SELECT sha256(t) AS h, arg_min(coalesce(lang, ''), 'd' || doc_id) AS lang FROM d WHERE t <> '' AND lang IS DISTINCT FROM 'fr' GROUP BY 1), c AS (SELECT DISTINCT sha256(t) AS h FROM d WHERE lang = 'en' AND source < 'src2')
SELECT (SELECT count(*) FROM o WHERE h NOT IN (SELECT h FROM f)) AS removed, (SELECT count(*) FROM f WHERE h NOT IN (SELECT h FROM o)) AS added,
  (SELECT count(DISTINCT h) FROM f WHERE h NOT IN (SELECT h FROM c) AND h NOT IN (SELECT h FROM o WHERE lang <> 'de')) AS missing,
  (SELECT count(DISTINCT h) FROM f) AS chunks""")
def index_sync(spark, sf):
    """An index after a pass over files: chunks removed, added and left without a vector; most keep one that the cache lacks."""
    d = Tables(spark, sf).documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file_path"), "text", "lang", "source")
    now = F.current_timestamp()
    old = R.chunk(d.where("lang IS DISTINCT FROM 'fr'"), "file_path", "text", 10**6, 0).drop("ord").withColumns({"embedding": F.array(F.lit(1.0).cast("float")), "updated_at": now})
    old = old.groupBy("content_hash").agg(F.min_by(F.struct(*old.columns), "file_path").alias("r")).select("r.*")
    cache = R.chunk(d.where("lang = 'en' AND source < 'src2'"), "file_path", "text", 10**6, 0).select("content_hash", F.array(F.lit(2.0).cast("float")).alias("embedding")).dropDuplicates(["content_hash"])
    # Documents hold one paragraph each, so a budget over their length makes one chunk of each.
    out, counts = R.sync_index(old, d.where("lang IS DISTINCT FROM 'de'").select("file_path", "text"), cache, tokens=10**6, overlap=0)
    c = {k: v.withColumnRenamed("n", k) for k, v in counts.items()}
    chunks = out.agg(F.count("*").alias("chunks"))
    return c["removed"].crossJoin(c["added"]).crossJoin(c["missing"]).crossJoin(chunks)


@query("SELECT doc_id FROM documents WHERE lang NOT IN ('en', 'fr')")
def vanished_files(spark, sf):
    """Indexed files that are no longer there."""
    d = Tables(spark, sf).documents.select(F.col("doc_id").alias("file_path"), "lang")
    return R.vanished_files(d, d.where("lang IN ('en', 'fr')")).select(F.col("file_path").alias("doc_id"))


@query("SELECT vec_id, NULL::FLOAT[] IS NULL AS cleared FROM embeddings")
def provider_change(spark, sf):
    """All vectors cleared when they come from another model."""
    e = Tables(spark, sf).embeddings
    return R.checked_fingerprint(e, "a:small", "a", "large").select("vec_id", F.col("embedding").isNull().alias("cleared"))


@query("""WITH s AS (SELECT lang AS name, source, row_number() OVER (PARTITION BY lang ORDER BY t DESC, doc_id) AS rn
  FROM (SELECT doc_id, lang, source, CASE WHEN lang = 'fr' AND source > 'src5' THEN 0 WHEN source < 'src15' THEN 1 ELSE 2 END AS t FROM documents))
SELECT name, 'about ' || source AS description, source || ' body' AS body FROM s WHERE rn = 1""")
def skill_override(spark, sf):
    """Skills of markdown files with a front matter; one a name, that of the last tier that has it."""
    src = F.col("source")
    tier = F.when((F.col("lang") == "fr") & (src > "src5"), "builtin").when(src < "src15", "user").otherwise("project")
    text = F.concat(F.lit("---\nname: "), "lang", F.lit("\ndescription:  about "), src, F.lit("\n---\n"), src, F.lit(" body"))
    f = Tables(spark, sf).documents.select(F.lpad(F.col("doc_id").cast("string"), 20, "0").alias("file_path"), text.alias("text"), tier.alias("source"))
    return S.override(S.front_matter(f), ["builtin", "user", "project"]).select("name", "description", "body")
