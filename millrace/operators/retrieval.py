"""Chunks, indexes and hybrid search."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import vector as V
from millrace.operators.vector_index import topk as vector_topk
from millrace.session import written

CHUNK_TOKENS, OVERLAP_TOKENS, MAX_RESULTS, MIN_SCORE, HALF_LIFE, MMR_LAMBDA = 400, 80, 6, 0.1, 30.0, 0.7


def paragraphs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Runs of lines that are not blank: id, ord, start_line, end_line, text (W08). By built-ins: gaps and islands over lines."""
    lines = df.select(id_col, F.posexplode(F.split(text_col, "\n", -1)).alias("n", "line")).withColumn("blank", F.col("line").rlike(r"^\s*$"))
    w = Window.partitionBy(id_col).orderBy("n")
    runs = lines.withColumn("run", F.sum(F.col("blank").cast("int")).over(w)).where("not blank")
    out = runs.groupBy(id_col, "run").agg(
        (F.min("n") + 1).alias("start_line"),
        (F.max("n") + 1).alias("end_line"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("text"),
    )
    return out.select(id_col, F.row_number().over(Window.partitionBy(id_col).orderBy("start_line")).alias("ord"), "start_line", "end_line", F.regexp_replace("text", r"^\s+|\s+$", "").alias("text"))


def pack_paragraphs(parts: list[tuple[int, int, str]], budget: int, overlap: int) -> list[tuple[int, int, str]]:
    """Paragraphs (first line, last line, text) packed greedily into chunks of a number of signs.

    A chunk takes paragraphs while they fit, one at least. The next one starts with as many of its last paragraphs as the overlap
    holds, but always later than the chunk before.
    """
    chunks, start = [], 0
    while start < len(parts):
        stop, size = start, 0
        while stop < len(parts):
            grown = size + len(parts[stop][2]) + (2 if stop > start else 0)
            if stop > start and grown > budget:
                break
            size, stop = grown, stop + 1
            if size >= budget:
                break
        chunks.append((parts[start][0], parts[stop - 1][1], "\n\n".join(p[2] for p in parts[start:stop])))
        if stop == len(parts):
            break
        again, carried = stop, 0
        while again > start and carried + len(parts[again - 1][2]) <= overlap:
            again -= 1
            carried += len(parts[again][2])
        start = again if again > start else max(start + 1, stop)
    return chunks


def chunk(df: DataFrame, id_col: str, text_col: str, tokens: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """Chunks of texts: id, ord, start_line, end_line, content, content_hash (W07). Packing depends on what went before, so each text is folded in an Arrow batch."""
    budget, carry = V.char_budget(tokens), V.char_budget(overlap)

    def split(text: str) -> list[tuple[int, int, str]]:
        out, run = [], []
        for n, line in enumerate([*text.split("\n"), ""], 1):
            if line.strip():
                run.append(line)
            elif run:
                out.append((n - len(run), n - 1, "\n".join(run).strip()))
                run = []
        return out

    @F.pandas_udf("array<struct<start_line:int,end_line:int,content:string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("start_line", "end_line", "content")
        for texts in batches:
            yield pd.Series([[dict(zip(names, c, strict=True)) for c in pack_paragraphs(split(t or ""), budget, carry)] for t in texts])

    out = df.select(id_col, F.posexplode(run(F.col(text_col))).alias("ord", "c"))
    return out.select(id_col, (F.col("ord") + 1).alias("ord"), "c.*", V.content_hash(F.col("c.content")).alias("content_hash"))


def query_terms(queries: DataFrame) -> DataFrame:
    """Distinct words of each query: query_id, need (their number), term."""
    words = queries.select("query_id", F.array_distinct(V.word_tokens(F.lower("text"))).alias("ws")).where(F.size("ws") > 0)
    return words.select("query_id", F.size("ws").alias("need"), F.explode("ws").alias("term"))


def inverted_index(chunks: DataFrame, chunk_id: str = "chunk_id", text: str = "content", queries: DataFrame | None = None) -> DataFrame:
    """Terms of chunks with their frequency and the chunk's length: term, chunk_id, tf, len (the full-text table of S13).

    queries: only the terms of these queries are kept, before anything is shuffled where they are small enough for Spark to broadcast; for a
    search without a stored index.
    """
    words = chunks.select(F.col(chunk_id).alias("chunk_id"), V.word_tokens(F.lower(text)).alias("ws")).withColumn("len", F.size("ws"))
    each = words.select("chunk_id", "len", F.explode("ws").alias("term"))
    if queries is not None:
        each = each.join(query_terms(queries).select("term").distinct(), "term")
    return each.groupBy("term", "chunk_id").agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def corpus_totals(chunks: DataFrame, text: str = "content") -> DataFrame:
    """Number of chunks with words, and their mean length: one row."""
    n = F.size(V.word_tokens(F.lower(text)))
    return chunks.select(n.alias("len")).where("len > 0").agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))


def keyword_topk(index: DataFrame, queries: DataFrame, k: int | None, mode: str = "parity", totals: DataFrame | None = None) -> DataFrame:
    """Chunks that hold all words of a query (T02, R02, R03): query_id, chunk_id, score, and rank where there is a k; without, all of them.

    mode "parity": every hit scores 1, as a negative rank does where only its size counts; "bm25": positive BM25 scaled to x / (1 + x).
    The hits are ranked by BM25 in both. Queries without words have no hits. totals: corpus_totals(), where the index holds the
    queries' terms alone. Chunks are found by the rarest word of a query; only these are looked up under its other words, so a common word
    meets the queries that have no rarer one alone.
    """
    terms = query_terms(queries)
    if totals is None:
        totals = index.groupBy("chunk_id").agg(F.first("len").alias("len")).agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    index = written(index.join(terms.select("term").distinct(), "term", "left_semi"), "query-postings")
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    terms = written(terms.join(df, "term").withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("df", "term"))), "query-words")
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    gain = idf * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("len") / F.col("avg_len")))
    first = index.join(terms.where("nth = 1"), "term")
    more = first.where("need > 1").select("query_id", "chunk_id").join(terms.where("nth > 1"), "query_id").join(index, ["chunk_id", "term"])
    hits = first.unionByName(more).join(F.broadcast(totals))  # one row
    scored = hits.groupBy("query_id", "chunk_id", "need").agg(F.count("*").alias("have"), F.sum(gain).alias("bm25")).where("have = need")
    w = Window.partitionBy("query_id").orderBy(F.desc("bm25"), "chunk_id")
    score = F.lit(1.0) if mode == "parity" else F.col("bm25") / (1 + F.col("bm25"))
    if k is None:
        return scored.select("query_id", "chunk_id", score.alias("score"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "chunk_id", score.alias("score"), "rank")


def merge_scores(vectors: DataFrame, keywords: DataFrame, weights: tuple[float, float] = (0.7, 0.3), min_score: float = MIN_SCORE) -> DataFrame:
    """Both candidate lists by chunk, missing scores 0, weighted (J01, R04, R05): query_id, chunk_id, score, source.

    Where only one list has hits for a query, its weight is 1.
    """
    v = vectors.select("query_id", "chunk_id", F.col("score").alias("v"))
    k = keywords.select("query_id", "chunk_id", F.col("score").alias("k"))
    both = v.join(k, ["query_id", "chunk_id"], "full")
    w = Window.partitionBy("query_id")
    return weighed(both.withColumns({"has_v": F.count("v").over(w) > 0, "has_k": F.count("k").over(w) > 0}), weights, min_score)


def weighed(both: DataFrame, weights: tuple[float, float], min_score: float) -> DataFrame:
    """Pairs with the scores of both lists (v, k), and whether a list has hits for the query (has_v, has_k): query_id, chunk_id, score, source."""
    a, b = V.normalised_weights(*weights)
    has_v, has_k = F.col("has_v"), F.col("has_k")
    vw = F.when(has_v & has_k, F.lit(a)).when(has_v, F.lit(1.0)).otherwise(F.lit(0.0))
    kw = F.when(has_v & has_k, F.lit(b)).when(has_v, F.lit(0.0)).otherwise(F.lit(1.0))
    both = both.withColumns({"vw": vw, "kw": kw}).na.fill(0.0, ["v", "k"])
    out = both.select("query_id", "chunk_id", (F.col("v") * F.col("vw") + F.col("k") * F.col("kw")).alias("score"), V.source_label(F.col("v"), F.col("k")).alias("source"))
    return out.where(F.col("score") >= min_score)


def with_details(ranked: DataFrame, chunks: DataFrame, chunk_id: str = "chunk_id") -> DataFrame:
    """Ranked ids with their chunk's columns and snippet; ids without a chunk go (J02). Snippets are cut before the join, so no whole content is shuffled."""
    details = chunks.select(F.col(chunk_id).alias("chunk_id"), "file_path", "start_line", "end_line", "updated_at", V.snippet(F.col("content")).alias("snippet"))
    return details.join(ranked, "chunk_id")


def decayed(results: DataFrame, now: Column, half_life: float = HALF_LIFE) -> DataFrame:
    """Scores decayed by age; ageless files stay as they are."""
    age = V.age_days(F.col("file_path"), F.col("updated_at"), now)
    return results.withColumn("score", F.when(age.isNull(), F.col("score")).otherwise(F.col("score") * V.decay(age, half_life)))


def mmr_order(ids: list, scores: list[float], sets: list[set], weight: float) -> list:
    """Ids in the order of maximal marginal relevance (W01, J17): each place goes to the best of weight * scaled score less
    (1 - weight) * the highest similarity to those chosen; ties to the higher score, then to the earlier one."""
    weight = min(1.0, max(0.0, weight))
    order = list(range(len(ids)))
    if weight == 1:
        return [ids[i] for i in sorted(order, key=lambda i: -scores[i])]
    low, spread = min(scores, default=0.0), max(scores, default=0.0) - min(scores, default=0.0)
    near = [0.0] * len(ids)
    out = []
    while order:
        best = max(order, key=lambda i: (weight * ((scores[i] - low) / spread if spread else 1.0) - (1 - weight) * near[i], scores[i], -i))
        order.remove(best)
        out.append(ids[best])
        for i in order:
            a, b = sets[i], sets[best]
            same = 1.0 if not a and not b else 0.0 if not a or not b else len(a & b) / len(a | b)
            near[i] = max(near[i], same)
    return out


def mmr(results: DataFrame, k: int = MAX_RESULTS, weight: float = MMR_LAMBDA) -> DataFrame:
    """Re-ranks the best 2k results of each query for diversity: query_id, chunk_id, score, rank.

    What is chosen depends on what was chosen before, so the at most 2k rows of a query are folded together.
    """
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    head = results.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= 2 * k).withColumn("_words", V.ascii_tokens(F.col("snippet")))

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_rn")
        order = mmr_order(rows["chunk_id"].tolist(), rows["score"].tolist(), [set(x) for x in rows["_words"]], weight)[:k]
        rows = rows.set_index("chunk_id").loc[order].reset_index()
        return rows.assign(rank=range(1, len(rows) + 1))[["query_id", "chunk_id", "score", "rank"]]

    return head.select("query_id", "chunk_id", "score", "_rn", "_words").groupBy("query_id").applyInPandas(fold, "query_id long, chunk_id long, score double, rank int")


def hybrid_search(chunks: DataFrame, index: DataFrame | str, queries: DataFrame, now: Column, k: int = MAX_RESULTS, weights: tuple[float, float] = (0.7, 0.3),
                  min_score: float = MIN_SCORE, half_life: float | None = HALF_LIFE, mmr_weight: float | None = MMR_LAMBDA, mode: str = "parity", totals: DataFrame | None = None) -> DataFrame:
    """Vector and keyword candidates (4k each), merged, decayed, diversified, the best k (T03): query_id, chunk_id, score, source, rank, snippet, file_path.

    index: inverted_index(), or the folder of a stored one (keyword_index).
    """
    if isinstance(index, str):
        from millrace.operators import keyword_index

        words = keyword_index.search(chunks.sparkSession, index, queries, 4 * k, mode)
    else:
        words = keyword_topk(index, queries, 4 * k, mode, totals)
    merged = merge_scores(vector_topk(chunks, queries, 4 * k), words, weights, min_score)
    results = with_details(merged, chunks)
    # Both the order of diversity and what is returned come from it.
    results = written(decayed(results, now, half_life) if half_life else results, "search-results")
    if mmr_weight is None:
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
        ranked = results.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    else:
        ranked = mmr(results, k, mmr_weight).select("query_id", "chunk_id", "rank").join(results, ["query_id", "chunk_id"])
    return ranked.select("query_id", "chunk_id", "score", "source", "rank", "snippet", "file_path")


def latest_wins(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Upsert as a rewrite: rows of new replace those of old with their key.

    Of rows of new with one key that with the greatest order stays (ties, and all where there is no order: the greatest by all columns).
    Combined on the map side, so a key that repeats is no hot one. A null key is a key.
    """
    rank = F.struct(*([order] if order else []), *(c for c in new.columns if c != order))
    last = new.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*new.columns), rank).alias("_row")).select("_row.*")
    kept = old.join(last.select(F.col(key).alias("_key")), F.col(key).eqNullSafe(F.col("_key")), "left_anti")
    return kept.unionByName(last, allowMissingColumns=True)


def upsert_chunks(old: DataFrame, new: DataFrame, keep_vectors: bool = True, touch: bool = False) -> DataFrame:
    """Chunks keyed by content hash (S15). New rows win and may move a chunk to another file.

    Of new rows with one hash that with the last file path stays (ties: the greatest by all columns). keep_vectors: a new row without a vector keeps the old one's. touch: unchanged chunks get the new row's time too; else they keep theirs.
    """
    last = new.withColumn("_rn", F.row_number().over(Window.partitionBy("content_hash").orderBy(F.desc("file_path"), *(F.desc(c) for c in new.columns if c != "file_path")))).where("_rn = 1").drop("_rn")
    merged = old.alias("o").join(last.alias("n"), F.col("o.content_hash") == F.col("n.content_hash"), "full")
    cols = []
    for c in old.columns:
        value = F.coalesce(f"n.{c}", f"o.{c}") if c in last.columns else F.col(f"o.{c}")
        if c == "embedding" and not keep_vectors:
            value = F.when(F.col("n.content_hash").isNotNull(), F.col("n.embedding")).otherwise(F.col("o.embedding"))
        if c == "updated_at" and not touch:
            value = F.coalesce("o.updated_at", "n.updated_at")
        cols.append(value.alias(c))
    return merged.select(*cols)


def missing_vectors(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Chunks whose content has no cached vector."""
    return chunks.join(cache.select("content_hash"), "content_hash", "left_anti")


def vanished_files(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """Indexed files that are no longer there."""
    return indexed.select("file_path").distinct().join(current.select("file_path"), "file_path", "left_anti")


def checked_fingerprint(chunks: DataFrame, stored: str | None, provider: str, model: str) -> DataFrame:
    """All vectors cleared if they come from another provider or model."""
    return chunks if stored == f"{provider}:{model}" else chunks.withColumn("embedding", F.lit(None).cast(chunks.schema["embedding"].dataType))


def sync_index(
    chunks: DataFrame, files: DataFrame, cache: DataFrame, force: bool = False, tokens: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Index after a pass over the files (S19): vanished files' chunks removed, those of changed files replaced, vectors from the cache.

    Returns the chunks and, as lazy counts, removed, added and missing (chunks left without a vector).
    """
    fresh = chunk(files, "file_path", "text", tokens, overlap).drop("ord").join(cache.select("content_hash", "embedding"), "content_hash", "left").withColumn("updated_at", F.current_timestamp())
    current = files.select("file_path").distinct()
    kept = chunks.join(current, "file_path", "left_semi").join(fresh.select("content_hash"), "content_hash", "left_semi")
    out = fresh.select(*[c for c in chunks.columns if c in fresh.columns]) if force else upsert_chunks(kept, fresh.select(*[c for c in chunks.columns if c in fresh.columns]))
    return out, {
        "removed": chunks.join(fresh.select("content_hash"), "content_hash", "left_anti").agg(F.count("*").alias("n")),
        "added": fresh.join(chunks.select("content_hash"), "content_hash", "left_anti").agg(F.count("*").alias("n")),
        "missing": out.where("embedding IS NULL").agg(F.count("*").alias("n")),
    }


def transcripts(history: DataFrame) -> DataFrame:
    """Chat turns with both sides as searchable entries: id, content, content_hash, timestamp."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    text = F.concat(F.lit("User: "), flat("user_message"), F.lit("\nAssistant: "), flat("agent_response"))
    full = (flat("user_message") != "") & (flat("agent_response") != "")
    return history.where(full).select("id", text.alias("content"), V.content_hash(text).alias("content_hash"), "timestamp")
