import datetime as dt
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import context as C
from millrace.operators import finance as O
from millrace.operators import ingest as I
from millrace.operators import messaging as M
from millrace.streaming import ops as S
from millrace.streaming import ordered as O2


def one(spark, col):
    return spark.range(1).select(col).head()[0]


ACCESS = "own string, frm string, sender string, grp boolean, mine boolean, dm string, gp string, allow array<string>, gallow array<string>, ts long, conn long"


@pytest.mark.parametrize(
    ("row", "reason", "pairing"),
    [
        (("+1", "+1", "+1", False, True, "allowlist", "open", ["+1"], [], 0, 0), None, False),
        (("+1", "+2", "+2", False, False, "open", "open", ["1"], [], 0, 0), "sender_not_self_in_self_chat_mode", False),
        (("+1", "+2", "+2", True, False, "open", "open", ["1"], [], 0, 0), "group_blocked_self_chat_mode", False),
        (("+1", "+2", "+2", True, False, "open", "disabled", [], [], 0, 0), "group_policy_not_permissive", False),
        (("+1", "+2", "+2", True, False, "open", "allowlist", [], [], 0, 0), "group_allowlist_empty", False),
        (("+1", "+2", None, True, False, "open", "allowlist", [], ["2"], 0, 0), "group_sender_not_allowlisted", False),
        (("+1", "+2", "+2", True, False, "open", "allowlist", [], ["*"], 0, 0), None, False),
        (("+1", "+2", "+2", False, False, "disabled", "open", [], [], 0, 0), "dm_policy_disabled", False),
        (("+1", "+2", "+1", False, True, "open", "open", [], [], 0, 0), "outbound_dm_to_non_self", False),
        (("+1", "+2", "+2", False, False, "pairing", "open", ["+3"], [], 100_000, 0), "dm_sender_not_allowlisted", True),
        (("+1", "+2", "+2", False, False, "pairing", "open", ["+3"], [], 0, 100_000), "dm_sender_not_allowlisted", False),
        (("+1", "+2", "+2", False, False, "allowlist", "open", ["*"], [], 0, 0), None, False),
        ((None, "+2", "+2", False, False, "allowlist", "open", ["+ 2"], [], 0, 0), None, False),
    ],
)
def test_access(spark, row, reason, pairing):
    d = spark.createDataFrame([row], ACCESS).select(M.access("own", "frm", "sender", "grp", "mine", "dm", "gp", "allow", "gallow", "ts", "conn").alias("d")).head()["d"]
    assert (d["reason"], d["allowed"], d["pairing"]) == (reason, reason is None, pairing)


def test_outbound(spark):
    call = lambda to, policy="open", allow=("*", "+1"): one(spark, M.outbound(F.lit(to), F.lit(policy), F.array(*map(F.lit, allow))))
    assert call("+1")["allowed"] and call("+2")["reason"] == "recipient_not_allowlisted" and call("+2", allow=("*",))["reason"] == "no_explicit_recipient"
    assert call("9@g.us")["allowed"] and call("9@g.us", "disabled")["reason"] == "group_destinations_disabled" and call("x@lid")["jid"] == "x@s.whatsapp.net"


def test_suppression_needs_the_last_alert(spark):
    call = lambda text, last, age: one(spark, M.suppression(F.lit(text), F.lit(last), F.lit(age)))["reason"]
    assert call("up", "up", 23 * 3_600_000) == "duplicate" and call("up", "up", 25 * 3_600_000) == "none" and call("up", "down", 1) == "none"
    assert one(spark, M.heartbeat_empty(F.lit("# head\n\n- \n* "))) and not one(spark, M.heartbeat_empty(F.lit("# head\n- buy")))


def test_jobs(spark):
    rows = [("at", True, 0, 9, False, 0, "keep"), ("every", True, 3, 9, False, 0, "keep"), ("every", False, 0, 10**9, False, 0, "keep"), ("every", True, 0, None, True, 2, "keep"), ("every", True, 0, 9, False, 0, "once")]
    df = spark.createDataFrame(rows, "kind string, ok boolean, consecutive_errors int, next_normal_ms long, schedule_failed boolean, schedule_errors int, fulfillment string")
    got = [(r["enabled"], r["next_run_ms"], r["consecutive_errors"]) for r in M.after_run(df, F.lit(1000)).collect()]
    assert got == [(False, None, 0), (True, 9, 0), (True, 10**9, 1), (False, None, 0), (False, None, 0)]
    jobs = spark.createDataFrame([(True, 5), (False, 1), (True, 50)], "enabled boolean, next_run_ms long")
    assert M.due_jobs(jobs, F.lit(10)).count() == 1
    s = spark.createDataFrame([("a", 1, "x"), ("b", 9, ""), ("c", 5, "y")], "session_key string, updated_at long, last_to string")
    assert M.last_target(s).head()["session_key"] == "c"


def test_context_edges(spark):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(["A", "A", "B", None, None, "A"])], "k int, o int, t string")
    assert [r["o"] for r in C.drop_consecutive_duplicates(df, "k", "o", "t").orderBy("o").collect()] == [0, 2, 3, 5]
    for n, cleared in ((8, 0), (9, 5)):
        rows = spark.createDataFrame([(1, i, "x" * 7) for i in range(n)], "k int, o int, c string")
        out = C.microcompact(rows, "k", "o", "c", F.lit(True))
        assert out.where("cleared").count() == cleared and (out.agg(F.sum("tokens_saved")).head()[0] or 0) == 2 * cleared
    big = spark.createDataFrame([(1, i, "x" * 70_000) for i in range(5)], "k int, o int, c string")
    assert [r["trigger"] for r in C.microcompact(big, "k", "o", "c", F.lit(True)).collect()] == ["token"] * 5
    sizes = spark.createDataFrame([(1, 1, 120_000), (1, 2, 70_000), (1, 3, 20_000), (2, 1, 200_000)], "k int, o int, s long")
    got = {(r["k"], r["o"]): r["persisted"] for r in C.spill_to_budget(sizes, "k", "o", "s").collect()}
    assert got == {(1, 1): True, (1, 2): False, (1, 3): False, (2, 1): False}


def test_budget_as_a_plain_loop(spark):
    rng = random.Random(3)
    rows = [(k, o, rng.randint(1, 90)) for k in range(40) for o in range(rng.randint(1, 8))]
    got = {(r["k"], r["o"]): r["persisted"] for r in C.spill_to_budget(spark.createDataFrame(rows, "k int, o int, s long"), "k", "o", "s", 120, 20).collect()}
    for k in range(40):
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2], r[1]))
        left, stop = sum(r[2] for r in own), False
        for r in own:
            stop = stop or left <= 120
            assert got[k, r[1]] == (not stop)
            left -= 0 if stop else r[2] - 20


def test_greedy_pack_as_a_plain_loop(spark):
    rng = random.Random(4)
    rows = [(k, o, rng.randint(1, 60)) for k in range(30) for o in range(rng.randint(1, 9))]
    got = {(r["k"], r["o"]): r["taken"] for r in C.greedy_pack(spark.createDataFrame(rows, "k int, o int, s int"), "k", "o", "s", 100).collect()}
    for k in range(30):
        used = 0
        for _, o, s in sorted(r for r in rows if r[0] == k):
            assert got[k, o] == (used + s <= 100)
            used += s if used + s <= 100 else 0


def test_finance_operators(spark):
    df = spark.createDataFrame([("X", "Tech", 5.0), ("Y", "tech", 9.0), ("Z", "Oil", 1.0)], "ticker string, sector string, pe double")
    assert [r[0] for r in O.screen(df, [{"field": "sector", "operator": "eq", "value": "TECH"}, {"field": "pe", "operator": "gte", "value": 6}], order=["ticker"]).collect()] == ["Y"]
    with pytest.raises(ValueError):
        O.predicate([{"field": "pe", "operator": "like", "value": 1}])
    assert O.request(df.withColumn("report_period", F.lit("2024-01-01")), ticker=" x ").count() == 1
    m = spark.createDataFrame([(({"k": (1, "USD")}, "p"),)], "s struct<m:map<string,struct<v:int,currency:string>>,period:string>")
    assert O.drop_fields(m).schema["s"].dataType.simpleString() == "struct<m:map<string,struct<v:int>>>"
    assert len(O.ENDPOINTS) == 21


def test_flattening_is_reversible(spark):
    df = spark.createDataFrame([(1, (2, "x"), [1, 2], None), (None, None, None, 2.5)], "a int, b struct<c:int,d:string>, e array<int>, f double")
    flat = I.flattened(df)
    assert flat.head()["b"] == '{"c":2,"d":"x"}' and flat.head()["f"] == "null"
    assert I.unflattened(flat, dict(df.dtypes)).collect() == df.collect()


def test_posts(spark):
    p = spark.createDataFrame([(1, 1, 5, False), (1, 2, 99, False), (2, 3, 7, True), (3, 4, 6, False), (4, 5, 6, None)], "id int, ord int, likes int, is_retweet boolean")
    assert [r["id"] for r in M.select_posts(p).collect()] == [3, 4, 1] and [r["id"] for r in M.select_posts(p, min_likes=6, retweets=True).collect()] == [2, 3, 4]


def ring(rows, size):
    held, out = {}, []
    for g, o, s, b, t in sorted(rows, key=lambda r: (r[0], r[1])):
        if t:
            out.append((g, o, len(held.get(g, [])), "\n".join(held.pop(g, []))))
        else:
            held[g] = [*held.get(g, []), f"{s}: {b}"][-size:]
    return sorted(out)


def test_ring_buffer_twins(spark):
    rng = random.Random(5)
    rows = [(rng.randint(1, 4), i, f"s{i % 3}", f"b{i}", rng.random() < 0.2) for i in range(120)]
    df = spark.createDataFrame(rows, "group_id long, ord long, sender string, body string, trigger boolean")
    want = ring(rows, 3)
    assert sorted(map(tuple, S.ring_context(df, size=3).collect())) == want
    assert sorted(map(tuple, S.fold_batch(df, "group_id", S.ring_buffer(3)).collect())) == want


def test_busy_gate_merges():
    rows = pd.DataFrame([(1, i, k, t) for i, (k, t) in enumerate([("message", "a"), ("message", "b"), ("message", "c"), ("done", ""), ("done", ""), ("message", "d")])], columns=["session_id", "ord", "kind", "text"])
    g = S.busy_gate()
    assert [(r["ord"], r["text"]) for r in g.run(g.start(), rows)[1]] == [(0, "a"), (3, "b\n\nc"), (5, "d")]


def test_alerts_as_stream_and_batch(spark, tmp_path):
    rows = [(1, 1, 0, "up"), (1, 2, 23 * 3600, "up"), (1, 3, 25 * 3600, "up"), (1, 4, 26 * 3600, "down"), (1, 5, 26 * 3600 + 1, "up"), (2, 6, 0, "up")]
    schema = "job_id long, ord long, ts_s long, text string"
    want = [(1, 1, True), (1, 2, False), (1, 3, True), (1, 4, True), (1, 5, True), (2, 6, True)]
    df = spark.createDataFrame(rows, schema)
    assert sorted(map(tuple, S.fold_batch(df, "job_id", S.alert_suppressor()).collect())) == want
    # The stream gets the rows in two files, one after the other, and keeps the state between them.
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        q = S.fold_stream(spark.readStream.schema(schema).json(str(tmp_path / "in")), "job_id", S.alert_suppressor(), ttl_ms=3_600_000)
        run = q.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).start()
        # A fold with a time to live is never done by itself, as times run out without new rows: it is stopped once its rows are committed.
        end = time.time() + 120
        while time.time() < end and not any(p.numInputRows for p in run.recentProgress):
            assert run.exception() is None
            time.sleep(0.1)
        run.stop()
    got = spark.read.schema("job_id long, ord long, emitted boolean").parquet(str(tmp_path / "out")).collect()
    assert sorted(map(tuple, got)) == want


def test_dedupe_stream_and_batch(spark, tmp_path):
    schema = "account_id string, chat_id string, id string, ts timestamp, ord long"
    src = spark.sql("SELECT 'a' account_id, 'c' chat_id, x.id, timestamp '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,x.m) AS ts, x.o AS ord FROM VALUES ('m1', 0, 1L), ('m1', 5, 2L), ('m2', 6, 3L), ('m1', 30, 4L) AS x(id, m, o)")
    assert sorted(r["ord"] for r in S.dedupe_batch(src).collect()) == [1, 3, 4]
    src.write.parquet(str(tmp_path / "in"))
    out = S.dedupe_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    run = out.writeStream.format("memory").queryName("dedupe_out").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {r["id"] for r in spark.table("dedupe_out").collect()} == {"m1", "m2"}


def run_ordered(spark, tmp_path, rows, schema, key, fold, delay, files, flush, ttl_ms=None):
    """Rows in a few files in any order, then one far later that lets the watermark pass them all."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", O2.ROCKSDB)
    try:
        for i in range(files):
            spark.createDataFrame(rows[i::files], schema).coalesce(1).write.parquet(str(tmp_path / f"in{i:02d}"))
        spark.createDataFrame([flush], schema).coalesce(1).write.parquet(str(tmp_path / "in99"))
        src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path))
        out = O2.fold_ordered(src, key, fold, "ts", delay, ttl_ms)
        name = f"ordered_{tmp_path.name}".replace("-", "_")
        run = out.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path.parent / f"cp-{tmp_path.name}")).trigger(availableNow=True).start()
        assert run.awaitTermination(240)
        return spark.table(name).collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def test_ordered_fold_of_shuffled_batches(spark, tmp_path):
    """Alerts that come in any order within an hour give what the batch twin gives."""
    rng = random.Random(1)
    schema = "job_id long, ord long, ts timestamp, ts_s long, text string"
    rows = [(rng.randrange(3), i, at(i * 40), i * 40, rng.choice(["up", "up", "down"])) for i in range(60)]
    fold = S.alert_suppressor(600)
    want = sorted(map(tuple, S.fold_batch(spark.createDataFrame(rows, schema), "job_id", fold).collect()))
    mixed = list(rows)
    rng.shuffle(mixed)
    got = run_ordered(spark, tmp_path, mixed, schema, "job_id", fold, "1 hour", 3, (9, 10**6, at(10**6), 10**6, "end"))
    assert sorted(map(tuple, got)) == want


def test_bounded_dedupe_as_stream_and_batch(spark, tmp_path):
    """Against a plain cache with evictions, whatever order the rows come in."""
    rng = random.Random(2)
    schema = "account_id long, ord long, ts timestamp, ts_ms long, id string"
    rows = [(rng.randrange(2), i, at(i), i * 1000, f"m{rng.randrange(9)}") for i in range(90)]
    want, caches = [], {}
    for account, i, _, now, ident in rows:
        cache = caches.setdefault(account, {})
        while cache and (next(iter(cache.values())) < now - 15_000 or len(cache) > 4):
            cache.pop(next(iter(cache)))
        want.append((account, i, ident in cache))
        cache.setdefault(ident, now)
    fold = O2.bounded_dedupe(15_000, 4)
    assert sorted(map(tuple, S.fold_batch(spark.createDataFrame(rows, schema), "account_id", fold).collect())) == sorted(want)
    assert any(r for _, _, r in want) and not all(r for _, _, r in want[40:])
    mixed = list(rows)
    rng.shuffle(mixed)
    got = run_ordered(spark, tmp_path, mixed, schema, "account_id", fold, "5 minutes", 2, (7, 10**6, at(10**6), 10**9, "end"), ttl_ms=15_000)
    assert sorted(map(tuple, got)) == sorted(want)
    assert (O2.bounded_dedupe().start(), S.DEDUPE_KEYS, S.RING_GROUPS, O2.DEDUPE_TTL_MS) == ({}, 5000, 200, 1_200_000)


def test_bounded_history_evicts_the_first_group():
    fold = O2.bounded_history(2, 2)
    state, out = fold.start(), []
    for i, (group, trigger) in enumerate([(1, 0), (1, 0), (1, 0), (2, 0), (3, 0), (1, 1), (2, 1), (4, 0), (3, 1), (4, 1), (4, 1)]):
        state = fold.load(fold.dump(state))
        state, more = fold.step(state, {"account_id": 0, "group_id": group, "ord": i, "sender": "s", "body": f"b{i}", "trigger": bool(trigger)})
        out += [(r["group_id"], r["context"]) for r in more]
    # Group 3 took the place of group 1; 4 had room, since 2 had been read.
    assert out == [(1, ""), (2, "s: b3"), (3, "s: b4"), (4, "s: b7"), (4, "")]


def test_correlation_stream(spark, tmp_path):
    t = "timestamp '2024-01-01 00:00:00'"
    spark.sql(f"SELECT 'a' call_id, {t} ts, 'x' args").write.parquet(str(tmp_path / "s"))
    spark.sql(f"SELECT 'a' call_id, {t} + interval 3 minutes ts, 'r' result, CAST(NULL AS string) error").write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema("call_id string, ts timestamp, args string").parquet(str(tmp_path / "s"))
    e = spark.readStream.schema("call_id string, ts timestamp, result string, error string").parquet(str(tmp_path / "e"))
    run = S.correlate_stream(s, e).writeStream.format("memory").queryName("calls_out").trigger(availableNow=True).start()
    run.awaitTermination(180)
    assert [(r["call_id"], r["result"]) for r in spark.table("calls_out").collect()] == [("a", "r")]


def test_dedupe_tells_keys_apart_that_share_ordinals(spark):
    rows = [("a", 1, 0), ("a", 2, 60), ("b", 1, 0), ("b", 2, 3000), (None, 2, 0), (None, 1, 60)]
    df = spark.createDataFrame(rows, "k string, ord long, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r["k"], r["ord"]) for r in S.dedupe_batch(df, "ts", ("k",), 1200).collect()}
    assert got == {("a", 1), ("b", 1), ("b", 2), (None, 2)}


def test_folds_pass_batches(spark):
    """A key's state goes on from one Arrow batch to the next; null is a key."""
    rows = [(None if i % 3 == 0 else i % 3, i, i * 400, f"t{i // 30}") for i in range(300)]
    df = spark.createDataFrame(rows, "job_id long, ord long, ts_s long, text string")
    want, state = [], {}
    fold = S.alert_suppressor(5000)
    for job, o, ts, text in rows:
        state[job], out = fold.step(state.get(job, fold.start()), {"job_id": job, "ord": o, "ts_s": ts, "text": text})
        want += [(x["ord"], x["emitted"]) for x in out]
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        assert sorted((r["ord"], r["emitted"]) for r in S.fold_batch(df, "job_id", fold).collect()) == want
        timed = df.select("job_id", "ord", "text", F.timestamp_seconds(F.when(F.col("ord") != 9, F.col("ts_s"))).alias("ts"))
        got = {r["ord"] for r in S.dedupe_batch(timed, "ts", ("job_id",), 3000).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    last, kept = {}, {9}
    for job, o, ts, _ in rows:
        if o != 9 and ts - last.get(job, -3000) >= 3000:
            last[job] = ts
            kept.add(o)
    assert got == kept
    assert S.dedupe_batch(timed.limit(0), "ts", ("job_id",), 3000).count() == 0


def test_similar_queries_as_all_pairs(spark):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(14)]
    rows = [(rng.randrange(2), i, " ".join(rng.sample(words, rng.choice([0, 1, 3, 5, 9, 10])))) for i in range(120)] + [(0, i, "word1 word2 word3") for i in range(120, 160)]
    df = spark.createDataFrame(rows, "tool int, ord long, q string")
    for least in (0.3, 0.7, 1.0):
        want = set()
        for tool, o, q in rows:
            mine = set(q.split())
            near = [(p, len(mine & set(x.split())) / len(mine | set(x.split()))) for t, p, x in rows if t == tool and p < o and mine and x]
            hit = next(((p, s) for p, s in near if s >= least), None)
            if hit:
                want.add((tool, o, hit[0], round(hit[1], 9)))
        got = {(r["tool"], r["ord"], r["earlier"], round(r["similarity"], 9)) for r in C.similar_queries(df, "tool", "ord", "q", least).collect()}
        assert got == want, least
