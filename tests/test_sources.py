import datetime as dt
import http.server
import json
import random
import sys
import threading
import time
import types

import pytest
from pyspark.sql import functions as F

from millrace.sources import files as S
from millrace.sources import pages, post, rest, stores, watch


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_json_files(spark, tmp_path):
    a = write(tmp_path / "a.json", json.dumps([{"id": "1", "x": 1}, {"id": "2"}]))
    b = write(tmp_path / "b.json", json.dumps([{"id": "3", "x": 3}]))
    assert {r["id"] for r in S.read_json_array(spark, [a, b], "id string, x int").collect()} == {"1", "2", "3"}
    u = S.union_sources(S.read_json_array(spark, a, "id string, x int"), S.read_json_array(spark, b, "id string"))
    assert u.count() == 3 and u.where("x is null").count() == 2
    good = write(tmp_path / "g.jsonl", '{"id": "1", "outcome": "TP"}\n\n{"id": "2", "error": "e"}\n')
    assert S.read_jsonl_strict(spark, good, "id string, outcome string", ["id", "outcome"]).count() == 1


def test_lenient_lines(spark, tmp_path):
    p = write(tmp_path / "l.jsonl", '{"id": 1}\n\nbroken\n{"id": 2}\n{"id": 3}\n')
    rows, facts = S.read_jsonl_lenient(spark, p, "id int", 3)
    assert [r["id"] for r in rows.collect()] == [1, 2] and tuple(facts.head()) == (4, True)


def test_line_numbers_over_several_splits(spark, tmp_path):
    """Files of many byte ranges, numbered in each file and over all of them; what a plain reader says."""
    rng = random.Random(3)
    texts = {}
    for name in ("a", "b", "c"):
        lines = [rng.choice(["", " ", "x" * rng.randint(1, 60), "é한", '{"id": 1}']) + rng.choice(["", "\r"]) for _ in range(200)]
        texts[name] = [x.removesuffix("\r") for x in lines]
        write(tmp_path / "in" / f"{name}.txt", "\n".join(lines) + rng.choice(["", "\n"]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        path = str(tmp_path / "in")
        assert spark.read.text(path).rdd.getNumPartitions() > 20
        got = {(r["file_path"][-5], r["line"]): r["text"] for r in S.numbered_lines(spark, path).collect()}
        # An empty last line is none.
        want = {(n, i): x for n, lines in texts.items() for i, x in enumerate(lines, 1) if i < 200 or x or (n, 200) in got}
        assert got == want
        assert sorted((r["file_path"][-5], r["line"]) for r in S.read_lines(spark, path, 99, 3).collect()) == [(n, i) for n in "abc" for i in (99, 100, 101)]
        solid = [x for n in "abc" for x in texts[n] if x.strip(" ")]
        every = S.numbered_lines(spark, path, blank=False, within_file=False).orderBy("line").collect()
        assert [r["text"] for r in every] == solid and [r["line"] for r in every] == list(range(1, len(solid) + 1))
        rows, facts = S.read_jsonl_lenient(spark, path, "id int", 250)
        assert rows.count() == sum(x == '{"id": 1}' for x in solid[:250]) and tuple(facts.head()) == (len(solid), True)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_event_log_and_csv(spark, tmp_path):
    p = write(tmp_path / "e.jsonl", '{"type": "init", "timestamp": "2024-01-01T00:00:00Z"}\nnot json\n{"type": "x"}\n')
    assert [r["type"] for r in S.read_event_log(spark, p).collect()] == ["init"]
    c = write(tmp_path / "q.csv", 'question,answer\n"a ""b""\nc","x, y"\n" ",z\nq2,"1"\n')
    assert [tuple(r) for r in S.read_qa_csv(spark, c).collect()] == [('a "b"\nc', "x, y"), ("q2", "1")]


def test_markdown_runs_and_skills(spark, tmp_path):
    for n in ("MEMORY.md", "2024-01-02.md", "notes.md", "2024-1-2.md"):
        write(tmp_path / "m" / n, f"# {n}\n")
    assert [r["name"] for r in S.read_markdown(spark, str(tmp_path / "m")).collect()] == ["2024-01-02.md", "MEMORY.md"]
    write(tmp_path / "r" / "a.jsonl", "{}")
    write(tmp_path / "r" / "b.jsonl", "{}")
    assert {r["name"] for r in S.list_runs(spark, str(tmp_path / "r")).collect()} == {"a.jsonl", "b.jsonl"}
    assert S.latest_run(spark, str(tmp_path / "r")) in ("a.jsonl", "b.jsonl")
    text = "---\nname: dcf\ndescription: Values\n---\nBody"
    f = spark.createDataFrame([("x", "builtin", text), ("y", "project", text.replace("Values", "Mine")), ("z", "user", "no head")], "file_path string, source string, text string")
    got = S.override(S.front_matter(f), ["builtin", "user", "project"]).collect()
    assert [(r["name"], r["description"], r["body"]) for r in got] == [("dcf", "Mine", "Body")]
    df = spark.createDataFrame([("a", "b"), ("a\n", "b"), ("", "b")], "t string, m string")
    assert [r[0] for r in df.select(S.appended("t", "m")).collect()] == ["a\nb", "a\nb", "b"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", (2, "x"))], "id string, s struct<a:int,b:string>")
    for _ in range(2):
        S.append_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    S.seed_table(df, str(tmp_path / "t"))
    S.seed_table(df.unionAll(df), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).head()["s"] == '{"a":2,"b":"x"}' and spark.read.parquet(str(tmp_path / "t")).count() == 1
    S.seed_table(df.unionAll(df), str(tmp_path / "t"), force=True)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    S.write_dashboard({"a": df}, str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d/a")).count() == 1
    spans = spark.createDataFrame([({"input.value": "a@b.co"},)], "attributes map<string,string>")
    S.write_traces(spans, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).head()[0]["input.value"] == "[REDACTED_EMAIL]"


def test_table_store(spark, tmp_path):
    store = stores.TableStore(spark, str(tmp_path / "kv"), "k string, v int", "k")
    assert store.read().count() == 0
    store.write(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"))
    store.upsert(spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int"))
    store.delete(spark.createDataFrame([("a",)], "k string"))
    assert {tuple(r) for r in store.read().collect()} == {("b", 3), ("c", 4)}
    chunks = stores.TableStore(spark, str(tmp_path / "c"), "content_hash string, embedding array<float>", "content_hash")
    chunks.write(spark.createDataFrame([("h", [1.0])], "content_hash string, embedding array<float>"))
    chunks.clear_vectors()
    assert chunks.read().head()["embedding"] is None


def test_store_runs(spark, tmp_path):
    """Random upserts and deletes against a dict; changes write their own rows alone, and merges keep the number of runs low."""
    rng = random.Random(6)
    store, want = stores.TableStore(spark, str(tmp_path / "kv"), "k string, v int, note string", "k", buckets=3), {}
    first = {f"k{i}": (i, None) for i in range(3000)}
    store.write(spark.createDataFrame([(k, *v) for k, v in first.items()], "k string, v int, note string"))
    want |= first
    base = store.runs()[0]["bytes"]
    for turn in range(10):
        new = {rng.choice([f"k{rng.randrange(4000)}", None]): (turn, f"n{turn}") for _ in range(20)}
        rows = [(k, *v) for k, v in new.items()] + [(k, -1, "") for k in new]  # a key twice: the greater row stays
        before = {r["name"] for r in store.runs()}
        store.upsert(spark.createDataFrame(rows, "k string, v int, note string"))
        want |= new
        if turn == 0:
            added = [r for r in store.runs() if r["name"] not in before]
            assert len(added) == 1 and added[0]["bytes"] < base / 2
        gone = [f"k{rng.randrange(4000)}" for _ in range(5)]
        store.delete(spark.createDataFrame([(k,) for k in gone], "k string"))
        for k in gone:
            want.pop(k, None)
    assert {r["k"]: (r["v"], r["note"]) for r in store.read().collect()} == want
    assert len(store.runs()) <= 4
    old = len(store.versions())
    store.compact(whole=True)
    assert len(store.runs()) == 1 and {r["k"]: (r["v"], r["note"]) for r in store.read().collect()} == want and store._read_run(store.runs()[0]).where("_deleted").count() == 0
    assert store.read(1).count() == 3000
    assert store.vacuum() > 0 and len(store.versions()) == 1 <= old and store.read().count() == len(want)
    # A column that new rows lack is null.
    store.upsert(spark.createDataFrame([("k1", 7)], "k string, v int"))
    assert tuple(store.read().where("k = 'k1'").head()) == ("k1", 7, None)


def test_store_after_a_crash(spark, tmp_path, monkeypatch):
    """A run without its manifest, and a draft of one, change nothing."""
    store = stores.TableStore(spark, str(tmp_path / "kv"), "k string, v int", "k")
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    store.write(rows(("a", 1), ("b", 2)))
    monkeypatch.setattr(store, "_publish", lambda runs: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.upsert(rows(("a", 9)))
    monkeypatch.undo()
    (tmp_path / "kv" / "manifests" / "_draft").write_text("[")
    assert {tuple(r) for r in store.read().collect()} == {("a", 1), ("b", 2)}
    store.upsert(rows(("c", 3)))
    assert {tuple(r) for r in store.read().collect()} == {("a", 1), ("b", 2), ("c", 3)}
    # Nobody's version is replaced.
    monkeypatch.setattr(store, "versions", lambda: [1])
    with pytest.raises(RuntimeError):
        store._publish([])


def test_caches(spark):
    t = dt.datetime(2024, 1, 1)
    c = spark.createDataFrame([("e", "u", '{"a": 1}', t), ("e", "u", "3", t), (None, "u", "{}", t)], "endpoint string, url string, data string, cached_at timestamp")
    now = F.lit("2024-01-01 00:01:00").cast("timestamp")
    assert stores.fresh(c, now, 60).count() == 1 and stores.fresh(c, now, 59).count() == 0
    m = spark.createDataFrame([("A", 1), ("a", 2), ("b", 3)], "key string, cached_at int")
    assert {tuple(r) for r in stores.latest_entries(m, 1).collect()} == {("b", 3)} and stores.latest_entries(m).count() == 2
    v = stores.cached_vectors(spark.createDataFrame([("h", None)], "content_hash string, embedding array<float>"), spark.createDataFrame([("h", [1.0])], "content_hash string, embedding array<float>"))
    assert v.head()["embedding"] == [1.0]
    r = stores.request_keys(spark.createDataFrame([("/p/", {"ticker": ["x"]})], "endpoint string, params map<string,array<string>>"))
    assert r.head()["cache_key"].startswith("p/X_")


PAGES = {None: ([{"id": 1, "t": {"a": 1}}, {"id": 2, "t": None}], "n"), "n": ([{"id": 2, "t": None}, {"id": 3, "t": None}], None)}


def answer(url, body, headers):
    token = url.partition("next_token=")[2].partition("&")[0] or None
    rows, nxt = PAGES[token]
    return {"data": [{**r, "ticker": "T"} for r in rows], "meta": {"next_token": nxt} if nxt else {}}


def test_rest_source():
    assert rest.serialise({"a": ["1", "2"], "b": None, "c": "x y"}) == "a=1&a=2&c=x+y"
    from pyspark.sql.datasource import EqualTo, GreaterThan
    from pyspark.sql.types import _parse_datatype_string  # noqa: F401

    sys.modules["rest_test_opener"] = types.SimpleNamespace(answer=answer)
    field = lambda n: types.SimpleNamespace(name=n)
    schema = types.SimpleNamespace(fields=[field("id"), field("t"), field("ticker")])
    reader = rest.RestReader({"url": "http://x", "endpoint": "/p", "params": '{"k": ["1", "2"]}', "split": "k", "pushed": "ticker", "pages": "9", "key": "id", "opener": "rest_test_opener:answer"}, schema)
    left = list(reader.pushFilters([EqualTo(("ticker",), "T"), GreaterThan(("id",), 1)]))
    assert len(left) == 1 and reader.params["ticker"] == "T"
    parts = reader.partitions()
    assert [p.params["k"] for p in parts] == ["1", "2"]
    assert [r[:2] for r in reader.read(parts[0])] == [(1, '{"a": 1}'), (2, None), (3, None)]
    assert rest.RestSource.name() == "millrace_rest"


def test_file_watch(spark, tmp_path):
    from millrace.streaming.ops import watch_files

    write(tmp_path / "in" / "a.json", '{"x": 1}\n')
    seen = []
    q = watch_files(spark, str(tmp_path / "in"), "x int", lambda df, _: seen.append(df.count()), str(tmp_path / "cp"), "100 milliseconds")
    q.processAllAvailable()
    q.stop()
    assert sum(seen) == 1


def test_pages_over_http(spark):
    """A server of this machine: redirects, a loop, a refusal, a charset; and what is no address."""
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    class Site(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            to = {"/a": "/b", "/b": "/ok", "/loop": "/loop", "/r0": "/r1", "/r1": "/r2", "/r2": "/r3", "/r3": "/r4", "/out": "ftp://x/y", "/lost": None}
            if self.path in to:
                self.send_response(302)
                if to[self.path]:
                    self.send_header("Location", to[self.path])
            else:
                self.send_response(200 if self.path == "/ok" else 404)
                self.send_header("Content-Type", "text/html; charset=latin-1")
            self.end_headers()
            if self.path not in to:
                self.wfile.write("caf\xe9".encode("latin-1"))

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{server.server_port}"
    want = {"/ok": None, "/a": None, "/loop": "redirect_loop", "/r0": "too_many_redirects", "/r1": "failed", "/out": "invalid_url", "/lost": "no_location", "/no": "failed"}
    try:
        df = spark.createDataFrame([(root + p,) for p in want] + [(None,), ("",), ("http://[x",), ("file:///etc/hosts",)], "url string")
        got = {r["url"]: r["page"] for r in pages.fetched(df).collect()}
    finally:
        server.shutdown()
        server.server_close()
    assert {p: got[root + p]["error"] for p in want} == want
    assert (got[root + "/a"]["final_url"], got[root + "/a"]["body"], got[root + "/a"]["status"]) == (root + "/ok", "café", 200)
    assert {got[u]["error"] for u in (None, "", "http://[x", "file:///etc/hosts")} == {"invalid_url"}
    assert got[None]["status"] is None
    assert pages.fetch(root + "/ok", seconds=1)["error"] == "URLError"
    assert pages.fetched(df.limit(0)).count() == 0


def test_changes_of_a_folder(tmp_path):
    """The listing that counts is the one after which the folder was quiet; each change starts the time again."""
    folder = tmp_path / "notes"
    write(folder / "a.md", "one")
    write(folder / "skip.txt", "x")
    reader = watch.ChangesReader({"path": str(folder), "quiet_ms": "300"})
    time.sleep(0.35)
    start, first = reader.initialOffset(), reader.latestOffset()
    events = lambda a, b: [(p.path.rsplit("/", 1)[1], p.event, next(reader.read(p))[4]) for p in reader.partitions(a, b)]
    assert events(start, first) == [("a.md", "added", "one")]
    for text in ("two", "three, and more"):
        write(folder / "a.md", text)
        write(folder / "sub" / "b.md", "b")
        assert reader.latestOffset() == first
        time.sleep(0.2)
        assert reader.latestOffset() == first
    time.sleep(0.35)
    second = reader.latestOffset()
    assert events(first, second) == [("a.md", "changed", "three, and more"), ("b.md", "added", "b")]
    (folder / "a.md").unlink()
    reader.latestOffset()
    time.sleep(0.35)
    assert events(second, reader.latestOffset()) == [("a.md", "vanished", None)]
    assert watch.ChangesReader({"path": str(folder), "from_now": "true"}).initialOffset()["files"] and watch.listing(str(tmp_path / "none"), "*") == {}


def test_changes_as_a_stream(spark, tmp_path):
    """A file that is edited several times fires once, with its last text."""
    folder = tmp_path / "notes"
    write(folder / "a.md", "first")
    spark.dataSource.register(watch.FileChanges)
    stream = spark.readStream.format("millrace_changes").options(path=str(folder), quiet_ms="1500").load()
    run = stream.writeStream.format("memory").queryName("changed_files").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
    try:
        rows = lambda: [(r["event"], r["text"]) for r in spark.table("changed_files").collect()]

        def wait_for(n):
            end = time.time() + 60
            while len(rows()) < n and time.time() < end:
                time.sleep(0.2)
            return rows()

        assert wait_for(1) == [("added", "first")]
        for i in range(4):
            write(folder / "a.md", f"edit number {i}")
            time.sleep(0.4)
        assert wait_for(2) == [("added", "first"), ("changed", "edit number 3")]
        time.sleep(1)
        assert len(rows()) == 2 and run.exception() is None
    finally:
        run.stop()


class _Endpoint(http.server.BaseHTTPRequestHandler):
    taken, refusals = [], {}

    def do_POST(self):
        body = self.rfile.read(int(self.headers["Content-Length"]))
        key = self.headers["Idempotency-Key"]
        left = self.refusals.get("first", 0)
        if left:
            self.refusals["first"] = left - 1
            self.send_response(503)
        elif b'"bad"' in body and self.refusals.get("bad"):
            self.send_response(400)
        else:
            self.taken.append((key, json.loads(body)["data"]))
            self.send_response(200)
        self.end_headers()

    def log_message(self, *args):
        pass


@pytest.fixture
def endpoint():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Endpoint)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    _Endpoint.taken, _Endpoint.refusals = [], {}
    yield f"http://127.0.0.1:{server.server_port}/v1/span_annotations"
    server.shutdown()


def test_posted_rows(spark, tmp_path, endpoint):
    """Refused for a while, then for good, then taken: each row arrives, and none twice."""
    spark.dataSource.register(post.PostSink)
    rows = [(f"s{i}", "groundedness", float(i % 2), None if i % 3 else "why é") for i in range(60)]
    schema = "span_id string, name string, score double, explanation string"
    options = {"batch": "7", "first_delay_s": "0.01"}
    _Endpoint.refusals["first"] = 2
    post.posted(spark.createDataFrame(rows, schema), endpoint, str(tmp_path / "sent"), **options)
    sent = [r for _, batch in _Endpoint.taken for r in batch]
    assert sorted((r["span_id"], r["name"], r["score"], r["explanation"]) for r in sent) == sorted(rows, key=lambda r: r[0])
    assert len(_Endpoint.taken) == len({k for k, _ in _Endpoint.taken}) and max(len(b) for _, b in _Endpoint.taken) <= 7
    # The same rows again: nothing is posted.
    before = len(_Endpoint.taken)
    post.posted(spark.createDataFrame(rows, schema), endpoint, str(tmp_path / "sent"), **options)
    assert len(_Endpoint.taken) == before
    # A batch that is refused fails the write; once it is taken, the rest is not sent again.
    more = [(f"t{i}", "bad" if i == 5 else "good", 1.0, None) for i in range(40)]
    _Endpoint.refusals["bad"] = True
    with pytest.raises(Exception, match="400"):
        post.posted(spark.createDataFrame(more, schema), endpoint, str(tmp_path / "sent2"), **options)
    _Endpoint.refusals["bad"] = False
    post.posted(spark.createDataFrame(more, schema), endpoint, str(tmp_path / "sent2"), **options)
    got = [r["span_id"] for _, batch in _Endpoint.taken[before:] for r in batch]
    assert sorted(got) == sorted(r[0] for r in more)


def test_posted_stream(spark, tmp_path, endpoint):
    spark.dataSource.register(post.PostSink)
    spark.range(10).selectExpr("concat('s', id) AS span_id", "'x' AS name").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("span_id string, name string").json(str(tmp_path / "in"))
    write_to = stream.writeStream.format("millrace_post").options(url=endpoint, sent=str(tmp_path / "sent"), batch="4")
    run = write_to.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    assert sorted(r["span_id"] for _, b in _Endpoint.taken for r in b) == [f"s{i}" for i in range(10)]
