import hashlib
import random

from pyspark.sql import functions as F

from millrace.llm import chat

SCHEMA = "conv_id long, seq long, turn long, kind string, role string, text string"
PARTS = ["</s>", "[INST]", "[/INST]", "<|im_end|>", "<|im_start|>", "<|im_sep|>", "<", "[", "\\", "|", "im_end", "|>", "é", "🙂", "\n", "s>", "/s>", "<\\", ""]


def fold(events):
    """Replays the log of one conversation."""
    rank = {"message": 0, "edit": 1, "regenerate": 2, "delta": 3}
    turns = {}
    log = sorted(events, key=lambda e: (e[1], rank[e[3]], e[2], e[4] or "", e[5] or ""))
    for _, seq, turn, kind, role, text in log:
        new = [seq, role or "", text or ""]
        if kind == "message":
            turns.setdefault(turn, []).append(new)
        elif kind == "delta":
            if turns.get(turn):
                turns[turn][-1][2] += text or ""
            else:
                turns[turn] = [new]
        else:
            turns[turn] = [new]
            if kind == "regenerate":
                for t in [t for t in turns if t > turn]:
                    turns[t] = []
    return [(m[1], m[2]) for t in sorted(turns) for m in turns[t]]


def test_escape_is_reversible(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for t, e, back in df.withColumn("b", chat.unescape(F.col("e"))).collect():
        assert back == t
        assert not any(c in e for c in ("</s>", "[INST]", "[/INST]", "<|im_end|>", "<|im_start|>", "<|im_sep|>"))


def test_folds_as_a_replay_does(spark):
    rng = random.Random(2)
    events = []
    for conv in range(1000):
        for _ in range(rng.randint(1, 14)):
            kind = rng.choice(["message", "delta", "delta", "edit", "regenerate"])
            # Some events tie on seq, some logs have gaps.
            events.append((conv, rng.randint(0, 40), rng.randint(0, 3), kind, rng.choice(["user", "assistant", None]), rng.choice(PARTS) + rng.choice(PARTS)))
    df = spark.createDataFrame(events, SCHEMA).withColumns({c: F.lit("clash") for c in ("formatted", "ord", "rank", "cut", "part", "pieces")})
    got = {r["conv_id"]: r for r in chat.chat_format(df).withColumn("turns", chat.parse(F.col("formatted"))).collect()}
    for conv in range(1000):
        assert [tuple(t) for t in got[conv]["turns"]] == fold([e for e in events if e[0] == conv])
        assert "".join(s["text"] for s in got[conv]["segments"]) == got[conv]["formatted"]


def test_answer_streamed_after_a_regeneration_stays(spark):
    log = [(0, "message", 0, "q"), (1, "message", 1, "old"), (2, "regenerate", 0, "q2"), (3, "delta", 1, "ne"), (4, "delta", 1, "w")]
    df = spark.createDataFrame([(1, s, t, k, "user" if t == 0 else "assistant", x) for s, k, t, x in log], SCHEMA)
    assert [tuple(t) for t in chat.chat_format(df).select(chat.parse(F.col("formatted"))).head()[0]] == [("user", "q2"), ("assistant", "new")]


def test_one_exchange_of_texts(spark):
    plan = chat.chat_format(spark.createDataFrame([], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_loss_mask_and_contract_row(spark):
    control = "</s>[INST] ok [/INST]"
    df = spark.createDataFrame([(-1, 0, 0, "message", "user", control), (-1, 1, 1, "message", "assistant", control)], SCHEMA)
    row = chat.chat_format(df).select("segments", chat.parse(F.col("formatted")).alias("turns")).head()
    assert [tuple(t) for t in row["turns"]] == [("user", control), ("assistant", control)]
    masked = [s["text"] for s in row["segments"] if s["loss"]]
    assert len(masked) == 1
    assert spark.createDataFrame([(masked[0],)], "t string").select(chat.unescape(F.col("t"))).head()[0] == control


def test_nulls_ties_and_empty(spark):
    assert chat.chat_format(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, None, None, None, None, None), (1, 0, 0, "message", "user", "b"), (1, 0, 0, "message", "user", "a"), (1, 0, 0, "message", "user", "a")]
    got = {r[0]: [tuple(t) for t in r[1]] for r in chat.chat_format(spark.createDataFrame(rows, SCHEMA)).select("conv_id", chat.parse(F.col("formatted"))).collect()}
    assert got == {None: [("", "")], 1: [("user", "a"), ("user", "a"), ("user", "b")]}


def test_query_digests(spark, data):
    from millrace.llm.queries import op1_chat_format

    rows = spark.read.parquet(f"{data}/conversations.parquet").collect()
    got = {r["conv_id"]: r for r in op1_chat_format(spark, data).collect()}
    assert -1 in got and len(got) == len({r["conv_id"] for r in rows}) + 1
    for conv in {r["conv_id"] for r in rows}:
        own = sorted((r for r in rows if r["conv_id"] == conv), key=lambda r: r["turn"])
        loss = "".join(r["text"] or "" for r in own if r["role"] == "assistant")
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r['role']}\n{r['text'] or ''}\n" for r in own).encode()).hexdigest()
        assert got[conv]["loss_chars"] == len(loss) and got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
