"""Message policies, routes, jobs and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions import timefns as TF

# Patterns and reasons of policies.
NO_ACTION = r"(?i)\bno action needed\b|\bno alert needed\b|\bnothing to report\b|\bno (?:significant |notable )?change|\beverything (?:is |looks )?(?:fine|normal|good|ok)\b"
OK_ALONE = r"^(?:\*\*)?HEARTBEAT_OK(?:\*\*)?[.!]?\s*$"
OK_AT_ENDS = r"(?i)^\s*(?:\*\*)?HEARTBEAT_OK(?:\*\*)?[.!]?\s*|\s*(?:\*\*)?HEARTBEAT_OK(?:\*\*)?[.!]?\s*$"
DUPLICATE_MS = 24 * 3_600_000
PAIRING_GRACE_MS = 30_000
MAX_AT_RETRIES, SCHEDULE_ERRORS = 3, 3
ERRORS = {
    "rate_limit": (r"(?i)rate[_ ]limit|too many requests|429", ["model_cooldown", "cooling down", "exceeded your current quota", "resource has been exhausted", "quota exceeded", "resource_exhausted", "usage limit", "tpm", "tokens per minute"]),
    "billing": (r"(?i)[\"']?(?:status|code)[\"']?\s*[:=]\s*402\b|\bhttp\s*402\b", ["payment required", "insufficient credits", "credit balance", "insufficient balance"]),
    "auth": (r"(?i)invalid[_ ]?api[_ ]?key|\b401\b|\b403\b", ["incorrect api key", "invalid token", "authentication", "unauthorized", "forbidden", "access denied", "no api key found"]),
    "timeout": (None, ["timeout", "timed out", "deadline exceeded", "context deadline exceeded"]),
    "overloaded": (r"(?i)overloaded_error", ["overloaded", "service unavailable", "high demand"]),
}
OVERFLOW = ["context length exceeded", "maximum context length", "prompt is too long", "request_too_large", "exceeds model context window", "context overflow", "exceed context limit", "model token limit", "上下文过长", "上下文超出", "超出最大上下文"]
OVERFLOW_PAIRS = [("request size exceeds", "context"), ("413", "too large")]
OVERFLOW_TRIPLES = [("max_tokens", "exceed", "context"), ("input length", "exceed", "context")]


def _any(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def error_class(text: Column) -> Column:
    """The first class of an error message that fits (P22): context_overflow, rate_limit, billing, auth, timeout, overloaded, unknown."""
    low = F.lower(text)
    full = _any(low, OVERFLOW)
    for group in OVERFLOW_PAIRS + OVERFLOW_TRIPLES:
        every = F.lit(True)
        for p in group:
            every = every & low.contains(p)
        full = full | every
    out = F.when(text.isNull() | (text == ""), "unknown").when(full & ~_any(low, ["tpm", "tokens per minute"]), "context_overflow")
    for name, (pattern, parts) in ERRORS.items():
        hit = _any(low, parts)
        out = out.when(hit if pattern is None else hit | text.rlike(pattern), name)
    return out.otherwise("unknown")


def non_retryable(text: Column) -> Column:
    return error_class(text).isin("context_overflow", "billing", "auth")


def retry_delay_ms(attempt: Column, message: Column, most: int = 3) -> Column:
    """Wait before attempt + 1 is made (X05): half a second, doubled each time; null once there were ``most``, or if the error cannot pass."""
    again = (attempt < most) & ~F.coalesce(non_retryable(message), F.lit(False))
    return F.when(again, F.lit(500).cast("long") * F.pow(F.lit(2.0), attempt).cast("long"))


def suppression(text: Column, last_text: Column | None = None, age_ms: Column | None = None) -> Column:
    """Whether an alert is held back and why (P15): struct of suppress, cleaned, reason. The last emitted text and its age come with the row."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    cleaned = F.regexp_replace(F.regexp_replace(trimmed, OK_AT_ENDS, ""), r"^\s+|\s+$", "")
    same = F.lit(False) if last_text is None else F.coalesce((cleaned == last_text) & (age_ms < DUPLICATE_MS), F.lit(False))
    reason = (
        F.when(trimmed == "", "empty").when(trimmed.rlike(OK_ALONE) | (cleaned == ""), "ok-token").when(cleaned.rlike(NO_ACTION), "no-action").when(same, "duplicate").otherwise("none")
    )
    return F.struct((reason != "none").alias("suppress"), F.when(reason.isin("empty", "ok-token"), "").otherwise(cleaned).alias("cleaned"), reason.alias("reason"))


def heartbeat_empty(text: Column) -> Column:
    """Whether nothing stands in a text but blanks, headings and empty list items."""
    return F.forall(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s", " ")).rlike(r"^$|^#+(\s.*)?$|^[-*]\s*$"))


def _numbers(entries: Column) -> Column:
    return F.transform(F.filter(entries, lambda e: e != "*"), X.e164)


def allowed_phone(sender: Column, allow: Column) -> Column:
    """Whether a list names a number, whatever its spelling, or a star."""
    return F.array_contains(allow, "*") | F.array_contains(_numbers(allow), X.e164(sender))


def self_chat(own: Column, allow: Column) -> Column:
    """Whether the list names the account's own number, which shuts out all others."""
    return F.coalesce(own.isNotNull() & F.array_contains(_numbers(allow), X.e164(own)), F.lit(False))


def access(own: str, sender_from: str, sender: str, is_group: str, from_me: str, dm_policy: str, group_policy: str, allow: str, group_allow: str,
           message_ms: str | None = None, connected_ms: str | None = None, grace_ms: int = PAIRING_GRACE_MS) -> Column:
    """Decision on an inbound message (P16, ST04): struct of allowed, mark_read, self_chat, reason, pairing (whether a pairing reply is due).

    Names of columns; the first reason that fits is given. Pairing replies are held back for messages older than the connection by the grace.
    """
    me, frm, who = X.e164(F.col(own)), X.e164(F.col(sender_from)), X.e164(F.col(sender))
    group, mine = F.col(is_group), F.coalesce(F.col(from_me), F.lit(False))
    dm, gp = F.col(dm_policy), F.col(group_policy)
    alone = self_chat(F.col(own), F.col(allow))
    is_self = F.coalesce(F.col(own).isNotNull() & ((frm == me) | (F.col(sender).isNotNull() & (who == me))), F.lit(False))
    same = F.coalesce(F.col(own).isNotNull() & (frm == me), F.lit(False))
    members, star = _numbers(F.col(group_allow)), F.array_contains(group_allow, "*")
    listed = F.array_contains(allow, "*") | F.array_contains(_numbers(F.col(allow)), frm)
    old = F.lit(False) if message_ms is None else F.coalesce(F.col(message_ms) < F.col(connected_ms) - grace_ms, F.lit(False))
    reason = (
        F.when(alone & group, "group_blocked_self_chat_mode")
        .when(alone & ~is_self, "sender_not_self_in_self_chat_mode")
        .when(alone, F.lit(None))
        .when(group & ~F.coalesce(gp.isin("open", "allowlist"), F.lit(False)), "group_policy_not_permissive")
        .when(group & (gp == "allowlist") & (F.size(members) == 0) & ~star, "group_allowlist_empty")
        .when(group & (gp == "allowlist") & ~star & ~F.coalesce(F.array_contains(members, who) & F.col(sender).isNotNull(), F.lit(False)), "group_sender_not_allowlisted")
        .when(group, F.lit(None))
        .when(dm == "disabled", "dm_policy_disabled")
        .when(mine & ~same, "outbound_dm_to_non_self")
        .when((dm != "open") & ~same & ~listed, "dm_sender_not_allowlisted")
    )
    return F.struct(reason.isNull().alias("allowed"), reason.isNull().alias("mark_read"), alone.alias("self_chat"), reason.alias("reason"),
                    F.coalesce((reason == "dm_sender_not_allowlisted") & (dm == "pairing") & ~old, F.lit(False)).alias("pairing"))


def outbound(to: Column, group_policy: Column, allow: Column) -> Column:
    """Decision on an outbound message (P27): struct of allowed, jid, recipient, reason. A star in the list does not count."""
    jid = X.to_jid(to)
    phone, group = X.jid_phone(jid), jid.endswith("@g.us")
    listed = _numbers(allow)
    reason = (
        F.when(group & (group_policy == "disabled"), "group_destinations_disabled").when(group, F.lit(None))
        .when(phone.isNull(), "invalid_recipient").when(F.size(listed) == 0, "no_explicit_recipient").when(~F.array_contains(listed, phone), "recipient_not_allowlisted")
    )
    return F.struct(reason.isNull().alias("allowed"), jid.alias("jid"), F.when(group, "").otherwise(phone).alias("recipient"), reason.alias("reason"))


def session_key(agent: Column, channel: Column, account: Column, kind: Column, peer: Column) -> Column:
    """agent:id:main, or the peer's own key."""
    own = F.concat_ws(":", F.lit("agent"), agent, channel, account, kind, F.lower(F.trim(peer)))
    return F.when(peer.isNull(), F.concat(F.lit("agent:"), agent, F.lit(":main"))).otherwise(own)


def route(messages: DataFrame, bindings: DataFrame, id_col: str = "id", default_agent: str = "default", default_account: str = "default") -> DataFrame:
    """The agent of each message (P18, J13): peer before account before channel binding, then the first in the list.

    messages: id, channel, account_id, peer_kind, peer_id. bindings: ord, agent_id, channel, account_id, peer_kind, peer_id. An equi-join
    on the channel (Spark broadcasts the bindings where they are small); wildcards are settled in the condition, and max_by keeps one binding a message.
    """
    m = messages.withColumns({"channel": F.lower(F.trim("channel")), "account_id": F.coalesce(F.nullif(F.trim("account_id"), F.lit("")), F.lit(default_account))})
    b = bindings.select("ord", F.col("agent_id").alias("b_agent"), F.lower(F.trim("channel")).alias("b_channel"), F.nullif("account_id", F.lit("")).alias("b_account"), F.nullif("peer_kind", F.lit("")).alias("b_kind"), F.nullif("peer_id", F.lit("")).alias("b_peer"))
    fits = (F.col("channel") == F.col("b_channel")) & (F.col("b_account").isNull() | (F.col("b_account") == "*") | (F.col("b_account") == F.col("account_id")))
    peer = F.col("b_peer").isNotNull() & (F.col("b_kind") == F.col("peer_kind")) & (F.col("b_peer") == F.trim("peer_id"))
    tier = F.when(F.col("b_channel").isNull(), F.lit(None)).when(peer, 1).when(F.col("b_account").isNotNull() & F.col("b_peer").isNull(), 2).when(F.col("b_account").isNull() & F.col("b_peer").isNull(), 3)
    rows = m.join(b, fits, "left").withColumn("tier", tier)
    best = rows.groupBy(id_col, "channel", "account_id", "peer_kind", "peer_id").agg(F.min(F.when(F.col("tier").isNotNull(), F.struct("tier", "ord", "b_agent"))).alias("b"))
    agent = F.coalesce(F.nullif(F.trim("b.b_agent"), F.lit("")), F.lit(default_agent))
    by = F.when(F.col("b.tier") == 1, "binding.peer").when(F.col("b.tier") == 2, "binding.account").when(F.col("b.tier") == 3, "binding.channel").otherwise("default")
    return best.select(id_col, agent.alias("agent_id"), by.alias("matched_by"), session_key(agent, F.col("channel"), F.col("account_id"), F.col("peer_kind"), F.col("peer_id")).alias("session_key"))


def mentioned(mentions: Column, own_ids: Column, own_phone: Column, body: Column) -> Column:
    """Whether the bot is addressed: by one of its ids, or by seven digits or more of its number in the text."""
    base = lambda ids: F.filter(F.transform(ids, lambda j: F.substring_index(F.substring_index(j, "@", 1), ":", 1)), lambda j: j != "")
    digits = F.regexp_replace(own_phone, "[^0-9]", "")
    return F.coalesce(F.arrays_overlap(base(mentions), base(own_ids)), F.lit(False)) | F.coalesce((F.length(digits) >= 7) & body.contains(digits), F.lit(False))


def roster_union(roster: DataFrame, participants: DataFrame, key: str = "group_id", member: str = "member_id") -> DataFrame:
    """The roster and those participants it lacks."""
    missing = participants.join(roster.select(key, member), [key, member], "left_anti")
    return roster.unionByName(missing, allowMissingColumns=True)


def latest_names(messages: DataFrame, key: str = "group_id", member: str = "member_id") -> DataFrame:
    """Last name of each member of a group (ST03)."""
    return messages.groupBy(key, member).agg(F.max_by("name", "ts").alias("name"), F.max("ts").alias("ts"))


def drain(queue: DataFrame, key: str = "queue_id") -> DataFrame:
    """Messages of each queue, "next" before "later", then by time (T07): adds rank, 1 being the one to take."""
    order = Window.partitionBy(key).orderBy(F.when(F.col("priority") == "next", 0).otherwise(1), "enqueued_at", "text")
    return queue.withColumn("rank", F.row_number().over(order))


def due_jobs(jobs: DataFrame, now_ms: Column) -> DataFrame:
    """Enabled jobs whose time has come."""
    return jobs.where(F.col("enabled") & (F.col("next_run_ms") <= now_ms))


def last_target(sessions: DataFrame) -> DataFrame:
    """The session updated last that has a target."""
    return sessions.where(F.coalesce("last_to", F.lit("")) != "").agg(*(F.max_by(c, "updated_at").alias(c) for c in sessions.columns))


def earliest_run(jobs: DataFrame, now_ms: Column) -> DataFrame:
    """Earliest run of the enabled jobs, and the timer's delay until then."""
    return jobs.where("enabled").agg(F.min("next_run_ms").alias("next_run_ms")).withColumn("delay_ms", TF.timer_delay_ms(F.col("next_run_ms"), now_ms))


def after_run(jobs: DataFrame, now_ms: Column) -> DataFrame:
    """State of jobs after a run (X09): jobs: kind, next_normal_ms (null: none), ok, consecutive_errors, schedule_failed, schedule_errors, fulfillment.

    Success resets the errors, and a one-shot or a job kept until fulfilled once ends; a failed one-shot is tried again up to three times;
    a failed recurring job waits for the later of its next time and the back-off; three schedule errors in a row end a job.
    """
    errors = F.when(F.col("ok"), 0).otherwise(F.col("consecutive_errors") + 1)
    backoff = now_ms + TF.error_backoff_ms(errors)
    schedule = F.when(F.col("schedule_failed"), F.col("schedule_errors") + 1).otherwise(0)
    done = F.col("ok") & ((F.col("kind") == "at") | (F.col("fulfillment") == "once"))
    spent = ~F.col("ok") & (F.col("kind") == "at") & (errors >= MAX_AT_RETRIES)
    ended = done | spent | (schedule >= SCHEDULE_ERRORS) | (F.col("ok") & F.col("next_normal_ms").isNull() & ~F.col("schedule_failed"))
    run = (
        F.when(ended, F.lit(None)).when(F.col("ok"), F.col("next_normal_ms")).when(F.col("kind") == "at", backoff)
        .otherwise(F.greatest(F.coalesce("next_normal_ms", backoff), backoff))
    )
    return jobs.withColumns({"consecutive_errors": errors, "schedule_errors": schedule, "enabled": ~ended, "next_run_ms": run})


def posts_with_users(posts: DataFrame, users: DataFrame) -> DataFrame:
    """Posts with their author's name, "?" where there is none."""
    u = users.select(F.col("id").alias("author_id"), "username", "name")
    return posts.join(u, "author_id", "left").na.fill("?", ["username", "name"])


def select_posts(posts: DataFrame, min_likes: int = 0, sort: str = "likes", limit: int = 15, retweets: bool = False) -> DataFrame:
    """Distinct posts with enough likes, sorted, the first of them (P09, P10, S30, T04, W13). sort: likes, impressions, retweets, recent."""
    first = posts.withColumn("_rn", F.row_number().over(Window.partitionBy("id").orderBy("ord"))).where("_rn = 1").drop("_rn")
    out = first if retweets else first.where(~F.coalesce(F.col("is_retweet"), F.lit(False)))
    out = out.where(F.col("likes") >= min_likes) if min_likes else out
    return out.orderBy(*([F.desc("created_at")] if sort == "recent" else [F.desc(sort)]), "ord").limit(limit)
