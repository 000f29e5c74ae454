"""Chat formatting from an event log.

Events are rows (conv_id, seq, turn, kind, role, text). Kinds:

* ``message``: a whole message at position ``turn``;
* ``delta``: a streamed piece, appended to the message last opened at its turn (it opens one where there is none);
* ``edit``: replaces all that was written at its turn so far;
* ``regenerate``: as ``edit``, and drops all that was written at later turns before it. Deltas may follow.

Any other kind, or null, counts as ``message``. A log is partitioned by conversation and sorted by sequence, once; all steps of the
replay are windows and aggregates in that partitioning. What a regeneration or an edit drops is told by its place in the sequence
alone: nothing that was written at a turn before the last regeneration at it or at an earlier turn, or before the last edit at it,
is seen in the end. So those events go first, and the others are folded turn by turn; a delta that comes after such a drop finds no
message and opens one.

Defined results: null text and null role are empty; a null turn or seq sorts first; events that tie on seq are taken in the
order message, edit, regenerate, delta, then by turn, role and text; repeated rows count each time; a null conv_id is a
conversation of its own; an empty log gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, SEP, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: After "<" or "[", what makes a control string; those of other common templates are escaped too.
_REST = r"\|im_start\|>|\|im_sep\|>|\|im_end\|>|/?s>|/?INST\]|<SYS>>|</SYS>>|\|endoftext\|>"
_LOSS_ROLES = ("assistant",)


def escape(col: Column) -> Column:
    """Puts a backslash after the first sign of each control string; where backslashes stand there already, one more."""
    return F.regexp_replace(col, rf"([<\[])(\\*)({_REST})", r"$1\\$2$3")


def unescape(col: Column) -> Column:
    """Takes back what escape() did, exactly."""
    return F.regexp_replace(col, rf"([<\[])\\(\\*)({_REST})", "$1$2$3")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, turn, part (order within a turn), role, text."""
    kind = F.when(F.col("kind").isin("delta", "edit", "regenerate"), F.col("kind")).otherwise(F.lit("message"))
    rank = F.when(kind == "message", 0).when(kind == "edit", 1).when(kind == "regenerate", 2).otherwise(3)
    e = events.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.col("seq").cast("long").alias("seq"),
        rank.alias("rank"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    e = e.withColumn("ord", F.row_number().over(Window.partitionBy("conv_id").orderBy("seq", "rank", "turn", "role", "text")))
    up_to_turn = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cut = F.max(F.when(F.col("rank") == 2, F.col("ord"))).over(up_to_turn)
    edited = F.max(F.when(F.col("rank") == 1, F.col("ord"))).over(Window.partitionBy("conv_id", "turn"))
    e = e.withColumns({"cut": cut, "edited": edited}).where(F.col("ord") >= F.greatest(F.coalesce("cut", F.lit(0)), F.coalesce("edited", F.lit(0))))
    order = Window.partitionBy("conv_id", "turn").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = (F.col("rank") < 3).cast("long")
    # A delta that finds nothing at its turn is part 0.
    e = e.withColumn("part", F.sum(opens).over(order))
    return (
        e.groupBy("conv_id", "turn", "part")
        .agg(F.min_by("role", "ord").alias("role"), F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("pieces"))
        .select("conv_id", "turn", "part", "role", F.array_join(F.transform("pieces", lambda x: x["text"]), "").alias("text"))
    )


def render(messages: DataFrame, loss_roles: tuple[str, ...] = _LOSS_ROLES) -> DataFrame:
    """One row per conversation: conv_id, formatted, segments.

    The segments (text, loss) joined are the formatted text; the loss mask covers those with loss set, which are the escaped
    texts of the roles in loss_roles and nothing else.
    """
    role, text = escape(F.col("role")), escape(F.col("text"))
    head = F.concat(F.lit(OPEN), role, F.lit(SEP))
    row = F.struct("turn", "part", head.alias("head"), text.alias("body"), F.col("role").isin(*loss_roles).alias("loss"))
    segments = F.flatten(
        F.transform(
            F.array_sort(F.collect_list(row)),
            lambda m: F.array(
                F.struct(m["head"].alias("text"), F.lit(False).alias("loss")),
                F.struct(m["body"].alias("text"), m["loss"].alias("loss")),
                F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    by = messages.groupBy("conv_id").agg(segments.alias("segments"))
    return by.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def chat_format(events: DataFrame, loss_roles: tuple[str, ...] = _LOSS_ROLES) -> DataFrame:
    """Event log to formatted conversations: conv_id, formatted, segments."""
    return render(fold_events(events), loss_roles)


def parse(formatted: Column) -> Column:
    """Reads the turns back from a formatted text: array of (role, text), unescaped."""
    pieces = F.split(formatted, F.lit(r"\Q" + CLOSE + r"\E"), -1)
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    return F.transform(
        F.transform(turns, lambda p: F.split(F.substr(p, F.lit(len(OPEN) + 1)), F.lit(r"\Q" + SEP + r"\E"), 2)),
        lambda x: F.struct(unescape(x[0]).alias("role"), unescape(x[1]).alias("text")),
    )
