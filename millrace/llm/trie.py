"""Conversation prefix trie: what conversations share from their first turn on.

A conversation is a sequence of turns (role, text). A node of the trie is a distinct sequence of the first d turns of some conversation, named by its
depth and the smallest conversation that starts with it, its owner. If a conversation owns a prefix it owns all longer ones of its
own, so its nodes are a chain from the first depth that it owns to its last turn.

A prefix has a digest of 128 bits: the sum of hashes of (depth, SHA-256 of the turn). The minima are one row a digest with the smallest
conversation, how many have it, and the length of its last text. The first owned depth of all conversations is then binary-searched by
batched joins against the minima. A chain hangs from the owner of the prefix before its first node; chains are summed up
from the bottom by pointer doubling (the logarithm of the trie's height in rounds), and within a chain by running sums.

No group is gathered: a conversation of any length is parted by ranges (``running_sums``), a prefix that many conversations have is counted in runs
and joined in runs (``spread_join``), and the ids that end at a node are joined into pieces by ranges before one digest takes the pieces in
order; that digest of a node is sequential, and holds its state alone.

Defined results: turns are ordered by turn (null first), ties by the SHA-256 of role and text; null role or text is empty; rows without a conversation
id belong to none and are left out; repeated rows are turns of their own; an empty table gives no rows; other columns are ignored. A very
long text is read once and travels as its digest. Ids are longs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import copies, materialize, running_sums, spread_join

#: Code points of ids in a piece of a node's list, about.
PIECE = 1 << 16
_EMPTY = hashlib.sha256(b"").hexdigest()


def turns_in_order(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos from 1, digest, chars) of the turns of conversations."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    role = text(role_col)
    turns = rows.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"),
        F.col(turn_col).alias("turn"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text(text_col)), 256)).alias("digest"),
        F.length(text(text_col)).cast("long").alias("chars"),
    )
    # Rows that agree in all are interchangeable; a range of them could not be parted.
    turns = turns.groupBy("conv", "turn", "digest", "chars").agg(F.count("*").alias("n")).withColumn("pos", F.col("n"))
    placed = running_sums(turns, "conv", [F.asc_nulls_first("turn"), F.asc("digest")], ["pos"], "turns")
    return copies(placed, "n", "copy").select("conv", (F.col("pos") - F.col("n") + F.col("copy") + 1).alias("pos"), "digest", "chars")


def rebuilt(turns: DataFrame, donor: Column, taken: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that start with the first turns of another one.

    donor and taken, over conv: whose first turns, and how many of them (at most ``most``), stand in place of as many own ones. A donor serves a
    bounded number of conversations. Gives all conversations (conv) and their turns (conv, depth, digest, chars).
    """
    convs = materialize(turns.select("conv").distinct(), "conversations")
    wanted = convs.select("conv", donor.alias("donor"), taken.alias("taken"))
    first = wanted.join(turns.where(F.col("pos") <= most).withColumnRenamed("conv", "donor"), "donor").where("pos <= taken")
    own = turns.where(F.col("pos") > taken).select("conv", F.lit(1).alias("part"), "pos", "digest", "chars")
    rows = first.select("conv", F.lit(0).alias("part"), "pos", "digest", "chars").unionByName(own).withColumn("depth", F.lit(1).cast("long"))
    return convs, running_sums(rows, "conv", [F.asc("part"), F.asc("pos")], ["depth"], "rebuilt").select("conv", "depth", "digest", "chars")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (owner, depth, conv) to (owner, depth, first conv, ids joined by commas) in pieces."""
    open_node, first, ids, size = None, None, [], 0

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"owner": open_node[0], "depth": open_node[1], "first": first, "ids": ",".join(ids)}], _PIECES)

    for batch in batches:
        for owner, depth, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (owner, depth) != open_node or size >= PIECE:
                if ids:
                    yield piece()
                open_node, first, ids, size = (owner, depth), conv, [], 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
    if ids:
        yield piece()


_PIECES = pa.schema([("owner", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to (owner, depth, ends): the digest of all that a node has."""
    open_node, state = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*open_node, state.hexdigest())], ["owner", "depth", "ends"])

    for batch in batches:
        for owner, depth, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (owner, depth) != open_node:
                if open_node:
                    yield row()
                open_node, state = (owner, depth), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if open_node:
        yield row()


def ends_digests(ends: DataFrame) -> DataFrame:
    """(owner, depth, conv) to (owner, depth, ends): the SHA-256 of the ids that end at a node, ascending, joined by commas."""
    pieces = ends.select("owner", "depth", "conv").repartitionByRange("owner", "depth", "conv").sortWithinPartitions("owner", "depth", "conv")
    pieces = pieces.mapInArrow(_joined, "owner long, depth long, first long, ids string")
    return pieces.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "first").mapInArrow(_digested, "owner long, depth long, ends string")


def _first_owned(prefixes: DataFrame, lengths: DataFrame, owners: DataFrame) -> DataFrame:
    """(conv, length, first): the smallest depth whose prefix the conversation owns, length + 1 if it owns none.

    owners: (run, k1, k2, owner). Two steps of the binary search of every conversation are one batch of joins: it probes the middle of the
    range and those of both halves.
    """
    state = lengths.select("conv", "length", F.lit(1).cast("long").alias("lo"), (F.col("length") + 1).alias("hi"))
    settled = state.where("lo >= hi")
    state = state.where("lo < hi")
    middle = F.expr("(lo + hi) div 2")
    while not state.isEmpty():
        spots = state.withColumn("m", middle).withColumns({"left": F.expr("(lo + m) div 2"), "right": F.expr("(m + 1 + hi) div 2")})
        probes = spots.withColumn("depth", F.explode(F.array_distinct(F.array("left", "m", "right")))).where("depth < hi")
        probes = probes.join(prefixes.select("conv", "run", "depth", "k1", "k2"), ["conv", "depth"]).join(owners, ["run", "k1", "k2"])
        at = lambda c: F.max((F.col("depth") == F.col(c)) & (F.col("owner") == F.col("conv"))).alias(f"owns_{c}")
        found = probes.groupBy("conv", "length", "lo", "hi", "left", "m", "right").agg(at("left"), at("m"), at("right"))
        low = F.when(F.col("owns_left"), F.col("lo")).when(F.col("owns_m"), F.col("left") + 1).when(F.col("owns_right"), F.col("m") + 1).otherwise(F.least(F.col("right") + 1, F.col("hi")))
        high = F.when(F.col("owns_left"), F.col("left")).when(F.col("owns_m"), F.col("m")).when(F.col("owns_right"), F.col("right")).otherwise(F.col("hi"))
        found = materialize(found.select("conv", "length", low.alias("lo"), high.alias("hi")), "probes")
        settled, state = settled.unionByName(found.where("lo >= hi")), found.where("lo < hi")
    return settled.select("conv", "length", F.col("lo").alias("first"))


def _totals(chains: DataFrame, root: int | None) -> DataFrame:
    """(chain, parent, leaves, saved) of single chains to (chain, leaves, saved) with all that hang from them, by pointer doubling."""
    rising = chains.where("parent IS NOT NULL")
    while not rising.isEmpty():
        up = rising.select(F.col("parent").alias("chain"), F.lit(None).cast("long").alias("parent"), "leaves", "saved")
        # What hangs from the root's chain has arrived there.
        jumps = rising.where(F.col("parent") != F.lit(root)).select("chain", "parent")
        jumps = spread_join(jumps, chains.select(F.col("chain").alias("parent"), F.col("parent").alias("next")), ["parent"], F.col("chain"))
        none = F.lit(0).cast("long")
        jumps = jumps.select("chain", F.col("next").alias("parent"), none.alias("leaves"), none.alias("saved"))
        kept = chains.select("chain", F.lit(None).cast("long").alias("parent"), "leaves", "saved")
        chains = kept.unionByName(up).unionByName(jumps).groupBy("chain").agg(F.max("parent").alias("parent"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        chains = materialize(chains, "chains")
        rising = chains.where("parent IS NOT NULL")
    return chains.select("chain", "leaves", "saved")


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """A row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    convs: (conv), each once, also those without turns. turns: (conv, depth from 1 without gaps, digest, chars).
    """
    zero, one, null = F.lit(0).cast("long"), F.lit(1).cast("long"), F.lit(None).cast("long")
    keys = {f"k{i}": F.xxhash64(F.lit(i), "depth", "digest") for i in (1, 2)}
    run = F.pmod(F.xxhash64("conv"), F.lit(64)).alias("run")
    prefixes = running_sums(turns.withColumns(keys), "conv", [F.asc("depth")], ["k1", "k2"], "digests").select("conv", run, "depth", "k1", "k2", "chars")
    # The minima, counted in runs of conversations, and what each run needs to know of them.
    by_run = materialize(prefixes.groupBy("run", "k1", "k2", "depth").agg(F.min("conv").alias("owner"), F.count("*").alias("n"), F.max("chars").alias("chars")), "prefix-runs")
    nodes = materialize(by_run.groupBy("k1", "k2", "depth").agg(F.min("owner").alias("owner"), F.sum("n").alias("n_convs"), F.max("chars").alias("chars")), "nodes")
    owners = materialize(by_run.select("run", "k1", "k2").join(nodes.select("k1", "k2", "owner"), ["k1", "k2"]), "owners")
    lengths = convs.select("conv", zero.alias("depth")).unionByName(prefixes.select("conv", "depth")).groupBy("conv").agg(F.max("depth").alias("length"))
    lengths = materialize(lengths, "lengths")
    root, everyone = lengths.agg(F.min("conv"), F.count("*")).head()

    firsts = materialize(_first_owned(prefixes, lengths, owners), "first-owned")
    # What a chain hangs from, and where a conversation that owns no node ends: the owner of the prefix before.
    hung = firsts.where("first > 1").select("conv", (F.col("first") - 1).alias("depth")).join(prefixes, ["conv", "depth"]).join(owners, ["run", "k1", "k2"])
    is_root = F.col("conv") == F.lit(root)
    hung = firsts.join(hung.select("conv", F.col("owner").alias("parent")), "conv", "left").select(
        "conv", "length", F.when(is_root, zero).otherwise(F.col("first")).alias("first"), F.when(~is_root, F.coalesce("parent", F.lit(root).cast("long"))).alias("parent")
    )
    hung = materialize(hung, "hung")
    chains = hung.where("first <= length").select(F.col("conv").alias("owner"), "parent", "first", F.col("length").alias("last"))
    branches = chains.where("parent IS NOT NULL").select("owner", F.col("parent").alias("top"), (F.col("first") - 1).alias("at"))

    # All that is known of a node, by its owner and depth: what it is, that a chain starts or ends there, and how many hang from it.
    def known(df: DataFrame, depth: str, **values: Column) -> DataFrame:
        columns = {c: values.get(c, null) for c in ("n_convs", "chars", "start", "parent", "last", "branches")}
        return df.select("owner", F.col(depth).alias("depth"), *(v.alias(c) for c, v in columns.items()))

    top = convs.sparkSession.createDataFrame([(root, 0, everyone, 0)] if everyone else [], "owner long, depth long, n_convs long, chars long")
    facts = known(nodes.select("owner", "depth", "n_convs", "chars").unionByName(top), "depth", n_convs=F.col("n_convs"), chars=F.col("chars"))
    facts = facts.unionByName(known(chains, "first", start=one, parent=F.col("parent"))).unionByName(known(chains, "last", last=one))
    facts = facts.unionByName(known(branches.drop("owner").withColumnRenamed("top", "owner"), "at", branches=one))
    facts = facts.groupBy("owner", "depth").agg(*(F.max(c).alias(c) for c in ("n_convs", "chars", "start", "parent", "last")), F.coalesce(F.sum("branches"), zero).alias("branches"))
    children = F.col("branches") + F.when(F.col("last").isNull(), one).otherwise(zero)
    facts = facts.select(
        "owner", "depth", "n_convs", "start", F.when(F.col("start").isNull(), F.col("owner")).otherwise(F.col("parent")).alias("parent"),
        children.alias("n_children"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), (children == 0).cast("long").alias("leaves"),
    )
    facts = materialize(facts, "facts")
    single = facts.groupBy(F.col("owner").alias("chain")).agg(F.max(F.when(F.col("start").isNotNull(), F.col("parent"))).alias("parent"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    totals = _totals(materialize(single, "chains"), root)
    hanging = branches.join(totals.withColumnRenamed("chain", "owner"), "owner").select(F.col("top").alias("owner"), F.col("at").alias("depth"), "leaves", "saved")
    own = ["n_convs", "parent", "n_children"]
    at_nodes = facts.drop("start").unionByName(hanging, allowMissingColumns=True).groupBy("owner", "depth").agg(*(F.max(c).alias(c) for c in own), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    summed = running_sums(at_nodes, "owner", [F.desc("depth")], ["leaves", "saved"], "summed")
    ends = hung.select(F.when(F.col("first") <= F.col("length"), F.col("conv")).otherwise(F.col("parent")).alias("owner"), F.col("length").alias("depth"), "conv")
    out = summed.join(ends_digests(ends), ["owner", "depth"], "left")
    return out.select(
        F.col("owner").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(_EMPTY)).alias("ends_sha256"),
    )
