"""URL filters: a blocked Bloom filter of the listed URLs, then an exact hash join.

A listed rule is (host, path, verdict). It fits a URL whose host is the rule's host or a subdomain of it and whose path starts
with the rule's path. For each URL the candidate keys are: every suffix of its host at a label boundary (no longer than the
longest listed host) with every prefix of its path that is as long as some listed path. Keys that the filter lets through are
joined with the rules by their text, which removes false positives; the longest rule wins (host and path together, then host,
then block before allow).

The filter is a table of blocks, each of eight 32-bit words with one bit a key in each. It is broadcast: its size is at most
``max_blocks`` rows, however long the list is; a fuller filter only passes more keys to the exact join. The rules themselves are
broadcast up to ``broadcast_bytes`` of keys and are joined by a salted shuffle beyond.

Defined results: a URL that is null or has no ``://`` has an empty host and path and no rule; verdict ``default``; repeated
(id, url) rows are each returned; rules with a null host or path are ignored; repeated rules count once; an empty list gives
the default everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import ascii_lower, copies

_WORDS = 8
_PART = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, _PART, 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PART, 2), F.lit(""))


def _key(host: Column, path: Column) -> Column:
    """No host holds a slash, so this names the pair."""
    return F.concat(host, F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/\x00"), path)))


def _block(key_hash: Column, blocks: int) -> Column:
    return F.pmod(F.shiftright(key_hash, 32), F.lit(blocks))


def _mask(key: Column, word: int) -> Column:
    """The key's bit in one word of its block: five bits of a second hash name it."""
    bit = F.shiftright(F.xxhash64(F.lit("bit"), key), 5 * word).bitwiseAND(F.lit(31))
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """The filter of the column key: block, w0 to w7; a row for each block that has a key."""
    h = F.xxhash64("key")
    return keys.groupBy(_block(h, blocks).alias("block")).agg(*(F.bit_or(_mask(F.col("key"), i)).alias(f"w{i}") for i in range(_WORDS)))


def url_filter(
    urls: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    max_blocks: int = 1 << 18,
    broadcast_bytes: int = 16 << 20,
    salts: int = 32,
) -> DataFrame:
    """Judges every URL: id, url, host, path, rule, verdict."""
    listed = (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
        .select(ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
        .groupBy("rule_host", "rule_path")
        .agg(F.max("verdict").alias("rule_verdict"))
        .select(_key(F.col("rule_host"), F.col("rule_path")).alias("key"), "*")
    )
    # A rule is held three times (key, host, path) with some 100 bytes beside.
    size = F.sum(F.octet_length("key").cast("long") * 2 + F.octet_length("rule_verdict") + 100)
    facts = listed.agg(F.count("*"), F.max(F.size(F.split("rule_host", r"\."))), F.collect_set(F.length("rule_path")), size).head()
    count, labels, lengths, rule_bytes = facts[0], facts[1] or 0, sorted(facts[2]), facts[3] or 0
    # One row for each (id, url) from here on: repeats come back at the end, and no row number is needed.
    pages = (
        urls.groupBy(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
        .agg(F.count("*").alias("_n"))
        .withColumns({"host": url_host(F.col("_url")), "path": url_path(F.col("_url"))})
    )
    if not count:
        judged = pages.withColumn("best", F.lit(None).cast("struct<size:int,host_size:int,verdict:string,rule:string>"))
    else:
        parts = F.split("host", r"\.")
        n = F.least(F.size(parts), F.lit(labels))
        suffixes = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(parts, -k, k), "."))
        prefixes = F.transform(
            F.filter(F.array(*map(F.lit, lengths)), lambda k: k <= F.length("path")), lambda k: F.substring(F.col("path"), F.lit(1), k)
        )
        keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: _key(s, p))))
        blocks = min(max_blocks, max(1, count // 16))
        probe = pages.withColumn("key", F.explode_outer(F.array_distinct(keys))).withColumn("_h", F.xxhash64("key"))
        filtered = probe.join(F.broadcast(bloom_blocks(listed.select("key"), blocks)), _block(F.col("_h"), blocks) == F.col("block"), "left")
        maybe = F.lit(True)
        for i in range(_WORDS):
            maybe = maybe & (F.col(f"w{i}").bitwiseAND(_mask(F.col("key"), i)) != 0)
        # A key that cannot be listed goes; the page's row stays with a null key.
        filtered = filtered.select("_id", "_url", "_n", "host", "path", F.when(maybe, F.col("key")).alias("key"))
        if rule_bytes <= broadcast_bytes:
            joined = filtered.join(F.broadcast(listed), "key", "left")
        else:
            salted = listed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
            mine = F.pmod(F.xxhash64("_id", "_url"), F.lit(salts)).cast("int")
            joined = filtered.withColumn("_salt", mine).join(salted, ["key", "_salt"], "left")
        rule = F.struct(
            (F.length("rule_host") + F.length("rule_path")).alias("size"),
            F.length("rule_host").alias("host_size"),
            F.col("rule_verdict").alias("verdict"),
            F.concat("rule_host", "rule_path").alias("rule"),
        )
        judged = joined.groupBy("_id", "_url").agg(
            F.first("_n").alias("_n"),
            F.first("host").alias("host"),
            F.first("path").alias("path"),
            F.max(F.when(F.col("rule_host").isNotNull(), rule)).alias("best"),
        )
    return copies(judged, "_n", "_copy").select(
        F.col("_id").alias(id_col),
        F.col("_url").alias(url_col),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
