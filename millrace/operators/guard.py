"""Personal-data guard over DataFrames.

Direct e-mails and cards, Luhn, masks and the outcome rules are columns of built-ins. Detectors that need offsets, decoding or
look-back run in Arrow batches (``pii_spans``, ``guarded``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import pii

SPAN = "struct<type:string,start:int,end:int,match:string,confidence:double>"
GUARD = (
    f"struct<action:string,masked_text:string,detections:array<{SPAN}>,stage1:array<{SPAN}>,deterministic:array<{SPAN}>,stage2:array<{SPAN}>,"
    "stage2_used:boolean,stage2_timed_out:boolean,leaked:array<string>,reasons:array<string>>"
)
#: Attribute keys whose values may hold personal data.
SENSITIVE_KEYS = ("input.value", "output.value")
SENSITIVE_PREFIXES = ("llm.input_messages", "llm.output_messages", "tool.parameters", "retrieval.documents")
#: ASCII word boundary; Java's own is one of Unicode.
_B = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
EMAIL = rf"({_B}[A-Za-z0-9._%+-]+\s*@\s*[A-Za-z0-9.-]+\s*\.\s*[A-Za-z]{{2,}}{_B})"
_FOUR = r"[0-9](?:\s*[0-9]){3}"
CARD = rf"({_B}{_FOUR}\s*[-.@_*]?\s*{_FOUR}\s*[-.@_*]?\s*{_FOUR}\s*[-.@_*]?\s*{_FOUR}{_B})"


def emails(text: Column) -> Column:
    """E-mail addresses, as written (D01). The pattern tries each word again and again, so only texts with an at sign meet it."""
    return F.when(text.contains("@") | text.isNull(), F.regexp_extract_all(text, F.lit(EMAIL), F.lit(1))).otherwise(F.array().cast("array<string>"))


def cards(text: Column) -> Column:
    """Runs of sixteen digits in four groups, as written."""
    return F.when(text.rlike("[0-9]") | text.isNull(), F.regexp_extract_all(text, F.lit(CARD), F.lit(1))).otherwise(F.array().cast("array<string>"))


def luhn(text: Column) -> Column:
    """Luhn's sum over 13 to 19 digits, in built-ins."""
    digits = F.reverse(F.regexp_replace(text, "[^0-9]", ""))
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return n.between(13, 19) & (F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda t, i: F.coalesce(add(t, i), F.lit(-1000))) % 10 == 0)


def mask_email(text: Column) -> Column:
    return F.when(text.contains("@"), F.regexp_replace(text, EMAIL, "[REDACTED_EMAIL]")).otherwise(text)


def mask_spans(text: Column, spans: Column) -> Column:
    """Replaces spans from right to left (D03), in built-ins."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"))), asc=False)
    return F.aggregate(
        ordered,
        text,
        lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), F.lit("[REDACTED_"), F.upper(s["type"]), F.lit("]"), F.substring(t, s["end"] + 1, F.length(t))),
    )


#: Signs without which no detector works but those of the three patterns below; one range for all that lie beyond Latin, since Java tries a class's
#: members one by one.
_SIGNS = "[0-9@%\u2460-\uffff]"
#: A token that may be Base64 of something; words of up to 17 letters decode to at most nine digits, and to no at sign.
_TOKEN = r"(?<![A-Za-z0-9+/])(?![A-Za-z][a-z]{11,16}(?![A-Za-z0-9+/=]))[A-Za-z0-9+/]{12}"
#: Three digits in words on end, of the ten that a number has.
_GAP = r"(?:[,.\-_/\s\x0B\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff])+"
_THREE = f"(?i)(?:^|[^a-z0-9_])(?:{pii._E}){_GAP}(?:{pii._E}){_GAP}(?:{pii._E})"


def may_hold_pii(text: Column) -> Column:
    """False only where no detector can find anything."""
    spoken = text.rlike("(?i)dot|period") & text.rlike("(?i)at")
    return text.rlike(_SIGNS) | spoken | text.rlike(_THREE) | text.rlike(_TOKEN)


_SPAN = pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("match", pa.string()), ("confidence", pa.float64())])


def _udf(run, kind: str, arrow: pa.DataType):
    @F.arrow_udf(kind)
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([run(t) if t is not None else None for t in texts.to_pylist()], arrow)

    return apply


_STAGES = {"direct": pii.direct, "deterministic": pii.deterministic, "contextual": pii.contextual, "all": pii.detect}
_STAGES |= {f.__name__: f for f in (pii.korean_numerals, pii.spaced_email, pii.reversed_numbers, pii.demographic, pii.base64_tokens, pii.url_tokens, pii.unicode_digits, pii.phrases, pii.spoken_emails, pii.english_digits)}


def pii_spans(text: Column, stage: str = "all") -> Column:
    """Spans of a stage or of a single detector (D01 to D16, D21); null text gives null."""
    run = _STAGES[stage]
    return _udf(lambda t: [s._asdict() for s in run(t)], f"array<{SPAN}>", pa.list_(_SPAN))(text)


def fingerprint(value: Column, salt: str) -> Column:
    """Keyed fingerprint (D22). The salt is a secret of the caller."""
    return _udf(lambda v: pii.fingerprint(v, salt), "string", pa.string())(value)


def fingerprint_sql(value: Column, salt: str) -> Column:
    """The same fingerprint in built-ins: the HMAC written out with two SHA-256."""
    key = salt.encode()
    if len(key) > 64:
        import hashlib

        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    plain = F.lower(F.regexp_replace(F.translate(value, "".join(pii.KOREAN), "".join(pii.KOREAN.values())), "[^A-Za-z0-9]", ""))
    first = F.unhex(F.sha2(F.concat(F.lit(inner), F.to_binary(plain, F.lit("utf-8"))), 256))
    return F.when(plain == "", "").otherwise(F.substring(F.sha2(F.concat(F.lit(outer), first), 256), 1, 16))


def seed_values(seed: Column) -> Column:
    """Values a seed text lists, without detection."""
    parts = F.transform(F.split(seed, ","), lambda p: F.trim(F.when(F.instr(p, ":") > 0, F.regexp_replace(p, "^[^:]*:", "")).otherwise(p)))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def guarded(df: DataFrame, text_col: str = "text", seed_col: str | None = None, stage2: str = "auto", salt: str = "", strict: bool = False) -> DataFrame:
    """df with a column ``guard`` (D20, D26): action, masked text, spans of each stage, leaked fingerprints and reasons.

    A null text is allowed as an empty one. A seed is a "name: value, name: value" text, or an array of values, which may hold commas and colons.
    """
    seed = F.col(seed_col) if seed_col else F.lit(None).cast("string")

    @F.arrow_udf(GUARD)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, seeds in batches:
            rows = []
            for t, s in zip(texts.to_pylist(), seeds.to_pylist(), strict=True):
                g = pii.guard(t or "", s, stage2=stage2, salt=salt, strict=strict)
                rows.append({k: [x._asdict() for x in v] if v and k in _SPANS else v for k, v in g.items()})
            yield pa.array(rows, _GUARD)

    # Detectors tell sooner than patterns of Java which texts hold nothing, so every row goes to them.
    return df.withColumn("guard", run(F.col(text_col), seed))


_SPANS = ("detections", "stage1", "deterministic", "stage2")
_GUARD = pa.struct(
    [("action", pa.string()), ("masked_text", pa.string()), *((k, pa.list_(_SPAN)) for k in _SPANS), ("stage2_used", pa.bool_()), ("stage2_timed_out", pa.bool_())]
    + [("leaked", pa.list_(pa.string())), ("reasons", pa.list_(pa.string()))]
)


def output_guard(df: DataFrame, text_col: str, seed_col: str, salt: str) -> DataFrame:
    """blocked, masked_output, leaked_tokens ("fp:" and the fingerprint) and reason of an answer."""
    g = guarded(df, text_col, seed_col, salt=salt)
    return g.select(
        *df.columns,
        (F.col("guard.action") == "block").alias("blocked"),
        F.col("guard.masked_text").alias("masked_output"),
        F.transform("guard.leaked", lambda x: F.concat(F.lit("fp:"), x)).alias("leaked_tokens"),
        F.array_join("guard.reasons", "; ").alias("reason"),
    )


def outcome(contains: Column, detected: Column, exact_mask: Column) -> Column:
    """TP if the mask is exact, PARTIAL if something was found, FN; FP or TN without personal data."""
    return F.when(contains & detected & exact_mask, "TP").when(contains & detected, "PARTIAL").when(contains, "FN").when(detected, "FP").otherwise("TN")


def stage1_truth(contains: Column, requires_stage: Column) -> Column:
    """Whether the first stage alone should find something."""
    return contains & (requires_stage.isNull() | (requires_stage == 1))


def redaction_tags(text: Column) -> Column:
    """Types named by the redaction tags of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[REDACTED_([A-Z_]+)\]"), F.lit(1)))


def sanitise(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """All strings inside the columns masked, however deep they lie (D24). Map keys and other types stay."""
    for name in columns or df.columns:
        kind = df.schema[name].dataType
        if _has_string(kind):
            df = df.withColumn(name, _sanitised(F.col(name), kind))
    return df


def _has_string(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_string(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _has_string(kind.elementType)
    return _has_string(kind.valueType) if isinstance(kind, T.MapType) else isinstance(kind, T.StringType)


def _plain(value, kind: T.DataType):
    if value is None or not _has_string(kind):
        return value
    if isinstance(kind, T.StructType):
        return {f.name: _plain(value[f.name], f.dataType) for f in kind.fields}
    if isinstance(kind, T.ArrayType):
        return [_plain(v, kind.elementType) for v in value]
    if isinstance(kind, T.MapType):
        return {k: _plain(v, kind.valueType) for k, v in dict(value).items()}
    spans = pii.detect(value)
    return pii.mask(value, spans) if spans else value


def _sanitised(col: Column, kind: T.DataType) -> Column:
    """Python cannot run inside a higher-order function, so a nested value goes to it as a whole."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            yield pa.array([_plain(v, kind) for v in values.to_pylist(maps_as_pydicts="strict")], values.type)

    return run(col)


def is_sensitive_key(key: Column) -> Column:
    """Keys of span attributes that may hold personal data."""
    return key.isin(*SENSITIVE_KEYS) | F.array_contains(F.array(*(key.startswith(p) for p in SENSITIVE_PREFIXES)), True)


def redact_attributes(df: DataFrame, col: str = "attributes") -> DataFrame:
    """Masks the values of sensitive keys of a map of attributes, and counts what was masked in "pii.redacted.count" (D25)."""
    keys = F.map_keys(F.map_filter(col, lambda k, _: is_sensitive_key(k)))

    @F.arrow_udf("map<string,string>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for maps, sensitive in batches:
            out = []
            for m, some in zip(maps.to_pylist(maps_as_pydicts="strict"), sensitive.to_pylist(), strict=True):
                n = 0
                for k in some or ():
                    if m[k] is not None and (spans := pii.detect(m[k])):
                        m[k], n = pii.mask(m[k], spans), n + len(spans)
                out.append(m if not n else {**m, "pii.redacted.count": str(n)})
            yield pa.array(out, pa.map_(pa.string(), pa.string()))

    return df.withColumn(col, run(F.col(col), keys))


def seeded_leaks(outputs: DataFrame, seeds: DataFrame, key: str, salt: str) -> DataFrame:
    """Outputs that hold a value of a seed of their key (J07: equal fingerprints of spans; J08: the value itself).

    outputs: key, text; seeds: key, value. A row per output and leaked fingerprint. A null key matches nothing.
    """
    known = seeds.select(key, "value", fingerprint_sql(F.col("value"), salt).alias("fp")).where(F.col("fp") != "").where(F.col(key).isNotNull()).distinct()
    texts = outputs.select(key, "text").where(F.col(key).isNotNull() & F.col("text").isNotNull()).distinct()
    spans = texts.select(key, "text", F.explode(pii_spans(F.col("text"))).alias("s"))
    marked = spans.select(key, "text", fingerprint_sql(F.col("s.match"), salt).alias("fp")).join(known.select(key, "fp").distinct(), [key, "fp"]).select(key, "text", "fp")
    return marked.unionByName(values_in_texts(texts, known, key).select(key, "text", "fp")).distinct()


#: Seeds an automaton holds, and signs of text that it reads in one task, about.
SEED_BLOCK, TEXT_PART = 100_000, 1 << 25
_RUNS = 64


def _dealt(rows: DataFrame, key: str, what: str, weight: Column, most: int, name: str) -> tuple[DataFrame, DataFrame]:
    """rows with a number ``name`` that deals those of a key to as many parts as their weight asks for; and (key, parts).

    Weighed in runs first, so that a key with many rows is spread over them on the way back.
    """
    rows = rows.withColumn("_run", F.pmod(F.xxhash64(what), F.lit(_RUNS)))
    runs = rows.groupBy(key, "_run").agg(F.sum(weight).alias("_w"))
    parts = runs.groupBy(key).agg(F.greatest(F.lit(1), F.ceil(F.sum("_w") / most)).cast("long").alias(f"{name}s"))
    decided = runs.select(key, "_run").join(parts, key)
    return rows.join(decided, [key, "_run"]).withColumn(name, F.pmod(F.xxhash64(what, F.lit(1)), F.col(f"{name}s"))).drop("_run", f"{name}s"), parts


def values_in_texts(texts: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """The values (key, value, fp) that texts (key, text) of their key contain: key, text, value, fp.

    A key's values go into Aho-Corasick automata of SEED_BLOCK values, each of which reads the texts of the key once, in as many tasks as their
    size asks for; no pair of text and value is made but those that are found.
    """
    kind = dict(texts.dtypes)[key]
    columns = f"`{key}` {kind}, text string, value string, fp string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        group, automaton, ready = None, None, False
        for batch in batches:
            found = []
            for k, block, part, is_text, text, fp in zip(*(batch.column(c).to_pylist() for c in (key, "block", "part", "is_text", "text", "fp")), strict=True):
                if (k, block, part) != group:
                    group, automaton, ready = (k, block, part), ahocorasick.Automaton(), False
                if not is_text:
                    automaton.add_word(text, (text, fp))
                    continue
                if not ready:
                    ready = True
                    if len(automaton):
                        automaton.make_automaton()
                if len(automaton):
                    found += [(k, text, v, f) for v, f in sorted({hit for _, hit in automaton.iter(text)})]
            out = list(zip(*found, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.column(key).type), *(pa.array(c, pa.string()) for c in out[1:])], [key, "text", "value", "fp"])

    seeds, blocks = _dealt(values.select(key, F.col("value").alias("text"), "fp"), key, "text", F.lit(1), SEED_BLOCK, "block")
    rows, parts = _dealt(texts.join(blocks.select(key), key, "left_semi"), key, "text", F.length("text"), TEXT_PART, "part")
    each = lambda df, counts, name: df.join(counts, key).withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{name}s") - 1))).drop(f"{name}s")
    seeds = each(seeds, parts, "part").withColumn("is_text", F.lit(False))
    rows = each(rows, blocks, "block").withColumns({"is_text": F.lit(True), "fp": F.lit(None).cast("string")})
    met = seeds.unionByName(rows).repartition(key, "block", "part").sortWithinPartitions(key, "block", "part", "is_text")
    return met.mapInArrow(run, columns)
