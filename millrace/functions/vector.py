"""Vector, token and similarity expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 3.5
SNIPPET_CHARS = 700


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def length(a: Column) -> Column:
    """Euclidean length in double precision."""
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, a_length: Column | None = None, b_length: Column | None = None) -> Column:
    """Cosine in double precision; 0 for vectors that are empty, zero, null or of different lengths (R01). Lengths may be given."""
    norm = (length(a) if a_length is None else a_length) * (length(b) if b_length is None else b_length)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.coalesce(F.try_divide(dot(a, b), norm), F.lit(0.0))).otherwise(F.lit(0.0))


#: A word of a keyword query: letters, digits and underscores of any script.
WORD = r"([\p{L}\p{N}_]+)"


def word_tokens(text: Column) -> Column:
    """The words of a text."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(1))


def ascii_tokens(text: Column) -> Column:
    """Distinct ASCII words of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), F.lit(1)))


def query_tokens(text: Column) -> Column:
    """Distinct words of more than two signs, everything else taken for space."""
    return F.array_distinct(F.filter(F.split(F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9_\s]", " ")), r"\s+"), lambda w: F.length(w) > 2))


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """Similarity of two sets; 0 if one is empty (U04). both_empty: 1 for snippets (U04), 0 for queries."""
    union = F.size(F.array_union(a, b))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(float(both_empty)))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(F.size(F.array_intersect(a, b)) / union)
    )


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / CHARS_PER_TOKEN)


def char_budget(tokens: int) -> int:
    """Signs that a number of tokens stands for, 1 at least."""
    return max(1, math.floor(tokens * CHARS_PER_TOKEN))


def auto_compact_threshold(window: int, reserved_output: int = 20_000, buffer: int = 13_000) -> int:
    """Tokens at which a context of that window is compacted."""
    return window - reserved_output - buffer


def flush_due(tokens: Column, threshold: Column, flushed: Column) -> Column:
    """At or over the threshold, and not flushed before."""
    return (tokens >= threshold) & ~flushed


def snippet(text: Column, chars: int = SNIPPET_CHARS) -> Column:
    """White space collapsed, cut at a number of signs with three dots behind."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= chars, flat).otherwise(F.concat(F.trim(F.substring(flat, 1, chars)), F.lit("...")))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def short_key(text: Column) -> Column:
    """The first 12 hex digits of the MD5."""
    return F.substring(F.md5(text), 1, 12)


def normalised_weights(vector: float, keyword: float) -> tuple[float, float]:
    """Weights that sum to 1; 0.7 and 0.3 if they cannot."""
    total = vector + keyword
    return (vector / total, keyword / total) if total > 0 else (0.7, 0.3)


def decay(age_days: Column, half_life: float) -> Column:
    """Halves every half_life days; a half-life that is not positive or not finite does not decay."""
    if half_life <= 0 or math.isinf(half_life) or math.isnan(half_life):
        return F.lit(1.0)
    return F.exp(-F.lit(math.log(2) / half_life) * F.greatest(age_days, F.lit(0.0)))


def age_days(path: Column, updated: Column, now: Column) -> Column:
    """Age of a chunk: of session files from their update, of dated files from the date in their name, else null, which does not age."""
    name = F.element_at(F.split(path, "/"), -1)
    dated = F.try_to_timestamp(F.when(name.rlike(r"^\d{4}-\d{2}-\d{2}\.md$"), F.substring(name, 1, 10)), F.lit("yyyy-MM-dd"))
    since = F.when(path.startswith("sessions/"), updated).otherwise(dated)
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))) / F.lit(86_400_000_000.0)


def source_label(vector: Column, keyword: Column) -> Column:
    """both, vector or keyword, by which score is over 0."""
    return F.when((vector > 0) & (keyword > 0), "both").when(vector > 0, "vector").otherwise("keyword")
