import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def prose(rng, n):
    return " ".join("".join(rng.choice(["ba", "to", "ri", "ne", "shu", "Ka", "é", "lom"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def edge_rows(seed=3):
    """Rows with nulls, empty and long texts, copies, near copies, repeated rows and shared lines."""
    rng = random.Random(seed)
    base = prose(rng, 120)
    near = base.split()
    near[60] = "changed"
    long = "\n".join(prose(rng, 30) for _ in range(400))
    shared = "this line stands in several documents"
    rows = [
        (1, base, "en", "a", 1),
        (2, base.upper(), "en", "a", 1),
        (3, " ".join(near), None, "a", 1),
        (4, None, "en", None, None),
        (5, "", "en", "a", 0),
        (6, " \t\n ", "en", "a", 1),
        (7, long, "de", "b", 1),
        (8, f"{prose(rng, 20)}\n {shared.upper()} \n{prose(rng, 9)}", "de", "b", 1),
        (9, f"{shared}\n{shared}\nshort", "de", "b", 1),
        (10, "a b c", "de", "b", 1),
        (11, "A B c", "de", "b", 1),
        (None, "a text without an id", "de", "b", 1),
        (12, prose(rng, 80), "fr", "c", 1),
        (12, "twice " + prose(rng, 8), "fr", "c", 1),
    ]
    rows += [(13, "repeated row " + base[:200], "fr", "c", 1)] * 2
    rows += [(100 + i, "the same text for many", "fr", "hot", 1) for i in range(20)]
    return rows


def edge_documents(spark):
    from pyspark.sql import functions as F

    # Columns whose names the operators use themselves must do no harm.
    extra = {c: F.lit("x") for c in ("id", "key", "run", "kept", "n", "size", "shard", "_id", "u", "v", "digest")}
    return spark.createDataFrame(edge_rows(), SCHEMA).withColumns(extra)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)
