"""Every registered query with SQL, against DuckDB on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from millrace.plans.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def rows(columns, records):
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    return sorted((tuple(plain(r[i]) for i in at) for r in records), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(list(want.columns), want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, data, name):
    """What SQL does not express is held against plain versions elsewhere; here it gives rows, each once."""
    df = QUERIES[name](spark, data)
    assert len(df.columns) == len(set(df.columns)) and df.count() > 0


def small(spark, folder, table, records, schema):
    """A folder with one table of those rows."""
    spark.createDataFrame(records, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    return str(folder)


def held(spark, folder, name, table):
    """Rows of a query and of its SQL over that table."""
    df = QUERIES[name](spark, folder)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want = con.sql(ORACLE_SQL[name])
    return rows(df.columns, df.collect()), rows(list(want.columns), want.fetchall())


def test_api_errors_with_codes_of_any_length(spark, tmp_path):
    records = [(i, u, kind) for i, u in enumerate((0, 599, 600, 1499, 99_999)) for kind in ("click", "view", "error", "purchase")]
    folder = small(spark, tmp_path, "events", [(4 * i + k, u, kind) for k, (i, u, kind) in enumerate(records)], "event_id long, user_id long, event_type string")
    got, want = held(spark, folder, "api_errors", "events")
    assert got == want and any("100399" in map(str, r) for r in got)


def test_human_sizes_of_halves(spark, tmp_path):
    folder = small(spark, tmp_path, "orders", [(1, 1023.5), (1, 1024.5), (1, 0.5), (1, 1.5), (3, 88294.5 / 3), (2, 220518.25)], "o_orderkey long, o_totalprice double")
    got, want = held(spark, folder, "human_sizes", "orders")
    assert got == want


def test_output_blocks_by_words_with_commas_and_colons(spark, tmp_path):
    firsts = ("Of, course", "a:b, c", "x,y z", "Of,\nAnd, it", ": no", ",,, no", None, "", "Plain word")
    texts = ("Of course", "Of, course", "says a:b, c", "b, then", "x,y", "x", "Of,\nAnd, it", "Of,", ": no", ",,,", "Plain", None)
    records = [(c, 0, first) for c, first in enumerate(firsts)] + [(c, t, text) for c in range(len(firsts)) for t, text in enumerate(texts, 1)]
    got, want = held(spark, small(spark, tmp_path, "conversations", records, "conv_id long, turn int, text string"), "output_blocks", "conversations")
    assert got == want and {r[0] for r in got} == {True, False}
