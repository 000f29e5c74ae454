"""Queries of financial tables. Orders, line items and parts stand in for statements, trades and a screener's universe."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import finance as X
from millrace.operators import finance as O
from millrace.plans.registry import Tables, query


@query("SELECT p_partkey, p_name FROM part WHERE p_size > 10 AND p_retailprice <= 1200 AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') AND p_type = 'ECONOMY' ORDER BY p_partkey LIMIT 25")
def screener(spark, sf):
    """Rows that pass a list of filters."""
    filters = [
        {"field": "p_size", "operator": "gt", "value": 10}, {"field": "p_retailprice", "operator": "lte", "value": 1200.0},
        {"field": "p_brand", "operator": "in", "value": ["Brand#1", "Brand#2", "Brand#3"]}, {"field": "p_type", "operator": "eq", "value": "ECONOMY"},
    ]
    return O.screen(Tables(spark, sf).part, filters, 25, ["p_partkey"]).select("p_partkey", "p_name")


@query("SELECT n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE lower(r_name) IN ('asia', 'europe')")
def screener_caseless(spark, sf):
    """Sector filters whatever their case."""
    t = Tables(spark, sf)
    n = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).withColumnRenamed("r_name", "sector")
    return n.where(O.predicate([{"field": "sector", "operator": "in", "value": ["Asia", "EUROPE"]}])).select("n_nationkey", "n_name")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 3")
def latest_n_per_key(spark, sf):
    """The newest three rows of each key."""
    return O.latest_n(Tables(spark, sf).orders, "o_custkey", [F.desc("o_orderdate"), "o_orderkey"], 3).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= date '1996-01-01' AND o_orderdate < date '1996-04-01' AND o_orderstatus = 'F'")
def date_range_filter(spark, sf):
    """Date and value filters of a request."""
    o = Tables(spark, sf).orders.withColumn("filing_type", F.col("o_orderstatus")).withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    import datetime as dt

    return O.request(o, date_col="o_orderdate", gte=dt.date(1996, 1, 1), lt=dt.date(1996, 4, 1), filing_types=["F"]).select("o_orderkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderdate = o_orderdate + to_days((o_orderkey % 2)::INT) THEN CAST(o_orderdate AS DATE) + 1 ELSE CAST(o_orderdate AS DATE) + (o_orderkey % 2)::INT END AS end_date,
CAST(o_orderdate AS DATE) + (o_orderkey % 2)::INT < date '1997-01-01' AS closed FROM orders""")
def window_repair(spark, sf):
    """Windows of no length get a day; windows in the past are closed."""
    o = Tables(spark, sf).orders.withColumn("s", F.col("o_orderdate").cast("date")).withColumn("e", F.date_add("s", (F.col("o_orderkey") % 2).cast("int")))
    return o.select("o_orderkey", O.repaired_end(F.col("s"), F.col("e")).alias("end_date"), O.is_closed(F.col("e"), F.lit("1997-01-01").cast("date")).alias("closed"))


@query("""SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(sum(CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_extendedprice * l_tax END), 2) AS tax,
round(sum(coalesce(CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_extendedprice END, 0) - abs(-l_extendedprice * l_tax)), 2) AS fcf FROM lineitem GROUP BY 1""")
def fcf_style_margin(spark, sf):
    """Cash-flow arithmetic with missing values, by supplier."""
    li = Tables(spark, sf).lineitem
    op = F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice"))
    fcf = X.free_cash_flow(op, -F.col("l_extendedprice") * F.col("l_tax"))
    return li.groupBy("l_suppkey").agg(
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.sum(op * F.col("l_tax")), 2).alias("tax"), F.round(F.sum(fcf), 2).alias("fcf")
    )


@query("""WITH n AS (SELECT o_orderkey, o_totalprice * pow(10, (o_orderkey % 9)::INT - 2) AS x FROM orders)
SELECT o_orderkey, CASE WHEN abs(x) >= 1e12 THEN 'T' WHEN abs(x) >= 1e9 THEN 'B' WHEN abs(x) >= 1e6 THEN 'M' WHEN abs(x) >= 1e3 THEN 'K' ELSE '' END AS unit,
round(x / CASE WHEN abs(x) >= 1e12 THEN 1e12 WHEN abs(x) >= 1e9 THEN 1e9 WHEN abs(x) >= 1e6 THEN 1e6 WHEN abs(x) >= 1e3 THEN 1e3 ELSE 1 END, 9) AS scaled FROM n""")
def humanise_numbers(spark, sf):
    """Numbers by magnitude."""
    x = F.col("o_totalprice") * F.pow(F.lit(10.0), (F.col("o_orderkey") % 9 - 2).cast("double"))
    scaled, unit = X.humanise_scale(x)
    return Tables(spark, sf).orders.select("o_orderkey", unit.alias("unit"), F.round(scaled, 9).alias("scaled"))


_VALUE = """base AS (SELECT o_custkey, year(o_orderdate) AS y, sum(o_totalprice) / 1000 AS f FROM orders GROUP BY ALL),
hist AS (SELECT o_custkey, arg_min(f, y) AS first, arg_max(f, y) AS last, (max(y) - min(y))::DOUBLE AS years FROM base GROUP BY 1),
g AS (SELECT *, CASE WHEN years > 0 THEN pow(last / first, 1 / years) - 1 END AS cagr FROM hist),
v AS (SELECT o_custkey, last AS fcf, least(coalesce(cagr, 0) * 0.85, 0.15) AS gr, 0.08 + (o_custkey % 3) / 100 AS wacc FROM g)"""


def _ev(w: str, g: str) -> str:
    flow, parts = "fcf", []
    for year, left in enumerate(X.GROWTH_DECAY, 1):
        flow = f"{flow} * (1 + gr * {left})"
        parts.append(f"{flow} / pow(1 + {w}, {year})")
    return f"({' + '.join(parts)} + {flow} * (1 + {g}) / ({w} - {g}) / pow(1 + {w}, 5))"


def _valued(spark, sf):
    o = Tables(spark, sf).orders.groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg((F.sum("o_totalprice") / 1000).alias("f"))
    h = O.cash_flow_history(o, "o_custkey", "y", "f").withColumns({"fcf": F.col("last"), "wacc": F.lit(0.08) + (F.col("o_custkey") % 3) / 100})
    return O.value(h.withColumns({"debt": F.lit(10.0), "cash": F.lit(5.0), "shares": F.lit(100.0)}))


@query(f"""WITH {_VALUE} SELECT o_custkey, round({_ev('wacc', '0.025')}, 4) AS ev, round(({_ev('wacc', '0.025')} - 10 + 5) / 100, 6) AS per_share FROM v""")
def dcf_value(spark, sf):
    """Discounted cash flow by customer."""
    return _valued(spark, sf).select("o_custkey", F.round("ev", 4).alias("ev"), F.round("per_share", 6).alias("per_share"))


def _terminal(w: str, g: str) -> str:
    flow = "fcf" + "".join(f" * (1 + gr * {left})" for left in X.GROWTH_DECAY)
    return f"({flow} * (1 + {g}) / ({w} - {g}) / pow(1 + {w}, 5))"


@query(f"""WITH {_VALUE}, e AS (SELECT *, {_ev('wacc', '0.025')} AS ev, {_terminal('wacc', '0.025')} AS terminal FROM v)
SELECT o_custkey, abs(ev - fcf * 20) > 0.3 * abs(fcf * 20) AS ev_off, terminal / ev > 0.9 AS terminal_high, terminal / ev < 0.4 AS terminal_low, terminal / ev BETWEEN 0.5 AND 0.8 AS terminal_usual,
  (ev - 10 + 5) / 100 BETWEEN fcf / 100 * 15 AND fcf / 100 * 25 AS multiple_usual FROM e""")
def dcf_checks(spark, sf):
    """Flags of valuations that need a second look."""
    v = _valued(spark, sf)
    flags = X.dcf_checks(F.col("ev"), F.col("fcf") * 20, F.col("terminal"), F.col("fcf") / 100, F.col("per_share"))
    return v.select("o_custkey", *(c.alias(n) for n, c in flags.items()))


@query("""SELECT s_suppkey, upper(s_name) || ': $' || printf('%.2f', s_acctbal::DOUBLE) || ' (H: $' || printf('%.2f', s_acctbal::DOUBLE + 1) || ' L: $' || printf('%.2f', s_acctbal::DOUBLE - 1) || ') Vol: ' || s_nationkey AS text FROM supplier""")
def quote_lines(spark, sf):
    """Quotes by the formatter that a data set's name asks for."""
    from millrace.functions.registry import formatter

    close = F.col("s_acctbal").cast("double")
    rows = Tables(spark, sf).supplier.select("s_name", "s_suppkey", close.alias("close"), (close + 1).alias("high"), (close - 1).alias("low"), F.col("s_nationkey").alias("volume"))
    return formatter("stock_price")(rows, ["s_name", "s_suppkey"]).select("s_suppkey", "text")


@query(f"""WITH {_VALUE}, w AS (SELECT v.*, wacc + dw.d AS wu, tg.g AS tg FROM v, (VALUES (-0.01), (0.0), (0.01)) dw(d), (VALUES (0.02), (0.025), (0.03)) tg(g))
SELECT o_custkey, round(wu, 6) AS wacc_used, tg::DOUBLE AS terminal_growth, round(({_ev('wu', 'tg')} - 10 + 5) / 100, 6) AS value FROM w""")
def dcf_grid(spark, sf):
    """Nine values by discount rate and terminal growth."""
    g = O.sensitivity(_valued(spark, sf))
    return g.select("o_custkey", F.round("wacc_used", 6).alias("wacc_used"), "terminal_growth", F.round("value", 6).alias("value"))


_SECTORS = {"AUTOMOBILE": "Consumer Discretionary", "BUILDING": " real estate ", "FURNITURE": "consumer staples", "HOUSEHOLD": "UTILITIES", "MACHINERY": "Information Technology"}


@query("""SELECT c_custkey, round((CASE c_mktsegment WHEN 'BUILDING' THEN (7 + 9) / 2 WHEN 'FURNITURE' THEN (7 + 8) / 2 WHEN 'HOUSEHOLD' THEN (6 + 7) / 2 WHEN 'MACHINERY' THEN (8 + 12) / 2 WHEN 'AUTOMOBILE' THEN (8 + 10) / 2 ELSE 9 END
  + CASE WHEN c_acctbal < 0 THEN 1.5 ELSE 0 END) / 100, 6)::DOUBLE AS wacc FROM customer""")
def sector_wacc(spark, sf):
    """Discount rates by sector with adjustments; an unknown sector has the middle rate."""
    adjust = F.when(F.col("c_acctbal") < 0, F.lit(1.5))
    sector = F.coalesce(*(F.when(F.col("c_mktsegment") == k, F.lit(v)) for k, v in _SECTORS.items()), F.lit("other"))
    return Tables(spark, sf).customer.select("c_custkey", F.round(X.sector_wacc(sector, adjust), 6).alias("wacc"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'FY' || year(o_orderdate) ELSE 'Q' || quarter(o_orderdate) || ' ' || strftime(o_orderdate, '%y') END AS label FROM orders""")
def period_labels(spark, sf):
    """Fiscal labels, or quarter and year."""
    fiscal = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("FY"), F.year("o_orderdate").cast("string")))
    return Tables(spark, sf).orders.select("o_orderkey", X.period_label(F.col("o_orderdate").cast("date"), fiscal).alias("label"))


@query("""WITH l AS (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS rn, count(*) OVER (PARTITION BY l_suppkey) AS n, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS d FROM lineitem)
SELECT l_suppkey, least(20, count(*))::INT AS shown, md5(string_agg(d, ',' ORDER BY rn) FILTER (rn <= 20)) AS dates_md5, any_value(n) > 20 AS more FROM l GROUP BY 1""")
def price_table(spark, sf):
    """Price tables of twenty rows, and how many more there are."""
    li = Tables(spark, sf).lineitem.select("l_suppkey", F.col("l_shipdate").cast("date").alias("date"), F.col("l_extendedprice").alias("open"), F.col("l_extendedprice").alias("close"), F.col("l_quantity").alias("volume"), "l_orderkey", "l_linenumber")
    render = X.table("Price History", ["Date"], ["------"], [F.col("date").cast("string")], "", ["date", "l_orderkey", "l_linenumber"], limit=20, more=True)
    t = render(li, ["l_suppkey"])
    dates = F.regexp_extract_all("text", F.lit(r"\| (\d{4}-\d{2}-\d{2}) \|"), F.lit(1))
    return t.select("l_suppkey", F.size(dates).alias("shown"), F.md5(F.array_join(dates, ",")).alias("dates_md5"), F.col("text").contains("more rows").alias("more"))


@query("""WITH r AS (SELECT event_type AS tool, user_id % 3 AS t, event_id, props, row_number() OVER (PARTITION BY event_type, user_id % 3 ORDER BY event_id DESC) AS rn FROM events)
SELECT tool || '_' || t AS key, props AS data FROM r WHERE rn = 1 AND tool <> 'error'""")
def combined_results(spark, sf):
    """Results of sub-requests by tool and ticker, the last of equal keys, errors apart."""
    return O.last_results(_requests(Tables(spark, sf).events)).where("error is null").select("key", "data")


def _requests(e):
    bad = F.when(F.col("event_type") == "error", F.lit("failed"))
    return e.select(F.col("event_type").alias("tool"), (F.col("user_id") % 3).cast("string").alias("ticker"), F.col("event_id").alias("ord"), F.when(bad.isNull(), F.col("props")).alias("data"), bad.alias("error"), F.array(F.col("event_type")).alias("urls"))


@query("SELECT o_orderkey, o_totalprice AS amount FROM orders")
def drop_fields(spark, sf):
    """Fields taken out at any depth."""
    nested = F.struct(F.col("o_totalprice").alias("amount"), F.lit("USD").alias("currency"), F.array(F.struct(F.lit(1).alias("period"), F.lit(2).alias("x"))).alias("items"))
    d = O.drop_fields(Tables(spark, sf).orders.select("o_orderkey", nested.alias("n"), F.lit("q").alias("period")))
    assert "period" not in d.columns and "currency" not in d.schema["n"].dataType.names
    return d.select("o_orderkey", "n.amount")


@query("""SELECT o_custkey, o_orderkey, l_linenumber FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 3) JOIN lineitem ON l_orderkey = o_orderkey""")
def filings_read(spark, sf):
    """The newest three filings of each ticker with their items."""
    t = Tables(spark, sf)
    f = t.orders.select(F.col("o_custkey").alias("ticker"), F.col("o_orderkey").alias("accession_number"), F.col("o_orderdate").alias("filing_date"))
    items = t.lineitem.select(F.col("l_orderkey").alias("accession_number"), "l_linenumber")
    return O.read_filings(f, items).select(F.col("ticker").alias("o_custkey"), F.col("accession_number").alias("o_orderkey"), "l_linenumber")
