"""Screens, parameter filters and valuations over financial tables."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import finance as X

_COMPARE = {"gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}
_CASELESS = ("sector", "industry")
#: Fields that carry no information for a reader.
REDUNDANT, REDUNDANT_TRADES = ("accession_number", "currency", "period"), ("issuer",)
#: Data sets by name, with the columns that their requests filter by.
ENDPOINTS = {
    "income_statements": ("ticker", "report_period"), "balance_sheets": ("ticker", "report_period"), "cash_flow_statements": ("ticker", "report_period"),
    "all_financial_statements": ("ticker", "report_period"), "key_ratios": ("ticker", None), "historical_key_ratios": ("ticker", "report_period"),
    "stock_price": ("ticker", None), "stock_prices": ("ticker", "date"), "stock_tickers": (None, None), "crypto_price": ("ticker", None), "crypto_prices": ("ticker", "date"),
    "crypto_tickers": (None, None), "segments": ("ticker", "report_period"), "estimates": ("ticker", "report_period"), "earnings": ("ticker", None),
    "news": ("ticker", "date"), "insider_trades": ("ticker", "filing_date"), "filings": ("ticker", "filing_date"), "10k_items": ("ticker", "year"),
    "10q_items": ("ticker", "year"), "8k_items": ("ticker", "accession_number"),
}


def predicate(filters: list[dict]) -> Column:
    """Conjunction of (field, operator, value) filters; operators gt, gte, lt, lte, eq, in; sector and industry whatever their case."""

    def one(f: dict) -> Column:
        col, op, value = F.col(f["field"]), f["operator"], f["value"]
        if f["field"] in _CASELESS and op in ("eq", "in"):
            values = [str(v).lower() for v in (value if isinstance(value, list) else [value])]
            return F.lower(col).isin(values)
        if op == "eq":
            return col == value
        if op == "in":
            return col.isin(list(value))
        if op not in _COMPARE:
            raise ValueError(f"unknown operator {op!r}")
        return _COMPARE[op](col, F.lit(value))

    return reduce(operator.and_, map(one, filters), F.lit(True))


def screen(df: DataFrame, filters: list[dict], limit: int = 5, order: list[str] | None = None) -> DataFrame:
    """Rows that pass all filters, the first of them."""
    out = df.where(predicate(filters))
    return (out.orderBy(*order) if order else out).limit(limit)


def request(df: DataFrame, ticker: str | None = None, date_col: str = "report_period", gt=None, gte=None, lt=None, lte=None, on=None, limit: int | None = None,
            period: str | None = None, filing_types: list[str] | None = None, name: str | None = None, ticker_col: str = "ticker") -> DataFrame:
    """Filters of a data request (P04): ticker, dates, period, several filing types, insider name, and the newest rows of each ticker."""
    if ticker is not None:
        df = df.where(F.col(ticker_col) == ticker.strip().upper())
    for op, value in (("gt", gt), ("gte", gte), ("lt", lt), ("lte", lte)):
        if value is not None:
            df = df.where(_COMPARE[op](F.col(date_col), F.lit(value)))
    df = df if on is None else df.where(F.col(date_col) == on)
    df = df if period is None else df.where(F.col("period") == period)
    df = df if not filing_types else df.where(F.col("filing_type").isin(filing_types))
    df = df if name is None else df.where(F.col("full_name") == name)
    return latest_n(df, ticker_col, [F.desc(date_col)], limit) if limit else df


def latest_n(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The first rows of each key in an order (P04, T08); Spark drops the rest before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def repaired_end(start: Column, end: Column) -> Column:
    """A window of no length gets a day."""
    return F.when(start == end, F.date_add(end, 1)).otherwise(end)


def is_closed(end: Column, today: Column | None = None) -> Column:
    """Whether a date window lies in the past, so that its rows cannot change."""
    return end < (F.current_date() if today is None else today)


def drop_fields(df: DataFrame, names: tuple[str, ...] = REDUNDANT) -> DataFrame:
    """Fields of these names taken out at any depth."""
    kept = [c for c in df.columns if c not in names]
    return df.select(*(_without(F.col(c), df.schema[c].dataType, names).alias(c) for c in kept))


def _without(col: Column, kind: T.DataType, names: tuple[str, ...]) -> Column:
    if isinstance(kind, T.StructType) and _holds(kind, names):
        fields = [_without(col[f.name], f.dataType, names).alias(f.name) for f in kind.fields if f.name not in names]
        return F.when(col.isNotNull(), F.struct(*fields)) if fields else F.lit(None)
    if isinstance(kind, T.ArrayType) and _holds(kind, names):
        return F.transform(col, lambda x: _without(x, kind.elementType, names))
    if isinstance(kind, T.MapType) and _holds(kind.valueType, names):
        return F.transform_values(col, lambda _, v: _without(v, kind.valueType, names))
    return col


def _holds(kind: T.DataType, names: tuple[str, ...]) -> bool:
    if isinstance(kind, T.StructType):
        return any(f.name in names or _holds(f.dataType, names) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _holds(kind.elementType, names)
    return isinstance(kind, T.MapType) and _holds(kind.valueType, names)


def last_results(df: DataFrame) -> DataFrame:
    """The last sub-request (tool, ticker, ord, data, error) of each tool_ticker: key, ord, data, error; of one ord, the greatest by data and error. Rows stay distributed."""
    key = F.when(F.col("ticker").isNotNull(), F.concat_ws("_", "tool", "ticker")).otherwise(F.col("tool"))
    w = Window.partitionBy("key").orderBy(F.desc("ord"), F.desc("data"), F.desc("error"))
    return df.select(key.alias("key"), "ord", "data", "error").withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def combine_results(df: DataFrame) -> DataFrame:
    """Results of sub-requests (tool, ticker, ord, data, error, urls) as one row (F07): data by tool_ticker, where the last of equal keys wins, errors apart, URLs flattened.

    A key's data and a URL are one row each before they are gathered; errors are all part of the result.
    """
    data = last_results(df).where("error is null").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "data")))).alias("data"))
    bad = df.where("error is not null").agg(F.array_sort(F.collect_list(F.struct("ord", "tool", "ticker", "error"))).alias("_errors"))
    each = df.select("ord", "urls", F.posexplode("urls").alias("pos", "url"))
    first = each.groupBy("url").agg(F.min(F.struct("ord", "urls", "pos")).alias("at"))
    urls = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "url"))), lambda x: x["url"]).alias("source_urls"))
    return data.crossJoin(bad).crossJoin(urls)


def read_filings(filings: DataFrame, items: DataFrame, most: int = 3) -> DataFrame:
    """The newest filings of each ticker with their items."""
    return latest_n(filings, "ticker", [F.desc("filing_date"), "accession_number"], most).join(items, "accession_number")


def cash_flow_history(df: DataFrame, key: str, year: str, fcf: str) -> DataFrame:
    """First and last cash flow of each key, and compound growth between them."""
    out = df.groupBy(key).agg(F.min_by(fcf, year).alias("first"), F.max_by(fcf, year).alias("last"), (F.max(year) - F.min(year)).cast("double").alias("years"))
    return out.withColumn("cagr", X.cagr(F.col("first"), F.col("last"), F.col("years")))


def value(df: DataFrame, haircut: float = 0.15) -> DataFrame:
    """Enterprise value, its terminal part and the value of a share (F09): needs fcf, cagr, wacc, debt, cash, shares."""
    growth = X.growth_rate(F.coalesce("cagr", F.lit(0.0)), haircut)
    ev, terminal = X.dcf(F.col("fcf"), growth, F.col("wacc"))
    out = df.withColumns({"growth": growth, "ev": ev, "terminal": terminal})
    return out.withColumn("per_share", X.equity_per_share(F.col("ev"), F.col("debt"), F.col("cash"), F.col("shares")))


def sensitivity(df: DataFrame) -> DataFrame:
    """Nine values of a share: WACC a point up and down by terminal growth of 2, 2.5 and 3 percent."""
    grid = F.array(*(F.struct(F.lit(dw).alias("dw"), F.lit(g).alias("g")) for dw in (-0.01, 0.0, 0.01) for g in (0.02, 0.025, 0.03)))
    out = df.withColumn("_c", F.explode(grid)).withColumns({"wacc_used": F.col("wacc") + F.col("_c.dw"), "terminal_growth": F.col("_c.g")})
    ev, _ = X.dcf(F.col("fcf"), F.col("growth"), F.col("wacc_used"), F.col("terminal_growth"))
    return out.withColumn("value", X.equity_per_share(ev, F.col("debt"), F.col("cash"), F.col("shares"))).drop("_c")
