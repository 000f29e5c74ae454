"""Number formats, statements and valuation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"


def _number(x: Column) -> Column:
    d = x.cast("double")
    return F.when(F.isnan(d), F.lit(None)).otherwise(d)


def fixed(x: Column, digits: int) -> Column:
    """A double with that many decimals, rounded half up from its decimal text."""
    return F.format_string(f"%.{digits}f", x.cast("double"))


def humanise(x: Column) -> Column:
    """1.2T, 3.4B, 5.6M, 7.8K, 9; a dash for null and NaN."""
    d = _number(x)
    a, sign = F.abs(d), F.when(d < 0, "-").otherwise("")
    out = F.concat(sign, fixed(a, 0))
    for limit, unit in ((1e3, "K"), (1e6, "M"), (1e9, "B"), (1e12, "T")):
        out = F.when(a >= limit, F.concat(sign, fixed(a / limit, 1), F.lit(unit))).otherwise(out)
    return F.when(d.isNull(), DASH).otherwise(out)


def humanise_scale(x: Column) -> tuple[Column, Column]:
    """The number and the unit that humanise() shows, as values."""
    d = _number(x)
    a = F.abs(d)
    scale, unit = F.lit(1.0), F.lit("")
    for limit, name in ((1e3, "K"), (1e6, "M"), (1e9, "B"), (1e12, "T")):
        scale, unit = F.when(a >= limit, F.lit(limit)).otherwise(scale), F.when(a >= limit, F.lit(name)).otherwise(unit)
    return d / scale, unit


def percent(x: Column) -> Column:
    return F.when(_number(x).isNull(), DASH).otherwise(F.concat(fixed(_number(x) * 100, 1), F.lit("%")))


def price(x: Column) -> Column:
    return F.when(_number(x).isNull(), DASH).otherwise(F.concat(F.lit("$"), fixed(_number(x), 2)))


def period_label(day: Column, fiscal: Column | None = None) -> Column:
    """The fiscal label if there is one, else Qn yy of an ISO date, else the text itself."""
    text = day.cast("string")
    quarter = F.concat(F.lit("Q"), F.ceil(F.substring(text, 6, 2).try_cast("int") / 3).cast("string"), F.lit(" "), F.substring(text, 3, 2))
    out = F.when(text.isNull() | (text == ""), DASH).when(F.length(text) >= 10, quarter).otherwise(text)
    return out if fiscal is None else F.when(text.isNull() | (text == ""), DASH).when(fiscal.isNotNull() & (fiscal != ""), fiscal).otherwise(out)


def free_cash_flow(operating: Column, capex: Column, *more: tuple[Column, Column]) -> Column:
    """Operating cash flow less the size of capital expenditure; missing is 0, further pairs are fallbacks."""
    ops = F.coalesce(operating, *(o for o, _ in more), F.lit(0.0))
    cap = F.coalesce(capex, *(c for _, c in more), F.lit(0.0))
    return ops - F.abs(cap)


#: WACC range of each sector, in percent.
SECTOR_WACC = {
    "communication services": (8.0, 10.0),
    "consumer discretionary": (8.0, 10.0),
    "consumer staples": (7.0, 8.0),
    "energy": (9.0, 11.0),
    "financials": (8.0, 10.0),
    "health care": (8.0, 10.0),
    "industrials": (8.0, 9.0),
    "information technology": (8.0, 12.0),
    "materials": (8.0, 10.0),
    "real estate": (7.0, 9.0),
    "utilities": (6.0, 7.0),
}
GROWTH_CAP, TERMINAL_GROWTH = 0.15, 0.025
#: What is left of the growth rate in years 1 to 5.
GROWTH_DECAY = (1.0, 0.95, 0.90, 0.85, 0.80)


def sector_wacc(sector: Column, *adjustments: Column) -> Column:
    """Middle of the sector's range with additive adjustments, as a share (F10). An unknown sector has 9 percent."""
    base = F.lit(9.0)
    for name, (low, high) in SECTOR_WACC.items():
        base = F.when(F.lower(F.trim(sector)) == name, F.lit((low + high) / 2)).otherwise(base)
    for a in adjustments:
        base = base + F.coalesce(a, F.lit(0.0))
    return base / 100


def cagr(first: Column, last: Column, years: Column) -> Column:
    """Compound growth a year; null unless both ends are positive."""
    return F.when((first > 0) & (last > 0) & (years > 0), F.pow(last / first, F.lit(1.0) / years) - 1)


def growth_rate(history: Column, haircut: float = 0.15, cap: float = GROWTH_CAP) -> Column:
    """Growth to project with: the CAGR less a haircut, capped."""
    return F.least(history * (1 - haircut), F.lit(cap))


def dcf(fcf: Column, growth: Column, wacc: Column, terminal_growth: Column | float = TERMINAL_GROWTH) -> tuple[Column, Column]:
    """Enterprise value and the present value of its terminal part."""
    g = F.lit(terminal_growth) if isinstance(terminal_growth, (int, float)) else terminal_growth
    flow, value, product = fcf, F.lit(0.0), F.lit(1.0)
    for year, left in enumerate(GROWTH_DECAY, 1):
        product = product * (1 + growth * left)
        flow = fcf * product
        value = value + flow / F.pow(1 + wacc, F.lit(float(year)))
    terminal = flow * (1 + g) / (wacc - g) / F.pow(1 + wacc, F.lit(float(len(GROWTH_DECAY))))
    return value + terminal, terminal


def equity_per_share(ev: Column, debt: Column, cash: Column, shares: Column) -> Column:
    return F.try_divide(ev - F.coalesce(debt, F.lit(0.0)) + F.coalesce(cash, F.lit(0.0)), shares)


def dcf_checks(ev: Column, reported_ev: Column, terminal: Column, fcf_per_share: Column, value_per_share: Column) -> dict[str, Column]:
    """Flags of a valuation that needs a second look."""
    share = F.try_divide(terminal, ev)
    return {
        "ev_off": F.abs(ev - reported_ev) > 0.3 * F.abs(reported_ev),
        "terminal_high": share > 0.9,
        "terminal_low": share < 0.4,
        "terminal_usual": share.between(0.5, 0.8),
        "multiple_usual": value_per_share.between(fcf_per_share * 15, fcf_per_share * 25),
    }


def table(title: str, header: list[str], rules: list[str], cells: list[Column], empty: str, order: list[str], limit: int | None = None, more: bool = False) -> Callable:
    """A renderer: (df, keys) to a row per group with a markdown table of its rows in order."""

    def render(df, keys: list[str]):
        from pyspark.sql import Window

        line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
        w = Window.partitionBy(*keys).orderBy(*order)
        ranked = df.withColumns({"_rn": F.row_number().over(w), "_line": line})
        shown = F.when(F.col("_rn") <= limit, F.struct("_rn", "_line")) if limit else F.struct("_rn", "_line")
        body = F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["_line"]), "\n")
        heading = F.concat(*([F.upper(F.first(keys[0])), F.lit(" ")] if "{key}" in title else []), F.lit(title.replace("{key} ", "")))
        head = F.concat(heading, F.lit("\n\n| " + " | ".join(header) + " |\n|" + "|".join(rules) + "|\n"))
        tail = F.when(F.count("*") > limit, F.concat(F.lit("\n... and "), (F.count("*") - limit).cast("string"), F.lit(" more rows"))).otherwise("") if limit and more else F.lit("")
        return ranked.groupBy(*keys).agg(F.concat(head, body, tail).alias("text"))

    render.empty = empty
    return render


def _c(*names: str) -> Column:
    return F.coalesce(*map(F.col, names))


def _or_dash(*names: str) -> Column:
    return F.coalesce(*(F.col(n).cast("string") for n in names), F.lit(DASH))


def _period(fiscal: bool = True) -> Column:
    return period_label(F.col("report_period"), F.col("fiscal_period") if fiscal else None)


def formatters() -> dict[str, Callable]:
    """Renderers by the name of the data set they show (F05, F06). Built when asked for, since columns need a session."""
    dash = "--------"
    latest = [F.desc("report_period")]
    out = {
        "income_statements": table("{key} Income Statement", ["Period", "Revenue", "Op Inc", "Net Inc", "R&D", "EPS"], ["--------", "---------", "--------", "---------", "-----", "-----"],
                                   [_period(), *(humanise(F.col(c)) for c in ("revenue", "operating_income", "net_income", "research_and_development")), price(F.col("earnings_per_share"))], "No income statement data available.", latest),
        "balance_sheets": table("{key} Balance Sheet", ["Period", "Total Assets", "Total Liab", "Equity", "Cash"], ["--------", "-------------", "------------", "--------", "------"],
                                [_period(), *(humanise(F.col(c)) for c in ("total_assets", "total_liabilities", "shareholders_equity", "cash_and_equivalents"))], "No balance sheet data available.", latest),
        "cash_flow_statements": table("{key} Cash Flow", ["Period", "Op CF", "CapEx", "FCF"], ["--------", "-------", "-------", "-----"],
                                      [_period(), humanise(F.coalesce(F.col("operating_cash_flow"), F.lit(0.0))), humanise(F.abs(F.coalesce(F.col("capital_expenditure"), F.lit(0.0)))), humanise(free_cash_flow(F.col("operating_cash_flow"), F.col("capital_expenditure")))], "No cash flow data available.", latest),
        "historical_key_ratios": table("{key} Historical Metrics", ["Period", "P/E", "EPS", "Rev Growth", "Op Margin", "ROE"], ["--------", "-----", "-----", "------------", "-----------", "-----"],
                                       [_period(False), _or_dash("pe_ratio"), price(F.col("eps")), *(percent(F.col(c)) for c in ("revenue_growth_rate", "operating_margin", "roe"))], "No historical metrics available.", latest),
        "stock_prices": table("Price History", ["Date", "Open", "Close", "Volume"], ["------", "------", "-------", "--------"],
                              [_or_dash("date"), price(F.col("open")), price(F.col("close")), humanise(F.col("volume"))], "No price history available.", ["date"], limit=20, more=True),
        "insider_trades": table("Insider Trades", ["Name", "Title", "Type", "Shares", "Price", "Date"], ["------", "-------", "------", "--------", "-------", "------"],
                                [_or_dash("full_name"), _or_dash("officer_title"), _or_dash("transaction_type"), humanise(F.col("shares")), price(F.col("price_per_share")), F.substring(_c("filing_date", "transaction_date").cast("string"), 1, 10)], "No insider trades found.", [F.desc("filing_date")], limit=15),
        "analyst_estimates": table("Analyst Estimates", ["Period", "Est. Revenue", "Est. EPS", "# Analysts"], [dash, "-------------", "----------", "------------"],
                                   [_period(False), humanise(F.col("estimated_revenue_avg")), price(F.col("estimated_eps_avg")), _or_dash("number_of_analysts")], "No analyst estimates available.", latest),
    }
    out["crypto_prices"] = out["stock_prices"]
    out["news"] = _news
    out["stock_price"] = out["crypto_price"] = _quote
    out["key_ratios"] = _ratios
    out["earnings"] = _earnings
    out["segments"] = _segments
    return out


def _news(df, keys: list[str]):
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(F.desc("date"), "title")
    line = F.concat(
        F.row_number().over(w).cast("string"), F.lit(". "), F.col("title"),
        F.when(F.coalesce("source", F.lit("")) != "", F.concat(F.lit(" — "), F.col("source"))).otherwise(""),
        F.when(F.col("date").isNotNull(), F.concat(F.lit(", "), F.substring(F.col("date").cast("string"), 1, 10))).otherwise(""),
    )
    rows = df.withColumns({"_rn": F.row_number().over(w), "_line": line})
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "_line"))), lambda x: x["_line"]), "\n").alias("text"))


def _quote(df, keys: list[str]):
    return df.select(*keys, F.concat(F.upper(keys[0]), F.lit(": "), price(F.col("close")), F.lit(" (H: "), price(F.col("high")), F.lit(" L: "), price(F.col("low")), F.lit(") Vol: "), humanise(F.col("volume"))).alias("text"))


def _ratios(df, keys: list[str]):
    lines = [
        F.concat(F.upper(keys[0]), F.lit(" Key Metrics")),
        F.concat(F.lit("- Market Cap: "), humanise(F.col("market_cap"))),
        F.concat(F.lit("- P/E: "), _or_dash("pe_ratio"), F.lit(" | EPS: "), price(F.col("eps"))),
        F.concat(F.lit("- Revenue Growth: "), percent(F.col("revenue_growth_rate")), F.lit(" | Earnings Growth: "), percent(F.col("earnings_growth_rate"))),
        F.when(F.coalesce("gross_margin", "operating_margin", "net_margin").isNotNull(), F.concat(F.lit("- Gross Margin: "), percent(F.col("gross_margin")), F.lit(" | Op Margin: "), percent(F.col("operating_margin")), F.lit(" | Net Margin: "), percent(F.col("net_margin")))),
        F.when(F.col("roe").isNotNull(), F.concat(F.lit("- ROE: "), percent(F.col("roe")), F.lit(" | ROIC: "), percent(F.col("roic")))),
        F.when(F.col("dividend_yield").isNotNull(), F.concat(F.lit("- Dividend Yield: "), percent(F.col("dividend_yield")))),
        F.when(F.col("debt_to_equity").isNotNull(), F.concat(F.lit("- D/E: "), fixed(F.col("debt_to_equity"), 2))),
    ]
    return df.select(*keys, F.concat_ws("\n", *lines).alias("text"))


def _earnings(df, keys: list[str]):
    shown = (("Revenue: ", "revenue", humanise), ("EPS: ", "eps", price), ("Revenue Surprise: ", "revenue_surprise", percent), ("EPS Surprise: ", "eps_surprise", percent))
    lines = [F.when(F.col(c).isNotNull(), F.concat(F.lit(label), fmt(F.col(c)))) for label, c, fmt in shown if c in df.columns]
    return df.select(*keys, F.concat_ws("\n", *lines).alias("text"))


def _segments(df, keys: list[str]):
    items = F.array_join(F.transform("segments", lambda s: F.concat(F.lit("- "), F.coalesce(s["label"], F.lit("Unknown")), F.lit(": "), humanise(s["value"]))), "\n")
    block = F.struct(F.col("report_period").alias("p"), F.concat(F.lit("**"), period_label(F.col("report_period")), F.lit("**\n"), items).alias("t"))
    return df.groupBy(*keys).agg(F.concat(F.upper(F.first(keys[0])), F.lit(" Revenue Segments\n\n"), F.array_join(F.transform(F.sort_array(F.collect_list(block), asc=False), lambda x: x["t"]), "\n")).alias("text"))
