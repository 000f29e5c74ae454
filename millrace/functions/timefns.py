"""Times, schedules and back-off."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Milliseconds to wait after the first, second, ... error of a job.
ERROR_LADDER = (30_000, 60_000, 300_000, 900_000, 3_600_000)


def since(text: Column, now: Column) -> Column:
    """Start time of a relative span like 30m, 6h or 7d, or of an ISO time; null for anything else."""
    n = F.regexp_extract(text, r"^(\d+)([mhd])$", 1)
    unit = F.regexp_extract(text, r"^(\d+)([mhd])$", 2)
    seconds = F.when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400)
    relative = F.timestamp_micros(F.unix_micros(now.cast("timestamp")) - F.expr("1000000L") * F.nullif(n, F.lit("")).try_cast("long") * seconds)
    return F.when(unit != "", relative).otherwise(F.try_to_timestamp(text))


def day_file(day: Column) -> Column:
    """Name of a day's memory file."""
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(".md"))


def next_every(now_ms: Column, every_ms: Column, anchor_ms: Column) -> Column:
    """The next multiple of a period after its anchor; a hit moves on to the next one; before the anchor, the anchor (X03, ST14)."""
    steps = F.floor((now_ms - anchor_ms) / every_ms) + 1
    return F.when(now_ms < anchor_ms, anchor_ms).otherwise(anchor_ms + steps * every_ms).cast("long")


def next_at(now_ms: Column, at_ms: Column) -> Column:
    """The time itself while it lies ahead, else null."""
    return F.when(at_ms > now_ms, at_ms)


def _field(text: str, low: int, high: int, names: dict[str, int] | None = None) -> set[int]:
    out: set[int] = set()
    for part in text.lower().split(","):
        span, _, step = part.partition("/")
        for k, v in (names or {}).items():
            span = span.replace(k, str(v))
        if span in ("*", "?"):
            a, b = low, high
        elif "-" in span:
            a, b = map(int, span.split("-"))
        else:
            a = int(span)
            b = high if step else a
        out.update(range(a, b + 1, int(step or 1)))
    return out


def cron_next(expr: str, now_ms: int, zone: str = "UTC", gap_ms: int = 2_000) -> int | None:
    """First match of a five-field cron expression at least gap_ms after now, in epoch milliseconds; None if there is none in five years."""
    days = {d: i for i, d in enumerate(("sun", "mon", "tue", "wed", "thu", "fri", "sat"))}
    months = {m: i for i, m in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"), 1)}
    f = expr.split()
    if len(f) != 5:
        raise ValueError(f"not five fields: {expr!r}")
    minute, hour, dom, month = _field(f[0], 0, 59), _field(f[1], 0, 23), _field(f[2], 1, 31), _field(f[3], 1, 12, months)
    dow = {d % 7 for d in _field(f[4], 0, 7, days)}
    tz = ZoneInfo(zone)
    start = dt.datetime.fromtimestamp((now_ms + gap_ms) / 1000, tz)
    day = start.date()
    for _ in range(5 * 366):
        by_dom, by_dow = day.day in dom, day.isoweekday() % 7 in dow
        fits = (by_dom or by_dow) if f[2] != "*" and f[4] != "*" else (by_dom and by_dow)
        if day.month in month and fits:
            for h in sorted(hour):
                for m in sorted(minute):
                    t = dt.datetime(day.year, day.month, day.day, h, m, tzinfo=tz)
                    if t.timestamp() * 1000 >= now_ms + gap_ms:
                        return int(t.timestamp() * 1000)
        day += dt.timedelta(days=1)
    return None


def next_cron(expr: Column, now_ms: Column, zone: Column) -> Column:
    """cron_next as a column; no built-in knows cron (X03). A bad expression gives null."""

    @F.pandas_udf("long")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def one(e: str | None, n: int, z: str | None) -> int | None:
            try:
                return cron_next(e, n, z or "UTC") if e else None
            except (ValueError, KeyError):
                return None

        for e, n, z in batches:
            yield pd.Series([one(*x) for x in zip(e, n, z, strict=True)], dtype="Int64")

    return run(expr, now_ms, zone)


def error_backoff_ms(errors: Column) -> Column:
    """Wait after that many errors in a row; the last rung holds on."""
    rungs = F.array(*map(F.lit, ERROR_LADDER))
    return F.when(errors > 0, F.element_at(rungs, F.least(errors, F.lit(len(ERROR_LADDER))).cast("int"))).otherwise(0)


def reconnect_delay_ms(attempt: Column, initial: float = 2_000, maximum: float = 30_000, factor: float = 1.8, jitter: Column | float = 0.0) -> Column:
    """Exponential back-off with a share of jitter, capped."""
    base = F.lit(initial) * F.pow(F.lit(factor), F.greatest(attempt - 1, F.lit(0)))
    jitter = F.lit(jitter) if isinstance(jitter, (int, float)) else jitter
    return F.least(F.lit(float(maximum)), F.round(base + base * jitter))


def backoff_policy(initial: float, maximum: float, factor: float, jitter: float, attempts: int) -> dict:
    """A policy with its values clamped."""
    initial = max(250, initial)
    return {"initial": initial, "maximum": max(initial, maximum), "factor": min(10, max(1.1, factor)), "jitter": min(1, max(0, jitter)), "attempts": max(0, int(attempts))}


def active_hours(ts: Column, zone: str = "America/New_York", start: str = "09:30", end: str = "16:00", days: tuple[int, ...] = (1, 2, 3, 4, 5)) -> Column:
    """Whether a UTC time lies on one of the weekdays (0: Sunday) and between two HH:MM texts, ends included; no wrap past midnight."""
    local = F.from_utc_timestamp(ts.cast("timestamp"), zone)
    clock = F.date_format(local, "HH:mm")
    return (F.dayofweek(local) - 1).isin(*days) & (clock >= start) & (clock <= end)


def timer_delay_ms(earliest: Column, now_ms: Column, most: int = 60_000) -> Column:
    """Milliseconds until the earliest run, between 0 and a minute."""
    return F.least(F.lit(most), F.greatest(F.lit(0), earliest - now_ms))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), x))


def finite_or(x: Column, default: float) -> Column:
    """A finite number, or the default."""
    d = x.try_cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), F.lit(default)).otherwise(d)


def latency_label(ms: Column) -> Column:
    """12ms, 3.4s."""
    return F.when(ms.isNull(), "—").when(ms < 1000, F.concat(F.round(ms).cast("long").cast("string"), F.lit("ms"))).otherwise(F.concat(F.format_string("%.1f", ms / 1000.0), F.lit("s")))


def cost_label(usd: Column) -> Column:
    return F.when(usd.isNull(), "—").otherwise(F.concat(F.lit("$"), F.format_string("%.4f", usd.cast("double"))))
