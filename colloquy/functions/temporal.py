"""Relative dates and business days against an explicit reference timestamp."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _plus(ts, months=0, days=0, hours=0) -> Column:
    zero = F.lit(0)
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return ts + F.make_interval(zero, as_col(months), zero, as_col(days), as_col(hours), zero, zero)


def resolve_relative_date(text, ref) -> Column:
    """today, tomorrow, next week, in 3 days, EOD, ASAP … to a timestamp; NULL if unknown."""
    low = F.lower(F.trim(text))
    amount = F.regexp_extract(low, r"^in (\d+) (days?|weeks?|months?|years?)", 1).try_cast("int")
    unit = F.regexp_extract(low, r"^in (\d+) (days?|weeks?|months?|years?)", 2)
    five_pm = F.date_trunc("day", ref) + F.expr("INTERVAL 17 HOURS")
    return (
        F.when(low.isin("eod", "cob"), five_pm)
        .when(low == "asap", _plus(ref, hours=1))
        .when(low.contains("today"), ref)
        .when(low.contains("tomorrow"), _plus(ref, days=1))
        .when(low.contains("yesterday"), _plus(ref, days=-1))
        .when(low.contains("next week"), _plus(ref, days=7))
        .when(low.contains("last week"), _plus(ref, days=-7))
        .when(low.contains("this week"), ref)
        .when(low.contains("next month"), _plus(ref, months=1))
        .when(low.contains("last month"), _plus(ref, months=-1))
        .when(low.contains("this month"), ref)
        .when(low.contains("next quarter"), _plus(ref, months=3))
        .when(low.contains("next year"), _plus(ref, months=12))
        .when(unit.startswith("day"), _plus(ref, days=amount))
        .when(unit.startswith("week"), _plus(ref, days=amount * 7))
        .when(unit.startswith("month"), _plus(ref, months=amount))
        .when(unit.startswith("year"), _plus(ref, months=amount * 12))
    )


_MONTHS = "january february march april may june july august september october november december".split()
_DAYS = ["MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN"]


def parse_date(text, ref) -> Column:
    """Written dates: ISO, month-day[-year], m/d/y, weekday names (next such day), relative words."""
    low = F.lower(text)
    iso = F.regexp_extract(low, r"(\d{4}-\d{2}-\d{2})", 1).try_cast("timestamp")
    pattern = r"(" + "|".join(_MONTHS) + r")\s+(\d{1,2})(?:st|nd|rd|th)?(?:,?\s+(\d{4}))?"
    month = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.regexp_extract(low, pattern, 1))
    day = F.regexp_extract(low, pattern, 2).try_cast("int")
    year = F.coalesce(F.regexp_extract(low, pattern, 3).try_cast("int"), F.year(ref))
    written = F.try_to_timestamp(
        F.format_string("%04d-%02d-%02d", year, month.cast("int"), F.coalesce(day, F.lit(0))), F.lit("yyyy-MM-dd")
    )
    slash = r"(\d{1,2})[-/](\d{1,2})[-/](\d{2,4})"
    sy = F.regexp_extract(low, slash, 3).try_cast("int")
    slashed = F.try_to_timestamp(
        F.format_string(
            "%04d-%02d-%02d",
            F.coalesce(F.when(sy < 100, sy + 2000).otherwise(sy), F.lit(0)),
            F.coalesce(F.regexp_extract(low, slash, 1).try_cast("int"), F.lit(0)),
            F.coalesce(F.regexp_extract(low, slash, 2).try_cast("int"), F.lit(0)),
        ),
        F.lit("yyyy-MM-dd"),
    )
    weekday = F.regexp_extract(low, r"\b(monday|tuesday|wednesday|thursday|friday|saturday|sunday|mon|tue|wed|thu|fri|sat|sun)\b", 1)
    next_named = None
    for short in _DAYS:
        # the named day on or after the reference date
        hit = F.next_day(F.date_sub(F.to_date(ref), 1), short).cast("timestamp")
        cond = F.upper(F.substr(weekday, F.lit(1), F.lit(3))) == short
        next_named = F.when(cond, hit) if next_named is None else next_named.when(cond, hit)
    return F.coalesce(iso, F.when(month > 0, written), slashed, resolve_relative_date(text, ref), next_named)


def is_business_day(d) -> Column:
    return F.weekday(d) < 5


def business_day_add(d, n) -> Column:
    """The n-th weekday after d (n ≥ 1), by arithmetic instead of a day loop."""
    n = n if isinstance(n, Column) else F.lit(n)
    # weekends count as the Friday before them
    wd = F.least(F.weekday(d), F.lit(4))
    back_to_friday = F.weekday(d) - wd
    weeks = F.floor((wd + n) / 5).cast("int")
    rest = ((wd + n) % 5).cast("int")
    return F.date_add(F.date_sub(d, back_to_friday), weeks * 7 + rest - wd)
