"""Dates: parsing of mixed formats, business days, months."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"(\d{4})\D{0,3}(\d{1,2})\D{0,3}(\d{1,2})"


def iso_date(c: Column) -> Column:
    """G1: 'YYYY-MM-DD' from the first three digit groups; only month 1-12 and day 1-31 are checked."""
    part = [F.regexp_extract(c, _PARTS, i) for i in (1, 2, 3)]
    ok = F.rlike(c, F.lit(_PARTS)) & F.try_to_number(part[1], F.lit("99")).between(1, 12) & F.try_to_number(part[2], F.lit("99")).between(1, 31)
    return F.when(ok, F.concat_ws("-", part[0], F.lpad(part[1], 2, "0"), F.lpad(part[2], 2, "0")))


def to_real_date(c: Column) -> Column:
    """The date of ``iso_date`` where it exists, else null; also two-digit years and 'YYYY년 M월 D일'."""
    short = F.regexp_replace(c, r"^\s*(\d{2})\.(\d{1,2})\.(\d{1,2})\s*$", "20$1-$2-$3")
    return F.try_to_date(iso_date(short), "yyyy-MM-dd")


def ymd(c: Column) -> Column:
    """Struct (year, month, iso); empty and null where the first eight characters are no digits."""
    s = F.trim(c.cast("string"))
    ok = F.rlike(s, F.lit(r"^\d{8}"))
    return F.struct(
        F.when(ok, F.substring(s, 1, 4)).otherwise("").alias("year"),
        F.when(ok, F.substring(s, 5, 2)).otherwise("").alias("month"),
        F.when(ok, F.concat_ws("-", F.substring(s, 1, 4), F.substring(s, 5, 2), F.substring(s, 7, 2))).alias("iso"),
    )


def digits8(c: Column) -> Column:
    """G3."""
    return F.substring(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\D", ""), 1, 8)


def months_between(first: Column, last: Column) -> Column:
    """First days of all months from ``first`` to ``last``."""
    return F.sequence(F.trunc(first, "MM"), F.trunc(last, "MM"), F.expr("interval 1 month"))


def month_windows(first: Column, last: Column) -> Column:
    """Array of (begin, end) that cut [first, last] at month ends."""
    return F.transform(months_between(first, last), lambda m: F.struct(F.greatest(m, first).alias("begin"), F.least(F.last_day(m), last).alias("end")))


def previous_business_day(d: Column) -> Column:
    """The date itself if Monday to Friday, else the Friday before; no holidays."""
    return F.date_sub(d, F.when(F.dayofweek(d) == 1, 2).when(F.dayofweek(d) == 7, 1).otherwise(0))


def next_business_day(d: Column) -> Column:
    """The first Monday to Friday after the date."""
    return F.date_add(d, F.when(F.dayofweek(d) == 6, 3).when(F.dayofweek(d) == 7, 2).otherwise(1))


def target_business_day(reference: Column) -> Column:
    """Previous business day of the day before."""
    return previous_business_day(F.date_sub(reference, 1))


def seoul_target_date(interval_end: Column) -> Column:
    """The local date one day before an interval's end."""
    return F.date_sub(F.to_date(F.from_utc_timestamp(interval_end, "Asia/Seoul")), 1)


def expand_two_digit_year(c: Column) -> Column:
    """'26.6.7' or '26년 6월' with the century, where no digit stands before."""
    return F.regexp_replace(c, r"(?<!\d)(\d{2})(?=[년.]\s?\d{1,2})", "20$1")


def month_day(c: Column) -> Column:
    """struct (month, day) of the first 'M월 D일'."""
    pattern = r"(\d{1,2})\s*월\s*(\d{1,2})\s*일"
    ok = F.rlike(c, F.lit(pattern))
    return F.struct(F.when(ok, F.regexp_extract(c, pattern, 1).try_cast("int")).alias("month"), F.when(ok, F.regexp_extract(c, pattern, 2).try_cast("int")).alias("day"))
