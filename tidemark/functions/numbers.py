"""Numbers: parsing, money and percent formats, bands and hits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import INDUSTRY_DIVISIONS, INDUSTRY_SECTIONS


def safe_divide(x: Column, y: Column) -> Column:
    """Null where the denominator is 0 or null."""
    return F.try_divide(x, y)


def double_ratio(x: Column, y: Column) -> Column:
    """x / y as doubles divide: infinite over 0, with the signs of both, and NaN for 0 over 0."""
    return F.when(y == 0, x * F.pow(y, F.lit(-1.0))).otherwise(F.try_divide(x, y))


def double_round(x: Column, digits: int) -> Column:
    """x rounded as doubles round: scaled, then half away from zero, where ``F.round`` takes the half of the decimal
    text; what becomes 0 keeps its sign."""
    scaled = F.abs(x) * 10.0**digits
    return F.when(scaled == float("inf"), x).otherwise(F.signum(x) * F.round(scaled) / 10.0**digits)


def to_long(c: Column) -> Column:
    """Commas go, '' and '-' are null, fractions are cut off."""
    return F.replace(F.trim(c.cast("string")), F.lit(","), F.lit("")).try_cast("double").try_cast("long")


def number_or(c: Column, default: int) -> Column:
    """G11, serving form: whole numbers only, anything else is the default."""
    return F.coalesce(F.replace(F.trim(c.cast("string")), F.lit(","), F.lit("")).try_cast("long"), F.lit(default))


def won(c: Column) -> Column:
    """G12: '1조 6,169억원', '5억원', '12,345원'; negative amounts carry one sign in front."""
    n = to_long(c)
    a = F.abs(n)
    jo, eok = F.floor(a / F.lit(10**12)), F.floor((a % F.lit(10**12)) / F.lit(10**8))
    body = F.when(jo > 0, F.concat(F.format_number(jo, 0), F.lit("조 "), F.format_number(eok, 0), F.lit("억원"))).when(eok > 0, F.concat(F.format_number(eok, 0), F.lit("억원"))).otherwise(F.concat(F.format_number(a, 0), F.lit("원")))
    return F.when(n.isNotNull(), F.concat(F.when(n < 0, F.lit("-")).otherwise(F.lit("")), body))


def won_short(c: Column) -> Column:
    """G12, serving form: 조 from 10^12 with two digits, else 억 rounded towards minus infinity."""
    v = F.replace(F.trim(c.cast("string")), F.lit(","), F.lit("")).try_cast("double").try_cast("long")
    big = F.format_string("%.2f조원", v / F.lit(1e12))
    return F.when(v.isNull() | (v == 0), F.lit("0")).when(F.abs(v) >= 10**12, big).otherwise(F.concat(F.format_number(F.floor(v / F.lit(10**8)), 0), F.lit("억원")))


def percent_text(c: Column) -> Column:
    """G13."""
    return F.format_string("%.2f%%", c * 100)


def error_band(c: Column) -> Column:
    """Right-closed bands of an absolute error in percent."""
    return F.when(c <= 1, "<=1%").when(c <= 3, "1-3%").when(c <= 5, "3-5%").otherwise(F.when(c.isNotNull(), ">5%"))


def same_direction(expected: Column, actual: Column) -> Column:
    """Both above or both below zero; zero never hits."""
    return ((expected > 0) & (actual > 0)) | ((expected < 0) & (actual < 0))


def industry_section(code: Column) -> Column:
    """Name of the section that holds the first two digits."""
    division = F.when(F.rlike(F.trim(code), F.lit(r"^\d\d")), F.substring(F.trim(code), 1, 2).try_cast("int"))
    out = F.lit(None).cast("string")
    for low, high, _, name in reversed(INDUSTRY_SECTIONS):
        out = F.when(division.between(low, high), F.lit(name)).otherwise(out)
    return out


def industry_name(code: Column, subclasses: dict[str, str] | None = None) -> Column:
    """The most specific name known: five digits, then two, then the section."""

    def lookup(names: dict[str, str], key: Column) -> Column:
        return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), key) if names else F.lit(None).cast("string")

    c = F.trim(code)
    return F.coalesce(lookup(subclasses or {}, c), lookup(INDUSTRY_DIVISIONS, F.substring(c, 1, 2)), industry_section(c))


def business_rank_text(rank: Column, total: Column) -> Column:
    """W18: 'k / n'."""
    return F.concat_ws(" / ", rank.cast("string"), total.cast("string"))


def rank_percentile(rank: Column, total: Column) -> Column:
    """Rounded half to even, at least 1."""
    return F.greatest(F.bround(rank / total * 100, 0).cast("long"), F.lit(1))
