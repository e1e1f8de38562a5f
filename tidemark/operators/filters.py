"""Row filters, predicates and universes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXCLUDED_TYPES = ["ETF", "ETN", "SPAC", "PREFERRED", "REIT"]
PRICES = ["open", "high", "low", "close"]


def common_stock(kind: Column) -> Column:
    """P1."""
    k = F.upper(kind)
    return (k == "COMMON") & ~k.isin(*EXCLUDED_TYPES)


def unflagged(df: DataFrame, flags: tuple[str, ...] = ("trading_halt", "management_issue")) -> DataFrame:
    """Flags that exist must be false; null drops."""
    for f in flags:
        if f in df.columns:
            df = df.where(F.col(f) == F.lit(False))
    return df


def liquid(df: DataFrame, least: float, column: str = "trading_value_ma20") -> DataFrame:
    """P3."""
    return df.where(F.col(column) >= least)


def universe(df: DataFrame, n: int, least: float = 5e9, per_date: bool = False) -> DataFrame:
    """P1-P3, then L1: the n largest by trading value, of all rows or of each date."""
    df = liquid(unflagged(df.where(common_stock(F.col("security_type")))), least)
    order = [F.desc("trading_value_ma20"), F.col("date"), F.col("ticker")]
    if not per_date:
        return df.orderBy(*order).limit(n)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy("date").orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def universe_notes(df: DataFrame) -> DataFrame:
    """One row of what a universe is made of, with the warning that a roster of today's listings
    leaves out those that have gone since (survivorship bias), unless the table says when they went."""
    dated = "delisted_at" in df.columns
    warning = F.lit(None).cast("string") if dated else F.lit("survivorship bias: only current listings")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("ticker").alias("tickers"), F.min("date").alias("first_date"), F.max("date").alias("last_date")).withColumn("warning", warning)


def sound_bar() -> Column:
    """The price rules of P4 as one nullable condition."""
    o, h, l, c = (F.col(x) for x in PRICES)  # noqa: E741
    rules = [o > 0, h > 0, l > 0, c > 0, F.col("volume") >= 0, h >= o, h >= c, h >= l, l <= o, l <= c, F.col("ticker").isNotNull() & F.col("date").isNotNull()]
    return F.coalesce(reduce(lambda a, b: a & b, rules), F.lit(False))


def mark_valid(bars: DataFrame) -> DataFrame:
    """Adds ``valid``; every copy of a repeated (date, ticker) is invalid."""
    return bars.withColumn("valid", sound_bar() & (F.count(F.lit(1)).over(Window.partitionBy("date", "ticker")) == 1))


def split_valid(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    marked = mark_valid(bars)
    return marked.where("valid").drop("valid"), marked.where("NOT valid").drop("valid")


def positive_bars(bars: DataFrame) -> DataFrame:
    """P5."""
    o, h, l, c = (F.col(x) for x in PRICES)  # noqa: E741
    return bars.where((o > 0) & (h > 0) & (l > 0) & (c > 0) & (h >= F.greatest(o, c, l)) & (l <= F.least(o, c)))


def in_dates(c: Column, start: str | None, end: str | None) -> Column:
    """Open-ended bounds; dates in either format."""
    d = F.coalesce(F.try_to_date(F.replace(c.cast("string"), F.lit("-"), F.lit("")), "yyyyMMdd"))
    day = lambda x: F.try_to_date(F.lit(x.replace("-", "")), "yyyyMMdd")
    return (F.lit(True) if start is None else d >= day(start)) & (F.lit(True) if end is None else d <= day(end))


def in_months(year: Column, month: Column, start: tuple[int, int], end: tuple[int, int]) -> Column:
    """At the grain of months; an unknown year or month passes."""
    n = year * 12 + month
    return F.coalesce(n.between(start[0] * 12 + start[1], end[0] * 12 + end[1]), F.lit(True))


def recent(year: Column, month: Column, today: Column, days: int = 30) -> Column:
    """The middle of the month is no older than ``days``; unknown passes."""
    return F.coalesce(F.make_date(year, month, F.lit(15)) >= F.date_sub(today, days), F.lit(True))


def company_scope(source: Column, corp: Column, stock: Column, corp_code: str | None, stock_code: str | None) -> Column:
    """Only filing chunks are scoped to the company."""
    hit = F.lit(False)
    if corp_code:
        hit = hit | (corp == corp_code)
    if stock_code:
        hit = hit | (stock == stock_code)
    return (source != "dart") | F.coalesce(hit, F.lit(False))


def selected(df: DataFrame, **wanted) -> DataFrame:
    """Equality on the selectors given; none given selects nothing."""
    picked = {k: v for k, v in wanted.items() if v is not None}
    return df.where(reduce(lambda a, b: a & b, [F.col(k) == v for k, v in picked.items()])) if picked else df.limit(0)


def retryable(error: Column, status: Column) -> Column:
    """Quota and transport failures."""
    return (status == "failed") & (F.like(error, F.lit("%020%")) | F.ilike(error, F.lit("%timeout%")) | F.ilike(error, F.lit("%connection%")) | F.ilike(error, F.lit("%quota%")))


def embeddable(df: DataFrame) -> DataFrame:
    """P16."""
    return df.where(F.col("embeddable") & F.col("rcept_dt").isNotNull() & ~F.col("report_type").isin("DISCLOSURE"))


def current_versions(df: DataFrame) -> DataFrame:
    """P17, V7."""
    return df.where(F.coalesce(F.col("is_latest"), F.lit(False)) & F.col("valid_to").isNull())


def without(df: DataFrame, excluded: set[str]) -> DataFrame:
    """P11."""
    return df.select(*[c for c in df.columns if c not in excluded])


def pages(df: DataFrame, keys: list[str], order: list[Column], size: int) -> DataFrame:
    """The page that each row falls on within its key, from 1."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("page_no", F.ceil(n / size).cast("int"))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> tuple[DataFrame, DataFrame]:
    """Rows of one page in order, and (total, total_pages). Only the first number * size rows are sorted out."""
    totals = df.agg(F.count(F.lit(1)).alias("total")).withColumn("total_pages", F.ceil(F.col("total") / size))
    return df.orderBy(*order).offset((number - 1) * size).limit(size), totals
