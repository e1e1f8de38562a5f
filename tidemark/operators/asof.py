"""As-of and interval joins, macro calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, value: str, max_age_days: int | None = None, on: str = "date", by: list[str] | None = None, positive: bool = True) -> DataFrame:
    """``left`` with the latest valid value on or before each date, and the date it is from.

    Both sides meet in one union ordered by date, so the cost is one sort per key and never the
    product of the sides; within ``by`` each key has its own series, and without it each month is a
    partition of its own. Values that are null, or not
    above 0 where ``positive``, are not observations. An observation older than ``max_age_days``
    leaves null.
    """
    if not by:
        # without keys the months share the work: what is last on or before each one's first day is carried into it
        return _as_of_by_month(left, right, value, max_age_days, on, positive)
    ok = F.col(value).isNotNull() & ((F.col(value) > 0) if positive else F.lit(True))
    seen = right.where(ok).groupBy(*by, on).agg(F.max(value).alias("_value"))
    return _filled(left, seen.withColumn("_seen", F.col(on)), right.schema[value].dataType, value, max_age_days, on, by)


def _filled(left: DataFrame, seen: DataFrame, kind, value: str, max_age_days: int | None, on: str, by: list[str]) -> DataFrame:
    """``left`` with the last of ``seen`` (by, on, _value, _seen: its true date) up to each row, per ``by``."""
    seen = seen.withColumn("_row", F.lit(None).cast("struct<" + ",".join(f"`{c}`:{t}" for c, t in left.dtypes) + ">"))
    asked = left.select(*by, on, F.lit(None).cast(kind).alias("_value"), F.lit(None).cast(left.schema[on].dataType).alias("_seen"), F.struct(*left.columns).alias("_row"))
    order = Window.partitionBy(*by).orderBy(on, F.col("_row").isNotNull(), "_seen").rowsBetween(Window.unboundedPreceding, 0)
    found = F.last(F.when(F.col("_row").isNull(), F.struct(F.col("_seen").alias("d"), F.col("_value").alias("v"))), ignorenulls=True).over(order)
    fresh = F.lit(True) if max_age_days is None else F.datediff(F.col(on), F.col("_found.d")) <= max_age_days
    both = seen.select(*by, on, "_value", "_seen", "_row").unionByName(asked).withColumn("_found", found).where("_row IS NOT NULL")
    return both.select("_row.*", F.when(fresh, F.col("_found.v")).alias(value), F.when(fresh, F.col("_found.d")).alias(f"{value}_date"))


def _as_of_by_month(left: DataFrame, right: DataFrame, value: str, max_age_days: int | None, on: str, positive: bool) -> DataFrame:
    month = "_month"
    ok = F.col(value).isNotNull() & ((F.col(value) > 0) if positive else F.lit(True))
    seen = right.where(ok).groupBy(on).agg(F.max(value).alias("_value")).withColumns({month: F.trunc(on, "MM"), "_seen": F.col(on)})
    # one row per month: its last observation, from which each month takes what earlier ones leave
    last = seen.groupBy(month).agg(F.max_by(F.struct("_value", "_seen"), on).alias("x")).unionByName(left.select(F.trunc(on, "MM").alias(month)).distinct(), allowMissingColumns=True)
    last = last.groupBy(month).agg(F.first("x", ignorenulls=True).alias("x"))
    before = F.last("x", ignorenulls=True).over(Window.orderBy(month).rowsBetween(Window.unboundedPreceding, -1))
    carried = last.withColumn("b", before).where("b IS NOT NULL").select(F.col(month).cast(left.schema[on].dataType).alias(on), "b._value", month, "b._seen")
    own = seen.select(on, "_value", month, "_seen")
    named = left.withColumn(month, F.trunc(on, "MM"))
    return _filled(named, own.unionByName(carried), right.schema[value].dataType, value, max_age_days, on, [month]).drop(month)


def assign_folds(rows: DataFrame, folds: DataFrame, date: str = "date") -> DataFrame:
    """Each row once per fold and part whose inclusive range holds its date. Folds are few
    (one per year or month); the join broadcasts them while their count is checked small."""
    parts = folds.selectExpr("fold_id", "stack(3, 'train', train_start, train_end, 'valid', valid_start, valid_end, 'test', test_start, test_end) as (part, _from, _to)")
    small = parts.limit(10_001).count() <= 10_000
    return rows.join(F.broadcast(parts) if small else parts, F.col(date).between(F.col("_from"), F.col("_to"))).drop("_from", "_to")


def outer_calendar(series: dict[str, DataFrame], start: str | None = None, end: str | None = None) -> DataFrame:
    """One row per date of any series (date, value), one column per series, trimmed to a range.
    A union and one aggregate stand for the chain of full outer joins."""
    stacked = None
    for name, df in series.items():
        part = df.select("date", F.lit(name).alias("series"), F.col("value").cast("double").alias("value"))
        stacked = part if stacked is None else stacked.unionByName(part)
    out = stacked.groupBy("date").pivot("series", list(series)).agg(F.max("value"))
    if start:
        out = out.where(F.col("date") >= F.lit(start).cast("date"))
    return out.where(F.col("date") <= F.lit(end).cast("date")) if end else out


def last_dates(rows: DataFrame, n: int, until: str, date: str = "date", strict: bool = False) -> DataFrame:
    """L2, L3: rows of the last n distinct dates up to ``until`` (before it, if ``strict``)."""
    bound = F.col(date) < F.lit(until).cast("date") if strict else F.col(date) <= F.lit(until).cast("date")
    days = rows.where(bound).select(date).distinct().orderBy(F.desc(date)).limit(n)
    return rows.join(F.broadcast(days), date, "left_semi")  # n dates at most


def neighbours(dates: DataFrame, day: str, date: str = "date") -> DataFrame:
    """One row with the dates before and after ``day`` and whether the calendar covers it."""
    d = F.lit(day).cast("date")
    return dates.agg(F.max(F.when(F.col(date) < d, F.col(date))).alias("previous"), F.min(F.when(F.col(date) > d, F.col(date))).alias("next"), F.coalesce(F.bool_or(F.col(date) == d), F.lit(False)).alias("covered"))
