"""Aggregates, model metrics and contracts."""

from __future__ import annotations

from collections.abc import Iterator

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import average_rank
from .filters import PRICES


def daily_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted", by: str = "date") -> DataFrame:
    """A2, A4: RMSE, MAE, sign agreement (0 agrees with 0) and rank IC per date; the IC is the
    correlation of average ranks, null with fewer than two distinct values on either side."""
    both = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    ranked = both.withColumns({"_a": average_rank(F.col(actual), [by]), "_p": average_rank(F.col(predicted), [by])})
    e = F.col(predicted) - F.col(actual)
    varied = (F.min(actual) < F.max(actual)) & (F.min(predicted) < F.max(predicted))
    return ranked.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg((F.signum(actual) == F.signum(predicted)).cast("double")).alias("directional_accuracy"),
        F.when(varied, F.corr("_a", "_p")).alias("rank_ic"),
    )


def overall_metrics(df: DataFrame, actual: str = "actual", predicted: str = "predicted", by: str = "date") -> DataFrame:
    """A3: one row with pooled figures and the mean of the daily ICs, which differ."""
    pooled = daily_metrics(df.withColumn("_all", F.lit(0)), actual, predicted, "_all").select(*[F.col(c).alias(f"pooled_{c}") for c in ("n", "rmse", "mae", "directional_accuracy", "rank_ic")])
    return pooled.crossJoin(daily_metrics(df, actual, predicted, by).agg(F.avg("rank_ic").alias("mean_daily_rank_ic")))


def opinion_counts(df: DataFrame, opinion: str = "opinion", firm: str = "firm", target: str = "target_price") -> DataFrame:
    """One row."""
    o = F.col(opinion)
    counts = [F.count_if(o == x).alias(x.lower()) for x in ("BUY", "HOLD", "SELL", "NOT_RATED")]
    return df.agg(F.count(F.lit(1)).alias("total"), *counts, F.count_if(o.isNull()).alias("no_opinion"), F.countDistinct(firm).alias("firms"), F.count(target).alias("with_target"), F.try_divide(F.count(target) * 100.0, F.count(F.lit(1))).alias("target_rate"))


def value_counts(df: DataFrame, *keys: str) -> DataFrame:
    """A6, A16."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *keys)


def flow(df: DataFrame, change: Column, *keys: str) -> DataFrame:
    """Sums of positive and of other changes."""
    return df.groupBy(*keys).agg(F.coalesce(F.sum(F.when(change > 0, change)), F.lit(0)).alias("bought"), F.coalesce(F.sum(F.when(change <= 0, change)), F.lit(0)).alias("sold"))


def account_pivot(rows: DataFrame, accounts: list[tuple[str, list[str]]], keys: list[str], position: str) -> DataFrame:
    """Per report and account the first non-zero amount, else the first zero; a null current amount
    falls back to the prior term's; labels rank in their given order."""
    value = F.coalesce(F.col("thstrm_amount"), F.col("frmtrm_amount"))
    name = F.trim("account_nm")
    out = []
    for account, labels in accounts:
        rank = reduce(lambda w, i: w.when(name == labels[i], i), range(1, len(labels)), F.when(name == labels[0], 0))
        out.append(F.min_by(value, F.when(rank.isNotNull() & value.isNotNull(), F.struct(rank, value == 0, F.col(position)))).alias(account))
    return rows.groupBy(*keys).agg(*out)


def latest_per_source(df: DataFrame, columns: list[str], date: str = "date") -> DataFrame:
    """Last date with a value, and nulls, of every column in one pass."""
    return df.agg(*[F.max(F.when(F.col(c).isNotNull(), F.col(date))).alias(f"{c}_latest") for c in columns], *[F.count_if(F.col(c).isNull()).alias(f"{c}_missing") for c in columns])


def _moments(df: DataFrame, columns: list[str], means: list[float]) -> list[np.ndarray]:
    """Over rows that have both of two columns: their number, the sums of the first, of its square and of the
    product, of values less ``means``; and the rows in which the two are not alike. One matrix of each per
    task, which the driver adds up."""
    n = len(columns)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((5, n, n))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                x = np.column_stack([piece.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in range(n)])
                null = np.column_stack([piece.column(i).is_null().to_numpy(zero_copy_only=False) for i in range(n)])
                there, y = (~null).astype(np.float64), np.where(null, 0.0, x - means)
                total[:4] += there.T @ there, y.T @ there, (y * y).T @ there, y.T @ y
                same = np.where(null, np.inf, x)  # no value is infinite where another one is null, but for infinite ones
                for i in range(n):
                    total[4, i] += ((same != same[:, i : i + 1]) | (null != null[:, i : i + 1])).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    rows = df.select(*[F.col(c).cast("double") for c in columns]).mapInArrow(add, "sums binary").toLocalIterator()
    return list(sum(np.frombuffer(r.sums).reshape(5, n, n) for r in rows))


def redundant(df: DataFrame, columns: list[str], limit: float = 0.999999) -> list[str]:
    """Columns to drop, as they correlate with an earlier one at ``limit`` or above, over the rows that have
    both, or are its copy. Two passes, for means and for sums of products; only matrices, whose size the
    column list fixes, reach the driver."""
    if len(columns) < 2:
        return []
    means = [float(m or 0.0) for m in df.agg(*[F.avg(F.col(c).cast("double")) for c in columns]).first()]
    n, x, xx, xy, unlike = _moments(df, columns, means)
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = xx - x * x / n
        spread[spread <= 1e-24 * n * (1 + np.square(means))[:, None]] = np.nan  # constant but for rounding
        corr = (xy - x * x.T / n) / np.sqrt(spread * spread.T)
    dropped: list[str] = []
    for i, a in enumerate(columns):
        for j in range(i + 1, len(columns)):
            if a not in dropped and columns[j] not in dropped and (np.nan_to_num(corr[i, j]) >= limit or unlike[i, j] == 0):
                dropped.append(columns[j])
    return dropped


def quota(df: DataFrame, now: Column, seconds: int = 60) -> DataFrame:
    """Requests and failures in the last seconds, and when the oldest of them leaves."""
    inside = F.col("ts") > now - F.make_dt_interval(secs=F.lit(seconds))
    return df.agg(F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).alias("used"), F.coalesce(F.sum(F.when(inside & (F.col("status") != "ok"), F.col("n"))), F.lit(0)).alias("failed"), F.min(F.when(inside, F.col("ts"))).alias("oldest"))


def sliding_requests(df: DataFrame, key: str, ts: str, seconds: int = 60) -> DataFrame:
    """Requests of the key in the ``seconds`` up to each second."""
    per = df.groupBy(key, F.unix_seconds(F.col(ts).cast("timestamp")).alias("second")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key).orderBy("second").rangeBetween(1 - seconds, 0)
    return per.withColumn("in_window", F.sum("n").over(w))


def top_appearances(df: DataFrame, rank: str, ticker: str, best: int = 10, n: int = 20) -> DataFrame:
    """A17."""
    return df.where(F.col(rank) <= best).groupBy(ticker).agg(F.count(F.lit(1)).alias("appearances")).orderBy(F.desc("appearances"), ticker).limit(n)


def percentile_buckets(df: DataFrame, column: str, bounds: tuple[int, ...] = (1, 5, 10, 20, 50)) -> DataFrame:
    """Cumulative counts."""
    return df.agg(*[F.count_if(F.col(column) <= b).alias(f"le_{b}") for b in bounds])


def quantiles(df: DataFrame, column: str, at: tuple[float, ...] = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99), exact: bool = True) -> DataFrame:
    """A19."""
    how = F.percentile if exact else F.approx_percentile
    return df.agg(how(column, [float(x) for x in at]).alias("q")).select(*[F.get("q", F.lit(i)).alias(f"p{x * 100:g}".replace(".", "_")) for i, x in enumerate(at)])


def sentiment_counts(df: DataFrame, column: str = "sentiment") -> DataFrame:
    """A20."""
    return df.agg(*[F.count_if(F.col(column) == x).alias(x) for x in ("positive", "negative", "neutral")])


def length_profile(df: DataFrame, firm: str, length: Column, short: int = 200, thin: int = 1000) -> DataFrame:
    """A21."""
    out = df.groupBy(firm).agg(F.count(F.lit(1)).alias("n"), F.avg(length).alias("avg_len"), F.min(length).alias("min_len"), F.max(length).alias("max_len"))
    return out.withColumn("status", F.when(F.col("avg_len") < short, "BAD").when(F.col("avg_len") < thin, "WARN").otherwise("OK"))


def collected(df: DataFrame, key: str, value: str, separator: str | None = None) -> DataFrame:
    """Sorted distinct values per key, as a list or joined."""
    found = F.array_sort(F.collect_set(value))
    return df.groupBy(key).agg((found if separator is None else F.array_join(found, separator)).alias("values"))


def months(df: DataFrame, date: str) -> DataFrame:
    """A23."""
    return df.groupBy(F.trunc(F.col(date).cast("date"), "MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def best_and_worst(daily: DataFrame, value: str, tie: str, by: str = "date") -> DataFrame:
    """Days with the highest and the lowest value; the smaller ``tie`` decides."""
    return daily.agg(F.max_by(by, F.struct(F.col(value), -F.col(tie))).alias("best"), F.min_by(by, F.struct(F.col(value), F.col(tie))).alias("worst"))


def chronological_split(df: DataFrame, date: str, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """By distinct dates; the cutoff is the element at int(n * share) - 1."""
    days = df.select(date).distinct()
    n = days.count()
    cutoff = days.orderBy(date).offset(max(0, int(n * share) - 1)).limit(1).first()[0] if n else None
    return df.where(F.col(date) <= F.lit(cutoff)), df.where(F.col(date) > F.lit(cutoff))


def compare_reports(df: DataFrame, code: str, opinion: str, order: Column, most: int = 3) -> DataFrame:
    """Opinions in order per stock, for at most ``most`` stocks."""
    return df.groupBy(code).agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col(opinion).alias("x")))), lambda s: s["x"]).alias("opinions"), F.count(F.lit(1)).alias("reports")).orderBy(F.desc("reports"), code).limit(most)


def feature_metadata(df: DataFrame, date: str = "date") -> DataFrame:
    """N23."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def date_range(df: DataFrame, date: str = "date") -> DataFrame:
    """First and last date of a result."""
    return df.agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def violations(df: DataFrame, rules: dict[str, Column], keys: list[str]) -> DataFrame:
    """Q1-Q3: rows that break each rule (null breaks it), and surplus rows of repeated keys; one pass for
    the rules and one aggregate for the keys."""
    broken = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    return broken.crossJoin(df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_keys")))


def bar_rules() -> dict[str, Column]:
    """Q1."""
    o, h, l, c = (F.col(x) for x in PRICES)  # noqa: E741
    return {**{f"{x}_positive": F.col(x) > 0 for x in PRICES}, "volume_not_negative": F.col("volume") >= 0, "high_bounds": (h >= o) & (h >= c) & (h >= l), "low_bounds": (l <= o) & (l <= c)}


def macro_rules(columns: list[str]) -> dict[str, Column]:
    """Q2."""
    return {f"{c}_positive": F.col(c) > 0 for c in columns}


def check(found: DataFrame) -> None:
    """Raise if any count of ``violations`` is above 0."""
    bad = {k: v for k, v in found.first().asDict().items() if v}
    if bad:
        raise ValueError(f"contract broken: {bad}")


def source_completeness(latest: DataFrame, target: str, exact: list[str], tolerant: list[str], days: int = 5) -> DataFrame:
    """Q5, Q7: one row (complete, failures) from the last dates per source of ``latest_per_source``."""
    day = F.lit(target).cast("date")
    late = [F.when(~F.coalesce(F.col(f"{c}_latest") == day, F.lit(False)), F.lit(c)) for c in exact]
    late += [F.when(~F.coalesce(F.datediff(day, F.col(f"{c}_latest")).between(0, days), F.lit(False)), F.lit(c)) for c in tolerant]
    return latest.select(F.array_compact(F.array(*late)).alias("failures")).withColumn("complete", F.size("failures") == 0)


def download_ratio(df: DataFrame, key: str, ok: Column, least: float = 0.95) -> DataFrame:
    """Q6."""
    return df.agg(F.try_divide(F.count_distinct(F.when(ok, F.col(key))), F.count_distinct(key)).alias("ratio")).withColumn("accepted", F.coalesce(F.col("ratio") >= least, F.lit(False)))


def not_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """M15."""
    return df.agg(*[F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))).alias(c) for c in columns])


def leaks(df: DataFrame, forbidden: set[str] = frozenset({"target_ranking", "target_gap", "target_intraday"}), features: list[str] | None = None) -> DataFrame:
    """Rows whose features are not older than their target, and targets among the features."""
    return df.agg(F.count_if(F.col("feature_date") >= F.col("target_date")).alias("late_rows")).withColumn("forbidden_features", F.lit(len(forbidden & set(features or []))))
