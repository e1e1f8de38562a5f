"""Linear models retrained for every day on the dates before it (M1, M2, M7, M8, L3), in a few jobs for all days.

A day's rows enter the normal equations only through sums of products, one small matrix per day and target.
These add up over tasks first, and over the days of a window by differences of running sums, within runs
of as many days as a window has, so rounding does not grow with the history. Each day then solves one
small ridge system per target. No job runs per day and no row is read twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .learn import TARGETS


def _packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, np.float64).tobytes()


def daily_products(rows: DataFrame, features: list[str], targets: dict[str, str] = TARGETS, date: str = "feature_date") -> DataFrame:
    """(date, target, n, products): per day and target the rows that have it, and the sums of products of
    (1, features, target) with one another, row by row; null features count as 0 (M1)."""
    names, width = list(targets), len(features) + 2
    slim = rows.select(F.col(date).cast("date").alias("date"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, f in enumerate(features)], *[F.col(t).cast("double").alias(f"y{i}") for i, t in enumerate(targets.values())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
        for batch in batches:
            day = batch.column("date").cast(pa.int32()).to_numpy(zero_copy_only=False)
            x = np.column_stack([np.ones(batch.num_rows), *[batch.column(f"x{i}").to_numpy(zero_copy_only=False) for i in range(len(features))]])
            for t in range(len(names)):
                y = batch.column(f"y{t}").to_numpy(zero_copy_only=False)
                some = np.flatnonzero(~np.isnan(y))
                order = some[np.argsort(day[some], kind="stable")]
                cut = np.flatnonzero(np.r_[len(order) > 0, day[order][1:] != day[order][:-1]])
                for of in np.split(order, cut[1:]) if len(order) else ():
                    z = np.column_stack([x[of], y[of]])
                    n, held = sums.get((int(day[of[0]]), t), (0, np.zeros((width, width))))
                    sums[int(day[of[0]]), t] = n + len(of), held + z.T @ z
        keys = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()).cast(pa.date32()), pa.array([names[k[1]] for k in keys], pa.string()), pa.array([sums[k][0] for k in keys], pa.int64()), pa.array([_packed(sums[k][1]) for k in keys], pa.binary())], ["date", "target", "n", "products"])

    def total(key, table):
        added = sum(np.frombuffer(x.as_py()) for x in table.column("products"))
        return pa.table({"date": pa.array([key[0].as_py()], pa.date32()), "target": [key[1].as_py()], "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "products": pa.array([_packed(added)], pa.binary())})

    schema = "date date, target string, n long, products binary"
    return slim.where("date IS NOT NULL").mapInArrow(add, schema).groupBy("date", "target").applyInArrow(total, schema)


def rolling_models(rows: DataFrame, features: list[str], window: int = 350, ridge: float = 1.0, targets: dict[str, str] = TARGETS, date: str = "feature_date") -> DataFrame:
    """(date, target, n, coefficients) of the models of every date that has ``window`` dates before it: the
    intercept, which is not penalised, then the features' in order. A target without rows in the window has
    no model."""
    width = len(features) + 2
    days = rows.select(F.col(date).cast("date").alias("date")).where("date IS NOT NULL").distinct()
    days = days.withColumn("day", F.row_number().over(Window.orderBy("date")) - 1)  # a row a date
    sums = daily_products(rows, features, targets, date).join(days, "date")
    # a run has the days run * window .. run * window + window - 1; a day's sums go to its own run and the next one
    sent = sums.withColumn("run", F.explode(F.array(F.floor(F.col("day") / window), F.floor(F.col("day") / window) + 1)))
    every = F.explode(F.array(*[F.lit(t) for t in targets]))
    asked = days.select(F.col("date").alias("at"), F.col("day").alias("no"), F.floor(F.col("day") / window).alias("turn"), every.alias("aim"))

    def solve(key, products, wanted):
        first = (key[0].as_py() - 1) * window
        total, count = np.zeros((2 * window + 1, width, width)), np.zeros(2 * window + 1, np.int64)
        for day, n, raw in zip(products.column("day").to_pylist(), products.column("n").to_pylist(), products.column("products")):
            total[day - first + 1] = np.frombuffer(raw.as_py()).reshape(width, width)
            count[day - first + 1] = n
        total, count = np.cumsum(total, axis=0), np.cumsum(count)
        out = []
        for day, at in sorted(zip(wanted.column("no").to_pylist(), wanted.column("at").to_pylist())):
            begin, end = day - window - first, day - first
            n = int(count[end] - count[begin]) if day >= window else 0
            if n:
                z = total[end] - total[begin]
                left = z[:-1, :-1] + np.diag([0.0, *[ridge] * len(features)])
                out.append((at, key[1].as_py(), n, np.linalg.lstsq(left, z[:-1, -1], rcond=None)[0].tolist()))
        columns = list(zip(*out)) or [()] * 4
        types = (pa.date32(), pa.string(), pa.int64(), pa.list_(pa.float64()))
        return pa.table({c: pa.array(x, t) for c, x, t in zip(("date", "target", "n", "coefficients"), columns, types)})

    return sent.groupBy("run", "target").cogroup(asked.groupBy("turn", "aim")).applyInArrow(solve, "date date, target string, n long, coefficients array<double>")


def predictions(rows: DataFrame, models: DataFrame, features: list[str], targets: dict[str, str] = TARGETS, date: str = "feature_date") -> DataFrame:
    """M2, M8: rows of the dates that have models, with ranking_score, pred_gap and pred_intraday; a missing
    feature column is an error."""
    missing = [f for f in features if f not in rows.columns]
    if missing:
        raise ValueError(f"missing features: {missing}")
    wide = models.groupBy("date").agg(*[F.first(F.when(F.col("target") == t, F.col("coefficients")), ignorenulls=True).alias(f"_{t}") for t in targets]).withColumnRenamed("date", "_date")
    joined = rows.join(wide, F.col(date).cast("date") == F.col("_date"))

    def value(t: str):
        c = F.col(f"_{t}")
        return sum((c[i + 1] * F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for i, f in enumerate(features)), c[0])

    name = lambda t: "ranking_score" if t == "ranking" else f"pred_{t}"
    return joined.withColumns({name(t): value(t) for t in targets}).drop("_date", *[f"_{t}" for t in targets])
