"""Three target models, folds and rolling retraining (M1, M2, M5-M8, U7). Boosted trees come from
``pyspark.ml``; figures need not equal those of other libraries."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .merge import reject_duplicates

TARGETS = {"ranking": "target_ranking", "gap": "target_gap", "intraday": "target_intraday"}


def train(rows: DataFrame, features: list[str], iterations: int = 20, depth: int = 4, seed: int = 42) -> dict:
    """M1: one regressor per target, each without the rows that lack it; null features count as 0."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    assembler = VectorAssembler(inputCols=features, outputCol="_features")
    filled = rows.fillna(0.0, features)
    return {name: Pipeline(stages=[assembler, GBTRegressor(featuresCol="_features", labelCol=t, predictionCol=f"pred_{name}", maxIter=iterations, maxDepth=depth, seed=seed)]).fit(filled.where(F.col(t).isNotNull())) for name, t in TARGETS.items()}


def predict(models: dict, rows: DataFrame, features: list[str]) -> DataFrame:
    """M2: adds ranking_score, pred_gap and pred_intraday; a missing feature column is an error."""
    missing = [f for f in features if f not in rows.columns]
    if missing:
        raise ValueError(f"missing features: {missing}")
    out = rows.fillna(0.0, features)
    for model in models.values():
        out = model.transform(out).drop("_features")
    return out.withColumnRenamed("pred_ranking", "ranking_score")


def expanding_folds(spark: SparkSession, first: date, train_years: int, valid_years: int, test_years: int, last: date) -> DataFrame:
    """M5: training always begins at ``first``; valid and test ranges follow one another year by year."""

    def plus(d: date, years: int) -> date:
        try:
            return d.replace(year=d.year + years)
        except ValueError:
            return d.replace(year=d.year + years, day=28)

    rows, n = [], 0
    while True:
        a, b, c = (plus(first, train_years + n + y) for y in (0, valid_years, valid_years + test_years))
        if c > last:
            break
        day = lambda d: date.fromordinal(d.toordinal() - 1)
        rows.append((n + 1, first, day(a), a, day(b), b, day(c)))
        n += test_years
    return check_folds(spark.createDataFrame(rows, "fold_id int, train_start date, train_end date, valid_start date, valid_end date, test_start date, test_end date"))


def check_folds(folds: DataFrame) -> DataFrame:
    """M5: ranges are ordered and do not overlap."""
    bad = folds.where("NOT (train_start <= train_end AND train_end < valid_start AND valid_start <= valid_end AND valid_end < test_start AND test_start <= test_end)")
    if not bad.limit(1).isEmpty():
        raise ValueError("folds overlap or run backwards")
    return folds


def walk_forward(rows: DataFrame, folds: DataFrame, features: list[str], date_column: str = "feature_date", parallel: int = 4, **how) -> DataFrame:
    """Train on each fold's training range, predict its test range; all predictions in one
    frame. Folds are few and independent jobs, so some run at a time."""

    def one(f) -> DataFrame:
        d = F.col(date_column)
        models = train(rows.where(d.between(F.lit(f.train_start), F.lit(f.train_end))), features, **how)
        return predict(models, rows.where(d.between(F.lit(f.test_start), F.lit(f.test_end))), features).withColumn("fold_id", F.lit(f.fold_id))

    with ThreadPoolExecutor(parallel) as pool:
        parts = list(pool.map(one, folds.orderBy("fold_id").collect()))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return reject_duplicates(out, [date_column, "ticker", "fold_id"])


def rolling_rows(rows: DataFrame, until: str, days: int, date_column: str = "feature_date") -> DataFrame:
    """L3, M7: rows of exactly the last ``days`` dates before ``until``; fewer dates are an error."""
    picked = rows.where(F.col(date_column) < F.lit(until).cast("date")).select(date_column).distinct().orderBy(F.desc(date_column)).limit(days)
    n = picked.count()
    if n < days:
        raise ValueError(f"{n} of {days} training dates before {until}")
    return rows.join(F.broadcast(picked), date_column, "left_semi")


def daily_retrain(rows: DataFrame, days_to_predict: list[str], features: list[str], window: int = 350, date_column: str = "feature_date", **how) -> DataFrame:
    """M7, M8: for each day, models of the window before it predict that day."""
    out = None
    for day in days_to_predict:
        part = predict(train(rolling_rows(rows, day, window, date_column), features, **how), rows.where(F.col(date_column) == F.lit(day).cast("date")), features)
        out = part if out is None else out.unionByName(part)
    return out
