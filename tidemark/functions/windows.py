"""Time-series and cross-section window expressions over a panel.

All frames count rows. ``series()`` orders a key's rows in time; reuse one window object per key so
that Catalyst plans a single exchange and sort for all expressions on it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

EPSILON = 1e-8


def series(key: str = "ticker", order: str = "date") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def lagged(c: Column, k: int, w: WindowSpec) -> Column:
    """W1."""
    return F.lag(c, k).over(w)


def lagged_return(c: Column, p: int, w: WindowSpec) -> Column:
    """Return over p rows that is known one row earlier."""
    return F.try_divide(F.lag(c, 1).over(w), F.lag(c, p + 1).over(w)) - 1


def pct_change(c: Column, w: WindowSpec) -> Column:
    """W9, W12."""
    return F.try_divide(c, F.lag(c, 1).over(w)) - 1


def before(how: Callable[[Column], Column], c: Column, n: int, w: WindowSpec) -> Column:
    """Aggregate of the n rows before the current one, null unless all n hold a value."""
    frame = w.rowsBetween(-n, -1)
    return F.when(F.count(c).over(frame) == n, how(c).over(frame))


def trailing(how: Callable[[Column], Column], c: Column, n: int, w: WindowSpec) -> Column:
    """As ``before``, with the current row as the last of the n."""
    frame = w.rowsBetween(1 - n, 0)
    return F.when(F.count(c).over(frame) == n, how(c).over(frame))


def true_range(high: Column, low: Column, previous_close: Column) -> Column:
    """W6; nulls are skipped."""
    return F.greatest(high - low, F.abs(high - previous_close), F.abs(low - previous_close))


def average_rank(c: Column, by: list[str]) -> Column:
    """Average-tie rank from 1, over non-null values: the mean of the first and the last place of equal
    values, which one sort gives."""
    order = Window.partitionBy(*by).orderBy(c.asc_nulls_last())
    last = F.count(F.lit(1)).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return F.when(c.isNotNull(), (F.rank().over(order) + last) / 2)


def rank_pct(c: Column, by: str | list[str] = "date") -> Column:
    """Average-tie rank divided by the number of non-null values; null for null."""
    keys = [by] if isinstance(by, str) else by
    whole = Window.partitionBy(*keys).orderBy(c.asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return average_rank(c, keys) / F.count(c).over(whole)


def first_rank(score: Column, tiebreak: str, by: str = "date") -> Column:
    """Descending rank without ties; equal scores follow the tiebreak column."""
    return F.row_number().over(Window.partitionBy(by).orderBy(score.desc_nulls_last(), F.col(tiebreak)))


def fill_forward(c: Column, w: WindowSpec) -> Column:
    """W13."""
    return F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def min_max_score(c: Column, w: WindowSpec, digits: int = 1) -> Column:
    """0 to 100 within the window's partition, 50 where it is constant."""
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.when(high == low, F.lit(50.0)).otherwise(F.bround((c - low) / F.nullif(high - low, F.lit(0.0)) * 100, digits))


#: Weight below which what lies further back is lost to the rounding of doubles.
_LOST = 1e-18


def ewm_columns(df: DataFrame, series: dict[str, tuple[Column, float]], observed: Column, key: str = "ticker", order: str = "date") -> DataFrame:
    """Exponentially weighted means in recursive form, as columns; ``series`` has their values and alphas,
    which are all there or all null, as ``observed`` says.

    An observed row maps the mean before it to a * mean + b. Maps compose, so a scan by doubling, with lags of
    1, 2, 4, ... observed rows, gives every row the map of all rows that still count: it ends when the weight
    of what lies further back is below ``_LOST``. All steps share one exchange and one sort of the rows, whose number
    per key does not matter. Leading nulls give null; inside, a null repeats the mean and lets its weight decay.
    """
    all_rows, seen = Window.partitionBy(key).orderBy(order), Window.partitionBy(key, "_seen").orderBy(order)
    df = df.withColumns({"_n": F.row_number().over(all_rows), "_seen": observed})
    df = df.withColumn("_gap", F.col("_n") - F.lag("_n").over(seen))
    alphas = sorted({alpha for _, alpha in series.values()})
    name = {alpha: f"_a{i}" for i, alpha in enumerate(alphas)}
    weight = {alpha: F.pow(F.lit(1 - alpha), F.col("_gap")) for alpha in alphas}
    first = F.col("_gap").isNull()
    df = df.withColumns(
        {name[alpha]: F.when(first, 0.0).otherwise(w / (w + alpha)) for alpha, w in weight.items()}
        | {f"_b_{out}": F.when(first, x.cast("double")).otherwise(alpha * x / (weight[alpha] + alpha)) for out, (x, alpha) in series.items()}
    )
    step = 1
    while any((1 - alpha) ** (step - 1) > _LOST for alpha in alphas):
        back = lambda c: F.lag(c, step).over(seen)  # noqa: B023, E731
        # a row without one so far back has its whole past already, and its map a factor of 0
        df = df.withColumns({f"_b_{out}": F.col(f"_b_{out}") + F.when(F.col(name[alpha]) == 0, 0.0).otherwise(F.col(name[alpha]) * back(f"_b_{out}")) for out, (_, alpha) in series.items()} | {a: F.when(F.col(a) == 0, 0.0).otherwise(F.col(a) * back(a)) for a in name.values()})
        step *= 2
    last = lambda out: F.last(F.when(F.col("_seen"), F.col(f"_b_{out}")), ignorenulls=True).over(all_rows.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumns({out: last(out) for out in series})
    return df.drop("_n", "_seen", "_gap", *name.values(), *[f"_b_{out}" for out in series])
