"""Feature library over a daily panel (section 2.19), targets, and exact-key joins.

Time-series expressions share one window per ticker. Means of a date are broadcast, and ranks are taken of the
values of one column and date, so no step needs a date's whole bars in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import EPSILON, before, ewm_columns, lagged_return, rank_pct, series, trailing, true_range

# Cross-section ranks and what they rank; the last three belong to the technical group.
RANKS = {
    "return_5d_rank_pct": "return_5d",
    "return_20d_rank_pct": "return_20d",
    "momentum_rank_pct": "momentum_20d",
    "momentum_20d_rank_pct": "momentum_20d",
    "momentum_diff_rank_pct": "momentum_diff",
    "trading_value_rank_pct": "relative_trading_value",
    "volume_change_rank_pct": "volume_change_1d",
    "volatility_rank_pct": "volatility_20d",
    "atr_rank_pct": "atr_percent",
    "bb_width_rank_pct": "bb_width",
    "breakout_rank_pct": "breakout_strength",
    "low_rebound_rank_pct": "close_to_20d_low",
    "relative_return_5d_rank_pct": "relative_return_5d_vs_market",
    "sector_relative_rank_pct": "relative_return_20d_vs_sector",
    "rsi_rank_pct": "rsi14",
    "macd_rank_pct": "macd_hist_ratio",
    "bb_position_rank_pct": "bb_position",
}
IDENTITY = ["sector", "market_type", "market_cap_group"]
MACRO = {"nasdaq_close": "nasdaq_return_1d", "sox_close": "sox_return_1d", "sp500_close": "sp500_return_1d", "usdkrw": "usdkrw_return_1d", "wti_close": "wti_return_1d", "vix_close": "vix_change_1d"}


def _with(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.withColumns(columns)


def price_features(df: DataFrame) -> DataFrame:
    w, c = series(), F.col("close")
    out = {f"return_{p}d": lagged_return(c, p, w) for p in (1, 3, 5, 20, 60)}
    out |= {f"close_ma{n}_ratio": F.try_divide(F.lag(c, 1).over(w), before(F.avg, c, n, w)) - 1 for n in (5, 20, 60)}
    return _with(df, out)


def momentum_features(df: DataFrame) -> DataFrame:
    w = series()
    df = _with(df, {"momentum_5d": F.col("return_5d"), "momentum_20d": F.col("return_20d"), "momentum_diff": F.col("return_5d") - F.col("return_20d")})
    df = df.withColumn("momentum_accel", F.col("momentum_5d") - F.lag("momentum_5d", 1).over(w))
    group = ["date", "sector"] if "sector" in df.columns else ["date"]
    day = Window.partitionBy("date")
    mean = lambda sums, counts: sums / F.nullif(counts, F.lit(0))
    sums = df.groupBy(*group).agg(*[x for n in (5, 20) for x in (F.sum(f"return_{n}d").alias(f"_sum{n}"), F.count(f"return_{n}d").alias(f"_count{n}"))])
    means = {f"_market{n}": mean(F.sum(f"_sum{n}").over(day), F.sum(f"_count{n}").over(day)) for n in (5, 20)} | {"_sector20": mean(F.col("_sum20"), F.col("_count20"))}
    means = sums.select(*[F.col(c).alias(f"_{c}") for c in group], *[x.alias(n) for n, x in means.items()])
    # a row per date and sector, so that a date's rows need not meet
    df = df.join(F.broadcast(means), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group], "left")
    out = {f"relative_return_{n}d_vs_market": F.col(f"return_{n}d") - F.col(f"_market{n}") for n in (5, 20)}
    if "sector" in df.columns:
        out["relative_return_20d_vs_sector"] = F.when(F.col("sector").isNotNull(), F.col("return_20d") - F.col("_sector20"))
    else:
        out["relative_return_20d_vs_sector"] = out["relative_return_20d_vs_market"]
    return _with(df, out).drop(*[f"_{c}" for c in group], "_market5", "_market20", "_sector20")


def volume_features(df: DataFrame) -> DataFrame:
    w, v = series(), F.col("volume").cast("double")
    df = df.withColumn("_value", F.lag("close", 1).over(w) * F.lag(v, 1).over(w))
    out = {"volume_change_1d": lagged_return(v, 1, w), "relative_trading_value": F.try_divide(F.col("_value"), trailing(F.avg, F.col("_value"), 20, w))}
    return _with(df, out).drop("_value")


def volatility_features(df: DataFrame) -> DataFrame:
    w = series()
    previous = F.lag("close", 1).over(w)
    df = _with(df, {"_change": F.try_divide(F.col("close"), previous) - 1, "_range": F.try_divide(F.col("high") - F.col("low"), F.col("close")), "_true": true_range(F.col("high"), F.col("low"), previous)})
    out = {f"volatility_{n}d": before(F.stddev_samp, F.col("_change"), n, w) for n in (5, 20)}
    out |= {"intraday_range_5d": before(F.avg, F.col("_range"), 5, w), "atr_percent": before(F.avg, F.col("_true"), 14, w) / (previous + EPSILON)}
    return _with(df, out).drop("_change", "_range", "_true")


def candlestick_features(df: DataFrame) -> DataFrame:
    w = series()
    o, h, l, c = (F.lag(x, 1).over(w) for x in ("open", "high", "low", "close"))  # noqa: E741
    return _with(
        df,
        {
            "body": (c - o) / (o + EPSILON),
            "upper_shadow": (h - F.greatest(o, c)) / (o + EPSILON),
            "lower_shadow": (F.least(o, c) - l) / (o + EPSILON),
            "body_ratio": F.abs(c - o) / (h - l + EPSILON),
            "close_position": (c - l) / (h - l + EPSILON),
        },
    )


def breakout_features(df: DataFrame) -> DataFrame:
    w = series()
    last = F.lag("close", 1).over(w)
    df = _with(df, {"high_20d": before(F.max, F.col("high"), 20, w), "low_20d": before(F.min, F.col("low"), 20, w)})
    return _with(
        df,
        {
            "close_to_20d_high": F.try_divide(last, F.col("high_20d")) - 1,
            "close_to_20d_low": F.try_divide(last, F.col("low_20d")) - 1,
            "breakout_strength": (last - F.col("low_20d")) / (F.col("high_20d") - F.col("low_20d") + EPSILON),
        },
    )


def technical_features(df: DataFrame) -> DataFrame:
    """RSI, MACD and Bollinger columns; the recursive means are scans over the rows."""
    w, last = series(), F.lag("close", 1).over(series())
    df = _with(df, {"_last": last, "_delta": last - F.lag("close", 2).over(w)})
    df = ewm_columns(df, {"gain": (F.greatest("_delta", F.lit(0.0)), 1 / 14), "loss": (F.greatest(-F.col("_delta"), F.lit(0.0)), 1 / 14)}, F.col("_delta").isNotNull())
    df = ewm_columns(df, {"fast": (F.col("_last"), 2 / 13), "slow": (F.col("_last"), 2 / 27)}, F.col("_last").isNotNull())
    df = _with(df, {"macd": F.col("fast") - F.col("slow")})
    df = ewm_columns(df, {"signal": (F.col("macd"), 2 / 10)}, F.col("macd").isNotNull())
    df = _with(df, {"rsi14": 100 - 100 / (1 + F.col("gain") / (F.col("loss") + EPSILON)), "macd_hist_ratio": (F.col("macd") - F.col("signal")) / (F.col("_last") + EPSILON)})
    middle, spread = before(F.avg, F.col("close"), 20, w), before(F.stddev_samp, F.col("close"), 20, w) * 2
    df = _with(df, {"_lower": middle - spread, "_upper": middle + spread, "_middle": middle})
    df = _with(df, {"bb_position": (F.col("_last") - F.col("_lower")) / (F.col("_upper") - F.col("_lower") + EPSILON), "bb_width": (F.col("_upper") - F.col("_lower")) / (F.col("_middle") + EPSILON)})
    out = {"rsi_change_5d": F.col("rsi14") - F.lag("rsi14", 5).over(w), "bb_position_change_5d": F.col("bb_position") - F.lag("bb_position", 5).over(w)}
    return _with(df, out).drop("_last", "_delta", "_lower", "_upper", "_middle", "gain", "loss", "macd", "signal", "fast", "slow")


def macro_features(df: DataFrame) -> DataFrame:
    """After the join, by the ticker's own dates."""
    w = series()
    return _with(df, {out: lagged_return(F.col(c), 1, w) for c, out in MACRO.items() if c in df.columns})


def rank_features(df: DataFrame) -> DataFrame:
    """The 14 ranks of the date, and those of the technical group. Each value goes as a row of its own to those
    of its column and date, and the ranks of a bar come together again, so no task sorts a date's whole bars."""
    ranks = {out: c for out, c in RANKS.items() if c in df.columns}
    values = list(dict.fromkeys(ranks.values()))
    if not values:
        return df
    id_, rest = ["date", "ticker", "_row"], [c for c in df.columns if c not in ("date", "ticker", *ranks)]
    bar = F.struct(F.lit(-1).alias("i"), F.lit(None).cast("double").alias("v"))  # stands for the bar itself
    entries = F.array(bar, *[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v")) for i, c in enumerate(values)])
    rows = df.withColumn("_row", F.row_number().over(series())).select(*id_, *rest, F.inline(F.filter(entries, lambda e: (e["i"] < 0) | e["v"].isNotNull())))
    # what is not ranked goes with the bar's own entry
    ranked = rows.select(*id_, *[F.when(F.col("i") < 0, F.col(c)).alias(c) for c in rest], "i", rank_pct(F.col("v"), ["date", "i"]).alias("r"))
    whole = ranked.repartition(*id_).groupBy(*id_).agg(*[F.first(c, ignorenulls=True).alias(c) for c in rest], *[F.max(F.when(F.col("i") == values.index(c), F.col("r"))).alias(out) for out, c in ranks.items()])
    return whole.select(*[c for c in df.columns if c not in ranks], *ranks)


def identity_features(df: DataFrame) -> DataFrame:
    return _with(df, {c: F.coalesce(F.col(c), F.lit("unknown")) for c in IDENTITY if c in df.columns})


GROUPS = {
    "price": price_features,
    "momentum": momentum_features,
    "volume": volume_features,
    "volatility": volatility_features,
    "candlestick": candlestick_features,
    "breakout": breakout_features,
    "technical": technical_features,
    "macro": macro_features,
    "cross_section": rank_features,
    "identity": identity_features,
}


def build_features(panel: DataFrame, groups: list[str] | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Feature groups in their fixed order, then without the excluded columns."""
    forbidden = [c for c in panel.columns if c.startswith("target_")]
    if forbidden:
        raise ValueError(f"features must not see targets: {forbidden}")
    for name, build in GROUPS.items():
        if groups is None or name in groups:
            panel = panel.transform(build)
    return panel.drop(*exclude)


def targets(panel: DataFrame, horizon: str = "next") -> DataFrame:
    """W14, N5: 'next' pairs a date's features with the next trading date, 'same' with its own."""
    w = series()
    if horizon == "same":
        day, o, c, base = F.col("date"), F.col("open"), F.col("close"), F.lag("close", 1).over(w)
    else:
        day, o, c, base = F.lead("date", 1).over(w), F.lead("open", 1).over(w), F.lead("close", 1).over(w), F.col("close")
    out = panel.select(F.col("date").alias("feature_date"), "ticker", day.alias("target_date"), base.alias("prev_close"), o.alias("_open"), c.alias("_close"))
    out = out.withColumns(
        {
            "prediction_horizon": F.datediff("target_date", "feature_date"),
            "target_ranking": F.try_divide(F.col("_close"), F.col("prev_close")) - 1,
            "target_gap": F.try_divide(F.col("_open"), F.col("prev_close")) - 1,
            "target_intraday": F.try_divide(F.col("_close"), F.col("_open")) - 1,
        }
    )
    return out.drop("_open", "_close").dropna(subset=["target_ranking", "target_gap", "target_intraday"])


def attach_macro(panel: DataFrame, macro: DataFrame) -> DataFrame:
    """Left join on date; the macro side must have one row per date. Its size decides the strategy."""
    twice = macro.groupBy("date").count().where("count > 1").limit(1)
    if not twice.isEmpty():
        raise ValueError("macro has several rows for a date")
    return panel.join(macro, "date", "left")


def training_rows(features: DataFrame, labels: DataFrame) -> DataFrame:
    """One-to-one inner join of features with targets; duplicates on either side are an error."""
    for side, keys in ((features, ["date", "ticker"]), (labels, ["feature_date", "ticker"])):
        if not side.groupBy(*keys).count().where("count > 1").limit(1).isEmpty():
            raise ValueError(f"duplicate {keys}")
    return features.withColumnRenamed("date", "feature_date").join(labels, ["feature_date", "ticker"])


def attach_required(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that fails when a left row finds no partner."""
    lost = left.join(right, keys, "left_anti").limit(1)
    if not lost.isEmpty():
        raise ValueError(f"rows without a partner on {keys}")
    return left.join(right, keys, "left")


def attach_previous_close(predictions: DataFrame, targets_: DataFrame) -> DataFrame:
    """Previous closes on (feature_date, ticker), many to one: several closes of a key are an error, and
    every prediction stays, once, with null where there is no close."""
    keys = ["feature_date", "ticker"]
    if not targets_.groupBy(*keys).count().where("count > 1").limit(1).isEmpty():
        raise ValueError(f"several previous closes of {keys}")
    return predictions.join(targets_.select(*keys, "prev_close"), keys, "left")


def attach_named(left: DataFrame, names: DataFrame, key: str, column: str, default: str = "UNKNOWN") -> DataFrame:
    """J5, N15."""
    return left.join(names.select(key, column).dropDuplicates([key]), key, "left").withColumn(column, F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(default)))
