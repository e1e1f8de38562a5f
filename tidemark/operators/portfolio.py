"""Predictions, selection, backtest and risk figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import business_rank_text, double_ratio, percent_text, rank_percentile
from ..functions.windows import first_rank, min_max_score, rank_pct

BUY_COST, SELL_COST, FEE = 1.001, 0.999, 0.0015
TRADING_DAYS = 252


def expected_return(gap: Column, intraday: Column, additive: bool = False) -> Column:
    """M3 multiplies the two moves; the daily variant M4 adds them."""
    return gap + intraday if additive else (1 + gap) * (1 + intraday) - 1


def with_prices(df: DataFrame, additive: bool = False) -> DataFrame:
    """M3, M4: predicted open and close from the previous close."""
    opened = F.col("prev_close") * (1 + F.col("pred_gap"))
    return df.withColumns({"expected_return": expected_return(F.col("pred_gap"), F.col("pred_intraday"), additive), "pred_open_price": opened, "pred_close_price": opened * (1 + F.col("pred_intraday"))})


def portfolio_score(df: DataFrame) -> DataFrame:
    """Ranks within the date."""
    return df.withColumn("expected_return_rank", rank_pct(F.col("expected_return"))).withColumn(
        "portfolio_score", 0.5 * F.col("ranking_score") + 0.3 * F.col("expected_return_rank") + 0.1 * F.col("trading_value_rank_pct") + 0.1 * F.col("momentum_rank_pct")
    )


def acceptable(df: DataFrame, min_value: float = 5e9, min_rank: float = 0.2, max_risk: float = 0.08, max_gap: float = 0.1) -> DataFrame:
    """Liquidity, risk and gap limits."""
    return df.where((F.col("trading_value_ma20") >= min_value) & (F.col("trading_value_rank_pct") >= min_rank) & (F.col("atr_percent") <= max_risk) & (F.col("volatility_20d") <= max_risk) & (F.abs("pred_gap") <= max_gap))


def select_portfolio(df: DataFrame, candidates: int = 30, size: int = 10, per_sector: int = 3, keep: Column | None = None) -> DataFrame:
    """Per date the best by ranking score, filtered, at most so many per sector, the best of
    these by expected return, equally weighted."""
    by_score = Window.partitionBy("date").orderBy(F.desc("ranking_score"), "ticker")
    by_return = lambda *keys: Window.partitionBy(*keys).orderBy(F.desc("expected_return"), "ticker")
    out = df.withColumn("_n", F.row_number().over(by_score)).where(F.col("_n") <= candidates)
    if keep is not None:
        out = out.where(keep)
    out = out.withColumn("_n", F.row_number().over(by_return("date", "sector"))).where(F.col("_n") <= per_sector)
    out = out.withColumn("_n", F.row_number().over(by_return("date"))).where(F.col("_n") <= size).drop("_n")
    return out.withColumn("weight", 1 / F.count(F.lit(1)).over(Window.partitionBy("date")))


def cap_checks(portfolio: DataFrame) -> DataFrame:
    """Whether sector and market weights stay within 30 and 70 percent."""
    by = lambda c, most: portfolio.groupBy("date", F.col(c).alias("name")).agg(F.sum("weight").alias("weight")).select("date", F.lit(c).alias("kind"), "name", "weight", (F.col("weight") <= most + 1e-9).alias("within"))
    return by("sector", 0.3).union(by("market_type", 0.7))


def exposures(portfolio: DataFrame, column: str) -> DataFrame:
    """M14."""
    return portfolio.groupBy("date", column).agg(F.sum("weight").alias("exposure"))


def trade_return(opened: Column, closed: Column) -> Column:
    """M9: bought and sold with slippage, fees on both legs; what opens at 0 gains without bound, or NaN if it
    closes at 0 too."""
    return double_ratio(closed * SELL_COST, opened * BUY_COST) - 1 - FEE * 2


def daily_returns(positions: DataFrame) -> DataFrame:
    """(date, daily_return) from weight and realised."""
    return positions.groupBy("date").agg(F.sum(F.col("weight") * F.col("realised")).alias("daily_return"))


def equity(daily: DataFrame) -> DataFrame:
    """Equity, its peak and the drawdown; one row per date, so one ordered partition suffices."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    out = daily.withColumn("equity", F.exp(F.sum(F.log1p("daily_return")).over(w)))
    out = out.withColumn("peak", F.max("equity").over(w))
    return out.withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def turnover(positions: DataFrame) -> DataFrame:
    """The share of holdings that the day before did not have."""
    held = positions.groupBy("date").agg(F.collect_set("ticker").alias("now"))
    before = F.lag("now", 1).over(Window.orderBy("date"))
    return held.withColumn("_before", before).select("date", F.when(F.col("_before").isNotNull(), 1 - F.size(F.array_intersect("now", "_before")) / F.size("now")).alias("turnover"))


def risk_figures(daily: DataFrame) -> DataFrame:
    """Annual return, volatility, Sharpe at a risk-free rate of 0, worst drawdown, win rate. Sortino,
    Calmar and profit factor follow their textbook definitions."""
    r, year = F.col("daily_return"), TRADING_DAYS
    out = equity(daily).agg(
        F.count(F.lit(1)).alias("days"),
        F.max_by("equity", "date").alias("final_equity"),
        F.avg(r).alias("_mean"),
        F.stddev_samp(r).alias("_std"),
        F.sqrt(F.avg(F.pow(F.least(r, F.lit(0.0)), 2))).alias("_down"),
        F.min("drawdown").alias("max_drawdown"),
        F.avg((r > 0).cast("double")).alias("win_rate"),
        F.sum(F.greatest(r, F.lit(0.0))).alias("_gain"),
        F.sum(F.greatest(-r, F.lit(0.0))).alias("_loss"),
    )
    out = out.withColumn("annual_return", F.pow("final_equity", F.lit(float(year)) / F.col("days")) - 1)
    return out.select(
        "days",
        "annual_return",
        (F.col("_std") * year**0.5).alias("annual_volatility"),
        (F.try_divide(F.col("_mean"), F.col("_std")) * year**0.5).alias("sharpe"),
        (F.try_divide(F.col("_mean"), F.col("_down")) * year**0.5).alias("sortino"),
        "max_drawdown",
        F.try_divide(F.col("annual_return"), F.abs("max_drawdown")).alias("calmar"),
        "win_rate",
        F.try_divide(F.col("_gain"), F.col("_loss")).alias("profit_factor"),
    )


def daily_report(predictions: DataFrame, n: int = 10) -> DataFrame:
    """The n best of each date with rank text, percentile and a 0-100 score."""
    day = Window.partitionBy("date")
    out = predictions.withColumns({"rank": first_rank(F.col("ranking_score"), "ticker"), "_total": F.count(F.lit(1)).over(day), "score_100": min_max_score(F.col("ranking_score"), day)})
    out = out.where(F.col("rank") <= n)
    return out.withColumns({"rank_text": business_rank_text(F.col("rank"), F.col("_total")), "percentile": rank_percentile(F.col("rank"), F.col("_total")), "expected_text": percent_text(F.col("expected_return"))}).drop("_total")
