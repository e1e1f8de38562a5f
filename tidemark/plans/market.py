"""Queries over the daily panel: one bar per user and day of ``events``."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import windows as W
from ..functions.numbers import double_round
from ..operators import asof, filters, learn, merge, panel, portfolio, rolling, stats
from ..session import table
from .registry import query, sql_of

DIGITS = 6


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """Open and close are the first and last value of the day, volume the number of events."""
    order = F.struct("ts", "event_id")
    return (
        table(spark, sf, "events")
        .groupBy("user_id", F.col("ts").cast("date").alias("date"))
        .agg(F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"), F.count(F.lit(1)).alias("volume"))
        .select(
            "date",
            F.lpad(F.col("user_id").cast("string"), 6, "0").alias("ticker"),
            "open",
            "high",
            "low",
            "close",
            "volume",
            F.concat(F.lit("S"), (F.col("user_id") % 5).cast("string")).alias("sector"),
            F.when(F.col("user_id") % 3 == 0, "KOSDAQ").otherwise("KOSPI").alias("market_type"),
        )
    )


BARS = """bars AS (SELECT CAST(ts AS DATE) AS date, lpad(CAST(user_id AS VARCHAR), 6, '0') AS ticker, first(value ORDER BY ts, event_id) AS open, max(value) AS high,
  min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS volume, 'S' || CAST(user_id % 5 AS VARCHAR) AS sector,
  CASE WHEN user_id % 3 = 0 THEN 'KOSDAQ' ELSE 'KOSPI' END AS market_type FROM events GROUP BY user_id, CAST(ts AS DATE))"""

W_ = "(PARTITION BY ticker ORDER BY date)"


def _l(c: str, k: int) -> str:
    return f"lag({c}, {k}) OVER {W_}"


def _before(how: str, c: str, n: int) -> str:
    frame = f"(PARTITION BY ticker ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({c}) OVER {frame} = {n} THEN {how}({c}) OVER {frame} END"


def _r(expr: str, name: str) -> str:
    return f"round({expr}, {DIGITS}) AS {name}"


def _rank(c: str, by: str = "date") -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {c} ASC NULLS LAST) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0) / count({c}) OVER (PARTITION BY {by}) END"


def shown(df: DataFrame, columns: list[str], keys: tuple[str, ...] = ("date", "ticker")) -> DataFrame:
    doubles = {c for c, kind in df.dtypes if kind == "double"}
    return df.select(*keys, *[(double_round if c in doubles else F.round)(F.col(c), DIGITS).alias(c) for c in columns])


RET = {p: f"({_l('close', 1)}) / nullif({_l('close', p + 1)}, 0) - 1" for p in (1, 3, 5, 20, 60)}


@query(
    f"""WITH {BARS}, f AS (SELECT date, ticker, {RET[1]} AS return_1d, ({_l('close', 1)}) / nullif({_before('avg', 'close', 5)}, 0) - 1 AS close_ma5_ratio FROM bars),
r AS (SELECT *, {_rank('return_1d')} AS rank_pct, row_number() OVER (PARTITION BY date ORDER BY return_1d DESC NULLS LAST, ticker) AS n FROM f)
SELECT date, ticker, {_r('return_1d', 'return_1d')}, {_r('close_ma5_ratio', 'close_ma5_ratio')}, {_r('rank_pct', 'rank_pct')}, n FROM r WHERE n <= 5"""
)
def panel_topk(spark, sf):
    """The five best of each day by yesterday's return."""
    w, c = W.series(), F.col("close")
    df = bars(spark, sf).withColumns({"return_1d": W.lagged_return(c, 1, w), "close_ma5_ratio": F.try_divide(F.lag(c, 1).over(w), W.before(F.avg, c, 5, w)) - 1})
    df = df.withColumns({"rank_pct": W.rank_pct(F.col("return_1d")), "n": W.first_rank(F.col("return_1d"), "ticker")}).where("n <= 5")
    return shown(df, ["return_1d", "close_ma5_ratio", "rank_pct"], ("date", "ticker", "n"))


@query(
    f"""WITH {BARS} SELECT date, ticker, {", ".join(_r(RET[p], f"return_{p}d") for p in (1, 3, 5, 20, 60))},
{", ".join(_r(f"({_l('close', 1)}) / nullif({_before('avg', 'close', n)}, 0) - 1", f"close_ma{n}_ratio") for n in (5, 20, 60))} FROM bars"""
)
def features_price(spark, sf):
    """Section 2.19: returns and moving-average ratios."""
    return shown(panel.price_features(bars(spark, sf)), [*[f"return_{p}d" for p in (1, 3, 5, 20, 60)], *[f"close_ma{n}_ratio" for n in (5, 20, 60)]])


_MOMENTUM = ["momentum_5d", "momentum_20d", "momentum_diff", "momentum_accel", "relative_return_5d_vs_market", "relative_return_20d_vs_market", "relative_return_20d_vs_sector", "momentum_rank_pct"]


@query(
    f"""WITH {BARS}, f AS (SELECT *, {RET[5]} AS r5, {RET[20]} AS r20 FROM bars)
SELECT date, ticker, {_r('r5', 'momentum_5d')}, {_r('r20', 'momentum_20d')}, {_r('r5 - r20', 'momentum_diff')}, {_r(f"r5 - {_l('r5', 1)}", 'momentum_accel')},
{_r('r5 - avg(r5) OVER (PARTITION BY date)', 'relative_return_5d_vs_market')}, {_r('r20 - avg(r20) OVER (PARTITION BY date)', 'relative_return_20d_vs_market')},
{_r('r20 - avg(r20) OVER (PARTITION BY date, sector)', 'relative_return_20d_vs_sector')}, {_r(_rank('r20'), 'momentum_rank_pct')} FROM f"""
)
def features_momentum(spark, sf):
    """A1, W8, W15."""
    df = panel.momentum_features(panel.price_features(bars(spark, sf)))
    return shown(df.withColumn("momentum_rank_pct", W.rank_pct(F.col("momentum_20d"))), _MOMENTUM)


@query(
    f"""WITH {BARS}, f AS (SELECT *, ({_l('close', 1)}) * ({_l('volume', 1)}) AS v FROM bars),
g AS (SELECT *, CASE WHEN count(v) OVER t = 20 THEN avg(v) OVER t END AS m FROM f WINDOW t AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
h AS (SELECT *, v / nullif(m, 0) AS relative_trading_value FROM g)
SELECT date, ticker, {_r(f"CAST(({_l('volume', 1)}) AS DOUBLE) / nullif({_l('volume', 2)}, 0) - 1", 'volume_change_1d')}, {_r('relative_trading_value', 'relative_trading_value')},
{_r(_rank('relative_trading_value'), 'trading_value_rank_pct')} FROM h"""
)
def features_volume(spark, sf):
    """W7."""
    df = panel.volume_features(bars(spark, sf)).withColumn("trading_value_rank_pct", W.rank_pct(F.col("relative_trading_value")))
    return shown(df, ["volume_change_1d", "relative_trading_value", "trading_value_rank_pct"])


@query(
    f"""WITH {BARS}, f AS (SELECT *, {_l('close', 1)} AS pc FROM bars),
g AS (SELECT *, close / nullif(pc, 0) - 1 AS chg, (high - low) / nullif(close, 0) AS rng, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM f)
SELECT date, ticker, {_r(_before('stddev_samp', 'chg', 5), 'volatility_5d')}, {_r(_before('stddev_samp', 'chg', 20), 'volatility_20d')},
{_r(_before('avg', 'rng', 5), 'intraday_range_5d')}, {_r(f"({_before('avg', 'tr', 14)}) / (pc + 1e-8)", 'atr_percent')} FROM g"""
)
def features_volatility(spark, sf):
    """W4, W6, W9."""
    return shown(panel.volatility_features(bars(spark, sf)), ["volatility_5d", "volatility_20d", "intraday_range_5d", "atr_percent"])


@query(
    f"""WITH {BARS}, f AS (SELECT date, ticker, {_l('open', 1)} AS o, {_l('high', 1)} AS h, {_l('low', 1)} AS l, {_l('close', 1)} AS c FROM bars)
SELECT date, ticker, {_r('(c - o) / (o + 1e-8)', 'body')}, {_r('(h - greatest(o, c)) / (o + 1e-8)', 'upper_shadow')}, {_r('(least(o, c) - l) / (o + 1e-8)', 'lower_shadow')},
{_r('abs(c - o) / (h - l + 1e-8)', 'body_ratio')}, {_r('(c - l) / (h - l + 1e-8)', 'close_position')} FROM f"""
)
def features_candlestick(spark, sf):
    """Section 2.19."""
    return shown(panel.candlestick_features(bars(spark, sf)), ["body", "upper_shadow", "lower_shadow", "body_ratio", "close_position"])


@query(
    f"""WITH {BARS}, f AS (SELECT date, ticker, {_l('close', 1)} AS c, {_before('max', 'high', 20)} AS high_20d, {_before('min', 'low', 20)} AS low_20d FROM bars),
g AS (SELECT *, (c - low_20d) / (high_20d - low_20d + 1e-8) AS breakout_strength FROM f)
SELECT date, ticker, {_r('high_20d', 'high_20d')}, {_r('low_20d', 'low_20d')}, {_r('c / nullif(high_20d, 0) - 1', 'close_to_20d_high')}, {_r('c / nullif(low_20d, 0) - 1', 'close_to_20d_low')},
{_r('breakout_strength', 'breakout_strength')}, {_r(_rank('breakout_strength'), 'breakout_rank_pct')} FROM g"""
)
def features_breakout(spark, sf):
    """W5."""
    df = panel.breakout_features(bars(spark, sf)).withColumn("breakout_rank_pct", W.rank_pct(F.col("breakout_strength")))
    return shown(df, ["high_20d", "low_20d", "close_to_20d_high", "close_to_20d_low", "breakout_strength", "breakout_rank_pct"])


def _ewm(source: str, x: str, alpha: str, out: str) -> str:
    """A recursive mean in closed form: weights decay from the first value on."""
    return f"""{out} AS (SELECT a.ticker, a.i, sum(b.{x} * CASE WHEN b.i = f.i0 THEN power(1 - {alpha}, a.i - f.i0) ELSE {alpha} * power(1 - {alpha}, a.i - b.i) END) AS {out}
  FROM {source} a JOIN (SELECT ticker, min(i) AS i0 FROM {source} WHERE {x} IS NOT NULL GROUP BY ticker) f ON a.ticker = f.ticker AND a.i >= f.i0
  JOIN {source} b ON b.ticker = a.ticker AND b.i <= a.i AND b.i >= f.i0 GROUP BY a.ticker, a.i)"""


@query(
    f"""WITH {BARS}, s AS (SELECT date, ticker, row_number() OVER {W_} AS i, {_l('close', 1)} AS c1, ({_l('close', 1)}) - ({_l('close', 2)}) AS d,
  {_before('avg', 'close', 20)} AS m, {_before('stddev_samp', 'close', 20)} AS sd FROM bars),
t AS (SELECT *, greatest(d, CASE WHEN d IS NOT NULL THEN 0 END) AS up, greatest(-d, CASE WHEN d IS NOT NULL THEN 0 END) AS down FROM s),
{_ewm('t', 'up', '(1/14.0::DOUBLE)', 'gain')}, {_ewm('t', 'down', '(1/14.0::DOUBLE)', 'loss')}, {_ewm('t', 'c1', '(2/13.0::DOUBLE)', 'fast')}, {_ewm('t', 'c1', '(2/27.0::DOUBLE)', 'slow')},
u AS (SELECT t.*, gain, loss, fast - slow AS macd FROM t LEFT JOIN gain USING (ticker, i) LEFT JOIN loss USING (ticker, i) LEFT JOIN fast USING (ticker, i) LEFT JOIN slow USING (ticker, i)),
{_ewm('u', 'macd', '(2/10.0::DOUBLE)', 'signal')},
v AS (SELECT u.date, u.ticker, u.i, c1, 100 - 100 / (1 + gain / (loss + 1e-8)) AS rsi14, (macd - signal) / (c1 + 1e-8) AS macd_hist_ratio,
  (c1 - (m - 2 * sd)) / ((m + 2 * sd) - (m - 2 * sd) + 1e-8) AS bb_position, ((m + 2 * sd) - (m - 2 * sd)) / (m + 1e-8) AS bb_width FROM u LEFT JOIN signal USING (ticker, i))
SELECT date, ticker, {_r('rsi14', 'rsi14')}, {_r(f"rsi14 - ({_l('rsi14', 5)})", 'rsi_change_5d')}, {_r('macd_hist_ratio', 'macd_hist_ratio')}, {_r('bb_position', 'bb_position')},
{_r('bb_width', 'bb_width')}, {_r(f"bb_position - ({_l('bb_position', 5)})", 'bb_position_change_5d')} FROM v"""
)
def features_technical(spark, sf):
    """W10, G10."""
    return shown(panel.technical_features(bars(spark, sf)), ["rsi14", "rsi_change_5d", "macd_hist_ratio", "bb_position", "bb_width", "bb_position_change_5d"])


#: Six macro series made from the events of a day.
_SERIES = {"nasdaq_close": "sum(value)", "usdkrw": "count(*)", "sox_close": "max(value)", "sp500_close": "avg(value)", "wti_close": "sum(value * value)", "vix_close": "count(DISTINCT user_id)"}


def macro(spark, sf) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.col("ts").cast("date").alias("date")).agg(*[F.expr(x.replace("count(*)", "count(1)")).cast("double").alias(c) for c, x in _SERIES.items()])


MACRO = f"macro AS (SELECT CAST(ts AS DATE) AS date, {', '.join(f'CAST({x} AS DOUBLE) AS {c}' for c, x in _SERIES.items())} FROM events GROUP BY 1)"


def _macro_return(c: str) -> str:
    return _r(f"({_l(c, 1)}) / nullif({_l(c, 2)}, 0) - 1", panel.MACRO[c])


@query(f"WITH {BARS}, {MACRO}, j AS (SELECT bars.*, {', '.join(_SERIES)} FROM bars LEFT JOIN macro USING (date)) SELECT date, ticker, {', '.join(map(_macro_return, _SERIES))} FROM j")
def features_macro(spark, sf):
    """All six series."""
    return shown(panel.macro_features(panel.attach_macro(bars(spark, sf), macro(spark, sf))), list(panel.MACRO.values()))


def _feature_groups() -> dict[str, list[str]]:
    """The registered SQL of each feature group, and its columns without ranks."""
    return {
        "features_price": [*[f"return_{p}d" for p in (1, 3, 5, 20, 60)], *[f"close_ma{n}_ratio" for n in (5, 20, 60)]],
        "features_momentum": _MOMENTUM[:-1],
        "features_volume": ["volume_change_1d", "relative_trading_value"],
        "features_volatility": ["volatility_5d", "volatility_20d", "intraday_range_5d", "atr_percent"],
        "features_candlestick": ["body", "upper_shadow", "lower_shadow", "body_ratio", "close_position"],
        "features_breakout": ["high_20d", "low_20d", "close_to_20d_high", "close_to_20d_low", "breakout_strength"],
        "features_technical": ["rsi14", "rsi_change_5d", "macd_hist_ratio", "bb_position", "bb_width", "bb_position_change_5d"],
        "features_macro": list(panel.MACRO.values()),
    }


def _all_features() -> list[str]:
    return [c for columns in _feature_groups().values() for c in columns]


def _features_sql() -> str:
    parts = ", ".join(f"{name} AS ({sql_of(name)})" for name in _feature_groups())
    joined = "features_price " + " ".join(f"JOIN {name} USING (date, ticker)" for name in list(_feature_groups())[1:])
    return f"WITH {BARS}, {parts} SELECT date, ticker, b.sector, b.market_type, {', '.join(_all_features())} FROM {joined} JOIN (SELECT date, ticker, sector, market_type FROM bars) b USING (date, ticker)"


@query(_features_sql())
def features_all(spark, sf):
    """All feature groups in order, as one frame, raw columns and ranks left out."""
    df = panel.build_features(panel.attach_macro(bars(spark, sf), macro(spark, sf)))
    kept = filters.without(df, {"open", "high", "low", "close", "volume", *_SERIES, *panel.RANKS})
    keys = ("date", "ticker", "sector", "market_type")
    return shown(kept, [c for c in kept.columns if c not in keys], keys)


@query(
    f"""WITH {", ".join(f"{name} AS ({sql_of(name)})" for name in _feature_groups())}
SELECT date, ticker, {", ".join(_r(_rank(c), out) for out, c in panel.RANKS.items())} FROM features_price {" ".join(f"JOIN {name} USING (date, ticker)" for name in list(_feature_groups())[1:])}"""
)
def features_ranks(spark, sf):
    """14 ranks of the date and the technical ones, of values rounded as the other queries show them."""
    df = panel.build_features(panel.attach_macro(bars(spark, sf), macro(spark, sf)), [g for g in panel.GROUPS if g != "cross_section"])
    return shown(panel.rank_features(shown(df, sorted(set(panel.RANKS.values())))), list(panel.RANKS))


@query(
    f"""WITH {BARS}, b AS (SELECT ticker, date, CASE WHEN sector = 'S1' THEN NULL ELSE sector END AS sector, market_type, CASE WHEN volume > 4 THEN 'large' END AS cap FROM bars)
SELECT date, ticker, coalesce(sector, 'unknown') AS sector, market_type, coalesce(cap, 'unknown') AS market_cap_group FROM b"""
)
def features_identity(spark, sf):
    """Section 2.19, identity group."""
    df = bars(spark, sf).withColumns({"sector": F.when(F.col("sector") != "S1", F.col("sector")), "market_cap_group": F.when(F.col("volume") > 4, "large")})
    return panel.identity_features(df).select("date", "ticker", "sector", "market_type", "market_cap_group")


TARGETS = f"""tg AS (SELECT date AS feature_date, ticker, lead(date, 1) OVER {W_} AS target_date, close AS prev_close, lead(open, 1) OVER {W_} AS o, lead(close, 1) OVER {W_} AS c FROM bars),
targets AS (SELECT feature_date, ticker, target_date, prev_close, date_diff('day', feature_date, target_date)::INT AS prediction_horizon, c / nullif(prev_close, 0) - 1 AS target_ranking,
  o / nullif(prev_close, 0) - 1 AS target_gap, c / nullif(o, 0) - 1 AS target_intraday FROM tg WHERE c / nullif(prev_close, 0) IS NOT NULL AND o / nullif(prev_close, 0) IS NOT NULL AND c / nullif(o, 0) IS NOT NULL)"""
_T = ["prev_close", "target_ranking", "target_gap", "target_intraday"]


@query(f"WITH {BARS}, {TARGETS} SELECT feature_date, ticker, target_date, prediction_horizon, {', '.join(_r(c, c) for c in _T)} FROM targets")
def targets_next(spark, sf):
    """W14."""
    return shown(panel.targets(bars(spark, sf)), _T, ("feature_date", "ticker", "target_date", "prediction_horizon"))


@query(
    f"""WITH {BARS}, b AS (SELECT date, ticker, open, close, {_l('close', 1)} AS prev_close FROM bars)
SELECT date AS feature_date, ticker, {_r('prev_close', 'prev_close')}, {_r('close / nullif(prev_close, 0) - 1', 'target_ranking')}, {_r('open / nullif(prev_close, 0) - 1', 'target_gap')},
{_r('close / nullif(open, 0) - 1', 'target_intraday')} FROM b WHERE prev_close <> 0 AND open <> 0"""
)
def targets_same_day(spark, sf):
    """Labels of the same date."""
    return shown(panel.targets(bars(spark, sf), "same"), _T, ("feature_date", "ticker"))


@query(
    f"""WITH {BARS}, {TARGETS}, f AS (SELECT date AS feature_date, ticker, {RET[1]} AS return_1d FROM bars)
SELECT feature_date, ticker, target_date, {_r('return_1d', 'return_1d')}, {_r('target_ranking', 'target_ranking')} FROM f JOIN targets USING (feature_date, ticker)"""
)
def training_join(spark, sf):
    """J2, J3."""
    df = bars(spark, sf)
    return shown(panel.training_rows(panel.price_features(df), panel.targets(df)), ["return_1d", "target_ranking"], ("feature_date", "ticker", "target_date"))


@query(
    """WITH q AS (SELECT DISTINCT l_suppkey AS k, CAST(l_shipdate AS DATE) AS date FROM lineitem),
o AS (SELECT o_custkey % 100 AS k, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS price FROM orders WHERE o_totalprice > 0 GROUP BY 1, 2),
j AS (SELECT q.k, q.date, o.price, o.date AS price_date FROM q ASOF LEFT JOIN o ON q.k = o.k AND q.date >= o.date)
SELECT k, date, CASE WHEN date_diff('day', price_date, date) <= 10 THEN price END AS price, CASE WHEN date_diff('day', price_date, date) <= 10 THEN price_date END AS price_date FROM j"""
)
def asof_by_key(spark, sf):
    """J6 with keys and an age limit."""
    left = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_shipdate").cast("date").alias("date")).distinct()
    right = table(spark, sf, "orders").select((F.col("o_custkey") % 100).alias("k"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_totalprice").alias("price"))
    return asof.as_of(left, right, "price", 10, by=["k"])


@query(
    """WITH d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem), o AS (SELECT CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS price FROM orders GROUP BY 1)
SELECT d.date, o.price, o.date AS price_date FROM d ASOF LEFT JOIN o ON d.date >= o.date"""
)
def asof_any_age(spark, sf):
    """J7."""
    left = table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("date")).distinct()
    right = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("date"), F.col("o_totalprice").alias("price"))
    return asof.as_of(left, right, "price")


FOLDS = [(1, "2024-01-01", "2024-01-10", "2024-01-11", "2024-01-15", "2024-01-16", "2024-01-20"), (2, "2024-01-01", "2024-01-15", "2024-01-16", "2024-01-20", "2024-01-21", "2024-01-25")]


@query(
    f"""WITH {BARS}, f(fold_id, part, a, b) AS (VALUES (1, 'train', DATE '2024-01-01', DATE '2024-01-10'), (1, 'valid', DATE '2024-01-11', DATE '2024-01-15'), (1, 'test', DATE '2024-01-16', DATE '2024-01-20'),
(2, 'train', DATE '2024-01-01', DATE '2024-01-15'), (2, 'valid', DATE '2024-01-16', DATE '2024-01-20'), (2, 'test', DATE '2024-01-21', DATE '2024-01-25'))
SELECT fold_id, part, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM bars JOIN f ON date BETWEEN a AND b GROUP BY 1, 2"""
)
def fold_assignment(spark, sf):
    """J9, P10."""
    names = "train_start train_end valid_start valid_end test_start test_end".split()
    folds = spark.createDataFrame(FOLDS, "fold_id int, " + ", ".join(f"{n} string" for n in names)).select("fold_id", *[F.col(n).cast("date").alias(n) for n in names])
    df = asof.assign_folds(bars(spark, sf), learn.check_folds(folds)).withColumnRenamed("col0", "part")
    return df.groupBy("fold_id", "part").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query(
    """SELECT date, max(p) AS purchases, max(s) AS signups FROM (SELECT CAST(ts AS DATE) AS date, sum(value) AS p, NULL::DOUBLE AS s FROM events WHERE event_type = 'purchase' GROUP BY 1
UNION ALL SELECT CAST(ts AS DATE), NULL, max(value) FROM events WHERE event_type = 'signup' GROUP BY 1) WHERE date >= DATE '2024-01-05' GROUP BY date"""
)
def outer_calendar(spark, sf):
    """J23."""
    e = table(spark, sf, "events").withColumn("date", F.col("ts").cast("date"))
    p = e.where("event_type = 'purchase'").groupBy("date").agg(F.sum("value").alias("value"))
    s = e.where("event_type = 'signup'").groupBy("date").agg(F.max("value").alias("value"))
    return asof.outer_calendar({"purchases": p, "signups": s}, "2024-01-05")


@query(f"WITH {BARS}, d AS (SELECT DISTINCT date FROM bars WHERE date <= DATE '2024-01-20' ORDER BY date DESC LIMIT 7) SELECT ticker, count(*) AS n, min(date) AS first_date FROM bars WHERE date IN (SELECT date FROM d) GROUP BY ticker")
def last_trading_dates(spark, sf):
    """L2."""
    return asof.last_dates(bars(spark, sf), 7, "2024-01-20").groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"))


@query(f"WITH {BARS}, d AS (SELECT DISTINCT date FROM bars WHERE date < DATE '2024-01-20' ORDER BY date DESC LIMIT 10) SELECT date, count(*) AS n FROM bars WHERE date IN (SELECT date FROM d) GROUP BY date")
def rolling_training_window(spark, sf):
    """L3, M7."""
    return learn.rolling_rows(bars(spark, sf), "2024-01-20", 10, "date").groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {BARS} SELECT max(CASE WHEN date < DATE '2024-01-15' THEN date END) AS previous, min(CASE WHEN date > DATE '2024-01-15' THEN date END) AS next, bool_or(date = DATE '2024-01-15') AS covered FROM bars")
def calendar_neighbours(spark, sf):
    """G7."""
    return asof.neighbours(bars(spark, sf), "2024-01-15")


@query(
    f"""WITH {BARS}, x AS (SELECT * FROM bars UNION ALL SELECT * FROM bars WHERE volume = 5), v AS (SELECT *, count(*) OVER (PARTITION BY date, ticker) AS copies FROM x)
SELECT sector, count(*) FILTER (WHERE copies = 1 AND open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume >= 0 AND high >= open AND high >= close AND high >= low AND low <= open AND low <= close) AS valid, count(*) AS n FROM v GROUP BY sector"""
)
def valid_bars(spark, sf):
    """Repeated keys are invalid in all copies."""
    df = bars(spark, sf)
    return filters.mark_valid(df.union(df.where("volume = 5"))).groupBy("sector").agg(F.count_if("valid").alias("valid"), F.count(F.lit(1)).alias("n"))


_UNIVERSE = """WITH u AS (SELECT CAST(o_orderdate AS DATE) AS date, CAST(o_custkey AS VARCHAR) AS ticker, o_orderstatus, o_totalprice AS trading_value_ma20 FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice >= 100000)"""


def _candidates(spark, sf):
    o = table(spark, sf, "orders")
    kind = F.when(F.col("o_orderstatus") == "P", "Etf").otherwise("Common")
    return o.select(F.col("o_orderdate").cast("date").alias("date"), F.col("o_custkey").cast("string").alias("ticker"), kind.alias("security_type"), F.col("o_totalprice").alias("trading_value_ma20"), F.lit(False).alias("trading_halt"))


@query(_UNIVERSE + " SELECT date, ticker, trading_value_ma20 FROM u ORDER BY trading_value_ma20 DESC, date, ticker LIMIT 100")
def universe_global(spark, sf):
    """The cap holds for all dates together."""
    return filters.universe(_candidates(spark, sf), 100, 1e5).select("date", "ticker", "trading_value_ma20")


@query(_UNIVERSE + " SELECT date, ticker, trading_value_ma20 FROM u QUALIFY row_number() OVER (PARTITION BY date ORDER BY trading_value_ma20 DESC, ticker) <= 2")
def universe_daily(spark, sf):
    """L1 per date."""
    return filters.universe(_candidates(spark, sf), 2, 1e5, per_date=True).select("date", "ticker", "trading_value_ma20")


def _predictions(spark, sf) -> DataFrame:
    df = bars(spark, sf)
    rows = panel.training_rows(panel.price_features(df).select("date", "ticker", "return_1d", "sector", "market_type", "open", "close"), panel.targets(df))
    return rows.select(F.col("feature_date").alias("date"), "ticker", "sector", "market_type", F.col("return_1d").alias("predicted"), F.col("target_ranking").alias("actual"), "target_gap", "target_intraday", "prev_close").where("predicted IS NOT NULL")


PREDICTIONS = f"""{TARGETS}, p AS (SELECT b.date, b.ticker, b.sector, b.market_type, b.predicted, t.target_ranking AS actual, t.target_gap, t.target_intraday, t.prev_close
  FROM (SELECT *, {RET[1]} AS predicted FROM bars) b JOIN targets t ON b.date = t.feature_date AND b.ticker = t.ticker WHERE predicted IS NOT NULL)"""
_METRIC = f"""e AS (SELECT *, {{k}} AS k, rank() OVER (PARTITION BY {{k}} ORDER BY actual) + (count(*) OVER (PARTITION BY {{k}}, actual) - 1) / 2.0 AS ra,
  rank() OVER (PARTITION BY {{k}} ORDER BY predicted) + (count(*) OVER (PARTITION BY {{k}}, predicted) - 1) / 2.0 AS rp FROM p),
m AS (SELECT k, count(*) AS n, sqrt(avg((predicted - actual) * (predicted - actual))) AS rmse, avg(abs(predicted - actual)) AS mae, avg((sign(actual) = sign(predicted))::INT) AS directional_accuracy,
  CASE WHEN count(DISTINCT actual) > 1 AND count(DISTINCT predicted) > 1 THEN corr(ra, rp) END AS rank_ic FROM e GROUP BY k)"""


@query(f"WITH {BARS}, {PREDICTIONS}, {_METRIC.format(k='date')} SELECT k AS date, n, {', '.join(_r(c, c) for c in ('rmse', 'mae', 'directional_accuracy', 'rank_ic'))} FROM m")
def metrics_daily(spark, sf):
    """A2, A4."""
    return shown(stats.daily_metrics(_predictions(spark, sf)), ["rmse", "mae", "directional_accuracy", "rank_ic"], ("date", "n"))


@query(
    f"""WITH {BARS}, {PREDICTIONS}, {_METRIC.format(k='0')}, d AS (SELECT date, CASE WHEN count(DISTINCT actual) > 1 AND count(DISTINCT predicted) > 1 THEN corr(a, b) END AS ic FROM
 (SELECT *, rank() OVER (PARTITION BY date ORDER BY actual) + (count(*) OVER (PARTITION BY date, actual) - 1) / 2.0 AS a, rank() OVER (PARTITION BY date ORDER BY predicted) + (count(*) OVER (PARTITION BY date, predicted) - 1) / 2.0 AS b FROM p) GROUP BY date)
SELECT n AS pooled_n, {_r('rmse', 'pooled_rmse')}, {_r('mae', 'pooled_mae')}, {_r('directional_accuracy', 'pooled_directional_accuracy')}, {_r('rank_ic', 'pooled_rank_ic')}, (SELECT round(avg(ic), {DIGITS}) FROM d) AS mean_daily_rank_ic FROM m"""
)
def metrics_overall(spark, sf):
    """A3: pooled and mean-of-daily figures side by side."""
    df = stats.overall_metrics(_predictions(spark, sf))
    return df.select("pooled_n", *[F.round(c, DIGITS).alias(c) for c in df.columns if c != "pooled_n"])


def _scored(spark, sf) -> DataFrame:
    p = _predictions(spark, sf).withColumnsRenamed({"target_gap": "pred_gap", "target_intraday": "pred_intraday", "predicted": "ranking_score"})
    return portfolio.with_prices(p)


_SEL = f"""WITH {BARS}, {PREDICTIONS}, s AS (SELECT date, ticker, sector, market_type, actual, predicted AS ranking_score, (1 + target_gap) * (1 + target_intraday) - 1 AS expected_return FROM p),
a AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY date ORDER BY ranking_score DESC NULLS LAST, ticker) <= 30),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY date, sector ORDER BY expected_return DESC NULLS LAST, ticker) <= 3),
c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY date ORDER BY expected_return DESC NULLS LAST, ticker) <= 10),
sel AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY date) AS weight FROM c)"""


@query(f"{_SEL} SELECT date, ticker, {_r('expected_return', 'expected_return')}, {_r('weight', 'weight')} FROM sel")
def portfolio_selection(spark, sf):
    """L5, W20, M11, M12."""
    return shown(portfolio.select_portfolio(_scored(spark, sf)), ["expected_return", "weight"])


@query(f"{_SEL} SELECT date, sector, {_r('sum(weight)', 'exposure')} FROM sel GROUP BY 1, 2")
def portfolio_exposure(spark, sf):
    """M14."""
    return shown(portfolio.exposures(portfolio.select_portfolio(_scored(spark, sf)), "sector"), ["exposure"], ("date", "sector"))


@query(f"{_SEL} SELECT date, 'sector' AS kind, sector AS name, {_r('sum(weight)', 'weight')}, sum(weight) <= 0.3 + 1e-9 AS within FROM sel GROUP BY date, sector UNION ALL SELECT date, 'market_type', market_type, round(sum(weight), {DIGITS}), sum(weight) <= 0.7 + 1e-9 FROM sel GROUP BY date, market_type")
def portfolio_caps(spark, sf):
    """M11."""
    return shown(portfolio.cap_checks(portfolio.select_portfolio(_scored(spark, sf))), ["weight"], ("date", "kind", "name", "within"))


@query(f"{_SEL}, h AS (SELECT date, list(ticker) AS now FROM sel GROUP BY date), g AS (SELECT date, now, lag(now) OVER (ORDER BY date) AS was FROM h) SELECT date, CASE WHEN was IS NOT NULL THEN round(1 - len(list_intersect(now, was)) / len(now)::DOUBLE, {DIGITS}) END AS turnover FROM g")
def portfolio_turnover(spark, sf):
    """W28."""
    return shown(portfolio.turnover(portfolio.select_portfolio(_scored(spark, sf))), ["turnover"], ("date",))


_DAILY = f"""{_SEL}, dr AS (SELECT date, sum(weight * (greatest(least(actual, 0.2), -0.2) - 0.17)) AS daily_return FROM sel GROUP BY date),
eq AS (SELECT *, exp(sum(ln(1 + daily_return)) OVER (ORDER BY date)) AS equity FROM dr), dd AS (SELECT *, max(equity) OVER (ORDER BY date) AS peak, equity / max(equity) OVER (ORDER BY date) - 1 AS drawdown FROM eq)"""


def _daily(spark, sf) -> DataFrame:
    positions = portfolio.select_portfolio(_scored(spark, sf)).withColumn("realised", F.greatest(F.least("actual", F.lit(0.2)), F.lit(-0.2)) - 0.17)
    return portfolio.daily_returns(positions)


@query(f"{_DAILY} SELECT date, {', '.join(_r(c, c) for c in ('daily_return', 'equity', 'peak', 'drawdown'))} FROM dd")
def equity_curve(spark, sf):
    """W27, M12."""
    return shown(portfolio.equity(_daily(spark, sf)), ["daily_return", "equity", "peak", "drawdown"], ("date",))


@query(
    f"""{_DAILY}, z AS (SELECT count(*) AS days, last(equity ORDER BY date) AS fe, avg(daily_return) AS mu, stddev_samp(daily_return) AS sd, sqrt(avg(power(least(daily_return, 0), 2))) AS down, min(drawdown) AS mdd,
  avg((daily_return > 0)::INT) AS wr, sum(greatest(daily_return, 0)) AS gain, sum(greatest(-daily_return, 0)) AS loss FROM dd)
SELECT days, round(power(fe, 252.0 / days) - 1, 4) AS annual_return, round(sd * sqrt(252), 4) AS annual_volatility, round(mu / nullif(sd, 0) * sqrt(252), 4) AS sharpe, round(mu / nullif(down, 0) * sqrt(252), 4) AS sortino,
 round(mdd, 4) AS max_drawdown, round((power(fe, 252.0 / days) - 1) / nullif(abs(mdd), 0), 4) AS calmar, round(wr, 4) AS win_rate, round(gain / nullif(loss, 0), 4) AS profit_factor FROM z"""
)
def risk_figures(spark, sf):
    """M13."""
    df = portfolio.risk_figures(_daily(spark, sf))
    return df.select("days", *[F.round(c, 4).alias(c) for c in df.columns if c != "days"])


@query(f"WITH {BARS} SELECT date, ticker, {_r('(close * 0.999) / (open * 1.001) - 1 - 0.0015 * 2', 'trade_return')} FROM bars")
def trade_returns(spark, sf):
    """M9."""
    return shown(bars(spark, sf).withColumn("trade_return", portfolio.trade_return(F.col("open"), F.col("close"))), ["trade_return"])


@query(
    f"""WITH {BARS}, {PREDICTIONS} SELECT date, ticker, {_r('(1 + target_gap) * (1 + target_intraday) - 1', 'expected_return')}, {_r('target_gap + target_intraday', 'expected_return_additive')},
{_r('prev_close * (1 + target_gap)', 'pred_open_price')}, {_r('prev_close * (1 + target_gap) * (1 + target_intraday)', 'pred_close_price')} FROM p"""
)
def price_reconstruction(spark, sf):
    """M3, M4."""
    df = _scored(spark, sf).withColumn("expected_return_additive", portfolio.expected_return(F.col("pred_gap"), F.col("pred_intraday"), True))
    return shown(df, ["expected_return", "expected_return_additive", "pred_open_price", "pred_close_price"])


@query(
    f"""WITH {BARS}, {PREDICTIONS}, s AS (SELECT date, ticker, predicted AS ranking_score, (1 + target_gap) * (1 + target_intraday) - 1 AS er FROM p),
r AS (SELECT *, {_rank('er')} AS expected_return_rank, {_rank('ranking_score')} AS q FROM s)
SELECT date, ticker, {_r('0.5 * ranking_score + 0.3 * expected_return_rank + 0.1 * q + 0.1 * q', 'portfolio_score')} FROM r"""
)
def portfolio_scores(spark, sf):
    """M10."""
    df = _scored(spark, sf)
    df = df.withColumns({c: W.rank_pct(F.col("ranking_score")) for c in ("trading_value_rank_pct", "momentum_rank_pct")})
    return shown(portfolio.portfolio_score(df), ["portfolio_score"])


@query(
    f"""WITH {BARS}, {PREDICTIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY predicted DESC NULLS LAST, ticker) AS rank, count(*) OVER (PARTITION BY date) AS total,
 min(predicted) OVER (PARTITION BY date) AS lo, max(predicted) OVER (PARTITION BY date) AS hi FROM p)
SELECT date, ticker, rank, rank || ' / ' || total AS rank_text, greatest(round_even(rank / total::DOUBLE * 100, 0)::BIGINT, 1) AS percentile, CASE WHEN hi = lo THEN 50.0 ELSE round_even((predicted - lo) / (hi - lo) * 100, 1) END AS score_100 FROM r WHERE rank <= 10"""
)
def daily_report(spark, sf):
    """W17-W19, L4, G13, X11."""
    return portfolio.daily_report(_scored(spark, sf)).select("date", "ticker", "rank", "rank_text", "percentile", "score_100")


@query(f"WITH {BARS} SELECT date, ticker, {_r(f'close / nullif(({_l("close", 1)}), 0) - 1', 'raw_return')} FROM bars")
def raw_returns(spark, sf):
    """Against the row before, not lagged."""
    return shown(bars(spark, sf).withColumn("raw_return", W.pct_change(F.col("close"), W.series())), ["raw_return"])


@query(f"WITH {BARS}, g AS (SELECT date, ticker, CASE WHEN volume >= 3 THEN close END AS x FROM bars) SELECT date, ticker, last_value(x IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM g")
def forward_fill(spark, sf):
    """W13."""
    df = bars(spark, sf).withColumn("x", F.when(F.col("volume") >= 3, F.col("close")))
    return df.select("date", "ticker", W.fill_forward(F.col("x"), W.series()).alias("filled"))


@query(
    f"""WITH {BARS}, m AS (SELECT count(*) FILTER (WHERE NOT open > 40) AS open_rule, count(*) FILTER (WHERE NOT high >= low) AS high_rule FROM bars), k AS (SELECT coalesce(sum(n - 1), 0)::BIGINT AS duplicate_keys FROM (SELECT count(*) AS n FROM bars GROUP BY sector))
SELECT open_rule, high_rule, duplicate_keys FROM m, k"""
)
def contract_violations(spark, sf):
    """Q1-Q3, Q8."""
    return stats.violations(bars(spark, sf), {"open_rule": F.col("open") > 40, "high_rule": F.col("high") >= F.col("low")}, ["sector"])


@query(
    """WITH d AS (SELECT max(CASE WHEN event_type = 'purchase' THEN CAST(ts AS DATE) END) AS a, max(CASE WHEN event_type = 'signup' AND ts < TIMESTAMP '2024-01-20' THEN CAST(ts AS DATE) END) AS b FROM events)
SELECT list_filter([CASE WHEN a IS DISTINCT FROM DATE '2024-01-30' THEN 'krx' END, CASE WHEN NOT coalesce(date_diff('day', b, DATE '2024-01-30') BETWEEN 0 AND 5, false) THEN 'us' END], lambda x: x IS NOT NULL) AS failures, a = DATE '2024-01-30' AND date_diff('day', b, DATE '2024-01-30') BETWEEN 0 AND 5 AS complete FROM d"""
)
def source_completeness(spark, sf):
    """A11, A12, Q5, Q7."""
    e = table(spark, sf, "events").withColumns({"date": F.col("ts").cast("date"), "krx": F.when(F.col("event_type") == "purchase", F.col("value")), "us": F.when((F.col("event_type") == "signup") & (F.col("ts") < "2024-01-20"), F.col("value"))})
    return stats.source_completeness(stats.latest_per_source(e, ["krx", "us"]), "2024-01-30", ["krx"], ["us"])


@query()
def model_walk_forward(spark, sf):
    """Boosted trees per fold; rows only."""
    rows = _predictions(spark, sf).withColumnsRenamed({"date": "feature_date", "actual": "target_ranking"}).withColumn("x", F.greatest(F.least("predicted", F.lit(10.0)), F.lit(-10.0)))
    folds = spark.createDataFrame(FOLDS, "fold_id int, train_start string, train_end string, valid_start string, valid_end string, test_start string, test_end string")
    folds = folds.select("fold_id", *[F.col(c).cast("date").alias(c) for c in folds.columns[1:]])
    out = learn.walk_forward(rows, folds, ["x"])
    return out.select("feature_date", "ticker", "fold_id", "ranking_score", "pred_gap", "pred_intraday")


_ROLLING = 5
_ROLLING_FEATURES = ["return_1d", "close_position"]


def _training_rows(spark, sf):
    b = bars(spark, sf)
    last = lambda c: F.lag(c, 1).over(W.series())
    features = b.select(F.col("date").alias("feature_date"), "ticker", F.col("open"), W.lagged_return(F.col("close"), 1, W.series()).alias("return_1d"), F.try_divide(last("close") - last("low"), last("high") - last("low") + 1).alias("close_position"))
    return features.join(panel.targets(b), ["feature_date", "ticker"], "left")


def _rolling_sql() -> str:
    """Ridge over two features by Cramer's rule, for every date with five before it."""
    sums = {"n": "count(*)", "a": "sum(x1)", "b": "sum(x2)", "aa": "sum(x1 * x1) + 1", "bb": "sum(x2 * x2) + 1", "ab": "sum(x1 * x2)", "y": "sum(y)", "ay": "sum(x1 * y)", "by_": "sum(x2 * y)"}
    det = "(n * (aa * bb - ab * ab) - a * (a * bb - ab * b) + b * (a * ab - aa * b))"
    c0 = f"(y * (aa * bb - ab * ab) - a * (ay * bb - ab * by_) + b * (ay * ab - aa * by_)) / {det}"
    c1 = f"(n * (ay * bb - ab * by_) - y * (a * bb - ab * b) + b * (a * by_ - ay * b)) / {det}"
    c2 = f"(n * (aa * by_ - ay * ab) - a * (a * by_ - ay * b) + y * (a * ab - aa * b)) / {det}"
    return f"""WITH {BARS}, {TARGETS}, f AS (SELECT date AS feature_date, ticker, {RET[1]} AS return_1d, ({_l('close', 1)} - {_l('low', 1)}) / ({_l('high', 1)} - {_l('low', 1)} + 1) AS close_position FROM bars),
rows AS (SELECT f.feature_date, f.ticker, coalesce(return_1d, 0) AS x1, coalesce(close_position, 0) AS x2, target_ranking, target_gap, target_intraday FROM f LEFT JOIN targets t ON t.feature_date = f.feature_date AND t.ticker = f.ticker),
days AS (SELECT feature_date, row_number() OVER (ORDER BY feature_date) AS day FROM (SELECT DISTINCT feature_date FROM rows)),
long AS (SELECT day, x1, x2, unnest(['ranking', 'gap', 'intraday']) AS target, unnest([target_ranking, target_gap, target_intraday]) AS y FROM rows JOIN days USING (feature_date)),
sums AS (SELECT d.feature_date, target, {', '.join(f'({e})::DOUBLE AS {k}' for k, e in sums.items())} FROM days d JOIN long l ON l.day BETWEEN d.day - {_ROLLING} AND d.day - 1 WHERE d.day > {_ROLLING} AND y IS NOT NULL GROUP BY 1, 2),
models AS (SELECT feature_date, target, n::BIGINT AS n, {c0} AS c0, {c1} AS c1, {c2} AS c2 FROM sums)"""


@query(f"{_rolling_sql()} SELECT feature_date AS date, target, n, {_r('c0', 'c0')}, {_r('c1', 'c1')}, {_r('c2', 'c2')} FROM models")
def rolling_models(spark, sf):
    """M1, M7, L3: the coefficients of every day's models, from the five dates before it."""
    models = rolling.rolling_models(_training_rows(spark, sf), _ROLLING_FEATURES, _ROLLING)
    return models.select("date", "target", "n", *[F.round(F.col("coefficients")[i], DIGITS).alias(f"c{i}") for i in range(3)])


@query(f"""{_rolling_sql()}, wide AS (SELECT feature_date, {', '.join(f"max({c}) FILTER (WHERE target = '{t}') AS {t[0]}{c[1]}" for t in ("ranking", "gap", "intraday") for c in ("c0", "c1", "c2"))} FROM models GROUP BY 1)
SELECT feature_date, ticker, {_r('r0 + r1 * x1 + r2 * x2', 'ranking_score')}, {_r('g0 + g1 * x1 + g2 * x2', 'pred_gap')}, {_r('i0 + i1 * x1 + i2 * x2', 'pred_intraday')} FROM rows JOIN wide USING (feature_date)""")
def rolling_predictions(spark, sf):
    """Every date predicted by the models of the dates before it, in one job; keys are unique."""
    rows = _training_rows(spark, sf)
    out = rolling.predictions(rows, rolling.rolling_models(rows, _ROLLING_FEATURES, _ROLLING), _ROLLING_FEATURES)
    return shown(merge.reject_duplicates(out, ["feature_date", "ticker"]), ["ranking_score", "pred_gap", "pred_intraday"], ("feature_date", "ticker"))


@query(f"WITH {BARS}, d AS (SELECT date, row_number() OVER (ORDER BY date) AS n, count(*) OVER () AS total FROM (SELECT DISTINCT date FROM bars)), c AS (SELECT date FROM d WHERE n = greatest(1, floor(total * 0.8)::BIGINT)) SELECT CASE WHEN b.date <= c.date THEN 'train' ELSE 'valid' END AS part, count(*) AS n, min(b.date) AS first_date, max(b.date) AS last_date FROM bars b, c GROUP BY 1")
def chronological_split(spark, sf):
    """N2."""
    parts = stats.chronological_split(bars(spark, sf), "date")
    sides = [p.agg(F.lit(n).alias("part"), F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date")) for n, p in zip(("train", "valid"), parts)]
    return sides[0].union(sides[1])


@query(f"WITH {BARS}, {PREDICTIONS}, d AS (SELECT date, avg(actual) AS mean_return, avg(abs(predicted - actual)) AS mae FROM p GROUP BY date) SELECT (SELECT date FROM d ORDER BY mean_return DESC, mae LIMIT 1) AS best, (SELECT date FROM d ORDER BY mean_return, mae LIMIT 1) AS worst")
def best_worst_day(spark, sf):
    """A24."""
    daily = _predictions(spark, sf).groupBy("date").agg(F.avg("actual").alias("mean_return"), F.avg(F.abs(F.col("predicted") - F.col("actual"))).alias("mae"))
    return stats.best_and_worst(daily, "mean_return", "mae")


@query(f"WITH {BARS}, r AS (SELECT ticker, row_number() OVER (PARTITION BY date ORDER BY close DESC NULLS LAST, ticker) AS n FROM bars) SELECT ticker, count(*) AS appearances FROM r WHERE n <= 10 GROUP BY ticker ORDER BY appearances DESC, ticker LIMIT 20")
def top_appearances(spark, sf):
    """A17."""
    return stats.top_appearances(bars(spark, sf).withColumn("n", W.first_rank(F.col("close"), "ticker")), "n", "ticker")


@query("SELECT quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM events")
def value_quantiles(spark, sf):
    """A19."""
    return stats.quantiles(table(spark, sf, "events"), "value", (0.05, 0.5, 0.95))


@query(f"WITH {BARS} SELECT " + ", ".join(f"count(*) FILTER (WHERE close <= {b}) AS le_{b}" for b in (1, 5, 10, 20, 50)) + " FROM bars")
def percentile_buckets(spark, sf):
    """A18."""
    return stats.percentile_buckets(bars(spark, sf), "close")
