"""Ready-made end-user queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.numbers import number_or
from .filters import in_dates, page
from .merge import find_company, latest, union_by_priority
from .stats import account_pivot, flow


def padded(code: Column, n: int = 6) -> Column:
    """Leading zeros up to n characters; longer codes stay whole."""
    c = F.coalesce(code.cast("string"), F.lit(""))
    return F.when(F.length(c) < n, F.lpad(c, n, "0")).otherwise(c)


def of_company(rows: DataFrame, companies: DataFrame, asked: str | None) -> DataFrame:
    if not asked:
        return rows
    one = find_company(asked, companies).select(F.ltrim("corp_code", F.lit("0")).alias("_code"))
    return rows.join(F.broadcast(one), F.ltrim("corp_code", F.lit("0")) == F.col("_code"), "left_semi")  # one row at most


def financial_statements(rows: DataFrame, companies: DataFrame, asked: str, n: int = 10) -> DataFrame:
    """Key accounts per report of a company, newest first."""
    keys = ["corp_code", "bsns_year", "reprt_code", "fs_div", "rcept_dt"]
    pivot = account_pivot(of_company(rows, companies, asked), fixed.KEY_ACCOUNTS, keys, "ord")
    return pivot.orderBy(F.desc("bsns_year"), F.desc("rcept_dt"), "reprt_code", "fs_div").limit(n)


def disclosure_events(sources: list[DataFrame], companies: DataFrame, asked: str | None, start: str | None, end: str | None, number: int = 1, size: int = 20) -> tuple[DataFrame, DataFrame]:
    """The union of sources, each filing once, ordered by date before it is paged."""
    rows = union_by_priority(sources, ["rcept_no"], ["rcept_dt", "corp_name", "report_nm"], [F.col("rcept_dt").desc()])
    rows = of_company(rows.where(in_dates(F.col("rcept_dt"), start, end)), companies, asked)
    return page(rows, [F.desc("rcept_dt"), F.desc("rcept_no")], number, size)


def insider_trades(rows: DataFrame, companies: DataFrame, asked: str | None, start: str | None, end: str | None, number: int = 1, size: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A page of transactions, page totals, and the sums bought and sold."""
    kept = of_company(rows.where(in_dates(F.col("rcept_dt"), start, end)), companies, asked)
    paged, totals = page(kept, [F.desc("rcept_dt"), F.desc("rcept_no")], number, size)
    return paged, totals, flow(kept, number_or(F.col("stkqy_irds"), 0))


def major_shareholders(rows: DataFrame, companies: DataFrame, asked: str | None, number: int = 1, size: int = 20) -> tuple[DataFrame, DataFrame]:
    """X4."""
    return page(of_company(rows.where("ownership_type = 'majorstock'"), companies, asked), [F.desc("rcept_dt"), F.desc("rcept_no")], number, size)


def dispatch(intent: str, handlers: dict) -> list[DataFrame]:
    """The frames of an intent; 'hybrid' runs disclosures and financials."""
    names = ["dart_disclosure", "dart_financial"] if intent == "hybrid" else [intent]
    return [handlers[n]() for n in names if n in handlers]


def reports_between(reports: DataFrame, start: str, end: str, number: int = 1, size: int = 20) -> tuple[DataFrame, DataFrame]:
    """X6, N9."""
    return page(reports.where(in_dates(F.regexp_replace("published", r"\.", "-"), start, end)), [F.desc("published"), F.col("report_id")], number, size)


def consensus_tickers(reports: DataFrame, model: DataFrame, filings: DataFrame, until: Column, min_score: float | None = None) -> DataFrame:
    """Tickers in reports and model that filings of the last 92 days qualify; where that leaves
    none, the unqualified intersection. Code 000000 never counts."""
    code = lambda df, c: df.select(padded(F.col(c)).alias("ticker")).where("ticker <> '000000'").distinct()
    scored = model if min_score is None else model.where(F.col("ranking_score") > min_score)
    both = code(reports, "code").join(code(scored, "ticker"), "ticker", "left_semi")
    signs = (
        filings.where(F.col("rcept_dt") >= F.date_sub(until, 92))
        .select(padded(F.col("stock_code")).alias("ticker"), ((F.col("sentiment") == "positive") | F.rlike("report_nm", F.lit(fixed.REGULAR_FILINGS))).alias("good"))
        .groupBy("ticker")
        .agg(F.bool_or(F.coalesce("good", F.lit(False))).alias("qualified"))
        .where("qualified")
    )
    tagged = both.join(signs, "ticker", "left")
    some = F.coalesce(tagged.agg(F.bool_or("qualified")).toDF("q").scalar(), F.lit(False))
    return tagged.where(F.coalesce("qualified", F.lit(False)) | ~some).select("ticker")


def triple_consensus(reports: DataFrame, model: DataFrame, filings: DataFrame, llm: DataFrame, until: Column) -> DataFrame:
    """Reports that say BUY with upside, for consensus tickers, with reasons and latest filings."""
    tickers = consensus_tickers(reports, model, filings, until)
    buys = reports.withColumn("ticker", padded(F.col("code"))).where((F.upper("opinion") == "BUY") & (F.col("upside_pct") > 0)).join(tickers, "ticker", "left_semi")
    last = filings.withColumn("ticker", padded(F.col("stock_code"))).where(F.col("rcept_dt").between(F.date_sub(until, 90), until))
    newest = lambda pattern, name: latest(last.where(F.rlike("report_nm", F.lit(pattern))), ["ticker"], [F.desc("rcept_dt"), F.desc("rcept_no")]).select("ticker", F.col("report_nm").alias(name))
    best = latest(model.withColumn("ticker", padded(F.col("ticker"))), ["ticker"], [F.desc("ranking_score")]).select("ticker", "ranking_score")
    return (
        buys.join(llm.select("report_id", "reason", "risks", "keywords"), "report_id", "left")
        .join(best, "ticker", "left")
        .join(newest("분기보고서|반기보고서|사업보고서|정기공시", "last_regular"), "ticker", "left")
        .join(newest(fixed.MAJOR_EVENTS, "last_event"), "ticker", "left")
    )


def major_disclosures(filings: DataFrame, chosen: DataFrame, day: Column, skip: str | None = None) -> DataFrame:
    """today's major, non-neutral filings of tickers not chosen yet, one per ticker."""
    rows = filings.withColumn("ticker", padded(F.col("stock_code"))).where((F.col("rcept_dt") == day) & F.rlike("report_nm", F.lit(fixed.MAJOR_EVENTS)) & (F.col("sentiment") != "neutral"))
    if skip:
        rows = rows.where(~F.rlike("report_nm", F.lit(skip)))
    return latest(rows.join(chosen, "ticker", "left_anti"), ["ticker"], [F.desc("rcept_no")])


def top_upside(reports: DataFrame, n: int = 8) -> DataFrame:
    """L6, X10."""
    return reports.where("upside_pct IS NOT NULL").orderBy(F.desc("upside_pct"), "report_id").limit(n)


def latest_month(rows: DataFrame) -> DataFrame:
    """One row (year, month)."""
    return rows.agg(F.max(F.struct("year", "month")).alias("m")).select("m.*")


def of_latest_date(rows: DataFrame, date: str) -> DataFrame:
    """L9, N16."""
    return rows.where(F.col(date) == rows.agg(F.max(date)).toDF("d").scalar())


def map_back(rows: DataFrame, key: str, order: Column, classify: Column, default: str = "neutral") -> DataFrame:
    """The first row of each key is classified, its result goes to all rows of the key."""
    first = latest(rows, [key], [order]).select(key, classify.alias("sentiment"))
    return rows.join(first, key, "left").withColumn("sentiment", F.coalesce("sentiment", F.lit(default)))


def tiered(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """The first source that has any row."""
    out = None
    for s in sources:
        out = s if out is None else out.unionByName(s.where(out.agg(F.count(F.lit(1)) == 0).toDF("x").scalar()), allowMissingColumns=True)
    return out


def recent_turns(turns: DataFrame, n: int = 14) -> DataFrame:
    """The last turns of each conversation."""
    return turns.withColumn("_n", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("_n") <= n).drop("_n")


def last_mention(turns: DataFrame, pattern: str, n: int = 6) -> DataFrame:
    """Per conversation, what the newest of the last n turns that matches says."""
    said = recent_turns(turns, n).withColumn("mention", F.regexp_substr("text", F.lit(pattern))).where("mention IS NOT NULL")
    return said.groupBy("conv_id").agg(F.max_by("mention", "turn").alias("mention"))


def fill_from_partitions(info: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """N12."""
    return info.join(parts.select(key, F.col("year").alias("_y"), F.col("month").alias("_m")), key, "left").withColumns({"year": F.coalesce("_y", "year"), "month": F.coalesce("_m", "month")}).drop("_y", "_m")
