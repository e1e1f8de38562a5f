"""Queries for end-user operators, predicates and keyed lookups, over reports and filings made of ``orders``,
lines of statements made of ``lineitem``, and companies made of ``nation``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import fixed
from ..functions import numbers as N
from ..functions import text as T
from ..operators import filters, learn, merge, panel, portfolio, serving, stats, vectors
from ..session import table
from ..streaming import incremental
from .market import BARS, PREDICTIONS, _predictions, _r, bars, shown
from .registry import query

UNTIL = "1998-06-30"
EVENTS = ["사업보고서 (1997.12)", "주요사항보고서(유상증자결정)", "[기재정정]합병 결정", "기타 안내", "분기보고서", "투자판단 관련"]

COMPANIES = "companies AS (SELECT lpad(n_nationkey::VARCHAR, 8, '0') AS corp_code, lpad((n_nationkey * 10)::VARCHAR, 6, '0') AS stock_code, n_name AS corp_name, n_nationkey AS position FROM nation)"
REPORTS = """reports AS (SELECT o_orderkey AS report_id, (o_custkey % 97)::VARCHAR AS code, strftime(o_orderdate, '%Y.%m.%d') AS published, CASE o_orderstatus WHEN 'F' THEN 'Buy' WHEN 'O' THEN 'HOLD' END AS opinion,
  CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 200) - 100.0::DOUBLE END AS upside_pct, o_custkey % 40 AS firm FROM orders)"""
FILINGS = f"""filings AS (SELECT lpad(o_orderkey::VARCHAR, 14, '0') AS rcept_no, lpad((o_custkey % 25)::VARCHAR, 8, '0') AS corp_code, 'c' || (o_custkey % 25) AS corp_name, (o_custkey % 89)::VARCHAR AS stock_code, CAST(o_orderdate AS DATE) AS rcept_dt,
  {EVENTS!r}[1 + o_orderkey % 6] AS report_nm, ['positive', 'neutral', 'negative'][1 + o_orderkey % 3] AS sentiment FROM orders)"""


def companies(spark, sf) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf, "nation").select(
        F.lpad(n.cast("string"), 8, "0").alias("corp_code"), F.lpad((n * 10).cast("string"), 6, "0").alias("stock_code"), F.col("n_name").alias("corp_name"), F.lit(None).cast("string").alias("stock_name"), n.alias("position")
    )


def reports(spark, sf) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        k.alias("report_id"), (F.col("o_custkey") % 97).cast("string").alias("code"), F.date_format("o_orderdate", "yyyy.MM.dd").alias("published"),
        F.when(F.col("o_orderstatus") == "F", "Buy").when(F.col("o_orderstatus") == "O", "HOLD").alias("opinion"), F.when(k % 7 != 0, (k % 200 - 100).cast("double")).alias("upside_pct"), (F.col("o_custkey") % 40).alias("firm"),
    )


def filings(spark, sf) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda words, i: F.get(F.array(*map(F.lit, words)), i.cast("int"))
    return table(spark, sf, "orders").select(
        F.lpad(k.cast("string"), 14, "0").alias("rcept_no"), F.lpad((c % 25).cast("string"), 8, "0").alias("corp_code"), F.concat(F.lit("c"), (c % 25).cast("string")).alias("corp_name"), (c % 89).cast("string").alias("stock_code"),
        F.col("o_orderdate").cast("date").alias("rcept_dt"), pick(EVENTS, k % 6).alias("report_nm"), pick(["positive", "neutral", "negative"], k % 3).alias("sentiment"),
    )


_ACCOUNTS = ["매출액", "영업이익(손실)", " 당기순이익(손실) ", "자산총계", "자본총계"]
_STATEMENTS = f"""statements AS (SELECT lpad((o_custkey % 25)::VARCHAR, 8, '0') AS corp_code, year(o_orderdate)::VARCHAR AS bsns_year, CASE WHEN o_orderkey % 2 = 0 THEN '11011' ELSE '11014' END AS reprt_code, CASE WHEN o_custkey % 2 = 0 THEN 'CFS' ELSE 'OFS' END AS fs_div,
  strftime(o_orderdate, '%Y%m%d') AS rcept_dt, {_ACCOUNTS!r}[l_linenumber] AS account_nm, CASE WHEN l_quantity > 10 THEN l_extendedprice WHEN l_quantity > 5 THEN 0 END AS cur, l_tax AS prior, o_orderkey, l_linenumber, l_partkey, l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""


def statements(spark, sf) -> DataFrame:
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    cur = F.when(F.col("l_quantity") > 10, F.col("l_extendedprice")).when(F.col("l_quantity") > 5, 0.0)
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.lpad((F.col("o_custkey") % 25).cast("string"), 8, "0").alias("corp_code"), F.year("o_orderdate").cast("string").alias("bsns_year"), F.when(F.col("o_orderkey") % 2 == 0, "11011").otherwise("11014").alias("reprt_code"),
        F.when(F.col("o_custkey") % 2 == 0, "CFS").otherwise("OFS").alias("fs_div"), F.date_format("o_orderdate", "yyyyMMdd").alias("rcept_dt"), F.get(F.array(*map(F.lit, _ACCOUNTS)), F.col("l_linenumber").cast("int") - 1).alias("account_nm"),
        cur.cast("double").alias("thstrm_amount"), F.col("l_tax").cast("double").alias("frmtrm_amount"), F.struct("o_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("ord"),
    )


def _account(label: str) -> str:
    return f"""first(coalesce(cur, prior) ORDER BY coalesce(cur, prior) = 0, o_orderkey, l_linenumber, l_partkey, l_suppkey) FILTER (WHERE trim(account_nm) = '{label}' AND coalesce(cur, prior) IS NOT NULL)"""


@query(
    f"""WITH {_STATEMENTS} SELECT corp_code, bsns_year, reprt_code, fs_div, rcept_dt, {", ".join(f"round({_account(labels[0])}, 4) AS {name}" for name, labels in fixed.KEY_ACCOUNTS)} FROM statements WHERE corp_code = '00000007'
GROUP BY ALL ORDER BY bsns_year DESC, rcept_dt DESC, reprt_code, fs_div LIMIT 10"""
)
def company_statements(spark, sf):
    """The seventh company."""
    out = serving.financial_statements(statements(spark, sf), companies(spark, sf), "NATION_7")
    return out.select("corp_code", "bsns_year", "reprt_code", "fs_div", "rcept_dt", *[F.round(n, 4).alias(n) for n, _ in fixed.KEY_ACCOUNTS])


def _sources(spark, sf) -> list[DataFrame]:
    f = filings(spark, sf).withColumn("rcept_dt", F.date_format("rcept_dt", "yyyyMMdd"))
    return [f.where("cast(rcept_no AS long) % 2 = 0").withColumn("report_nm", F.lit("a")), f, f.where("cast(rcept_no AS long) % 3 = 0").withColumn("report_nm", F.lit("c"))]


_DISCLOSED = f"""WITH {FILINGS}, d AS (SELECT rcept_no, strftime(rcept_dt, '%Y%m%d') AS rcept_dt, CASE WHEN rcept_no::BIGINT % 2 = 0 THEN 'a' ELSE report_nm END AS report_nm FROM filings WHERE corp_code = '00000003' AND rcept_dt BETWEEN DATE '1995-01-01' AND DATE '1997-12-31')"""


@query(f"{_DISCLOSED} SELECT rcept_no, rcept_dt, report_nm FROM d ORDER BY rcept_dt DESC, rcept_no DESC LIMIT 20 OFFSET 20")
def company_disclosures(spark, sf):
    """The second page of the filings of code 3, earlier sources first."""
    return serving.disclosure_events(_sources(spark, sf), companies(spark, sf), "00000003", "1995-01-01", "19971231", 2)[0].select("rcept_no", "rcept_dt", "report_nm")


@query(f"{_DISCLOSED} SELECT 'dart_disclosure' AS source, count(*) AS n FROM (SELECT 1 FROM d LIMIT 20) UNION ALL SELECT 'dart_financial', count(*) FROM (WITH {_STATEMENTS} SELECT DISTINCT corp_code, bsns_year, reprt_code, fs_div, rcept_dt FROM statements WHERE corp_code = '00000003' LIMIT 10)")
def hybrid_answer(spark, sf):
    """A hybrid question runs both sources."""
    handlers = {
        "dart_disclosure": lambda: serving.disclosure_events(_sources(spark, sf), companies(spark, sf), "00000003", "1995-01-01", "19971231")[0].select(F.lit("dart_disclosure").alias("source")),
        "dart_financial": lambda: serving.financial_statements(statements(spark, sf), companies(spark, sf), "00000003").select(F.lit("dart_financial").alias("source")),
    }
    one, two = serving.dispatch("hybrid", handlers)
    return one.union(two).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


_TRADES = """trades AS (SELECT lpad(l_orderkey::VARCHAR, 10, '0') || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS rcept_no, lpad((l_suppkey % 25)::VARCHAR, 8, '0') AS corp_code, strftime(l_shipdate, '%Y-%m-%d') AS rcept_dt, (CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END * 1000)::BIGINT AS x,
  CASE WHEN l_linenumber % 2 = 0 THEN 'majorstock' ELSE 'elestock' END AS ownership_type FROM lineitem)"""


def trades(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    no = F.concat(F.lpad(F.col("l_orderkey").cast("string"), 10, "0"), F.col("l_linenumber").cast("string"), F.lit("-"), F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string"))
    change = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")) * 1000
    return li.select(
        no.alias("rcept_no"), F.lpad((F.col("l_suppkey") % 25).cast("string"), 8, "0").alias("corp_code"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("rcept_dt"), F.format_number(change, 0).alias("stkqy_irds"),
        F.when(F.col("l_linenumber") % 2 == 0, "majorstock").otherwise("elestock").alias("ownership_type"),
    )


@query(f"WITH {_TRADES} SELECT coalesce(sum(x) FILTER (WHERE x > 0), 0)::BIGINT AS bought, coalesce(sum(x) FILTER (WHERE x <= 0), 0)::BIGINT AS sold, count(*) AS total, ceil(count(*) / 20.0)::BIGINT AS total_pages FROM trades WHERE corp_code = '00000002' AND rcept_dt >= '1996-01-01'")
def insider_flow(spark, sf):
    """Sums of a company's transactions, and page totals."""
    _, totals, flow = serving.insider_trades(trades(spark, sf), companies(spark, sf), "000020", "1996-01-01", None)
    return flow.crossJoin(totals)


@query(f"WITH {_TRADES} SELECT rcept_no, rcept_dt FROM trades WHERE corp_code = '00000002' AND rcept_dt >= '1996-01-01' ORDER BY rcept_dt DESC, rcept_no DESC LIMIT 20")
def insider_page(spark, sf):
    """The first page."""
    return serving.insider_trades(trades(spark, sf), companies(spark, sf), "NATION_2", "1996-01-01", None)[0].select("rcept_no", "rcept_dt")


@query(f"WITH {_TRADES} SELECT rcept_no, rcept_dt FROM trades WHERE corp_code = '00000002' AND ownership_type = 'majorstock' ORDER BY rcept_dt DESC, rcept_no DESC LIMIT 20 OFFSET 40")
def shareholder_page(spark, sf):
    """X4."""
    return serving.major_shareholders(trades(spark, sf), companies(spark, sf), "NATION_2", 3)[0].select("rcept_no", "rcept_dt")


@query(f"WITH {REPORTS} SELECT report_id, published FROM reports WHERE published BETWEEN '1997.01.01' AND '1997.03.31' ORDER BY published DESC, report_id LIMIT 20 OFFSET 20")
def reports_page(spark, sf):
    """X6, N9."""
    return serving.reports_between(reports(spark, sf), "1997-01-01", "19970331", 2)[0].select("report_id", "published")


_MODEL = "model AS (SELECT (l_suppkey % 83)::VARCHAR AS ticker, max(round(l_discount * 10)::INT) AS ranking_score FROM lineitem GROUP BY 1)"


def _model(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 83).cast("string").alias("ticker")).agg(F.max(F.round(F.col("l_discount") * 10).cast("int")).alias("ranking_score"))


def _newest(pattern: str, name: str) -> str:
    return f"{name} AS (SELECT lpad(stock_code, 6, '0') AS ticker, report_nm AS {name} FROM filings WHERE rcept_dt BETWEEN DATE '{UNTIL}' - 90 AND DATE '{UNTIL}' AND regexp_matches(report_nm, '{pattern}') QUALIFY row_number() OVER (PARTITION BY stock_code ORDER BY rcept_dt DESC, rcept_no DESC) = 1)"


_REGULAR = "분기보고서|반기보고서|사업보고서|정기공시"


@query(
    f"""WITH {REPORTS}, {FILINGS}, {_MODEL}, q AS (SELECT lpad(stock_code, 6, '0') AS t FROM filings WHERE rcept_dt >= DATE '{UNTIL}' - 92 GROUP BY 1 HAVING bool_or(sentiment = 'positive' OR regexp_matches(report_nm, '{fixed.REGULAR_FILINGS}'))),
b AS (SELECT DISTINCT lpad(code, 6, '0') AS t FROM reports WHERE lpad(code, 6, '0') IN (SELECT lpad(ticker, 6, '0') FROM model) AND lpad(code, 6, '0') <> '000000'),
chosen AS (SELECT t FROM b WHERE t IN (SELECT t FROM q) OR NOT EXISTS (SELECT 1 FROM b JOIN q USING (t))), {_newest(_REGULAR, "last_regular")}, {_newest(fixed.MAJOR_EVENTS, "last_event")}
SELECT report_id, lpad(code, 6, '0') AS ticker, CASE WHEN report_id % 3 = 0 THEN 'why ' || report_id END AS reason, ranking_score, last_regular, last_event FROM reports r LEFT JOIN model m ON m.ticker = r.code
LEFT JOIN last_regular a ON a.ticker = lpad(code, 6, '0') LEFT JOIN last_event e ON e.ticker = lpad(code, 6, '0') WHERE upper(opinion) = 'BUY' AND upside_pct > 0 AND lpad(code, 6, '0') IN (SELECT t FROM chosen)"""
)
def triple_consensus(spark, sf):
    """X8, J8."""
    r = reports(spark, sf)
    llm = r.where("report_id % 3 = 0").select("report_id", F.concat(F.lit("why "), F.col("report_id").cast("string")).alias("reason"), F.lit(None).alias("risks"), F.lit(None).alias("keywords"))
    out = serving.triple_consensus(r, _model(spark, sf), filings(spark, sf), llm, F.lit(UNTIL).cast("date"))
    return out.select("report_id", "ticker", "reason", "ranking_score", "last_regular", "last_event")


@query(
    f"""WITH {FILINGS} SELECT lpad(stock_code, 6, '0') AS ticker, rcept_no, sentiment FROM filings WHERE rcept_dt BETWEEN DATE '2001-07-01' AND DATE '2001-07-31' AND regexp_matches(report_nm, '{fixed.MAJOR_EVENTS}') AND sentiment <> 'neutral' AND report_nm NOT LIKE '%안내%'
AND lpad(stock_code, 6, '0') NOT IN ('000001', '000002') QUALIFY row_number() OVER (PARTITION BY stock_code ORDER BY rcept_no DESC) = 1"""
)
def major_disclosures(spark, sf):
    """X9, J11, P15; a month counts as one day."""
    f = filings(spark, sf).withColumn("rcept_dt", F.trunc("rcept_dt", "MM"))
    day = F.lit("2001-07-01").cast("date")
    chosen = spark.createDataFrame([("000001",), ("000002",)], "ticker string")
    return serving.major_disclosures(f, chosen, day, "안내").select("ticker", "rcept_no", "sentiment")


@query(f"WITH {REPORTS} SELECT report_id, upside_pct FROM reports WHERE upside_pct IS NOT NULL ORDER BY upside_pct DESC, report_id LIMIT 8")
def top_upside(spark, sf):
    """L6, X10."""
    return serving.top_upside(reports(spark, sf)).select("report_id", "upside_pct")


@query("SELECT max(year(o_orderdate)) AS year, max_by(month(o_orderdate), o_orderdate) AS month FROM orders")
def latest_month(spark, sf):
    """L8."""
    return serving.latest_month(table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)")
def of_latest_date(spark, sf):
    """L9, N16."""
    return serving.of_latest_date(table(spark, sf, "orders"), "o_orderdate").select("o_orderkey")


@query("SELECT o_orderkey, 'second' AS tier FROM orders")
def tiered_source(spark, sf):
    """The first source is empty, so the second answers and the third is not asked."""
    o = table(spark, sf, "orders").select("o_orderkey")
    tiers = [o.where("o_orderkey < 0").withColumn("tier", F.lit("first")), o.withColumn("tier", F.lit("second")), o.withColumn("tier", F.lit("third"))]
    return serving.tiered(tiers, ["o_orderkey"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN year(o_orderdate) ELSE 0 END AS year, CASE WHEN o_orderkey % 2 = 0 THEN month(o_orderdate) ELSE 0 END AS month FROM orders")
def filled_partitions(spark, sf):
    """N12."""
    o = table(spark, sf, "orders")
    info = o.select("o_orderkey", F.lit(0).alias("year"), F.lit(0).alias("month"))
    return serving.fill_from_partitions(info, o.where("o_orderkey % 2 = 0").select("o_orderkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")), "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def attached_prices(spark, sf):
    """J4."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return panel.attach_required(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), o, ["l_orderkey"])


@query("SELECT o_orderkey, CASE WHEN c_custkey % 3 = 0 THEN 'UNKNOWN' ELSE coalesce(c_name, 'UNKNOWN') END AS name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 2 = 1")
def attached_names(spark, sf):
    """J5."""
    names = table(spark, sf, "customer").where("c_custkey % 2 = 1").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).otherwise("").alias("name"))
    return panel.attach_named(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), names, "o_custkey", "name").select("o_orderkey", "name")


@query("SELECT c_custkey, max_by(o_orderpriority, struct_pack(a := o_orderdate, b := o_orderkey)) AS corp_cls FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON o_custkey = c_custkey GROUP BY 1")
def latest_class(spark, sf):
    """J13."""
    f = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("corp_cls"), F.col("o_orderdate").alias("rcept_dt"), F.col("o_orderkey").alias("rcept_no"))
    return merge.with_latest_value(table(spark, sf, "customer").select("c_custkey"), f, "c_custkey", "corp_cls")


@query(f"WITH {BARS} SELECT b.date AS feature_date, b.ticker, round(a.close, 6) AS prev_close FROM bars b LEFT JOIN bars a ON a.date = b.date AND a.ticker = b.ticker AND a.volume > 2")
def attached_closes(spark, sf):
    """Predictions without a close stay."""
    b = bars(spark, sf).withColumnRenamed("date", "feature_date")
    closes = b.where("volume > 2").select("feature_date", "ticker", F.round("close", 6).alias("prev_close"))
    return panel.attach_previous_close(b.select("feature_date", "ticker"), closes)


@query(
    """WITH c AS (SELECT c_custkey AS chunk_id, lpad((c_custkey % 25)::VARCHAR, 8, '0') AS corp_code, CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE '' END AS corp_name FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 7 <> 0 AND c_custkey % 5 <> 0)
SELECT chunk_id, coalesce(nullif(corp_name, ''), CASE WHEN n_nationkey < 20 THEN n_name END) AS corp_name FROM c LEFT JOIN nation ON corp_code = lpad(n_nationkey::VARCHAR, 8, '0')"""
)
def index_rows(spark, sf):
    """Current chunks with a vector, named where they lack a name."""
    k = F.col("c_custkey")
    chunks = table(spark, sf, "customer").select(
        k.alias("chunk_id"), F.lpad((k % 25).cast("string"), 8, "0").alias("corp_code"), F.when(k % 4 == 0, F.col("c_name")).otherwise("").alias("corp_name"), F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("is_latest"),
        F.when(k % 7 == 0, F.lit("2020-01-01")).alias("valid_to"), F.when(k % 5 != 0, F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>")).alias("embedding"),
    )
    return vectors.index_rows(filters.current_versions(chunks), companies(spark, sf).where("position < 20")).select("chunk_id", "corp_name")


@query(f"WITH {FILINGS} SELECT count(*) FILTER (WHERE sentiment = 'positive') AS positive, count(*) FILTER (WHERE sentiment = 'negative') AS negative, count(*) FILTER (WHERE sentiment = 'neutral') AS neutral, min(rcept_dt) AS first_date, max(rcept_dt) AS last_date FROM filings")
def sentiment_tallies(spark, sf):
    """A20, A8."""
    f = filings(spark, sf)
    return stats.sentiment_counts(f).crossJoin(stats.date_range(f, "rcept_dt"))


@query(f"WITH {BARS} SELECT date, ticker FROM bars WHERE open > 30 AND high - 30 >= greatest(open - 30, close - 30, low - 30) AND low > 30 AND high > 30 AND close > 30")
def positive_bars(spark, sf):
    """P5, with prices lowered so that some are not positive."""
    return filters.positive_bars(bars(spark, sf).withColumns({c: F.col(c) - 30 for c in ("open", "high", "low", "close")})).select("date", "ticker")


_ERRORS = ["HTTP 020 limit", "Read TIMEOUT", "Connection reset", "quota over", "not found"]


@query(f"SELECT event_id FROM (SELECT event_id, {_ERRORS!r}[1 + event_id % 5] AS e, CASE WHEN event_id % 3 = 0 THEN 'done' ELSE 'failed' END AS s FROM events) WHERE s = 'failed' AND (e LIKE '%020%' OR e ILIKE '%timeout%' OR e ILIKE '%connection%' OR e ILIKE '%quota%')")
def retryable_calls(spark, sf):
    """P14."""
    e = table(spark, sf, "events")
    error = F.get(F.array(*map(F.lit, _ERRORS)), (F.col("event_id") % 5).cast("int"))
    return e.where(filters.retryable(error, F.when(F.col("event_id") % 3 == 0, "done").otherwise("failed"))).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 AND o_orderpriority <> '5-LOW'")
def embeddable_chunks(spark, sf):
    """P16."""
    k = F.col("o_orderkey")
    c = table(spark, sf, "orders").select("o_orderkey", (k % 2 == 0).alias("embeddable"), F.when(k % 3 != 0, F.col("o_orderdate")).alias("rcept_dt"), F.when(F.col("o_orderpriority") == "5-LOW", "DISCLOSURE").otherwise(F.col("o_orderpriority")).alias("report_type"))
    return filters.embeddable(c).select("o_orderkey")


@query(f"WITH {REPORTS} SELECT code, list(opinion ORDER BY published, report_id) AS opinions, count(*) AS reports FROM reports WHERE opinion IS NOT NULL GROUP BY code ORDER BY reports DESC, code LIMIT 3")
def compared_reports(spark, sf):
    """N10."""
    return stats.compare_reports(reports(spark, sf).where("opinion IS NOT NULL"), "code", "opinion", F.struct("published", "report_id"))


@query(f"WITH {BARS} SELECT count(*) AS rows, 9 AS columns, min(date) AS first_date, max(date) AS last_date FROM bars")
def feature_metadata(spark, sf):
    """N23."""
    return stats.feature_metadata(bars(spark, sf))


@query("SELECT round(count(DISTINCT CASE WHEN event_type <> 'error' THEN user_id END) / count(DISTINCT user_id)::DOUBLE, 6) AS ratio, count(DISTINCT CASE WHEN event_type <> 'error' THEN user_id END) / count(DISTINCT user_id)::DOUBLE >= 0.95 AS accepted FROM events")
def download_ratio(spark, sf):
    """Q6."""
    return stats.download_ratio(table(spark, sf, "events"), "user_id", F.col("event_type") != "error").withColumn("ratio", F.round("ratio", 6))


@query("SELECT count(*) FILTER (WHERE user_id % 3 = 0) AS a, count(*) FILTER (WHERE user_id % 4 = 0 OR user_id % 5 = 0) AS b FROM events")
def not_finite(spark, sf):
    """Nulls, NaN and infinities."""
    u = F.col("user_id")
    e = table(spark, sf, "events").select(F.when(u % 3 != 0, F.col("value")).alias("a"), F.when(u % 4 == 0, float("nan")).when(u % 5 == 0, float("inf")).otherwise(F.col("value")).alias("b"))
    return stats.not_finite(e, ["a", "b"])


@query("SELECT count(*) FILTER (WHERE o_orderkey % 10 < 2) AS late_rows, 1 AS forbidden_features FROM orders")
def leakage(spark, sf):
    """M16, Q4."""
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("feature_date"), F.when(k % 10 == 0, F.col("o_orderdate").cast("date")).when(k % 10 == 1, F.date_sub("o_orderdate", 1)).otherwise(F.date_add("o_orderdate", 1)).alias("target_date"))
    return stats.leaks(rows, features=["return_1d", "target_gap"])


@query("""SELECT event_id, sha256('{"event_type":"' || event_type || '","user_id":' || user_id || '}') AS h FROM events""")
def request_hashes(spark, sf):
    """Whatever the order in which the columns are named."""
    e = table(spark, sf, "events")
    return e.select("event_id", merge.request_hash(e, ["user_id", "event_type"]).alias("h"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN ['b', 'a'] WHEN 1 THEN ['c', 'b'] ELSE ['a', 'c'] END AS lines FROM orders")
def distinct_lines(spark, sf):
    """U13."""
    k, line = F.col("o_orderkey") % 3, lambda *x: F.array(*[F.lit(v) for v in x])
    lines = F.when(k == 0, line("b", "a", " ", "b", None)).when(k == 1, line("", "c", "c", "b")).otherwise(line("a", "c", "a", ""))
    return table(spark, sf, "orders").select("o_orderkey", merge.distinct_in_order(lines).alias("lines"))


@query("SELECT o_orderkey AS job_id FROM orders WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1997-06-30' ORDER BY o_orderpriority DESC, o_orderdate, o_orderkey LIMIT 50")
def claimed_jobs(spark, sf):
    """L10."""
    q = table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").cast("timestamp").alias("scheduled_at"))
    return merge.claim(q, 50, F.lit("1997-06-30").cast("timestamp")).select("job_id")


@query(f"WITH {BARS} SELECT date, ticker, CASE WHEN date = DATE '2024-01-10' THEN close * 2 ELSE close END AS close FROM bars WHERE date <> DATE '2024-01-10' OR volume > 2")
def replaced_date(spark, sf):
    """One date gives way to new rows."""
    b = bars(spark, sf).select("date", "ticker", "close", "volume")
    new = b.where("date = DATE '2024-01-10' AND volume > 2").withColumn("close", F.col("close") * 2)
    return merge.replace_date(b, new, "date", "2024-01-10").drop("volume")


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-15 12:00:00' AND user_id % 4 <> 0 AND lpad((user_id % 30)::VARCHAR, 2, '0') > '12'")
def increments(spark, sf):
    """Increments after a run, and rows since a time."""
    e = table(spark, sf, "events").withColumns({"run_id": F.lpad((F.col("user_id") % 30).cast("string"), 2, "0"), "ingest_mode": F.when(F.col("user_id") % 4 == 0, "backfill").otherwise("daily")})
    return incremental.changed_since(incremental.since_run(e, "12"), "ts", "2024-01-15 12:00:00").select("event_id")


@query("SELECT count(*) AS rows, count(DISTINCT o_custkey) AS tickers, min(CAST(o_orderdate AS DATE)) AS first_date, max(CAST(o_orderdate AS DATE)) AS last_date, 'survivorship bias: only current listings' AS warning FROM orders")
def universe_notes(spark, sf):
    """N24."""
    return filters.universe_notes(table(spark, sf, "orders").select(F.col("o_custkey").alias("ticker"), F.col("o_orderdate").cast("date").alias("date")))


@query(
    """WITH b AS (SELECT date_trunc('year', min(o_orderdate))::DATE AS f, max(o_orderdate)::DATE AS l FROM orders)
SELECT i::INT AS fold_id, f AS train_start, (f + to_years(2 + i::INT) - INTERVAL 1 DAY)::DATE AS train_end, (f + to_years(2 + i::INT))::DATE AS valid_start, (f + to_years(3 + i::INT) - INTERVAL 1 DAY)::DATE AS valid_end,
(f + to_years(3 + i::INT))::DATE AS test_start, (f + to_years(4 + i::INT) - INTERVAL 1 DAY)::DATE AS test_end FROM b, range(1, 100) t(i) WHERE f + to_years(4 + i::INT) <= l"""
)
def yearly_folds(spark, sf):
    """M5: folds over the years of the table's dates."""
    day = F.col("o_orderdate").cast("date")
    first, last = table(spark, sf, "orders").agg(F.trunc(F.min(day), "year"), F.max(day)).first()
    return learn.expanding_folds(spark, first, 3, 1, 1, last)


@query(
    f"""WITH {BARS}, {PREDICTIONS}, s AS (SELECT p.*, b.close * b.volume AS value, target_gap AS pred_gap FROM p JOIN bars b USING (date, ticker))
SELECT date, ticker, {_r('pred_gap', 'pred_gap')} FROM s WHERE value >= 100 AND abs(predicted) <= 0.8 AND abs(predicted) / 2 <= 0.8 AND abs(pred_gap) <= 0.5 AND value / 1000 >= 0.2"""
)
def acceptable_candidates(spark, sf):
    """Liquidity, risk and gap limits."""
    p = _predictions(spark, sf).join(bars(spark, sf).select("date", "ticker", (F.col("close") * F.col("volume")).alias("trading_value_ma20")), ["date", "ticker"])
    p = p.withColumns({"trading_value_rank_pct": F.col("trading_value_ma20") / 1000, "atr_percent": F.abs("predicted"), "volatility_20d": F.abs("predicted") / 2, "pred_gap": F.col("target_gap")})
    return shown(portfolio.acceptable(p, 100, 0.2, 0.8, 0.5), ["pred_gap"])


@query("SELECT unnest(['b', 'd']) AS dropped")
def redundant_features(spark, sf):
    """Columns that repeat an earlier one, exactly or in scale."""
    e = table(spark, sf, "events").select(F.col("value").alias("a"), (F.col("value") * 2 + 1).alias("b"), F.col("user_id").alias("c"), F.col("user_id").alias("d"))
    return spark.createDataFrame([(c,) for c in stats.redundant(e, ["a", "b", "c", "d"])], "dropped string")


# ---- texts and numbers

_TYPES = ["0051", "REGULAR", "", "OWNERSHIP"]


@query(
    f"""WITH k AS (SELECT o_orderkey, {_TYPES!r}[1 + o_orderkey % 4] AS kind, CASE WHEN o_orderkey % 3 = 0 THEN 'majorstock' WHEN o_orderkey % 3 = 1 THEN 'none' END AS section FROM orders), c AS (SELECT *, CASE WHEN kind = '0051' THEN 'MATERIAL_EVENT' WHEN kind = '' THEN 'DISCLOSURE' ELSE kind END AS type FROM k)
SELECT o_orderkey, type, CASE WHEN section = 'majorstock' THEN 0.6 WHEN type = 'MATERIAL_EVENT' THEN 0.9 WHEN type = 'REGULAR' THEN 0.5 WHEN type = 'OWNERSHIP' THEN 0.6 ELSE 0.0 END AS importance,
array_to_string(list_sort([CASE type WHEN 'MATERIAL_EVENT' THEN '주요사항보고서' WHEN 'REGULAR' THEN '정기보고서' WHEN 'OWNERSHIP' THEN '지분공시' ELSE '공시' END, 'Z']), ',') AS words FROM c"""
)
def type_labels(spark, sf):
    """F17, G17."""
    k = F.col("o_orderkey")
    kind, section = F.get(F.array(*map(F.lit, _TYPES)), (k % 4).cast("int")), F.when(k % 3 == 0, "majorstock").when(k % 3 == 1, "none")
    return table(spark, sf, "orders").select("o_orderkey", T.canonical_type(kind).alias("type"), T.importance(kind, section).cast("double").alias("importance"), F.array_join(T.keywords(kind, F.lit("Z")), ",").alias("words"))


@query("SELECT c_custkey, concat_ws(' / ', CASE WHEN c_custkey % 2 = 0 THEN '이름: ' || c_name END, CASE WHEN c_custkey % 3 = 0 THEN '구분: ' || c_mktsegment END) AS shown, c_name || '. 구분 ' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN ', 번호 ' || c_custkey ELSE '' END AS line, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS filled FROM customer")
def rendered_records(spark, sf):
    """fields without words and empty ones are left out."""
    k = F.col("c_custkey")
    name, segment = F.when(k % 2 == 0, F.col("c_name")).otherwise("-"), F.when(k % 3 == 0, F.col("c_mktsegment")).otherwise(" 12,345 ")
    m = F.create_map(F.lit("nm"), name, F.lit("sg"), segment, F.lit("no"), F.lit("99"))
    line = T.summary_line(F.col("c_name"), [("구분", F.col("c_mktsegment")), ("번호", F.when(k % 2 == 0, k.cast("string")))])
    return table(spark, sf, "customer").select("c_custkey", T.labelled_text(m, {"nm": "이름", "sg": "구분", "no": "번호"}).alias("shown"), line.alias("line"), T.first_filled(F.lit(" nan "), name, F.col("c_mktsegment")).alias("filled"))


@query("SELECT c_custkey, 'about ' || c_name AS reason, ['risk ' || c_mktsegment] AS risks, CASE c_custkey % 4 WHEN 0 THEN ['k'] WHEN 1 THEN ['k', 'l'] ELSE [] END AS keywords, CASE c_custkey % 3 WHEN 0 THEN 'positive' ELSE 'neutral' END AS sentiment FROM customer")
def read_answers(spark, sf):
    """Answers that are whole, fenced, cut off or carry a single text for a list."""
    k, q = F.col("c_custkey"), '{"reason": "about  %s", "risks": '
    start = F.format_string(q, "c_name")
    risk = F.concat(F.lit('"risk '), F.col("c_mktsegment"), F.lit('"'))
    whole = F.concat(F.lit("```json\n"), start, F.lit("["), risk, F.lit('], "keywords": ["k", ""]}\n```'))
    single = F.concat(F.lit("say: "), start, risk, F.lit(', "keywords": ["k", "l"]} bye'))
    cut = F.concat(start, F.lit("["), risk, F.lit(', "half'))
    answer = F.when(k % 4 == 0, whole).when(k % 4 == 1, single).otherwise(cut)
    said = F.when(k % 3 == 0, 'so {"sentiment": "Positive"}').when(k % 3 == 1, '{"sentiment": "great"}').otherwise("none")
    return table(spark, sf, "customer").select("c_custkey", T.llm_fields(answer).alias("f"), T.sentiment(said).alias("sentiment")).select("c_custkey", "f.*", "sentiment")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN [lpad(o_orderkey::VARCHAR, 14, '0')] ELSE []::VARCHAR[] END AS ungrounded, CASE WHEN o_orderkey % 2 = 0 THEN 'see' ELSE 'see' || chr(10) || '- 원문: https://x.y/v?rcpNo=' || lpad(o_orderkey::VARCHAR, 14, '0') END AS kept FROM orders")
def grounded_links(spark, sf):
    """addresses whose receipt number the context lacks go."""
    no = F.lpad(F.col("o_orderkey").cast("string"), 14, "0")
    answer = F.concat(F.lit("see\n- 원문: https://x.y/v?rcpNo="), no)
    context = F.when(F.col("o_orderkey") % 2 == 0, F.lit("nothing")).otherwise(F.concat(F.lit("filing "), no, F.lit(" of today")))
    return table(spark, sf, "orders").select("o_orderkey", T.ungrounded(answer, context).alias("ungrounded"), T.without_ungrounded(answer, context).alias("kept"))


@query("SELECT r_regionkey, '<b>' || r_name || '</b>' || chr(10) || '• <b>a</b> <i>b</i> <code>c &lt; d</code>' || chr(10) || '<a href=\"https://x.y/z\">link</a>' AS html FROM region")
def markdown(spark, sf):
    """F22."""
    md = F.concat(F.lit("## "), F.col("r_name"), F.lit("\n- **a** *b* `c < d`\n[link](https://x.y/z)"))
    return table(spark, sf, "region").select("r_regionkey", T.markdown_html(md).alias("html"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'Short one.' WHEN 1 THEN 'First sentence.' ELSE repeat('x', 30) END AS s FROM orders")
def first_sentences(spark, sf):
    """F23, at 30 characters."""
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, "  Short \n one. ").when(k == 1, "First sentence. Then a second that is long").otherwise(F.repeat(F.lit("x"), 50))
    return table(spark, sf, "orders").select("o_orderkey", T.first_sentence(text, 30).alias("s"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y') || '년 ' || month(o_orderdate) || '월 report' AS full_year, CASE WHEN o_orderkey % 2 = 0 THEN month(o_orderdate) END AS month, CASE WHEN o_orderkey % 2 = 0 THEN day(o_orderdate) END AS day, CAST(o_orderdate AS DATE) - CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS target FROM (SELECT o_orderkey, o_orderdate + INTERVAL 3650 DAY AS o_orderdate FROM orders)")
def spoken_dates(spark, sf):
    """Two-digit years, month and day in words, and the local date before an interval's end."""
    d, k = F.expr("o_orderdate + INTERVAL 3650 DAY"), F.col("o_orderkey")
    o = table(spark, sf, "orders").withColumn("d", d)
    m = D.month_day(F.when(k % 2 == 0, F.date_format("d", "M'월' d'일'")).otherwise("soon"))
    end = F.when(k % 2 == 0, F.col("d").cast("timestamp")).otherwise(F.col("d").cast("timestamp") + F.expr("INTERVAL 16 HOURS"))
    return o.select("o_orderkey", D.expand_two_digit_year(F.concat(F.date_format("d", "yy'년 'M'월'"), F.lit(" report"))).alias("full_year"), m["month"].alias("month"), m["day"].alias("day"), D.seoul_target_date(end).alias("target"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / nullif(l_quantity - 5, 0) AS x FROM lineitem")
def divided(spark, sf):
    """G9."""
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", N.safe_divide(F.col("l_extendedprice"), F.col("l_quantity") - 5).alias("x"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '005merger' WHEN 1 THEN 'multi' ELSE 'unclassified' END AS kind, 1 + (o_orderkey % 2)::INT AS rows FROM orders")
def event_kinds(spark, sf):
    """Records of the filing or of none, and the filing's one event type."""
    k = F.col("o_orderkey")
    names = F.when(k % 3 == 0, F.array(F.lit("merger"))).when(k % 3 == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    rows = F.array(F.create_map(F.lit("rcept_no"), F.when(k % 2 == 0, "other").otherwise(k.cast("string"))), F.create_map(F.lit("x"), F.lit("y")))
    return table(spark, sf, "orders").select("o_orderkey", T.event_type(names).alias("kind"), F.size(T.event_rows(rows, k.cast("string"))).alias("rows"))
