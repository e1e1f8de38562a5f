"""Queries over filings that are built from ``orders`` and ``lineitem`` as nested records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents, merge
from ..session import table
from .registry import query

#: Lines of orders that one task gathers into filings: few as long as there are at most ``TASKS`` tasks, so many as which
#: Spark writes to without holding rows, and never more than ``MOST_LINES``.
FEW_LINES, MOST_LINES, TASKS = 50_000, 1_250_000, 200


def _tasks(lines) -> int:
    n = lines.count()
    return max(1, -(-n // MOST_LINES), min(TASKS, -(-n // FEW_LINES)))


def reports(spark, sf):
    """One filing per order; its lines are its structured, event and ownership records."""
    li = table(spark, sf, "lineitem")
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_extendedprice")
    # only plain columns are dealt and gathered; records are made after
    lines = li.repartition(_tasks(li), "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("x"))
    record = lambda s: F.create_map(
        F.lit("nm"), s["l_returnflag"], F.lit("account_nm"), F.concat(F.lit("계정"), s["l_linenumber"].cast("string")), F.lit("account_id"), F.concat(F.lit("a"), s["l_partkey"].cast("string")),
        F.lit("thstrm_amount"), F.format_number(s["l_extendedprice"], 0), F.lit("ord"), s["l_linenumber"].cast("string"), F.lit("sj_div"), F.lit("BS"), F.lit("repror"), F.concat(F.lit("h"), (s["l_suppkey"] % 3).cast("string")),
    )
    records = F.transform("x", record)
    meta = F.struct(
        F.lpad((F.col("o_custkey") % 50).cast("string"), 8, "0").alias("corp_code"), F.concat(F.lit("회사"), (F.col("o_custkey") % 50).cast("string")).alias("corp_name"), F.lpad((F.col("o_custkey") % 50).cast("string"), 6, "0").alias("stock_code"),
        F.lpad(F.col("o_orderkey").cast("string"), 14, "0").alias("rcept_no"), F.date_format("o_orderdate", "yyyyMMdd").alias("rcept_dt"), F.col("o_orderpriority").alias("report_nm"), F.when(F.col("o_orderstatus") == "F", "REGULAR").otherwise("005x").alias("report_type"), F.lit(True).alias("is_latest"),
    )
    one = lambda name: F.create_map(F.lit(name), records)
    return table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        meta.alias("meta"), F.create_map(F.lit("induty_code"), F.lit("26410"), F.lit("ceo_nm"), F.col("o_orderpriority")).alias("company_overview"), one("CFS").alias("financials"), one("emplyMttrs").alias("structured"),
        one("merger").alias("event_reports"), one("majorstock").alias("ownership"), one("bond").alias("securities"), F.struct(F.col("o_orderpriority").alias("text")).alias("document"),
    )


_DAY = "strftime(o_orderdate, '%Y%m%d')"
_J = "orders JOIN lineitem ON o_orderkey = l_orderkey"
_NO = "lpad(o_orderkey::VARCHAR, 14, '0')"


@query(f"SELECT 'dart:' || lpad((o_custkey % 50)::VARCHAR, 8, '0') || ':' || {_NO} || ':' || CASE WHEN o_orderstatus = 'F' THEN 'REGULAR' ELSE '005x' END AS doc_id, strftime(o_orderdate, '%Y') AS rcept_year, strftime(o_orderdate, '%m') AS rcept_month FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def filing_registry(spark, sf):
    """D2."""
    return documents.registry(reports(spark, sf)).select("doc_id", "rcept_year", "rcept_month")


@query(f"SELECT {_NO} || ':CFS:BS:' || l_linenumber || ':a' || l_partkey AS fact_id, '계정' || l_linenumber AS account_nm, count(*) AS n FROM {_J} GROUP BY 1, 2")
def filing_financials(spark, sf):
    """D3."""
    keys = ["fact_id", "account_nm"]
    rows = documents.financial_rows(reports(spark, sf)).select(*keys)
    return rows.repartition(_tasks(table(spark, sf, "lineitem")), *keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT {_NO} || ':merger:' || (row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1) AS event_id, 'merger' AS event_type, strftime(o_orderdate, '%Y') AS rcept_year FROM {_J}")
def filing_events(spark, sf):
    """D4."""
    return documents.event_rows(reports(spark, sf)).select("event_id", "event_type", "rcept_year")


@query(f"WITH r AS (SELECT lpad((o_custkey % 50)::VARCHAR, 8, '0') AS corp_code, {_NO} AS rcept_no, 'h' || (l_suppkey % 3) AS repror, {_DAY} AS d FROM {_J}) SELECT corp_code, repror, rcept_no FROM r QUALIFY row_number() OVER (PARTITION BY corp_code, repror ORDER BY d DESC, rcept_no DESC) = 1")
def filing_ownership(spark, sf):
    """D5, W24."""
    return documents.ownership_rows(reports(spark, sf)).select("corp_code", "repror", "rcept_no")


@query(f"SELECT lpad((o_custkey % 50)::VARCHAR, 8, '0') AS corp_code, {_NO} AS rcept_no, '전자부품, 컴퓨터, 영상, 음향 및 통신장비 제조업' AS industry FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def filing_snapshots(spark, sf):
    """D2, G16."""
    return documents.company_snapshot(reports(spark, sf)).select("corp_code", "rcept_no", "industry")


@query(
    f"""SELECT {_NO} AS rcept_no, sum(l_linenumber)::BIGINT AS employees, max(l_linenumber)::DOUBLE AS top_share, max('h' || (l_suppkey % 3)) FILTER (WHERE l_linenumber = m) AS top_holder,
first('h' || (l_suppkey % 3) ORDER BY l_partkey, l_suppkey) FILTER (WHERE l_linenumber = 2) AS ceo FROM (SELECT *, max(l_linenumber) OVER (PARTITION BY o_orderkey) AS m FROM {_J}) GROUP BY o_orderkey"""
)
def filing_people(spark, sf):
    """A10."""
    lines = F.try_element_at("structured", F.lit("emplyMttrs"))
    at = lambda r, n: F.try_element_at(r, F.lit(n))
    tables = {
        "emplyMttrs": lambda r: F.create_map(F.lit("sm"), at(r, "ord")),
        "hyslrSttus": lambda r: F.create_map(F.lit("nm"), at(r, "repror"), F.lit("trmend_posesn_stock_qota_rt"), at(r, "ord")),
        "exctvSttus": lambda r: F.create_map(F.lit("nm"), at(r, "repror"), F.lit("ofcps"), F.when(at(r, "ord") == "2", "대표이사").otherwise("이사")),
    }
    r = reports(spark, sf).withColumn("structured", F.create_map(*[x for n, f in tables.items() for x in (F.lit(n), F.transform(lines, f))]))
    return documents.people(r).select("rcept_no", "employees", "top_share", "top_holder", "ceo")


@query("SELECT CASE WHEN o_orderkey % 10 = 0 OR o_orderkey % 10 = 2 THEN 'ERROR' WHEN o_orderkey % 10 IN (4, 5) THEN 'WARN' ELSE 'OK' END AS severity, o_orderkey % 10 = 1 AS spaced, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1, 2")
def filing_gate(spark, sf):
    """Filings without a company code, with a garbled name, without a name or a date."""
    r = reports(spark, sf).withColumn("k", F.col("meta.rcept_no").cast("long") % 10)
    garbled = "삼성전자".encode().decode("latin-1")
    name = F.when(F.col("k") == 2, garbled).when(F.col("k") == 4, "").when(F.col("k") == 1, F.concat(F.lit(" "), F.col("meta.corp_name"))).otherwise(F.col("meta.corp_name"))
    meta = F.col("meta").withField("corp_code", F.when(F.col("k") != 0, F.col("meta.corp_code"))).withField("corp_name", name).withField("rcept_dt", F.when(F.col("k") != 5, F.col("meta.rcept_dt")))
    return documents.gate(r.withColumn("meta", meta)).groupBy("severity", (F.col("k") == 1).alias("spaced")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH r AS (SELECT {_NO} AS rcept_no, '회사' || (o_custkey % 50) || '. 보고서 ' || o_orderpriority || ', 접수일 ' || {_DAY} AS card, o_orderpriority AS body, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders)
SELECT rcept_no, 'summary_card' AS rag_doc_type, 1 AS lines, card AS first_line FROM r WHERE n > 0 UNION ALL SELECT rcept_no, 'document_text', 1, body FROM r WHERE n > 0 UNION ALL SELECT rcept_no, 'financial_summary', n, '계정' FROM r WHERE n > 0"""
)
def filing_summaries(spark, sf):
    """The texts of a filing that are cut into chunks."""
    lines = F.split("text", "\n")
    first = F.when(F.col("rag_doc_type") == "financial_summary", F.substring("text", 1, 2)).otherwise(F.get(lines, F.lit(0)))
    return documents.summary_documents(reports(spark, sf)).select("rcept_no", "rag_doc_type", F.size(lines).alias("lines"), first.alias("first_line"))


@query(f"SELECT 'dart:00000001:' || {_NO} || ':event:' || substr(sha1(o_orderpriority), 1, 8) || ':' || lpad((o_orderkey % 500)::VARCHAR, 3, '0') AS chunk_id FROM orders")
def chunk_ids(spark, sf):
    """Ids of chunks that come from keyed records."""
    o = table(spark, sf, "orders")
    return o.select(documents.keyed_chunk_id(F.lit("00000001"), F.lpad(F.col("o_orderkey").cast("string"), 14, "0"), F.lit("event"), F.col("o_orderpriority"), (F.col("o_orderkey") % 500).cast("int")).alias("chunk_id"))


@query(
    """WITH l AS (SELECT l_orderkey, l_linenumber, max(l_quantity)::BIGINT AS q FROM lineitem GROUP BY 1, 2)
SELECT o_orderkey AS rcept_no, max(q) FILTER (WHERE l_linenumber = 1)::VARCHAR AS financials, max(q) FILTER (WHERE l_linenumber = 3)::VARCHAR AS event_reports, count(*) FILTER (WHERE l_linenumber = 5)::INT AS securities FROM orders LEFT JOIN l ON o_orderkey = l_orderkey GROUP BY 1"""
)
def assembled_filings(spark, sf):
    """A marker with its artifacts of five kinds."""
    kinds = F.array(*[F.lit(k) for k in ("financials", "structured", "event_reports", "ownership", "securities")])
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("rcept_no"), "l_linenumber").agg(F.max("l_quantity").cast("long").cast("string").alias("q"))
    artifacts = lines.where("l_linenumber <= 5").select("rcept_no", F.get(kinds, F.col("l_linenumber").cast("int") - 1).alias("kind"), F.lit("x").alias("name"), F.array(F.create_map(F.lit("q"), F.col("q"))).alias("records"))
    whole = documents.assemble(table(spark, sf, "orders").select(F.col("o_orderkey").alias("rcept_no")), artifacts)
    first = lambda c: F.try_element_at(F.get(F.try_element_at(F.col(c), F.lit("x")), F.lit(0)), F.lit("q"))
    return whole.select("rcept_no", first("financials").alias("financials"), first("event_reports").alias("event_reports"), F.coalesce(F.size(F.map_keys("securities")), F.lit(0)).alias("securities"))


@query()
def filing_chunks(spark, sf):
    """D7, D8, D11; rows only."""
    return documents.chunks(documents.summary_documents(reports(spark, sf))).select("chunk_id", "token_count")


@query(
    f"""WITH d AS (SELECT DISTINCT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT lpad(o_orderkey::VARCHAR, 14, '0') AS doc_id, c_name AS mentioned_name, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS resolved_code, CASE WHEN c_custkey % 2 = 0 THEN 0.9 ELSE 0.4 END AS confidence FROM d JOIN customer USING (c_name)"""
)
def filing_relations(spark, sf):
    """D9, J15."""
    c = table(spark, sf, "customer")
    mentions = table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.lpad(F.col("o_orderkey").cast("string"), 14, "0").alias("doc_id"), F.lit("holder").alias("relation_type"), F.col("c_name").alias("mentioned_name"), F.lit(0).alias("position"))
    companies = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("corp_code"), F.col("c_name").alias("corp_name"), F.lit(True).alias("is_listed"))
    return documents.relations(mentions, companies).select("doc_id", "mentioned_name", "resolved_code", F.col("confidence").cast("double").alias("confidence"))


@query(
    f"""SELECT lpad((o_custkey % 50)::VARCHAR, 8, '0') AS corp_code, max({_DAY}) AS latest_dt, max_by(o_orderpriority, {_DAY} || {_NO}) AS ceo_nm, '전자부품, 컴퓨터, 영상, 음향 및 통신장비 제조업' AS industry, count(*) AS filings,
[lpad((o_custkey % 50)::VARCHAR, 6, '0')] AS related FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY o_custkey % 50"""
)
def filing_context(spark, sf):
    """J17, A22, W25, W26, X12."""
    r = reports(spark, sf)
    snapshots = documents.company_snapshot(r)
    summaries = documents.summary_documents(r).where("rag_doc_type = 'summary_card'").withColumn("rcept_dt", F.lit("20200101"))
    relations = documents.registry(r).select("corp_code", F.col("stock_code").alias("resolved_code"))
    market = documents.registry(r).groupBy("corp_code").agg(F.count(F.lit(1)).alias("filings"))
    return documents.company_context(documents.registry(r), snapshots, summaries, relations, market).select("corp_code", "latest_dt", "ceo_nm", "industry", "filings", F.col("related_corp_codes").alias("related"))


@query("SELECT o_orderkey % 1000 AS event_id, max(floor(o_totalprice))::BIGINT AS amount FROM orders GROUP BY 1")
def merge_material_events(spark, sf):
    """A concrete merge with casts and an explicit order."""
    o = table(spark, sf, "orders").select((F.col("o_orderkey") % 1000).alias("event_id"), F.floor("o_totalprice").cast("string").alias("amount"), F.lit("1").alias("is_latest"), "o_totalprice")
    target = o.where("event_id < 10").select("event_id", F.lit(0).cast("long").alias("amount"), F.lit(False).alias("is_latest")).dropDuplicates(["event_id"])
    return merge.merge_table("material_event", target, o, [F.desc("o_totalprice")]).select("event_id", "amount")
