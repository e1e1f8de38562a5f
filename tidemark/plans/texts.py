"""Queries for text, date and number functions, vectors, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import numbers as N
from ..functions import text as T
from ..operators import documents, ivf, serving, stats, vectors
from ..session import scratch, table
from ..sources import readers
from .registry import query


@query("SELECT doc_id, CASE WHEN length(t) > 60 THEN replace(replace(replace(regexp_replace(substr(t, 1, 60), ' [^ ]*$', ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '...' ELSE replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') END AS short FROM (SELECT doc_id, replace(text, chr(10), ' ') AS t FROM documents)")
def truncated_text(spark, sf):
    """F21."""
    return table(spark, sf, "documents").select("doc_id", T.truncate(F.replace("text", F.lit("\n"), F.lit(" ")), 60).alias("short"))


@query("SELECT doc_id, regexp_replace(regexp_replace(lower(trim(text)), '\\([^)]*\\)', '', 'g'), '[^0-9a-z가-힣]', '', 'g') AS k FROM (SELECT doc_id, replace(replace(lower(text), 'corp', ''), 'inc', '') AS text FROM documents)")
def company_keys(spark, sf):
    """F13."""
    base = F.replace(F.replace(F.lower("text"), F.lit("corp"), F.lit("")), F.lit("inc"), F.lit(""))
    return table(spark, sf, "documents").select("doc_id", T.company_key(base).alias("k"))


@query(
    """WITH n AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '[기재정정]사업보고서 (2023.12)' WHEN 1 THEN '분기보고서  (2024.03)' WHEN 2 THEN '주식등의대량보유상황보고서' WHEN 3 THEN '주요사항보고서(유상증자결정)' WHEN 4 THEN '투자설명서' ELSE '기타공시' END AS nm FROM orders)
SELECT o_orderkey, trim(regexp_replace(replace(nm, '[기재정정]', ''), '\\s+', ' ', 'g')) AS name, nm LIKE '%[기재정정]%' AS corrected,
CASE o_orderkey % 6 WHEN 0 THEN 'REGULAR' WHEN 1 THEN 'REGULAR' WHEN 2 THEN 'OWNERSHIP' WHEN 3 THEN 'MATERIAL_EVENT' WHEN 4 THEN 'SECURITIES_REGISTRATION' ELSE 'DISCLOSURE' END AS kind,
CASE o_orderkey % 6 WHEN 0 THEN '11011' WHEN 1 THEN '11014' END AS code, CASE o_orderkey % 6 WHEN 0 THEN '2023' WHEN 1 THEN '2024' ELSE '1999' END AS year FROM n"""
)
def report_names(spark, sf):
    """F14-F16."""
    k = F.col("o_orderkey") % 6
    nm = F.when(k == 0, "[기재정정]사업보고서 (2023.12)").when(k == 1, "분기보고서  (2024.03)").when(k == 2, "주식등의대량보유상황보고서").when(k == 3, "주요사항보고서(유상증자결정)").when(k == 4, "투자설명서").otherwise("기타공시")
    o = table(spark, sf, "orders").select("o_orderkey", nm.alias("nm"))
    n, none = F.col("nm"), F.lit(None).cast("string")
    return o.select("o_orderkey", T.report_name(n).alias("name"), T.is_correction(n).alias("corrected"), T.report_type(n, none, none).alias("kind"), T.report_code(n).alias("code"), T.fiscal_year(n, F.lit("19990101")).alias("year"))


@query("SELECT doc_id, ceil((length(text)) / 2.0)::INT AS tokens FROM documents")
def approx_tokens(spark, sf):
    """D6."""
    return table(spark, sf, "documents").select("doc_id", T.approx_tokens(F.col("text")).alias("tokens"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, CAST(o_orderdate AS DATE) AS real_date, strftime(o_orderdate, '%Y%m%d') AS digits FROM orders")
def date_formats(spark, sf):
    """Five formats name the same day."""
    k = F.col("o_orderkey") % 4
    d = F.col("o_orderdate")
    text = F.when(k == 0, F.date_format(d, "yyyyMMdd")).when(k == 1, F.date_format(d, "yyyy.MM.dd")).when(k == 2, F.date_format(d, "yyyy'년 'M'월 'd'일'")).otherwise(F.date_format(d, "yyyy-M-d"))
    return table(spark, sf, "orders").select("o_orderkey", D.iso_date(text).alias("iso"), D.to_real_date(text).alias("real_date"), D.digits8(F.date_format(d, "yyyy-MM-dd HH")).alias("digits"))


@query(
    """SELECT o_orderkey, CAST(CASE isodow(d) WHEN 7 THEN d - 2 WHEN 6 THEN d - 1 ELSE d END AS DATE) AS previous_day, CAST(CASE isodow(d) WHEN 5 THEN d + 3 WHEN 6 THEN d + 2 ELSE d + 1 END AS DATE) AS next_day,
CAST(CASE isodow(d - 1) WHEN 7 THEN d - 3 WHEN 6 THEN d - 2 ELSE d - 1 END AS DATE) AS target_day FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)"""
)
def business_days(spark, sf):
    """G6."""
    d = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").select("o_orderkey", D.previous_business_day(d).alias("previous_day"), D.next_business_day(d).alias("next_day"), D.target_business_day(d).alias("target_day"))


@query("SELECT o_orderkey, len(generate_series(date_trunc('month', o_orderdate), TIMESTAMP '2001-12-31', INTERVAL 1 MONTH))::INT AS months FROM orders")
def month_sequence(spark, sf):
    """G4, G5."""
    return table(spark, sf, "orders").select("o_orderkey", F.size(D.month_windows(F.col("o_orderdate").cast("date"), F.lit("2001-12-31").cast("date"))).alias("months"))


@query(
    """WITH x AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN (o_totalprice * 10000000)::BIGINT WHEN 1 THEN (o_totalprice * -1000)::BIGINT ELSE floor(o_totalprice)::BIGINT END AS n FROM orders), y AS (SELECT *, abs(n) AS a FROM x)
SELECT o_orderkey, CASE WHEN n < 0 THEN '-' ELSE '' END || CASE WHEN a >= 1000000000000 THEN format('{:,}', a // 1000000000000) || '조 ' || format('{:,}', (a % 1000000000000) // 100000000) || '억원' WHEN a >= 100000000 THEN format('{:,}', a // 100000000) || '억원' ELSE format('{:,}', a) || '원' END AS won FROM y"""
)
def money_text(spark, sf):
    """G12."""
    k = F.col("o_orderkey") % 3
    n = F.when(k == 0, F.round(F.col("o_totalprice") * 10000000)).when(k == 1, F.round(F.col("o_totalprice") * -1000)).otherwise(F.floor("o_totalprice")).cast("long")
    return table(spark, sf, "orders").select("o_orderkey", N.won(n).alias("won"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN e <= 1 THEN '<=1%' WHEN e <= 3 THEN '1-3%' WHEN e <= 5 THEN '3-5%' ELSE '>5%' END AS band, (x > 0 AND y > 0) OR (x < 0 AND y < 0) AS hit FROM (SELECT *, l_tax * 100 AS e, l_discount - 0.05 AS x, l_tax - 0.04 AS y FROM lineitem)")
def bands_and_hits(spark, sf):
    """G14, G15."""
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", N.error_band(F.col("l_tax") * 100).alias("band"), N.same_direction(F.col("l_discount") - 0.05, F.col("l_tax") - 0.04).alias("hit"))


@query("SELECT p_partkey, CASE WHEN d = 10 THEN '식료품 제조업' WHEN d = 26 THEN '전자부품, 컴퓨터, 영상, 음향 및 통신장비 제조업' WHEN d BETWEEN 1 AND 3 THEN '농업, 임업 및 어업' END AS industry FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 10 WHEN 1 THEN 26 WHEN 2 THEN 2 ELSE 4 END AS d FROM part)")
def industries(spark, sf):
    """G16."""
    k = F.col("p_partkey") % 4
    code = F.when(k == 0, "10").when(k == 1, "26410").when(k == 2, "02").otherwise("04")
    return table(spark, sf, "part").select("p_partkey", N.industry_name(code).alias("industry"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'k' || ' · ' || CAST(json_extract(props, '$.k') AS VARCHAR) AS shown FROM events")
def json_payload(spark, sf):
    """JSON objects as maps."""
    m = F.from_json("props", "map<string,string>")
    return table(spark, sf, "events").select("event_id", F.try_element_at(m, F.lit("k")).cast("long").alias("k"), F.concat_ws(" · ", F.lit("k"), T.row_text(m, ["other"])).alias("shown"))


@query("SELECT event_id, sha256(event_type || '|' || user_id) AS id, substr(sha1(event_type || '|' || user_id), 1, 16) AS short FROM events")
def stable_ids(spark, sf):
    """F28."""
    parts = [F.col("event_type"), F.col("user_id")]
    return table(spark, sf, "events").select("event_id", T.stable_id(*parts).alias("id"), T.stable_id(*parts, bits=64).alias("short"))


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'dart_financial' WHEN role = 'system' THEN 'hybrid' END AS intent FROM conversations")
def question_intents(spark, sf):
    """F26, N21."""
    asked = F.when(F.col("role") == "user", "재무 제표 알려줘").when(F.col("role") == "system", "공시와 목표 주가").otherwise("안녕")
    return table(spark, sf, "conversations").select("conv_id", "turn", T.intent(asked).alias("intent"))


@query("SELECT conv_id, count(*) AS turns, min(turn) AS first_turn FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3) GROUP BY conv_id")
def recent_turns(spark, sf):
    """I9."""
    return serving.recent_turns(table(spark, sf, "conversations"), 3).groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.min("turn").alias("first_turn"))


@query("WITH r AS (SELECT *, regexp_extract(text, '[A-Z][a-z]{4,}', 0) AS mention FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6) SELECT conv_id, max_by(mention, turn) AS mention FROM r WHERE mention <> '' GROUP BY conv_id")
def last_mentions(spark, sf):
    """N11."""
    return serving.last_mention(table(spark, sf, "conversations"), "[A-Z][a-z]{4,}")


@query("SELECT source AS firm, count(*) AS n, round(avg(length(text)), 4) AS avg_len, min(length(text))::INT AS min_len, max(length(text))::INT AS max_len, CASE WHEN avg(length(text)) < 200 THEN 'BAD' WHEN avg(length(text)) < 2500 THEN 'WARN' ELSE 'OK' END AS status FROM documents GROUP BY source")
def length_profile(spark, sf):
    """A21."""
    d = table(spark, sf, "documents").withColumnRenamed("source", "firm")
    return stats.length_profile(d, "firm", F.length("text"), 200, 2500).withColumn("avg_len", F.round("avg_len", 4))


@query(
    """WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, list_sum(list_transform(list_zip(embedding, q), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS x FROM embeddings, q)
SELECT vec_id, round(x, 4) AS score FROM s ORDER BY round(x, 4) DESC, vec_id LIMIT 10"""
)
def vector_top_k(spark, sf):
    """V2, L11, X7."""
    e = table(spark, sf, "embeddings")
    return vectors.top_k(e, list(e.where("vec_id = 0").first()["embedding"]), 10).select("vec_id", "score")


@query(
    """WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id IN (0, 1, 2)), s AS (SELECT query_id, vec_id, round(list_sum(list_transform(list_zip(embedding, q), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 4) AS score FROM embeddings, q)
SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 5"""
)
def vector_multi_query(spark, sf):
    """V4, V5."""
    e = table(spark, sf, "embeddings")
    return vectors.top_k_per_query(e, e.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 5).select("query_id", "vec_id", "score", "rank")


@query(
    """WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id IN (0, 1, 2)), s AS (SELECT query_id, vec_id, round(list_sum(list_transform(list_zip(embedding, q), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 4) AS score FROM embeddings, q),
k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10) SELECT vec_id, query_id, score FROM k QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY query_id, score DESC) = 1"""
)
def vector_merged_hits(spark, sf):
    """V4: max(10, 20 / queries) per query, each vector once."""
    e = table(spark, sf, "embeddings")
    hits = vectors.top_k_per_query(e, e.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 0)
    return vectors.merged_hits(hits).select("vec_id", "query_id", "score")


@query(
    """WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 1), s AS (SELECT vec_id, label, round(list_sum(list_transform(list_zip(embedding, q), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 4) AS score FROM embeddings, q), k AS (SELECT * FROM s ORDER BY score DESC, vec_id LIMIT 20)
SELECT vec_id, score FROM k WHERE label % 2 = 0"""
)
def vector_post_filter(spark, sf):
    """V3: the filter follows the limit."""
    e = table(spark, sf, "embeddings")
    return vectors.top_k_then_filter(e, list(e.where("vec_id = 1").first()["embedding"]), 20, F.col("label") % 2 == 0).select("vec_id", "score")


def _index(spark, sf):
    """The index of all vectors, and as queries every one whose id is divisible by 100."""
    path, e = scratch(spark, "index"), table(spark, sf, "embeddings")
    ivf.build(e, path)
    return path, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query(
    """WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id, round(list_sum([z[1]::DOUBLE * z[2]::DOUBLE FOR z IN list_zip(embedding, q)]), 4) AS score FROM embeddings, q)
SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10"""
)
def vector_index_search(spark, sf):
    """The index in its exact mode."""
    path, queries = _index(spark, sf)
    return ivf.search_all(spark, path, queries, 10, None)


@query("SELECT vec_id AS query_id, 10 AS n, TRUE AS reached FROM embeddings WHERE vec_id % 100 = 0")
def vector_index_probes(spark, sf):
    """K6, V2: as many cells of the index as its trials needed for a recall of 0.98; whether these hold 0.95 or
    more of the ten nearest of all queries together."""
    path, queries = _index(spark, sf)
    counted = f"{path}/found"
    ivf.found_of(ivf.search_all(spark, path, queries, 10, 0.98), ivf.search_all(spark, path, queries, 10, None)).write.parquet(counted)
    per = spark.read.parquet(counted)
    mean = per.agg(F.sum("found") / F.sum("n")).first()[0]
    return per.select("query_id", "n", F.lit(mean is not None and mean >= 0.95).alias("reached"))


@query(
    r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all('passage: ' || coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS token FROM documents), c AS (SELECT doc_id, ('0x' || right(sha1(token), 2))::INT % 64 AS i, count(*) AS n FROM t GROUP BY 1, 2),
m AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM c GROUP BY 1) SELECT doc_id, i::INT AS i, round(n / norm, 6) AS x FROM c JOIN m USING (doc_id)"""
)
def hash_embeddings(spark, sf):
    """The places of each text's vector that are not 0."""
    e = table(spark, sf, "documents").select("doc_id", F.posexplode(vectors.hash_embedding(vectors.passage(F.coalesce("text", F.lit(""))), 64)).alias("i", "x"))
    return e.where("x <> 0").withColumn("x", F.round("x", 6))


@query()
def chunked_documents(spark, sf):
    """Rows only."""
    d = table(spark, sf, "documents").select(F.lit("00000001").alias("corp_code"), F.format_string("%014d", "doc_id").alias("rcept_no"), F.lit("document_text").alias("rag_doc_type"), "text")
    return documents.chunks(d).select("chunk_id", "chunk_index", "token_count")


@query()
def html_lists(spark, sf):
    """Rows only."""
    return table(spark, sf, "pages").select("page_id", F.posexplode(readers.html_rows(F.col("html"))).alias("i", "row")).select("page_id", "i", F.size("row.cells").alias("cells"), "row.link")


_REPORT_TEXTS = """t AS (SELECT o_orderkey, o_orderkey % 16 AS k, (1 + o_custkey % 900) * 1000 AS price, (100000 + o_custkey)::VARCHAR AS stock, 1 + o_custkey % 900 AS a, 1 + o_custkey % 90 AS b FROM orders)"""


@query(
    f"""WITH {_REPORT_TEXTS} SELECT o_orderkey, CASE k WHEN 0 THEN 'BUY' WHEN 1 THEN 'HOLD' WHEN 2 THEN 'SELL' WHEN 3 THEN 'NOT_RATED' WHEN 4 THEN 'BUY' END AS opinion,
CASE WHEN k IN (0, 4, 13, 14) THEN price WHEN k = 1 THEN price * 10 END AS target_price, CASE WHEN k <= 1 THEN 20000 END AS current_price,
CASE WHEN k IN (0, 1, 4) THEN '["' || stock || '"]' ELSE '[]' END AS codes, CASE WHEN k IN (0, 1, 4) THEN stock WHEN k = 5 THEN '005930' END AS code,
CASE WHEN k = 3 THEN '{{"revenue_mentions":["' || a || '"],"op_profit_mentions":["' || b || '"]}}' END AS estimates, CASE WHEN k = 0 THEN (price - 20000) / 200.0 WHEN k = 1 THEN (price * 10 - 20000) / 200.0 END::DOUBLE AS upside_pct FROM t"""
)
def structured_reports(spark, sf):
    """Fields of report texts that state an order's numbers, and of those where something near a
    number says that it is no price: a year, a percentage, months, dollars, a cell of a table, an abbreviated
    year, a multiple, a heading."""
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 16).alias("k"), ((1 + F.col("o_custkey") % 900) * 1000).cast("long").alias("price"), (100000 + F.col("o_custkey")).cast("string").alias("stock"), (1 + F.col("o_custkey") % 900).cast("int").alias("a"), (1 + F.col("o_custkey") % 90).cast("int").alias("b"))
    k, price, stock = F.col("k"), F.format_number("price", 0), F.col("stock")
    some = (F.col("a") + 1000).cast("string")  # a number that differs by order
    text = (
        F.when(k == 0, F.concat(F.lit("투자의견 매수(유지) 목표주가 "), price, F.lit("원 현재주가 20,000원 ("), stock, F.lit(")")))
        .when(k == 1, F.concat(F.lit("Neutral, TP "), F.format_string("%.1f", F.col("price") / 1000), F.lit("만원, 현재주가: 20,000원 ["), stock, F.lit("]")))
        .when(k == 2, F.lit("목표주가 괴리율 12% SELL"))
        .when(k == 3, F.format_string("Not Rated 매출액 %d억원 영업이익 %d억원", "a", "b"))
        .when(k == 4, F.concat(F.lit("12개월 목표주가 "), price, F.lit("원 Outperform "), stock))
        .when(k == 5, F.lit("오늘의 시장"))
        .when(k == 6, F.concat(F.lit("목표주가 "), some, F.lit("년 실적 전망")))
        .when(k == 7, F.concat(F.lit("TP "), some, F.lit("% 상승 여력")))
        .when(k == 8, F.concat(F.lit("목표주가 "), some, F.lit("M 기준")))
        .when(k == 9, F.concat(F.lit("주당 USD 목표주가 "), some))
        .when(k == 10, F.concat(F.lit("목표주가 "), some, F.lit("\n"), some, F.lit(" 대비")))
        .when(k == 11, F.concat(F.lit("목표주가 ‘"), some, F.lit("E 대비")))
        .when(k == 12, F.concat(F.lit("TP × "), some, F.lit(" 적용")))
        .when(k == 13, F.concat(F.lit("목표주가 추이 "), some, F.lit(" 및 그 뒤에 새로 제시된 목표주가 "), price, F.lit("원")))
        .when(k == 14, F.concat(F.lit("TP "), some, F.lit("% 상승, 이에 따른 적정주가 "), price, F.lit("원")))
        .otherwise(F.concat(F.lit("TP 0 "), F.lit("개장")))
    )
    out = o.select("o_orderkey", *T.structured(text, F.when(k == 5, "A005930"))).drop("text_len")
    return out.withColumn("upside_pct", T.upside(F.col("target_price"), F.col("current_price")))


@query(
    """SELECT o_orderkey, 4 + (o_orderkey % 2)::INT AS lines, 'Title ' || o_orderkey || chr(10) || '매출액' || CASE WHEN o_orderkey % 2 = 1 THEN chr(10) || 'Body text' ELSE '' END AS narrative, '매출액: ' || (o_orderkey % 900 + 1) || ', 5.6%' AS signal FROM orders"""
)
def report_signals(spark, sf):
    """F8-F12 on report pages that are made of orders."""
    k = F.col("o_orderkey")
    page = F.concat(F.lit("Title "), k.cast("string"), F.lit("\n1/12\n매출액\n"), (k % 900 + 1).cast("string"), F.lit("\n5.6%\n"), F.when(k % 2 == 1, "Body text\n").otherwise(""), F.lit("Compliance Notice\nleft out"))
    lines = table(spark, sf, "orders").select("o_orderkey", T.report_lines(page).alias("l"))
    return lines.select("o_orderkey", F.size("l").alias("lines"), T.narrative(F.col("l"), 2000).alias("narrative"), T.table_signal(F.col("l"), 1000).alias("signal"))


@query()
def report_lines(spark, sf):
    """Cleaned lines, narrative and table signal; rows only."""
    lines = T.report_lines(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", lines.alias("lines")).select("doc_id", F.size("lines").alias("lines_n"), F.length(T.narrative(F.col("lines"), 2000)).alias("narrative_len"), F.length(T.table_signal(F.col("lines"), 1000)).alias("table_len"))
