"""Queries for keyed merges, deduplication, lineage, joins and aggregates over the ledger tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import filters, merge, serving, stats
from ..session import table
from ..streaming import incremental
from .registry import query

_BATCHES = """t AS (SELECT event_id, user_id, value FROM events WHERE event_id % 3 <> 0), s AS (SELECT event_id, user_id, value * 2 AS value FROM events WHERE event_id % 2 = 0)"""


def _batches(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "value")
    return e.where("event_id % 3 <> 0"), e.where("event_id % 2 = 0").withColumn("value", F.col("value") * 2)


@query(f"WITH {_BATCHES} SELECT * FROM s UNION ALL SELECT * FROM t WHERE event_id NOT IN (SELECT event_id FROM s)")
def merge_upsert(spark, sf):
    """Source rows win."""
    t, s = _batches(spark, sf)
    return merge.merge(t, s, ["event_id"])


@query(f"WITH {_BATCHES} SELECT * FROM t UNION ALL SELECT * FROM s WHERE event_id NOT IN (SELECT event_id FROM t)")
def merge_append_new(spark, sf):
    """Target rows win."""
    t, s = _batches(spark, sf)
    return merge.append_new(t, s, ["event_id"])


@query(
    """WITH t AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment FROM customer WHERE c_custkey % 3 <> 0), s AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE upper(c_name) END AS name, CASE WHEN c_custkey % 5 <> 0 THEN 'NEW' END AS segment FROM customer WHERE c_custkey % 2 = 0)
SELECT k, coalesce(nullif(s.name, ''), t.name) AS name, coalesce(nullif(s.segment, ''), t.segment) AS segment FROM t FULL JOIN s USING (k)"""
)
def merge_filled(spark, sf):
    """Only values that are there replace."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = c.where("k % 2 = 0").select("k", F.when(F.col("k") % 4 == 0, "").otherwise(F.upper("name")).alias("name"), F.when(F.col("k") % 5 != 0, "NEW").alias("segment"))
    return merge.upsert_filled(c.where("k % 3 <> 0"), s, ["k"])


@query(
    """WITH u AS (SELECT 0 AS p, o_orderkey AS rcept_no, o_orderstatus AS v FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT 1, o_orderkey, 'b' FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 2, o_orderkey, 'c' FROM orders WHERE o_orderkey % 2 = 0)
SELECT rcept_no, v FROM u QUALIFY row_number() OVER (PARTITION BY rcept_no ORDER BY p) = 1"""
)
def union_by_priority(spark, sf):
    """Earlier sources win."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("rcept_no"), F.col("o_orderstatus").alias("v"))
    sources = [o.where("rcept_no % 5 = 0"), o.where("rcept_no % 3 = 0").withColumn("v", F.lit("b")), o.where("rcept_no % 2 = 0").withColumn("v", F.lit("c"))]
    return merge.union_by_priority(sources, ["rcept_no"], ["v"], [F.col("v")])


@query("SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_shipdate, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_quantity DESC) = 1")
def latest_per_holder(spark, sf):
    """The latest row per key under a total order."""
    li = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")
    return merge.latest_by_max(li, ["l_partkey", "l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_quantity"]).select(*li.columns)


@query(
    """WITH f AS (SELECT o_orderkey AS rcept_no, o_orderdate AS rcept_dt, CASE WHEN o_custkey % 10 <> 0 THEN o_custkey || ':' || o_orderpriority END AS group_id FROM orders),
g AS (SELECT *, coalesce(group_id, rcept_no::VARCHAR) AS g FROM f)
SELECT rcept_no, first_value(rcept_no) OVER w AS original_rcept_no, last_value(rcept_no) OVER w AS latest_rcept_no, row_number() OVER (PARTITION BY g ORDER BY rcept_dt, rcept_no) - 1 AS amendment_seq,
count(*) OVER (PARTITION BY g) AS version_count, rcept_no = last_value(rcept_no) OVER w AS is_latest FROM g WINDOW w AS (PARTITION BY g ORDER BY rcept_dt, rcept_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""
)
def amendment_lineage(spark, sf):
    """W21-W23, J12, A14, X13."""
    group = F.when(F.col("o_custkey") % 10 != 0, F.concat(F.col("o_custkey").cast("string"), F.lit(":"), F.col("o_orderpriority")))
    f = table(spark, sf, "orders").select(F.col("o_orderkey").alias("rcept_no"), F.col("o_orderdate").alias("rcept_dt"), group.alias("group_id"))
    return merge.lineage(f).select("rcept_no", "original_rcept_no", "latest_rcept_no", "amendment_seq", "version_count", "is_latest")


@query(
    """WITH o AS (SELECT c_custkey AS stock_code, c_name AS corp_name, CASE WHEN c_custkey % 11 = 0 THEN 'DELISTED' ELSE 'LISTED' END AS status FROM customer WHERE c_custkey % 4 <> 0),
n AS (SELECT c_custkey AS stock_code, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END AS corp_name FROM customer WHERE c_custkey % 3 <> 0)
SELECT coalesce(o.stock_code, n.stock_code) AS stock_code, CASE WHEN o.stock_code IS NULL THEN 'LISTED' WHEN n.stock_code IS NULL THEN CASE WHEN status = 'DELISTED' THEN 'UNCHANGED' ELSE 'DELISTED' END
WHEN status = 'DELISTED' THEN 'RELISTED' WHEN o.corp_name IS DISTINCT FROM n.corp_name THEN 'INFO_CHANGED' ELSE 'UNCHANGED' END AS change, coalesce(n.corp_name, o.corp_name) AS corp_name FROM o FULL JOIN n ON o.stock_code = n.stock_code"""
)
def roster_diff(spark, sf):
    """J14."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("stock_code"), F.col("c_name").alias("corp_name"))
    old = c.where("stock_code % 4 <> 0").withColumn("status", F.when(F.col("stock_code") % 11 == 0, "DELISTED").otherwise("LISTED"))
    new = c.where("stock_code % 3 <> 0").withColumn("corp_name", F.when(F.col("stock_code") % 7 != 0, F.col("corp_name")))
    return merge.roster_diff(old, new, ["corp_name"])


@query(
    """WITH c AS (SELECT p_partkey AS corp_code, p_name AS corp_name, p_size < 5 AS is_listed FROM part), u AS (SELECT corp_name, count(*) AS n, count(*) FILTER (WHERE is_listed) AS l, first(corp_code ORDER BY NOT is_listed, corp_code) AS code FROM c GROUP BY 1)
SELECT m.p_partkey AS id, CASE WHEN n = 1 OR l = 1 THEN code END AS resolved_code FROM part m LEFT JOIN u ON m.p_name = u.corp_name"""
)
def resolve_names(spark, sf):
    """J15."""
    p = table(spark, sf, "part")
    companies = p.select(F.col("p_partkey").alias("corp_code"), F.col("p_name").alias("corp_name"), (F.col("p_size") < 5).alias("is_listed"))
    return merge.resolve_names(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), companies, F.col("corp_name"), F.col("name")).select("id", "resolved_code")


@query("SELECT c_name AS corp_name, c_custkey AS corp_code FROM customer WHERE starts_with(c_name, 'Customer#00000001') ORDER BY c_custkey LIMIT 1")
def find_company(spark, sf):
    """A name prefix, as no alias or code matches."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("corp_code"), F.lit(None).cast("string").alias("stock_code"), F.col("c_name").alias("corp_name"), F.lit(None).cast("string").alias("stock_name"), F.col("c_custkey").alias("position"))
    return merge.find_company("Customer#00000001", c).select("corp_name", F.col("corp_code").cast("long").alias("corp_code"))


@query("SELECT DISTINCT alias, corp_name FROM (SELECT unnest([lpad(n_nationkey::VARCHAR, 8, '0'), ltrim(lpad(n_nationkey::VARCHAR, 8, '0'), '0'), n_name]) AS alias, n_name AS corp_name FROM nation)")
def alias_dimension(spark, sf):
    """N14."""
    n = table(spark, sf, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 8, "0").alias("corp_code"), F.lit(None).cast("string").alias("stock_code"), F.col("n_name").alias("corp_name"))
    return merge.alias_dimension(n).select("alias", "corp_name")


@query("SELECT o_orderkey AS rcept_no FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def todo_anti_join(spark, sf):
    """J18, J11, I3."""
    return merge.todo(table(spark, sf, "orders").select(F.col("o_orderkey").alias("rcept_no")), table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("rcept_no")), ["rcept_no"])


@query("SELECT a.api, r.r_name FROM (SELECT DISTINCT o_orderpriority AS api FROM orders EXCEPT ALL SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority LIKE '%LOW%') a, region r")
def missing_calls(spark, sf):
    """J19."""
    names = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("api")).distinct()
    return merge.missing_calls(names, names.where("api LIKE '%LOW%'"), table(spark, sf, "region").select("r_name"))


@query(
    """WITH e AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS path FROM lineitem), p AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS path FROM lineitem WHERE l_quantity > 5)
SELECT k, bool_and(p.path IS NOT NULL) AS complete, count(*) FILTER (WHERE p.path IS NULL) AS missing FROM e LEFT JOIN p USING (k, path) GROUP BY k"""
)
def completion(spark, sf):
    """J20."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("path"), "l_quantity")
    return merge.completion(li.select("k", "path").distinct(), li.where("l_quantity > 5"), ["k"])


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2")
def value_counts(spark, sf):
    """A6, A16."""
    return stats.value_counts(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus")


@query("SELECT l_suppkey, coalesce(sum(CASE WHEN x > 0 THEN x END), 0)::BIGINT AS bought, coalesce(sum(CASE WHEN x <= 0 THEN x END), 0)::BIGINT AS sold FROM (SELECT l_suppkey, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END::BIGINT AS x FROM lineitem) GROUP BY 1")
def flow_totals(spark, sf):
    """Changes arrive as text with commas."""
    text = F.format_number(F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")), 0)
    return stats.flow(table(spark, sf, "lineitem"), N.to_long(text), "l_suppkey")


@query(
    """WITH a AS (SELECT l_orderkey, l_linenumber, l_returnflag AS name, CASE WHEN l_quantity > 10 THEN l_quantity WHEN l_quantity > 5 THEN 0 END AS cur, l_tax AS prior FROM lineitem), v AS (SELECT *, coalesce(cur, prior) AS x FROM a)
SELECT l_orderkey, first(x ORDER BY x = 0, l_linenumber, l_orderkey, x) FILTER (WHERE name = 'A' AND x IS NOT NULL) AS a, first(x ORDER BY CASE name WHEN 'N' THEN 0 ELSE 1 END, x = 0, l_linenumber, x) FILTER (WHERE name IN ('N', 'R') AND x IS NOT NULL) AS nr FROM v GROUP BY 1"""
)
def account_pivot(spark, sf):
    """First non-zero amount per account, labels in order."""
    li = table(spark, sf, "lineitem")
    current = F.when(F.col("l_quantity") > 10, F.col("l_quantity")).when(F.col("l_quantity") > 5, 0.0)
    rows = li.select("l_orderkey", F.col("l_returnflag").alias("account_nm"), current.alias("thstrm_amount"), F.col("l_tax").alias("frmtrm_amount"), F.struct("l_linenumber", F.coalesce(current, "l_tax")).alias("ord"))
    return stats.account_pivot(rows, [("a", ["A"]), ("nr", ["N", "R"])], ["l_orderkey"], "ord")


@query(
    """WITH r AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'BUY' WHEN 'O' THEN 'HOLD' WHEN 'P' THEN NULL END AS o, o_custkey % 40 AS firm, CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS tp FROM orders)
SELECT count(*) AS total, count(*) FILTER (WHERE o = 'BUY') AS buy, count(*) FILTER (WHERE o = 'HOLD') AS hold, count(*) FILTER (WHERE o = 'SELL') AS sell, count(*) FILTER (WHERE o = 'NOT_RATED') AS not_rated, count(*) FILTER (WHERE o IS NULL) AS no_opinion,
count(DISTINCT firm) AS firms, count(tp) AS with_target, round(count(tp) * 100.0 / count(*), 6) AS target_rate FROM r"""
)
def briefing_counts(spark, sf):
    """A5, X10."""
    o = table(spark, sf, "orders")
    r = o.select(F.when(F.col("o_orderstatus") == "F", "BUY").when(F.col("o_orderstatus") == "O", "HOLD").alias("opinion"), (F.col("o_custkey") % 40).alias("firm"), F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("target_price"))
    return stats.opinion_counts(r).withColumn("target_rate", F.round(F.col("target_rate").cast("double"), 6))


@query(
    """WITH per AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS second, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, second, n, (sum(n) OVER (PARTITION BY user_id ORDER BY second RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW))::BIGINT AS in_window FROM per"""
)
def sliding_requests(spark, sf):
    """W29, I10."""
    return stats.sliding_requests(table(spark, sf, "events"), "user_id", "ts", 3600)


@query("SELECT coalesce(sum(1), 0)::BIGINT AS used, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 END), 0)::BIGINT AS failed, min(ts) AS oldest FROM events WHERE ts > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 86400 SECOND")
def quota_window(spark, sf):
    """A15."""
    e = table(spark, sf, "events").select("ts", F.lit(1).cast("long").alias("n"), F.when(F.col("event_type") != "error", "ok").otherwise("error").alias("status"))
    return stats.quota(e, F.lit("2024-01-30 00:00:00").cast("timestamp"), 86400)


@query("SELECT o_custkey % 100 AS k, array_to_string(list_sort(list_distinct(list(o_orderpriority))), '+') AS values FROM orders GROUP BY 1")
def collected_sets(spark, sf):
    """A22, N3."""
    return stats.collected(table(spark, sf, "orders").select((F.col("o_custkey") % 100).alias("k"), "o_orderpriority"), "k", "o_orderpriority", "+")


@query("SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, count(*) AS n FROM lineitem GROUP BY 1")
def rows_per_month(spark, sf):
    """A23."""
    return stats.months(table(spark, sf, "lineitem"), "l_shipdate")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def third_page(spark, sf):
    """L7."""
    return filters.page(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 3, 25)[0]


@query("SELECT count(*) AS total, ceil(count(*) / 25.0)::BIGINT AS total_pages FROM orders")
def page_totals(spark, sf):
    """L7."""
    return filters.page(table(spark, sf, "orders"), [F.col("o_orderkey")], 1, 25)[1]


@query("SELECT o_orderkey, ceil(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) / 100.0)::INT AS page_no FROM orders")
def replay_pages(spark, sf):
    """N20."""
    return filters.pages(table(spark, sf, "orders"), ["o_orderpriority"], [F.col("o_orderdate"), F.col("o_orderkey")], 100).select("o_orderkey", "page_no")


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-03-01' AND DATE '1996-06-30'")
def date_window(spark, sf):
    """P6."""
    o = table(spark, sf, "orders")
    return o.where(filters.in_dates(F.date_format("o_orderdate", "yyyy-MM-dd"), "19960301", "1996-06-30")).select("o_orderkey")


@query("WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN year(o_orderdate) END AS y, month(o_orderdate) AS m FROM orders) SELECT o_orderkey FROM x WHERE y IS NULL OR y * 12 + m BETWEEN 1996 * 12 + 3 AND 1997 * 12 + 2")
def month_window(spark, sf):
    """Unknown passes."""
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 != 0, F.year("o_orderdate")).alias("y"), F.month("o_orderdate").alias("m"))
    return o.where(filters.in_months(F.col("y"), F.col("m"), (1996, 3), (1997, 2))).select("o_orderkey")


@query("WITH x AS (SELECT o_orderkey, year(o_orderdate) AS y, CASE WHEN o_orderkey % 9 <> 0 THEN month(o_orderdate) END AS m FROM orders) SELECT o_orderkey FROM x WHERE m IS NULL OR make_date(y, m, 15) >= DATE '1998-06-30' - 30")
def recency(spark, sf):
    """Unknown passes."""
    o = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.when(F.col("o_orderkey") % 9 != 0, F.month("o_orderdate")).alias("m"))
    return o.where(filters.recent(F.col("y"), F.col("m"), F.lit("1998-06-30").cast("date"))).select("o_orderkey")


@query("WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'dart' ELSE 'report' END AS source, o_custkey::VARCHAR AS corp FROM orders) SELECT o_orderkey FROM x WHERE source <> 'dart' OR corp = '7'")
def company_scope(spark, sf):
    """P9."""
    o = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "dart").otherwise("report").alias("source"), F.col("o_custkey").cast("string").alias("corp"), F.lit(None).cast("string").alias("stock"))
    return o.where(filters.company_scope(F.col("source"), F.col("corp"), F.col("stock"), "7", None)).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'F'")
def selector_query(spark, sf):
    """P13."""
    return filters.selected(table(spark, sf, "orders"), o_custkey=7, o_orderstatus="F", o_orderpriority=None).select("o_orderkey")


@query("WITH r AS (SELECT lpad((o_custkey % 97)::VARCHAR, 6, '0') AS t FROM orders), m AS (SELECT lpad((l_suppkey % 89)::VARCHAR, 6, '0') AS t FROM lineitem), f AS (SELECT lpad((c_custkey % 50)::VARCHAR, 6, '0') AS t FROM customer WHERE c_acctbal > 5000) SELECT DISTINCT t AS ticker FROM r WHERE t IN (SELECT t FROM m) AND t IN (SELECT t FROM f) AND t <> '000000'")
def consensus(spark, sf):
    """J10, U9."""
    reports = table(spark, sf, "orders").select((F.col("o_custkey") % 97).alias("code"))
    model = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 89).alias("ticker"), F.lit(1.0).alias("ranking_score"))
    filings = table(spark, sf, "customer").where("c_acctbal > 5000").select((F.col("c_custkey") % 50).alias("stock_code"), F.lit("2024-01-01").cast("date").alias("rcept_dt"), F.lit("positive").alias("sentiment"), F.lit("x").alias("report_nm"))
    return serving.consensus_tickers(reports, model, filings, F.lit("2024-01-31").cast("date"))


@query("WITH r AS (SELECT DISTINCT lpad((o_custkey % 97)::VARCHAR, 6, '0') AS t FROM orders) SELECT t AS ticker FROM r WHERE t IN (SELECT lpad((l_suppkey % 89)::VARCHAR, 6, '0') FROM lineitem) AND t <> '000000'")
def consensus_fallback(spark, sf):
    """No filing qualifies, so the plain intersection counts."""
    reports = table(spark, sf, "orders").select((F.col("o_custkey") % 97).alias("code"))
    model = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 89).alias("ticker"), F.lit(1.0).alias("ranking_score"))
    filings = table(spark, sf, "customer").select(F.lit("x").alias("stock_code"), F.lit("2020-01-01").cast("date").alias("rcept_dt"), F.lit("negative").alias("sentiment"), F.lit("x").alias("report_nm"))
    return serving.consensus_tickers(reports, model, filings, F.lit("2024-01-31").cast("date"))


@query("WITH f AS (SELECT o_custkey, CASE WHEN o_totalprice > 200000 THEN 'positive' ELSE 'negative' END AS s FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1) SELECT o_orderkey, coalesce(s, 'neutral') AS sentiment FROM orders LEFT JOIN f USING (o_custkey)")
def sentiment_map_back(spark, sf):
    """N7."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return serving.map_back(o, "o_custkey", F.col("o_orderkey"), F.when(F.col("o_totalprice") > 200000, "positive").otherwise("negative")).select("o_orderkey", "sentiment")


@query("SELECT event_id, user_id FROM events WHERE event_type <> 'purchase' OR event_id % 2 = 1 OR value > 10")
def stale_rows(spark, sf):
    """Rows never done, or done under other values."""
    e = table(spark, sf, "events").select("event_id", "user_id", "value", "event_type")
    done = e.where("event_type = 'purchase' AND event_id % 2 = 0").withColumn("value", F.when(F.col("value") > 10, -1.0).otherwise(F.col("value"))).withColumn("mark", incremental.tracked_hash("user_id", "value"))
    return incremental.stale(e, done, ["event_id"], ["user_id", "value"]).select("event_id", "user_id")


@query("SELECT max_by(event_type, ts) AS state_value FROM events WHERE user_id = 1")
def saved_frontier(spark, sf):
    """I2."""
    state = table(spark, sf, "events").select(F.col("user_id").alias("state_key"), F.col("event_type").alias("state_value"), F.col("ts").alias("updated_at"))
    return incremental.frontier(state, 1)
