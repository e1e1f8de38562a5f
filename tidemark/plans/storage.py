"""Queries that write a table to the shared scratch folder in some layout, read it back through a source
operator, and are compared with the table itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import filters, stats
from ..session import scratch, table
from ..sources import pages, readers, versions, writers
from .market import BARS, bars
from .registry import query


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_orderpriority")


@query("SELECT f AS format, o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders, (VALUES ('parquet'), ('csv'), ('orc'), ('json')) t(f) GROUP BY 1, 2")
def read_formats(spark, sf):
    """The reader follows the suffix."""
    out = None
    for kind in ("parquet", "csv", "orc", "json"):
        path = f"{scratch(spark, 'table')}.{kind}"
        w = _orders(spark, sf).write
        (w.option("header", True).csv(path) if kind == "csv" else getattr(w, kind)(path))
        df = readers.read_table(spark, path).groupBy(F.col("o_custkey").cast("long").alias("o_custkey")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("o_totalprice").cast("double")), 2).alias("total"))
        df = df.select(F.lit(kind).alias("format"), "o_custkey", "n", "total")
        out = df if out is None else out.union(df)
    return out


@query(f"WITH {BARS} SELECT date, ticker, round(open, 6) AS open, round(close, 6) AS close, volume::DOUBLE AS volume FROM bars")
def read_bars(spark, sf):
    """Tickers keep their zeros, numbers become doubles."""
    path = f"{scratch(spark, 'bars')}.csv"
    bars(spark, sf).select(F.col("date").cast("string").alias("date"), "ticker", "open", "high", "low", "close", "volume").write.option("header", True).csv(path)
    return readers.read_bars(spark, path).select("date", "ticker", F.round("open", 6).alias("open"), F.round("close", 6).alias("close"), "volume")


@query("SELECT CAST(ts AS DATE) AS date, CASE WHEN count(*) % 3 <> 0 THEN count(*)::DOUBLE END AS x, count(DISTINCT user_id)::DOUBLE AS y FROM events GROUP BY 1")
def read_series(spark, sf):
    """S3: NaN is no value."""
    path = f"{scratch(spark, 'series')}.parquet"
    n = F.count(F.lit(1)).cast("double")
    e = table(spark, sf, "events").groupBy(F.col("ts").cast("date").cast("string").alias("date")).agg(n.alias("x"), F.count_distinct("user_id").alias("y"))
    e.withColumn("x", F.when(F.col("x") % 3 == 0, float("nan")).otherwise(F.col("x"))).write.parquet(path)
    return readers.read_series(spark, path)


def _monthly(spark, sf, path: str) -> None:
    o = _orders(spark, sf).withColumns({"year": F.date_format("o_orderdate", "yyyy"), "month": F.when(F.col("o_orderkey") % 50 != 0, F.date_format("o_orderdate", "MM"))})
    writers.write_partitioned(o, path, ["year", "month"])


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y')::INT AS year FROM orders WHERE o_orderkey % 50 <> 0 AND (year(o_orderdate), month(o_orderdate)) IN ((1995, 3), (1996, 11))")
def read_months(spark, sf):
    """Two months of a partitioned table."""
    path = scratch(spark, "months")
    _monthly(spark, sf, path)
    return readers.read_months(spark, path, [(1995, 3), (1996, 11)]).select("o_orderkey", F.col("year").cast("int").alias("year"))


@query("SELECT coalesce(CASE WHEN o_orderkey % 50 <> 0 THEN strftime(o_orderdate, '%m') END, 'NA') AS month, count(*) AS n FROM orders GROUP BY 1")
def partition_values(spark, sf):
    """K1: blank partition values are NA."""
    path = scratch(spark, "parts")
    _monthly(spark, sf, path)
    return writers._as_text(spark, path, ["year", "month"]).groupBy("month").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-03-01' - 92 AND DATE '1996-06-30'")
def lookback_window(spark, sf):
    """Dates in two formats, 92 days before the window included."""
    o = _orders(spark, sf).withColumn("dt", F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))
    return readers.in_window(o, "dt", "19960301", "1996-06-30", 92).select("o_orderkey")


@query("SELECT o_orderkey::VARCHAR AS o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey::VARCHAR ELSE 'c' || o_custkey END AS o_custkey, CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority END AS extra FROM orders")
def read_drifting(spark, sf):
    """Files whose types and columns disagree, and a path that is not there."""
    path, o = scratch(spark, "drift"), _orders(spark, sf)
    o.where("o_orderkey % 2 = 0").select("o_orderkey", "o_custkey").write.parquet(f"{path}/a")
    o.where("o_orderkey % 2 = 1").select(F.col("o_orderkey").cast("string"), F.concat(F.lit("c"), "o_custkey").alias("o_custkey"), F.col("o_orderpriority").alias("extra")).write.parquet(f"{path}/b")
    return readers.read_drifting(spark, [f"{path}/a", f"{path}/b", f"{path}/none"])


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y.%m.%d') AS dt FROM orders WHERE year(o_orderdate) = 1997 AND month(o_orderdate) = 5")
def read_first_format(spark, sf):
    """A format that is absent gives way to Parquet, pruned to columns and a date prefix."""
    path = scratch(spark, "fallback")
    _orders(spark, sf).withColumn("dt", F.date_format("o_orderdate", "yyyy.MM.dd")).write.parquet(path)
    return readers.first_readable(spark, [("delta", f"{path}-none"), ("parquet", path)], ["o_orderkey", "dt"], ("dt", "1997-05"))


@query("SELECT o_orderkey AS rcept_no, CASE WHEN o_orderkey % 3 = 0 THEN 'old' ELSE 'new' END AS kind FROM orders")
def read_registry(spark, sf):
    """Of a receipt number's versions the latest one stays."""
    o = _orders(spark, sf)
    new = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("rcept_no"), F.date_add("o_orderdate", 1).alias("rcept_dt"), F.lit("TRUE").alias("is_latest"), F.lit("new").alias("kind"))
    old = o.select(F.col("o_orderkey").alias("rcept_no"), F.date_add("o_orderdate", 9).alias("rcept_dt"), F.lit(None).cast("string").alias("is_latest"), F.lit("old").alias("kind"))
    return readers.read_registry(old.union(new)).select("rcept_no", "kind")


@query("SELECT n_nationkey, n_name, n_nationkey % 2 = 0 AS even FROM nation")
def read_json_objects(spark, sf):
    """One JSON object per file under nested folders."""
    path = scratch(spark, "objects")
    n = table(spark, sf, "nation").select(F.to_json(F.struct("n_nationkey", "n_name"), {"pretty": "true"}).alias("value"), (F.col("n_nationkey") % 2).alias("broker"), F.col("n_nationkey").alias("day"))
    n.write.partitionBy("broker", "day").text(path)
    df = readers.read_reports(spark, path, "n_nationkey long, n_name string")
    return df.select("n_nationkey", "n_name", F.contains("source_key", F.lit("broker=0")).alias("even"))


@query("SELECT n_nationkey, n_name FROM nation")
def read_broken_json(spark, sf):
    """Records that line breaks cut."""
    path = scratch(spark, "broken")
    n = table(spark, sf, "nation")
    value = F.format_string('{"n_nationkey": %d, "n_name":\n"%s",\n "x": {"y": [1,\n2]}}', F.col("n_nationkey").cast("long"), "n_name")
    n.select(value.alias("value")).coalesce(1).write.text(path)
    rows = readers.read_broken_lines(spark, path)
    return rows.select(F.from_json("record", "n_nationkey long, n_name string").alias("r")).select("r.*")


@query("SELECT 25 AS records, 5 AS errors, count(*) FILTER (WHERE n_nationkey % 2 = 0) AS matched, count(*) FILTER (WHERE n_nationkey % 2 = 1) AS unknown FROM nation")
def matched_output(spark, sf):
    """Batch output against its manifest; what does not parse is an error and counted."""
    path = scratch(spark, "batch")
    n = table(spark, sf, "nation")
    lines = n.select(F.format_string('{"recordId": "r%d"}', F.col("n_nationkey").cast("long")).alias("value"), F.col("n_nationkey").alias("k"))
    bad = table(spark, sf, "region").select(F.lit('{"recordId": "cut').alias("value"), (F.col("r_regionkey") * 5 + 2.5).alias("k"))
    lines.select("value", F.col("k").cast("double").alias("k")).union(bad).coalesce(1).sortWithinPartitions("k").select("value").write.text(path)
    manifest = n.where("n_nationkey % 2 = 0").select(F.format_string("r%d", F.col("n_nationkey").cast("long")).alias("recordId"))
    return readers.matched_output(readers.read_broken_lines(spark, path), manifest)[1]


@query("SELECT n_nationkey, n_name AS name, '/n/' || n_nationkey AS link, 3 AS cells FROM nation")
def html_tables(spark, sf):
    """Cells and links of list pages."""
    html = F.concat(F.lit("<html><script>var x='<td>no</td>'</script><table><tr><th>no</th></tr><tr><td> "), F.col("n_name"), F.lit(" </td><td>a &amp; b<td><a href='/n/"), F.col("n_nationkey").cast("string"), F.lit("'>more</a></td></tr></table>"))
    rows = table(spark, sf, "nation").select("n_nationkey", F.explode(readers.html_rows(html)).alias("row")).where("row.link IS NOT NULL")
    return rows.select("n_nationkey", F.get("row.cells", F.lit(0)).alias("name"), "row.link", F.size("row.cells").alias("cells"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_linenumber - 1 = 0) OR (l_quantity % 3 = 0) OR ((l_quantity % 3) / nullif(l_linenumber - 1, 0) < 0.3 AND l_partkey < 200) AS ocr FROM lineitem")
def needs_ocr(spark, sf):
    """No pages, no pages with text, or few of them and little text."""
    pages, with_text = F.col("l_linenumber") - 1, F.col("l_quantity") % 3
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", readers.needs_ocr(pages, with_text, F.col("l_partkey")).alias("ocr"))


@query("SELECT lpad(n_nationkey::VARCHAR, 8, '0') AS corp_code, n_name AS corp_name, CASE WHEN n_nationkey % 2 = 0 THEN lpad(n_nationkey::VARCHAR, 6, '0') END AS stock_code FROM nation")
def read_corp_codes(spark, sf):
    """S19."""
    path = scratch(spark, "codes")
    code = F.when(F.col("n_nationkey") % 2 == 0, F.lpad(F.col("n_nationkey").cast("string"), 6, "0")).otherwise(" ")
    row = F.concat(F.lit("<list><corp_code>"), F.lpad(F.col("n_nationkey").cast("string"), 8, "0"), F.lit("</corp_code><corp_name> "), F.col("n_name"), F.lit(" </corp_name><stock_code>"), code, F.lit("</stock_code></list>"))
    whole = F.concat(F.lit("<result>"), F.array_join(F.collect_list(row), ""), F.lit("</result>"))
    table(spark, sf, "nation").agg(whole.alias("value")).write.text(path)
    return readers.read_corp_codes(spark, path).select("corp_code", "corp_name", "stock_code")


@query("SELECT c_custkey, '회사 ' || c_custkey AS name FROM customer")
def read_encoded(spark, sf):
    """A file that is not UTF-8."""
    path = scratch(spark, "encoded")
    raw = "회사 ".encode("cp949").decode("latin-1")  # its bytes, one character each
    table(spark, sf, "customer").select(F.col("c_custkey").cast("string"), F.concat(F.lit(raw), F.col("c_custkey").cast("string"))).write.option("encoding", "iso-8859-1").csv(path)
    return readers.read_csv_any(spark, path, ["c_custkey", "name"]).select(F.col("c_custkey").cast("long").alias("c_custkey"), "name")


@query("SELECT 'f' || (o_orderkey % 500) AS file_id, md5('b_' || max(strftime(o_orderdate, '%Y%m%d')) || '_f' || (o_orderkey % 500)) AS report_id, '000000' AS code FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31' GROUP BY o_orderkey % 500")
def listed_reports(spark, sf):
    """An API list within its dates, once per file."""
    o = _orders(spark, sf).select(F.concat(F.lit("f"), (F.col("o_orderkey") % 500).cast("string")).alias("file_id"), F.date_format("o_orderdate", "yyyyMMdd").alias("date"), F.lit("b").alias("broker"), F.col("o_orderpriority").alias("title"), F.lit("").alias("code"))
    return readers.listed_reports(o, "1995-01-01", "1996-12-31").select("file_id", "report_id", "code")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y') AS year, CASE WHEN o_orderkey % 4 = 0 AND year(o_orderdate) = 1995 THEN 'new' ELSE 'old' END AS v FROM orders WHERE o_orderkey % 2 = 0 OR (o_orderkey % 5 = 0 AND year(o_orderdate) = 1995)")
def rewritten_months(spark, sf):
    """Only the partitions that the source touches are written anew."""
    path = scratch(spark, "rewrite")
    o = _orders(spark, sf).select("o_orderkey", F.date_format("o_orderdate", "yyyy").alias("year"), F.date_format("o_orderdate", "MM").alias("month"), F.lit("old").alias("v"))
    writers.rewrite_months(spark, path, o.where("o_orderkey % 2 = 0"), ["o_orderkey"], ["year", "month"], ["o_orderkey"])
    new = o.where("year = '1995' AND (o_orderkey % 4 = 0 OR (o_orderkey % 5 = 0 AND o_orderkey % 2 = 1))").withColumn("v", F.when(F.col("o_orderkey") % 4 == 0, "new").otherwise("old"))
    writers.rewrite_months(spark, path, new, ["o_orderkey"], ["year", "month"], ["o_orderkey"])
    return writers._as_text(spark, path, ["year", "month"]).select("o_orderkey", "year", "v")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN value * 2 ELSE value END AS value FROM events WHERE event_id % 3 <> 0 OR event_id % 2 = 0")
def merged_table(spark, sf):
    """Two merges into a table on disk; the later one wins."""
    path = scratch(spark, "merged")
    e = table(spark, sf, "events").select("event_id", "value")
    versions.merge_into(spark, path, e.where("event_id % 3 <> 0"), ["event_id"])
    versions.merge_into(spark, path, e.where("event_id % 2 = 0").withColumn("value", F.col("value") * 2), ["event_id"])
    return versions.read(spark, path)


def _versioned_orders(spark, sf, path):
    """Orders, then a merge that changes some, adds some and removes some, all with keys of one month."""
    o = _orders(spark, sf)
    month = F.date_trunc("month", "o_orderdate") == F.lit("1996-02-01")
    versions.merge_into(spark, path, o.where(~month | (F.col("o_orderkey") % 7 != 0)), ["o_orderdate", "o_orderkey"])
    change = o.where(month & (F.col("o_orderkey") % 3 != 2)).withColumns({"o_totalprice": F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")), "gone": F.col("o_orderkey") % 3 == 1})
    versions.merge_into(spark, path, change, ["o_orderdate", "o_orderkey"], gone="gone")


_CHANGED = "year(o_orderdate) = 1996 AND month(o_orderdate) = 2"


@query(f"SELECT o_orderkey, CASE WHEN {_CHANGED} AND o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE NOT ({_CHANGED}) OR o_orderkey % 3 = 0 OR (o_orderkey % 3 = 2 AND o_orderkey % 7 <> 0)")
def merged_month(spark, sf):
    """A merge of one month's keys, with removals, writes only the files whose range and filter admit them."""
    path = scratch(spark, "month")
    _versioned_orders(spark, sf, path)
    return versions.read(spark, path).select("o_orderkey", "o_totalprice")


@query(
    f"""WITH o AS (SELECT *, o_orderkey % 7 <> 0 AS held FROM orders WHERE {_CHANGED})
SELECT 'insert' AS change, o_orderkey, o_totalprice + 1 AS o_totalprice FROM o WHERE NOT held AND o_orderkey % 3 = 0
UNION ALL SELECT 'update_before', o_orderkey, o_totalprice FROM o WHERE held AND o_orderkey % 3 = 0
UNION ALL SELECT 'update_after', o_orderkey, o_totalprice + 1 FROM o WHERE held AND o_orderkey % 3 = 0
UNION ALL SELECT 'delete', o_orderkey, o_totalprice FROM o WHERE held AND o_orderkey % 3 = 1"""
)
def change_feed(spark, sf):
    """What a merge has changed, from the files that it has written anew."""
    path = scratch(spark, "feed")
    _versioned_orders(spark, sf, path)
    return versions.changes(spark, path, ["o_orderdate", "o_orderkey"], 1, 2).select("change", "o_orderkey", "o_totalprice")


@query(
    """WITH j AS (SELECT o_orderkey AS job_id, o_orderpriority AS priority, o_orderdate AS scheduled_at, row_number() OVER (ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS n FROM orders)
SELECT job_id, CASE WHEN n <= 10 THEN 'a' WHEN n BETWEEN 41 AND 70 THEN 'b' ELSE 'c' END AS owner, CASE WHEN n <= 10 OR n BETWEEN 41 AND 70 THEN 'DONE' ELSE 'RUNNING' END AS status FROM j WHERE n <= 100"""
)
def leased_jobs(spark, sf):
    """Rivals hold different jobs; of a's 40 it ends 10, the other 30 lapse and pass to c, and a, coming late, ends none."""
    path = scratch(spark, "jobs")
    o = _orders(spark, sf).select(F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").cast("timestamp").alias("scheduled_at"), F.lit("PENDING").alias("status"), F.lit(None).cast("string").alias("owner"), F.lit(None).cast("timestamp").alias("expires_at"))
    versions.merge_into(spark, path, o, ["job_id"])
    a = versions.claim(spark, path, "a", "2024-01-01 00:00:00", 40, 60)
    b = versions.claim(spark, path, "b", "2024-01-01 00:00:30", 30, 3600)
    versions.finish(spark, path, "a", a.orderBy("priority", "scheduled_at", "job_id").limit(10))
    versions.finish(spark, path, "b", a.union(b))
    versions.claim(spark, path, "c", "2024-01-01 00:02:00", 60, 3600)
    versions.finish(spark, path, "a", a)
    return versions.read(spark, path).where("owner IS NOT NULL").select("job_id", "owner", "status")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 10 OFFSET 49990")
def deep_page(spark, sf):
    """Page 5,000 of the line items by price, from the slice that holds it."""
    path, columns = scratch(spark, "ordered"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    order = [F.desc("l_extendedprice"), *columns[:-1]]
    pages.write_ordered(table(spark, sf, "lineitem").select(*columns), path, order, 10_000)
    return pages.read_page(spark, path, order, 5000, 10)[0]


@query("SELECT strftime(o_orderdate, '%Y-%m') AS dt, count(*) AS n FROM orders GROUP BY 1")
def exported_months(spark, sf):
    """K4: one partition per month, whatever the dates' format."""
    path = scratch(spark, "export")
    o = _orders(spark, sf)
    date = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.date_format("o_orderdate", "yyyy.MM.dd"))
    writers.export_by_month(o.withColumn("d", date), path, "d")
    return writers._as_text(spark, path, ["dt"]).groupBy("dt").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, c_name FROM customer")
def exported_csv(spark, sf):
    """K5: a byte-order mark before the header, which the reader takes off again."""
    path = scratch(spark, "csv")
    writers.export_csv(table(spark, sf, "customer").select("c_custkey", "c_name"), path)
    back = spark.read.option("header", True).csv(path)
    return back.toDF(*[c.replace("﻿", "") for c in back.columns]).select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name")


@query("SELECT 'r1' AS run_id, 'orders' AS \"table\", count(*) AS rows FROM orders UNION ALL SELECT 'r2', 'customer', count(*) FROM customer")
def run_log(spark, sf):
    """One row per run and table."""
    path = scratch(spark, "runs")
    writers.log_run(table(spark, sf, "orders"), path, "r1", "orders")
    writers.log_run(table(spark, sf, "customer"), path, "r2", "customer")
    return spark.read.parquet(path)


@query("SELECT o_orderkey, strftime(o_orderdate, '%m') AS month, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS v FROM orders")
def compacted_table(spark, sf):
    """K8: of equal keys the row of the last file stays, and partition values keep their spelling."""
    path = scratch(spark, "compact")
    o = _orders(spark, sf).select("o_orderkey", F.date_format("o_orderdate", "MM").alias("month"), F.lit(1).alias("v"))
    staged = [scratch(spark, "part"), scratch(spark, "part")]
    o.hint("rebalance", "month").write.partitionBy("month").parquet(staged[0])
    o.where("o_orderkey % 2 = 0").withColumn("v", F.lit(2)).hint("rebalance", "month").write.partitionBy("month").parquet(staged[1])
    fs = spark._jvm.org.apache.hadoop.fs
    for i, s in enumerate(staged):  # file names decide, so they are given here
        root = fs.Path(s)
        system = root.getFileSystem(spark._jsc.hadoopConfiguration())
        for folder in system.globStatus(fs.Path(f"{s}/month=*")):
            goal = fs.Path(f"{path}/{folder.getPath().getName()}")
            system.mkdirs(goal)
            for n, f in enumerate(system.globStatus(fs.Path(f"{folder.getPath().toString()}/part-*"))):
                system.rename(f.getPath(), fs.Path(f"{goal.toString()}/part-{i}-{n}.parquet"))
    writers.compact_partitions(spark, path, ["o_orderkey"], ["month"])
    return writers._as_text(spark, path, ["month"]).select("o_orderkey", "month", "v")


@query("SELECT n_nationkey, length(n_name) + 1 AS bytes, sha256(n_name || chr(10)) AS sha256 FROM nation")
def file_checksums(spark, sf):
    """Length and hash of every file."""
    path = scratch(spark, "files")
    table(spark, sf, "nation").select(F.col("n_name").alias("value"), F.col("n_nationkey").alias("k")).write.partitionBy("k").text(path)
    found = writers.checksums(spark, path).where("path LIKE '%part-%'")
    return found.select(F.regexp_extract("path", r"k=(\d+)", 1).cast("long").alias("n_nationkey"), "bytes", "sha256")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE o_orderkey % 4 = 0) AS broken FROM orders")
def mojibake(spark, sf):
    """UTF-8 that was read as Latin-1, as its bytes spelled one by one."""
    word = "삼성전자 보고서"
    text = F.when(F.col("o_orderkey") % 4 == 0, word.encode().decode("latin-1")).when(F.col("o_orderkey") % 4 == 1, "plain é").otherwise(word)
    return table(spark, sf, "orders").select(T.looks_mojibake(text).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.count_if("b").alias("broken"))


@query(f"WITH {BARS}, x AS (SELECT count(*) FILTER (WHERE NOT close > 40) AS close_positive, 0 AS volume_not_negative FROM bars), m AS (SELECT count(*) FILTER (WHERE n % 2 = 0) AS usdkrw_positive FROM (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1)) SELECT close_positive, volume_not_negative, usdkrw_positive FROM x, m")
def rule_violations(spark, sf):
    """Q1, Q2: bar and macro rules on stored tables."""
    path = f"{scratch(spark, 'rules')}.parquet"
    bars(spark, sf).withColumns({c: F.col(c) - 40 for c in filters.PRICES}).write.parquet(path)
    macro = table(spark, sf, "events").groupBy(F.col("ts").cast("date").alias("date")).agg(F.count(F.lit(1)).alias("n")).withColumn("usdkrw", F.when(F.col("n") % 2 == 1, F.col("n")).otherwise(0))
    found = stats.violations(readers.read_bars(spark, path), stats.bar_rules(), ["date", "ticker"]).select("close_positive", "volume_not_negative")
    return found.crossJoin(stats.violations(macro, stats.macro_rules(["usdkrw"]), ["date"]).select("usdkrw_positive"))
