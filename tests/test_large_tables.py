"""Cases that only larger or odder tables have."""

import math
import re

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import documents, ivf, panel, portfolio
from tidemark.plans import filings, registry, storage
from tidemark.plans.streams import _TablePages
from tidemark.sources import pages, readers, versions
from tidemark.streaming import incremental, state


def test_trade_returns_over_a_price_of_zero(spark):
    rows = spark.createDataFrame([(1, 10.0, 11.0), (2, 0.0, 5.0), (3, 0.0, 0.0), (4, None, 1.0), (5, 0.0, None)], "k int, open double, close double")
    got = {r.k: r.r for r in rows.select("k", F.round(portfolio.trade_return(F.col("open"), F.col("close")), 6).alias("r")).collect()}
    assert got[1] == round((11 * 0.999) / (10 * 1.001) - 1 - 0.003, 6)
    assert got[2] == math.inf and math.isnan(got[3]) and got[4] is None and got[5] is None


def test_returns_round_as_their_sql_does(spark, tmp_path):
    bars = [(236.8, 730.73), (864.0, 510.51), (1.28, 670.67), (172.8, 530.53), (518.4, 390.39), (0.96, 16.64), (1.61, 1.28), (19.97, 20.07), (0.0, 5.0), (0.0, 0.0), (-0.0, 5.0), (-0.0, -5.0), (10.0, -1e306), (None, 1.0), (9.0, math.nan)]
    rows = [(3 * i + j, i, f"2024-01-0{day} 0{j}:00:00", bar[j % 2]) for i, bar in enumerate(bars) for j, day in enumerate((2, 2, 3))]
    spark.createDataFrame(rows, "event_id long, user_id long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    for name, column in (("trade_returns", "trade_return"), ("raw_returns", "raw_return")):
        got = {(r.date, r.ticker): repr(r[column]) for r in registry.queries()[name](spark, str(tmp_path)).collect()}
        want = duck.execute(f"select date, ticker, {column} from ({registry.oracle_sql()[name]})").fetchall()
        assert got == {(d, t): repr(x) for d, t, x in want}


def test_an_index_takes_any_number_of_queries(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 8))
    x[9] = x[3]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    path = str(tmp_path / "index")
    ivf.build(vectors, path)
    queries = vectors.where("vec_id < 1203").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    score = np.round(x[:1203] @ x.T, ivf.DIGITS)
    want = {(q, int(i), n + 1) for q in range(1203) for n, i in enumerate(np.lexsort((np.arange(1500), -score[q]))[:5])}
    monkeypatch.setattr(ivf, "PAIRS_A_PASS", 1)  # two passes
    got = ivf.search_all(spark, path, queries, 5, None)
    assert {(r.query_id, r.vec_id, r.rank) for r in got.collect()} == want
    assert ivf.search_all(spark, path, queries, 5, probes=2).count() == 1203 * 5


def test_ordered_tables_have_fewer_ranges_than_slices(spark, tmp_path):
    path, order = str(tmp_path / "ordered"), [F.desc("k")]
    pages.write_ordered(spark.range(6000).select((F.col("id") * 7919 % 6000).alias("k")), path, order, 20)
    counts = spark.read.parquet(f"{path}/counts").collect()
    assert max(r.n for r in counts) == 20 and len({r.slice >> 20 for r in counts}) <= 6000 / 20 / 50
    for number in (1, 77, 400, 401):
        rows, totals = pages.read_page(spark, path, order, number, 15)
        assert [r.k for r in rows.collect()] == list(range(5999 - (number - 1) * 15, -1, -1))[:15] and totals["total"] == 6000


def test_a_paged_service_reads_the_slices_of_a_page(spark, tmp_path):
    path = str(tmp_path / "served")
    pages.write_ordered(spark.range(95).select("id", F.col("id").cast("string").alias("v")), path, [F.col("id")], 10)
    client, read = _TablePages(path, "id", 7), []
    whole = client._table
    client._table = lambda name: read.append(name) or whole(name)
    assert client.pages() == 14
    assert [r["id"] for p in range(14) if p % 7 != 3 for r in client.fetch(p)] == [i for i in range(95) if i // 7 % 7 != 3]
    assert len(read) == len(set(read)) == 11  # the counts and each slice once


def test_text_functions_hold_few_rows_at_once(spark):
    held = []
    got = T.by_row(lambda s: held.append(s) or f"{len(held)}", pa.string(), "string")
    texts = [None, "", "매출액 12\n5.6%", "a\\u0041\\ud83d\\ude00b\nCompliance Notice\nx", "<table><tr><td>a<td>b</tr></table><ul><li><a href=u>c</a></ul>"] * 40
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string").repartition(1)
    assert max(int(r.n) for r in df.select(got("t").alias("n")).collect()) <= 200
    lines = df.select("k", "t", T.report_lines(F.col("t")).alias("l"), readers.html_rows(F.col("t")).alias("h"))
    for r in lines.select("*", T.table_signal(F.col("l"), 100).alias("s")).collect():
        assert r.l == [[], [], ["매출액 12", "5.6%"], ["aA😀b"], [texts[4]]][r.k % 5]
        assert r.s == ("매출액 12: 12, 5.6%" if r.k % 5 == 2 else "")
        assert [(x.cells, x.link) for x in r.h] == ([(["a", "b"], None), (["c"], "u")] if r.k % 5 == 4 else [])


def test_short_texts_are_one_chunk():
    for text in ("", " \n\t", "　x y　", "가" * 400, "a" * 400 + " "):
        assert documents.chunk_text(text) == ([text.strip()] if text.strip() else [])
    assert len(documents.chunk_text("가" * 401)) == 2


def test_boilerplate_is_cut_from_one_evaluation(spark):
    plan = spark.range(1).select(T.report_lines(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("_unescape(") == 1


def test_files_to_compact_are_written_by_many_tasks(spark, sf, monkeypatch):
    found, whole = set(), storage.writers.compact_partitions
    monkeypatch.setattr(storage.writers, "compact_partitions", lambda s, path, *a: found.update(r.n for r in s.read.parquet(path).select(F.col("_metadata.file_name").alias("n")).distinct().collect()) or whole(s, path, *a))
    rows = registry.queries()["compacted_table"](spark, sf).collect()
    assert found and all(re.fullmatch(r"part-[01]-\d+\.parquet", n) for n in found)
    assert all(r.v == (2 if r.o_orderkey % 2 == 0 else 1) for r in rows)


def test_conversations_end_when_idle_without_python(spark, tmp_path):
    schema, at = "key long, ts timestamp, turn long, text string", lambda m: F.timestamp_seconds(F.lit(1_704_067_200) + 60 * m)
    texts = F.when(F.col("id") == 1, None).when(F.col("id") == 2, "x,y").otherwise(F.concat(F.lit("t"), F.col("id").cast("string")))
    rows = spark.range(10).select((F.col("id") * 0 + 7).alias("key"), at(F.col("id") * 60).alias("ts"), F.col("id").alias("turn"), texts.alias("text"))
    one = lambda key, minute, turn: spark.range(1).select(F.lit(key).alias("key"), at(F.lit(minute)).alias("ts"), F.lit(turn).alias("turn"), F.lit("z").alias("text"))
    source, goal, checkpoint = (str(tmp_path / x) for x in ("in", "table", "state"))
    build = lambda s: state.conversations(s, "1 hour", 6, 180)
    # the turn at 720 comes exactly as long after the last one as a conversation may be idle, that at 901 a minute later
    for part in (rows, one(7, 720, 10).union(one(7, 901, 11)), one(-1, 9000, 12)):
        part.coalesce(1).write.mode("append").parquet(source)
        with state.stateful(spark):
            incremental.merge_stream(build(incremental.file_stream(spark, source, spark.createDataFrame([], schema).schema)), goal, ["key", "started"], [], checkpoint).awaitTermination()
    got = versions.read(spark, goal).orderBy("started").collect()
    assert [(r.key, r.n_turns, r.turns, r.topics) for r in got] == [(7, 11, ["t5", "t6", "t7", "t8", "t9", "z"], "t0,t3,t4,x,y"), (7, 1, ["z"], "")]
    assert (got[0].last - got[0].started).total_seconds() == 720 * 60
    assert "Python" not in build(spark.createDataFrame([], schema))._jdf.queryExecution().optimizedPlan().toString()


def test_a_batch_is_evaluated_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    batch = spark.range(8).repartition(2).select("id", F.udf(lambda x: (seen.add(1), x)[1], "long")("id").alias("v"))
    put = incremental.merging(str(tmp_path / "t"), ["id"], [], "s")
    for number, evaluated in ((0, 8), (0, 16), (1, 24)):  # one that comes again too, as a stream's state goes with it
        put(batch, number)
        assert seen.value == evaluated
    put(batch.where("id < 0"), 2)
    assert versions.version(spark, str(tmp_path / "t")).batches == {"s": 1}


def test_ranks_of_a_date_without_its_whole_bars(spark):
    rows = [("d1", "a", 1.0, 2.0, "x"), ("d1", "b", 1.0, None, None), ("d1", "c", 3.0, None, "z"), ("d1", "c", 0.5, math.nan, "w"), ("d2", "a", None, None, "v")]
    df = spark.createDataFrame(rows, "date string, ticker string, rsi14 double, atr_percent double, note string")
    ranked = panel.rank_features(df)
    assert ranked.columns == [*df.columns, "atr_rank_pct", "rsi_rank_pct"]
    got = sorted(ranked.collect(), key=lambda r: (r.date, r.ticker, r.rsi14 or 0))
    assert [(r.note, r.rsi_rank_pct, r.atr_rank_pct) for r in got] == [("x", 0.625, 0.5), (None, 0.625, None), ("w", 0.25, 1.0), ("z", 1.0, None), ("v", None, None)]
    bars = spark.createDataFrame([("d1", "a", "s", 1.0, 2.0), ("d1", "b", None, 3.0, 4.0), ("d1", "c", "s", None, 8.0)], "date string, ticker string, sector string, return_5d double, return_20d double")
    momentum = panel.momentum_features(bars)
    assert [(r.relative_return_5d_vs_market, round(r.relative_return_20d_vs_market, 6), r.relative_return_20d_vs_sector) for r in momentum.orderBy("ticker").collect()] == [(-1.0, -2.666667, -3.0), (1.0, -0.666667, None), (None, 3.333333, 3.0)]
    # no window holds whole bars of a date, only sums of its sectors
    for plan in (ranked, momentum):
        windows = re.findall(r"^[ :+-]*Window (\[.*\]), \[date#\d+(?:, sector#\d+)?\]", plan._jdf.queryExecution().optimizedPlan().toString(), re.M)
        assert all(w.startswith("[sum(_sum5") for w in windows)


def test_filings_gather_plain_lines_by_many_tasks(spark, sf, monkeypatch):
    monkeypatch.setattr(filings, "FEW_LINES", 100)
    monkeypatch.setattr(filings, "TASKS", 50)
    assert filings._tasks(spark.range(1)) == 1 and filings._tasks(spark.range(6000)) == 50
    monkeypatch.setattr(filings, "MOST_LINES", 75)
    assert filings._tasks(spark.range(6000)) == 80
    tree = registry.queries()["filing_financials"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    gathered = [x for x in tree.splitlines() if "collect_list" in x]
    assert len(gathered) == 1 and "map(" not in gathered[0] and tree.count("RepartitionByExpression") == 2
