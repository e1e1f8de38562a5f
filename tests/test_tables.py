import json
from datetime import date

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import windows as W
from tidemark.operators import asof, filters, learn, merge, panel, portfolio, stats
from tidemark.plans import market, registry
from tidemark.sources import readers, versions, writers
from tidemark.streaming import incremental


def test_rank_and_ewm_match_pandas(spark):
    values = [1.0, 1.0, 2.0, 3.0, 3.0, 3.0, None]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "date int, i int, v double")
    got = [r[0] for r in df.select("i", W.rank_pct(F.col("v")).alias("r")).orderBy("i").select("r").collect()]
    expected = pd.Series(values).rank(pct=True)
    assert [None if pd.isna(x) else round(x, 9) for x in expected] == [None if x is None else round(x, 9) for x in got]


def test_recursive_means_match_pandas(spark):
    rng = __import__("random").Random(4)
    short = [None, 3.0, None, 5.0, 4.0, None, 7.0]
    long = [None if rng.random() < 0.1 else rng.uniform(-50, 100) for _ in range(900)]
    sparse = [rng.uniform(0, 9) if i % 300 == 5 else None for i in range(900)]
    kept = {"a": short, "b": long, "c": sparse, "d": [None, None], "e": [2.0]}
    df = spark.createDataFrame([(t, i, v) for t, s in kept.items() for i, v in enumerate(s)], "ticker string, date int, v double").repartition(3)
    out = W.ewm_columns(df, {"fast": (F.col("v"), 2 / 13), "slow": (F.col("v"), 1 / 14)}, F.col("v").isNotNull())
    assert out.columns == ["ticker", "date", "v", "fast", "slow"]
    plan = out._jdf.queryExecution().toString()
    assert "collect_list" not in plan and plan.count("Exchange hashpartitioning") <= 2 * 2  # in the plan and its first form
    got = out.orderBy("ticker", "date").toPandas()
    for t, s in kept.items():
        for column, alpha in (("fast", 2 / 13), ("slow", 1 / 14)):
            want = pd.Series(s, dtype=float).ewm(alpha=alpha, adjust=False).mean()
            pd.testing.assert_series_equal(got[got.ticker == t][column].reset_index(drop=True), want, check_names=False, rtol=1e-9)


def test_rolling_matches_pandas(spark):
    bars = [(date(2024, 1, 1 + i % 28), f"T{i // 28}", float((i * 37) % 23 + 1)) for i in range(56)]
    df = spark.createDataFrame(bars, "date date, ticker string, close double")
    got = df.withColumn("m", W.before(F.stddev_samp, F.col("close"), 5, W.series())).orderBy("ticker", "date").toPandas()
    expected = got.groupby("ticker").close.transform(lambda s: s.shift(1).rolling(5).std())
    pd.testing.assert_series_equal(got.m, expected, check_names=False)


def test_feature_plan_has_few_exchanges(spark, sf):
    plan = panel.volatility_features(panel.price_features(market.bars(spark, sf)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(ticker") == 1


def test_filters_reach_the_scan(spark, sf):
    plan = spark.read.parquet(f"{sf}/orders.parquet").where(filters.in_months(F.lit(1996), F.lit(1), (1990, 1), (2000, 1)) & (F.col("o_custkey") == 7)).select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_custkey,7)" in plan and "ReadSchema: struct<o_orderkey" in plan


def test_features_refuse_targets(spark):
    with pytest.raises(ValueError):
        panel.build_features(spark.createDataFrame([(1,)], "target_gap int"))


def test_same_and_next_targets(spark):
    df = spark.createDataFrame([(date(2024, 1, d), "A", 10.0 * d, 11.0 * d) for d in (1, 2, 3)], "date date, ticker string, open double, close double")
    assert panel.targets(df).count() == 2 and panel.targets(df, "same").count() == 2
    assert panel.targets(df).agg(F.max("target_date")).first()[0] == date(2024, 1, 3)


def test_as_of_age(spark):
    left = spark.createDataFrame([(date(2024, 1, 10),), (date(2024, 1, 1),)], "date date")
    right = spark.createDataFrame([(date(2024, 1, 4), 5.0), (date(2024, 1, 9), None), (date(2024, 1, 10), -1.0)], "date date, x double")
    assert {r.date.day: r.x for r in asof.as_of(left, right, "x", 6).collect()} == {10: 5.0, 1: None}
    assert {r.date.day: r.x for r in asof.as_of(left, right, "x", 5).collect()} == {10: None, 1: None}


def test_folds(spark):
    folds = learn.expanding_folds(spark, date(2018, 1, 1), 3, 1, 1, date(2025, 1, 1))
    assert [r.fold_id for r in folds.orderBy("fold_id").collect()] == [1, 2, 3]
    with pytest.raises(ValueError):
        learn.check_folds(folds.withColumn("valid_start", F.col("train_start")))


def test_validity_rules(spark):
    rows = [("2024-01-01", "A", 1.0, 2.0, 0.5, 1.5, 10), ("2024-01-01", "B", 0.0, 2.0, 0.5, 1.5, 10), ("2024-01-01", "C", 1.0, 0.9, 0.5, 1.5, 10), ("2024-01-01", "D", 1.0, 2.0, 0.5, 1.5, 1), ("2024-01-01", "D", 1.0, 2.0, 0.5, 1.5, 1), ("2024-01-01", None, 1.0, 2.0, 0.5, 1.5, 1)]
    df = spark.createDataFrame(rows, "date string, ticker string, open double, high double, low double, close double, volume int")
    good, bad = filters.split_valid(df)
    assert [r.ticker for r in good.collect()] == ["A"] and bad.count() == 5
    with pytest.raises(ValueError):
        stats.check(stats.violations(df, stats.bar_rules(), ["date", "ticker"]))


def test_flags_and_universe(spark):
    df = spark.createDataFrame([("d", "A", "Common", 6e9, False), ("d", "B", "ETF", 9e9, False), ("d", "C", "common", 5e9, False), ("d", "D", "common", 9e9, None), ("d", "E", "common", 4e9, False)], "date string, ticker string, security_type string, trading_value_ma20 double, trading_halt boolean")
    assert [r.ticker for r in filters.universe(df, 10).collect()] == ["A", "C"]


def test_portfolio_limits(spark):
    rows = [("d", f"T{i}", 1 - 0.01 * i, 0.01 * i, f"S{i % 5}", "KOSPI") for i in range(50)]
    df = spark.createDataFrame(rows, "date string, ticker string, ranking_score double, expected_return double, sector string, market_type string")
    got = portfolio.select_portfolio(df)
    assert got.count() == 10 and abs(got.agg(F.sum("weight")).first()[0] - 1) < 1e-9
    assert got.groupBy("sector").count().agg(F.max("count")).first()[0] <= 3
    assert {int(r.ticker[1:]) for r in got.collect()} <= set(range(30))


def test_merge_and_latest(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    s = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert sorted(map(tuple, merge.merge(t, s, ["k"]).collect())) == [(1, "a"), (2, "B"), (3, "C")]
    assert sorted(map(tuple, merge.append_new(t, s, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "C")]
    rows = spark.createDataFrame([("c", "2024-01-02", "1", "x", 0), ("c", "20240103", "2", "x", 1), ("c", None, "3", None, 2), ("c", None, "4", " ", 3)], "corp_code string, rcept_dt string, rcept_no string, repror string, pos int")
    assert sorted(r.rcept_no for r in merge.latest_ownership(rows, "pos").collect()) == ["2", "3", "4"]


def test_drifting_files(spark, tmp_path):
    spark.createDataFrame([(1, 515679)], "id int, stkqy long").write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([("2", "약식", "x")], "id string, stkqy string, extra string").write.parquet(str(tmp_path / "b"))
    got = readers.read_drifting(spark, [str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "none")])
    assert {t for _, t in got.dtypes} == {"string"} and sorted(map(tuple, got.collect())) == [("1", "515679", None), ("2", "약식", "x")]


def test_broken_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{"a":\n 2}\n\n{"a": "cut {[ \\" \nhere"}\n{"b": {\n{"c": 3}\n[4]\n{"a": "tail')
    got = [(r.line, r.record and json.loads(r.record), r.error) for r in readers.read_broken_lines(spark, str(tmp_path / "x.jsonl")).orderBy("line").collect()]
    assert got == [(1, {"a": 1}, None), (2, {"a": 2}, None), (5, {"a": 'cut {[ " here'}, None), (7, None, '{"b": {'), (8, {"c": 3}, None), (9, [4], None), (10, None, '{"a": "tail')]
    known = spark.createDataFrame([("1",)], "a string")
    rows, counts = readers.matched_output(readers.read_broken_lines(spark, str(tmp_path / "x.jsonl")), known, "a")
    assert rows.count() == 1 and counts.first().asDict() == {"records": 5, "errors": 2, "matched": 1, "unknown": 4}


def test_html_rows(spark):
    html = "<table><tr><td>A &amp; B</td><td><a href='/x'>t</a></td></tr></table><ul><li>one<script>no</script><li>two</ul>"
    got = spark.createDataFrame([(html,)], "h string").select(readers.html_rows(F.col("h"))).first()[0]
    assert [(list(r.cells), r.link) for r in got] == [(["A & B", "t"], "/x"), (["one"], None), (["two"], None)]


def test_xml_codes(spark, tmp_path):
    (tmp_path / "c.xml").write_text("<result><list><corp_code>00000001</corp_code><corp_name>가</corp_name><corp_eng_name>A</corp_eng_name><stock_code> </stock_code><modify_date>20240101</modify_date></list></result>")
    row = readers.read_corp_codes(spark, str(tmp_path / "c.xml")).first()
    assert row.corp_code == "00000001" and row.stock_code is None


def test_month_rewrite_and_compaction(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("2024", "01", 1, "a"), ("2024", "02", 2, "b")], "year string, month string, id int, v string")
    writers.rewrite_months(spark, path, first, ["id"], ["year", "month"], ["id"])
    writers.rewrite_months(spark, path, spark.createDataFrame([("2024", "02", 2, "B"), ("2024", "02", 3, "c")], first.schema), ["id"], ["year", "month"], ["id"])
    assert sorted((r.id, r.v) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "B"), (3, "c")]
    assert sorted((r.id, r.v) for r in readers.read_months(spark, path, [(2024, 1)]).collect()) == [(1, "a")]
    writers.write_partitioned(first.withColumn("month", F.lit(" ")), str(tmp_path / "p"), ["year", "month"])
    assert spark.read.parquet(str(tmp_path / "p")).select("month").distinct().first()[0] == "NA"
    writers.compact_partitions(spark, path, ["id"], ["year", "month"])
    assert spark.read.parquet(path).count() == 3
    assert writers.checksums(spark, path).where("length(sha256) = 64").count() > 0


def test_stream_merges_once(spark, tmp_path):
    schema = "k int, v string, t int"
    source, table, state = (str(tmp_path / x) for x in ("in", "table", "state"))
    for batch in ([(1, "a", 1), (1, "b", 2)], [(1, "c", 3), (2, "d", 1)]):
        df = spark.createDataFrame(batch, schema)
        df.write.mode("append").parquet(source)
        incremental.merge_stream(incremental.file_stream(spark, source, df.schema), table, ["k"], [F.desc("t")], state).awaitTermination()
    assert sorted((r.k, r.v) for r in versions.read(spark, table).collect()) == [(1, "c"), (2, "d")]


def test_training_and_prediction(spark):
    rows = spark.createDataFrame([(float(i), float(i % 7), None if i == 3 else 2.0 * i, 0.1 * i, 0.2 * i) for i in range(40)], "x double, y double, target_ranking double, target_gap double, target_intraday double")
    models = learn.train(rows, ["x", "y"], iterations=3)
    assert {"ranking_score", "pred_gap", "pred_intraday"} <= set(learn.predict(models, rows, ["x", "y"]).columns)
    with pytest.raises(ValueError):
        learn.predict(models, rows.drop("y"), ["x", "y"])
    assert stats.redundant(rows.withColumn("z", F.col("x") * 2), ["x", "y", "z"]) == ["z"]


def test_walk_forward_query_predicts_every_fold(spark, sf):
    got = registry.queries()["model_walk_forward"](spark, sf).groupBy("fold_id").agg(F.min("feature_date"), F.max("feature_date")).collect()
    found = {r[0]: (str(r[1]), str(r[2])) for r in got}
    assert set(found) == {f[0] for f in market.FOLDS}
    assert all(f[5] <= found[f[0]][0] <= found[f[0]][1] <= f[6] for f in market.FOLDS)
