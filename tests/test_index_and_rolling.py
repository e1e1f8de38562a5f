"""The vector index and the models of every day against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ivf, rolling


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    middle = rng.standard_normal((30, 16)) * 3
    x = middle[rng.integers(0, 30, 3000)] + rng.standard_normal((3000, 16))
    x[7] = x[5]  # ties go to the smaller id
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None)], "vec_id long, embedding array<double>").repartition(4)
    return df.cache(), x


def best(x, asked, k):
    score = np.round(asked @ x.T, ivf.DIGITS)
    return {(q, int(i), r + 1) for q in range(len(asked)) for r, i in enumerate(np.lexsort((np.arange(len(x)), -score[q]))[:k])}


def test_index(spark, vectors, tmp_path):
    df, x = vectors
    path = str(tmp_path / "index")
    ivf.build(df, path)
    asked = x[::100]
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, query array<double>")
    want = best(x, asked, 10)
    exact = ivf.search(spark, path, queries, 10, None)
    assert {(r.query_id, r.vec_id, r.rank) for r in exact.collect()} == want
    assert spark.read.parquet(f"{path}/vectors").count() == 3000
    few = ivf.search(spark, path, queries, 10, 0.95)
    found = ivf.found_of(few, exact).agg(F.sum("found") / F.sum("n")).first()[0]
    assert found >= 0.95
    info = spark.read.schema(ivf._INFO).json(f"{path}/info").first()
    cells = [p.cells for p in info.probes]
    assert cells == sorted(cells) and cells[2] < info.cells / 2  # vectors that gather need few cells
    one = ivf.search(spark, path, queries, 10, probes=1)
    assert 0 < ivf.found_of(one, exact).agg(F.sum("found")).first()[0] < len(want)
    # only the folders of the probed cells are read
    assert len({f.split("cell=")[1].split("/")[0] for f in ivf._scan(spark, path, 16, [0], asked[:1], {3: [0], 4: [0]}, 5).inputFiles()}) <= info.cells
    with pytest.raises(ValueError):
        ivf.search(spark, path, spark.range(1001).select(F.col("id").alias("query_id"), F.array(*[F.lit(0.0)] * 16).alias("query")), 3)


def test_index_of_nothing_and_of_odd_vectors(spark, vectors, tmp_path):
    df, x = vectors
    path = str(tmp_path / "index")
    ivf.build(df, path)
    ivf.build(df.limit(0), path)  # over an index that was there
    queries = spark.createDataFrame([(1, x[0].tolist())], "query_id long, query array<double>")
    assert ivf.search(spark, path, queries, 5).count() == 0 and ivf.search(spark, path, queries, 5, None).count() == 0
    with pytest.raises(ValueError):
        ivf.build(df.union(spark.createDataFrame([(9, [1.0])], df.schema)), path)


def test_rolling_models_equal_those_of_each_day(spark):
    rng = np.random.default_rng(1)
    days = np.repeat(np.arange(40), rng.integers(1, 9, 40))
    x = rng.standard_normal((len(days), 3))
    y = x @ [1.0, -2.0, 0.5] + 0.3 + 0.1 * rng.standard_normal(len(days))
    miss = rng.random((len(days), 3)) < 0.2
    rows = [(f"2024-{1 + d // 28:02d}-{1 + d % 28:02d}", i, *[None if m else float(v) for v, m in zip(x[i], (miss[i, 0], False, False))], None if miss[i, 1] else float(y[i]), None if 10 <= d < 25 else float(-y[i]), float(y[i] ** 2)) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "feature_date string, ticker long, a double, b double, c double, target_ranking double, target_gap double, target_intraday double").withColumn("feature_date", F.col("feature_date").cast("date")).repartition(5)
    window, ridge = 7, 0.5
    got = {(str(r.date), r.target): (r.n, r.coefficients) for r in rolling.rolling_models(df, ["a", "b", "c"], window, ridge).collect()}
    x0 = np.where(np.column_stack([miss[:, 0], np.zeros((len(days), 2), bool)]), 0.0, x)
    want = {}
    for d in range(window, 40):
        for t, (name, value) in enumerate({"ranking": np.where(miss[:, 1], np.nan, y), "gap": np.where((days >= 10) & (days < 25), np.nan, -y), "intraday": y**2}.items()):
            some = (days >= d - window) & (days < d) & ~np.isnan(value)
            if some.any():
                z = np.column_stack([np.ones(some.sum()), x0[some]])
                want[f"2024-{1 + d // 28:02d}-{1 + d % 28:02d}", name] = (int(some.sum()), np.linalg.lstsq(z.T @ z + ridge * np.diag([0, 1, 1, 1]), z.T @ value[some], rcond=None)[0])
    assert got.keys() == want.keys() and ("2024-01-20", "gap") not in got
    for k, (n, c) in want.items():
        assert got[k][0] == n and np.allclose(got[k][1], c, atol=1e-8), k
    out = rolling.predictions(df, rolling.rolling_models(df, ["a", "b", "c"], window, ridge), ["a", "b", "c"])
    assert out.count() == int((days >= window).sum()) and {"ranking_score", "pred_gap", "pred_intraday"} <= set(out.columns)
    row = out.where("ticker = %d" % (len(days) - 1)).first()
    assert abs(row.ranking_score - np.r_[1, x0[-1]] @ want[str(row.feature_date), "ranking"][1]) < 1e-8
    with pytest.raises(ValueError):
        rolling.predictions(df.drop("a"), df.limit(0), ["a"])
