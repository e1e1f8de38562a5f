import json

import pytest

from tidemark.sources import remote


def test_source_reads_one_task_per_key(spark):
    fetch = lambda key: [{"k": key, "n": i} for i in range(2)]
    spark.dataSource.register(remote.remote_source("pages_of", "k string, n int", fetch))
    df = spark.read.format("pages_of").option("keys", json.dumps(["a", "b"])).load()
    assert sorted(map(tuple, df.collect())) == [("a", 0), ("a", 1), ("b", 0), ("b", 1)] and df.rdd.getNumPartitions() == 2


def test_retry():
    calls = []

    def fails(key):
        calls.append(key)
        raise TimeoutError

    with pytest.raises(TimeoutError):
        remote.with_retry(fails, 3, 0)("x")
    assert len(calls) == 3


def test_extraction_keeps_failed_rows(spark):
    def client(text):
        if not text:
            raise ValueError("empty")
        return text.upper()

    got = {r.report_id: r for r in remote.extract_each(spark.createDataFrame([("1", "a"), ("2", None)], "report_id string, text string"), client).collect()}
    assert got["1"].answer == "A" and got["2"].error == "ValueError: empty"
    assert remote.api_dimension(spark, [("mgIssDsps", "DS005", "t", "p")]).first().is_event
