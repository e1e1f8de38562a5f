"""Versioned tables: which files a merge writes, rivals, replayed batches, change feeds, leases, old versions."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from tidemark.sources import versions
from tidemark.streaming import incremental


@pytest.fixture()
def path(tmp_path):
    return str(tmp_path / "table")


def rows_of(spark, path, number=None):
    return sorted(tuple(r) for r in versions.read(spark, path, number).collect())


def names(spark, path, number=None):
    return {r.file for r in versions.files(spark, path, versions.version(spark, path, number)).collect()}


def test_a_merge_writes_few_files(spark, path, monkeypatch):
    monkeypatch.setattr(versions, "ROWS_A_FILE", 500)
    base = spark.range(20_000).select((F.col("id") * 3).alias("k"), F.col("id").alias("v"))
    assert versions.merge_into(spark, path, base, ["k"]) == 1
    before = names(spark, path)
    assert len(before) >= 30
    # ten keys that lie in one range, of which five are new
    source = spark.createDataFrame([(3000 + i * 3 + i % 2, -i) for i in range(10)], "k long, v long")
    assert versions.merge_into(spark, path, source, ["k"]) == 2
    after = names(spark, path)
    assert len(before - after) <= 2 and len(after - before) <= 3
    want = {3 * i: i for i in range(20_000)} | {3000 + i * 3 + i % 2: -i for i in range(10)}
    assert dict(rows_of(spark, path)) == want and dict(rows_of(spark, path, 1)) == {3 * i: i for i in range(20_000)}
    # keys inside the ranges that no file holds: the filters keep all files as they are
    fresh = spark.createDataFrame([(30 * i + 1, 0) for i in range(40)], "k long, v long")
    versions.merge_into(spark, path, fresh, ["k"])
    assert len(after - names(spark, path)) <= 2
    assert len(rows_of(spark, path)) == len(want | {30 * i + 1: 0 for i in range(40)})
    versions.compact(spark, path, ["k"])
    assert len(rows_of(spark, path)) == len(want | {30 * i + 1: 0 for i in range(40)})


def test_keys_of_several_columns_with_nulls_and_texts(spark, path):
    schema = "a string, b int, v string"
    versions.merge_into(spark, path, spark.createDataFrame([("x", 1, "old"), (None, 2, "old"), ("z", None, "old")], schema), ["a", "b"])
    versions.merge_into(spark, path, spark.createDataFrame([("x", 1, "new"), ("y", 1, "new")], schema).withColumn("w", F.lit(1)), ["a", "b"])
    got = {(r.a, r.b): (r.v, r.w) for r in versions.read(spark, path).collect()}
    assert got == {("x", 1): ("new", 1), ("y", 1): ("new", 1), (None, 2): ("old", None), ("z", None): ("old", None)}


def test_the_second_writer_fails(spark, path):
    one = spark.createDataFrame([(1, "a")], "k int, v string")
    versions.merge_into(spark, path, one, ["k"])
    with pytest.raises(versions.Conflict):
        versions.merge_into(spark, path, one, ["k"], expect=0)
    held = versions.version(spark, path)
    versions._create(spark, f"{path}/_log/{held.number + 1:020d}.json", '{"whole": false, "added": [], "removed": [], "batches": {}, "schema": %s}' % json.dumps(held.schema))
    with pytest.raises(versions.Conflict):
        versions._commit(spark, path, held, [], [], {}, held.schema)
    versions.merge_into(spark, path, spark.createDataFrame([(2, "b")], "k int, v string"), ["k"])
    assert rows_of(spark, path) == [(1, "a"), (2, "b")]


def test_rivals_lose_nothing(spark, path):
    failed = []

    def write(i):
        try:
            versions.merge_into(spark, path, spark.createDataFrame([(i, "v"), (0, f"{i}")], "k int, v string"), ["k"], attempts=20)
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(1, 4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and versions.version(spark, path).number == 3
    assert [k for k, _ in rows_of(spark, path)] == [0, 1, 2, 3]


def test_snapshots_keep_the_log_short(spark, path, monkeypatch):
    monkeypatch.setattr(versions, "SNAPSHOT", 3)
    for i in range(7):
        versions.merge_into(spark, path, spark.createDataFrame([(i, i), (0, i)], "k int, v int"), ["k"], batch=("s", i))
    held = versions.version(spark, path)
    assert held.number == 7 and held.parts <= 3 and held.batches == {"s": 6}
    assert dict(rows_of(spark, path)) == {0: 6} | {i: i for i in range(1, 7)} and dict(rows_of(spark, path, 2)) == {0: 1, 1: 1}
    gone = versions.vacuum(spark, path, 7)
    assert gone and dict(rows_of(spark, path)) == {0: 6} | {i: i for i in range(1, 7)}


def test_a_batch_counts_once(spark, path):
    put = incremental.merging(path, ["k"], [F.desc("t")], "s")
    batch = lambda *rows: spark.createDataFrame(list(rows), "k int, v string, t int")
    put(batch((1, "a", 1), (1, "b", 3)), 0)
    put(batch((1, "late", 2), (2, "c", 1)), 1)  # older than what is held
    put(batch((1, "again", 9)), 1)
    put(batch((1, "again", 9)), 0)
    assert rows_of(spark, path) == [(1, "b", 3), (2, "c", 1)] and versions.version(spark, path).number == 2


def test_removals_and_changes(spark, path):
    base = spark.createDataFrame([(i, f"v{i}") for i in range(6)], "k int, v string")
    versions.merge_into(spark, path, base, ["k"])
    change = spark.createDataFrame([(1, "v1", False), (2, "new", False), (3, None, True), (9, "added", False), (77, None, True)], "k int, v string, gone boolean")
    versions.merge_into(spark, path, change, ["k"], gone="gone")
    assert rows_of(spark, path) == [(0, "v0"), (1, "v1"), (2, "new"), (4, "v4"), (5, "v5"), (9, "added")]
    got = sorted(tuple(r) for r in versions.changes(spark, path, ["k"], 1).collect())
    assert got == [("delete", 3, "v3"), ("insert", 9, "added"), ("update_after", 2, "new"), ("update_before", 2, "v2")]
    assert versions.changes(spark, path, ["k"], 0, 1).where("change = 'insert'").count() == 6
    versions.merge_into(spark, path, spark.createDataFrame([(i, None, True) for i in range(10)], change.schema), ["k"], gone="gone")
    assert rows_of(spark, path) == [] and versions.changes(spark, path, ["k"], 2).where("change = 'delete'").count() == 6


def test_two_claimers_never_share_a_job(spark, path):
    jobs = spark.createDataFrame([(i, i % 3, "2024-01-01 00:00:00", "PENDING", None, None) for i in range(12)], "job_id long, priority int, scheduled_at string, status string, owner string, expires_at timestamp").withColumn("scheduled_at", F.col("scheduled_at").cast("timestamp"))
    versions.merge_into(spark, path, jobs, ["job_id"])
    got = {}
    threads = [threading.Thread(target=lambda o: got.update({o: [r.job_id for r in versions.claim(spark, path, o, "2024-01-02 00:00:00", 5, 60).collect()]}), args=(o,)) for o in "ab"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(got["a"]) == len(got["b"]) == 5 and not set(got["a"]) & set(got["b"]) and {0, 3, 6, 9} <= {*got["a"], *got["b"]}
    assert versions.claim(spark, path, "c", "2024-01-02 00:00:59", 5, 60).count() == 2  # those still pending
    late = versions.claim(spark, path, "d", "2024-01-02 00:01:00", 12, 60)  # a's and b's have lapsed
    assert sorted(r.job_id for r in late.collect()) == sorted([*got["a"], *got["b"]])
    mine = spark.createDataFrame([(i,) for i in got["a"]], "job_id long")
    assert versions.finish(spark, path, "a", mine).count() == 0 and versions.finish(spark, path, "d", mine).count() == 5
    assert versions.read(spark, path).where("status = 'DONE'").count() == 5
