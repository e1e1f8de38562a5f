import re
import sys
import threading
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidemark.sources import paged, pages, versions
from tidemark.streaming import incremental

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests


class Service:
    """Pages as files of a folder, so that workers see what is added."""

    def __init__(self, folder, slow=(), broken=()):
        self.folder, self.slow, self.broken, self.asked = str(folder), set(slow), set(broken), set()

    def pages(self):
        import os

        return len(os.listdir(self.folder))

    def fetch(self, page):
        if page in self.broken:
            raise ConnectionError
        if page in self.slow and page not in self.asked:
            self.asked.add(page)
            time.sleep(2)
        return [{"k": int(x), "v": f"p{page}"} for x in open(f"{self.folder}/{page:04d}").read().split()]


def put(folder, first, end):
    for p in range(first, end):
        (folder / f"{p:04d}").write_text(f"{p * 10} {p * 10 + 1}")


def test_batches_in_several_tasks_with_slow_pages(spark, tmp_path):
    put(tmp_path, 0, 9)
    spark.dataSource.register(paged.paged_source("svc_a", "k long, v string", Service(tmp_path, slow=[2, 5]), paged.Patience(2, 0.5, 0.01)))
    df = spark.read.format("svc_a").option("pages", 4).load()
    assert df.rdd.getNumPartitions() == 3
    assert [tuple(r) for r in df.collect()] == [(p, p * 10 + i, f"p{p}") for p in range(9) for i in (0, 1)]


def test_a_page_that_always_fails_is_an_error(tmp_path):
    put(tmp_path, 0, 2)
    began = time.time()
    with pytest.raises(paged.SourceFailed, match="page 1: ConnectionError in 3 attempts"):
        paged.Patience(3, 1, 0.01).fetch(Service(tmp_path, broken=[1]), 1)
    with pytest.raises(paged.SourceFailed, match="page 0: TimeoutError"):
        paged.Patience(1, 0.05, 0.01).fetch(Service(tmp_path, slow=[0]), 0)
    assert time.time() - began < 1.5 and threading.active_count() < 50


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()
    table, state = str(tmp_path / "table"), str(tmp_path / "state")
    spark.dataSource.register(paged.paged_source("svc_b", "k long, v string", Service(pages), paged.Patience(2, 5, 0.01)))
    for first, end in ((0, 5), (5, 8), (8, 8)):
        put(pages, first, end)
        stream = spark.readStream.format("svc_b").option("pages", 2).load()
        incremental.merge_stream(stream, table, ["k"], [F.col("page")], state, "svc").awaitTermination()
        assert sorted(r.k for r in versions.read(spark, table).collect()) == [p * 10 + i for p in range(end) for i in (0, 1)]
    assert versions.version(spark, table).number == 2  # the third run had nothing to read


def test_pages_read_the_slices_that_hold_them(spark, tmp_path):
    path = str(tmp_path / "ordered")
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 10).alias("g"))
    order = [F.desc("g"), F.col("k")]
    pages.write_ordered(df, path, order, 100)
    want = sorted((tuple(r) for r in df.collect()), key=lambda r: (-r[1], r[0]))
    for number, size in ((1, 10), (7, 13), (10, 100), (40, 25), (3, 400), (41, 25)):
        rows, totals = pages.read_page(spark, path, order, number, size)
        assert [tuple(r) for r in rows.collect()] == want[(number - 1) * size : number * size]
        assert totals == {"total": 1000, "total_pages": -(-1000 // size)}
    deep = pages.read_page(spark, path, order, 38, 25)[0]
    assert re.search(r"PartitionFilters: \[[^\]]*slice", deep._jdf.queryExecution().toString())
    pages.write_ordered(df.limit(0), path, order)
    assert pages.read_page(spark, path, order, 1, 10)[0].count() == 0
