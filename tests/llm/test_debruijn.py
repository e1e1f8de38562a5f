"""Removal of repeated word spans against brute force, and the compaction of the graph."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import debruijn

SPAN = 50
SCHEMA = "doc_id long, text string, n_chars long, spans string, checks string, span_id string, span_mark string, mark string, head string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    base, passage, other = words(rng, 300), words(rng, 80), words(rng, 120)
    out = [(5, base), (5, base), (5, words(rng, 30) + " " + passage + " " + words(rng, 20)), (5, passage + " x " + words(rng, 30)), (9, base), (9, base), (None, base), (3, None), (2, ""), (1, " \t\n")]
    out += [(11, "y " * 700), (12, "y " * 300 + passage), (4, words(rng, 20) + "\n" + passage), (20, " ".join([*base.split()[:150], "Q", *base.split()[150:]])), (21, "é 東 " * 60 + "q" * 2000 + " " + passage)]
    for i in range(60):
        w = base.split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(300)] = f"z{i}"
        out.append((30 + i // 2, " ".join(w[rng.randrange(100) :]) + " " + " ".join(passage.split()[rng.randrange(60) :]) + " " + " ".join(other.split()[: rng.randrange(30, 120)])))
    long = words(rng, 260_000, 10**6)
    return [*out, *[(200 + i, words(rng, 60, 2)) for i in range(30)], (300, long), (301, long[:1_200_000]), (302, long)]


def brute(rows):
    first, out = {}, []
    for d, t in rows:
        w = split(t) if d is not None else []
        for a in range(len(w) - SPAN + 1):
            k = hash(tuple(w[a : a + SPAN]))
            first[k] = min(first.get(k, d), d)
    for d, t in rows:
        w = split(t)
        gone = np.zeros(len(w), bool)
        for a in range(len(w) - SPAN + 1 if d is not None else 0):
            if first[hash(tuple(w[a : a + SPAN]))] < d:
                gone[a : a + SPAN] = True
        out.append((d, len(w), int(gone.sum()), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, len(t or ""), "s", "c", "i", "m", "k", "h") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("chars", [8_000_000, 200_000])
def test_digest(spark, rows, monkeypatch, chars):
    monkeypatch.setattr(debruijn, "PARTITION_CHARS", chars)
    docs = frame(spark, rows)
    assert sorted(map(tuple, debruijn.digest(docs.repartition(3)).collect()), key=str) == sorted(brute(rows), key=str)
    assert debruijn.digest(docs.limit(0)).count() == 0


def test_texts(spark, rows):
    rows = rows[:20]
    docs = frame(spark, rows)
    got = debruijn.without_repeats(docs)
    assert got.columns == docs.columns
    kept = sorted(((r.doc_id, hashlib.sha256(" ".join(split(r.text)).encode()).hexdigest()) for r in got.collect()), key=str)
    assert kept == sorted(((d, h) for d, _, _, h in brute(rows)), key=str)
    by = {r.doc_id: r for r in got.collect()}
    assert by[3].text is None and by[1].text == " \t\n" and by[9].text == "" and by[9].n_chars == 0 and by[9].spans == "s"


def test_paths_end_at_branches_and_join_at_borders(spark):
    # two runs of documents 1 and 2 (edges 10..14, then 15..19), of which document 3 leaves after 12 and document 4 has the end alone
    runs = [(1, 0, 5, 10, 0, 7), (1, 5, 5, 15, 7, 0), (2, 0, 5, 10, 0, 7), (2, 5, 5, 15, 7, 0), (3, 0, 3, 10, 0, 0), (4, 0, 2, 18, 0, 0)]
    docs, starts, sizes, first, heads, tails = (np.array(x) for x in zip(*runs))
    key = np.concatenate([np.arange(a, a + n) for a, n in zip(first, sizes)]).astype(np.uint64)
    places, paths = debruijn.graph_pieces(docs, docs * 0, starts, sizes, heads.astype(np.uint64), tails.astype(np.uint64), key)
    assert sorted(zip(*(places.column(c).to_pylist() for c in ("doc_id", "start", "n", "src_doc", "src_start")))) == [
        (2, 0, 3, 1, 0), (2, 3, 2, 1, 3), (2, 5, 3, 1, 5), (2, 8, 2, 1, 8), (3, 0, 3, 1, 0), (4, 0, 2, 1, 8),
    ]
    assert sorted(zip(*(paths.column(c).to_pylist() for c in ("start", "n", "head", "tail")))) == [(0, 3, None, None), (3, 2, None, 7), (5, 3, 7, None), (8, 2, None, None)]
    graph = spark.createDataFrame([tuple(r.values()) for r in paths.to_pylist()], debruijn._PIECE)
    assert sorted((r.src_start, r.path) for r in debruijn.compacted(graph).collect()) == [(0, 0), (3, 3), (5, 3), (8, 8)]
    # a second path that enters the node makes it a branch
    more = graph.union(graph.where("tail = 7").withColumn("src_doc", F.lit(9).cast("long")))
    assert sorted((r.src_doc, r.src_start, r.path) for r in debruijn.compacted(more).collect()) == [(1, 0, 0), (1, 3, 3), (1, 5, 5), (1, 8, 8), (9, 3, 3)]


def test_paths_are_fewer_than_pieces(spark, rows, monkeypatch):
    monkeypatch.setattr(debruijn, "PARTITION_CHARS", 50_000)
    graph = debruijn._graph(frame(spark, rows), SPAN, 25, 0).cache()
    paths = debruijn.compacted(graph)
    assert paths.count() == graph.where("is_path").count() > 3 * paths.where("path = src_start").count()


def test_words_of_a_span_are_compared_with_its_source(spark, rows, monkeypatch):
    rows = rows[:20]
    spans, seeds = debruijn.repeated_spans, []

    def wrong(docs, span, edge, seed):
        seeds.append(seed)
        found = spans(docs, span, edge, seed)
        return debruijn.written(found if seed else found.withColumn("src_start", F.col("src_start") + F.when(F.col("doc_id") == 9, 1).otherwise(0)), "wrong")

    monkeypatch.setattr(debruijn, "repeated_spans", wrong)
    assert sorted(map(tuple, debruijn.digest(frame(spark, rows)).collect()), key=str) == sorted(brute(rows), key=str)
    assert seeds == [0, 1]
