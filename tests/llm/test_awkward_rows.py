"""Nulls in any column, repeated rows, several texts under one id, very long texts and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bagminhash, bloomlm, lengths, media, mixing, packing, projections, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, mark string, held_out string, length string, taken string, component string, part string, target string, source_size string"


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    text = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    base, other, long = text(120), text(90), text(250_000)
    out = [(1, base), (1, base), (1, other), (None, base), (None, None), (None, None), (2, None), (2, ""), (3, " \n\t"), (4, other), (9, "one"), (10, long), (11, long), (6, "é" * 9000 + " " + base)]
    return out + [(20 + i, text(40)) for i in range(12)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    source = lambda i: None if i is None or i % 4 == 0 else f"s{i % 3}"
    return spark.createDataFrame([(i, t, None, source(i), None, *["x"] * 9) for i, t in rows], SCHEMA).repartition(3).cache()


def test_lengths(docs, rows):
    bpe = tokens.byte_bpe(tokens.default_path("byte_bpe_50k.tiktoken"))
    want = Counter(len(bpe.encode_ordinary(t)) if t else 0 for _, t in rows)
    assert {r.length: r.n_docs for r in lengths.histogram(docs).collect()} == want
    assert sorted(((r.doc_id, r.length) for r in lengths.token_lengths(docs).collect()), key=str) == sorted(((i, len(bpe.encode_ordinary(t)) if t else 0) for i, t in rows), key=str)


def test_packing(docs, rows):
    bpe = tokens.word_bpe(tokens.default_path("word_bpe_49k.json"))
    got, want = Counter(), Counter()
    for r in packing.pack(docs).collect():
        got[r.doc_id, r.doc_tokens] += r.length
    for (i, t), ids in zip(rows, bpe.ids([t for _, t in rows])):
        want[i, len(ids) + 1] += len(ids) + 1
    assert got == want


def scores(rows):
    token = [[*[w.translate({a: a + 32 for a in range(65, 91)}) for w in split(t)], None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    c, pairs = Counter(), Counter()
    for x, h in zip(token, held):
        if not h:
            c.update(x)
            pairs.update(zip([None, *x], x))
    total, floor = sum(c.values()), sum(c.values()) + 0.5 * (len(c) + 1)
    level = {p: bloomlm.LOG_BASE ** round(math.log(n) / math.log(bloomlm.LOG_BASE)) for p, n in pairs.items()}
    out = []
    for (i, _), x, h in zip(rows, token, held):
        base = sum(math.log10((c[w] + 0.5) / floor) for w in x)
        score = sum(math.log10(bloomlm.WEIGHT * level.get((a, w), 0) / max(c[a], level.get((a, w), 0), 1) + (1 - bloomlm.WEIGHT) * (c[w] + 0.5) / floor) for a, w in zip([None, *x], x))
        out.append((i, h, len(x), sum(c[w] > 0 for w in x), total, round(base, 4), round(score, 4)))
    return sorted(out, key=str)


@pytest.mark.parametrize("groups", [1, 3])
def test_lm_scores_against_a_model_in_plain_python(docs, rows, monkeypatch, groups):
    rows = [r for r in rows if len(r[1] or "") < 100_000]
    docs = docs.where("text IS NULL OR length(text) < 100000")
    if groups > 1:
        monkeypatch.setattr(bloomlm, "SHARD_CHARS", 2000)
        monkeypatch.setattr(bloomlm, "MAX_BROADCAST", 20_000)
        monkeypatch.setattr(bloomlm, "HEAD", 30)
    for shuffled in (docs, docs.orderBy(F.rand(5))):
        got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in bloomlm.score_texts(shuffled, 64).collect()), key=str)
        want = scores(rows)  # with 64 bits false positives do not blur the comparison
        assert [x[:5] for x in got] == [x[:5] for x in want]
        assert np.allclose([x[5:] for x in got], [x[5:] for x in want], rtol=1e-6, atol=1e-3)


def test_long_texts_are_scored_whole(docs, rows):
    got = {r.doc_id: r.n_tokens for r in bloomlm.score_texts(docs).collect()}
    assert got[10] == got[11] == 250_001


def test_mixing(docs, rows):
    got = mixing.taken(docs).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len(split(t))) for i, t in rows)
    of = {}
    for r in got:
        assert of.setdefault((r.doc_id, r.target), r.copies) == r.copies
    assert mixing.mix(docs).columns == docs.columns


def test_toxicity(spark, docs, rows):
    labels = spark.createDataFrame([(i, None, None if i == 4 else int(i % 5 == 0)) for i in range(1, 30)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxic_scores(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (2, 3)} | {r.score for r in got if r.doc_id is None and r.score == got[0].score}) <= 2
    kept = toxicity.without_toxic(docs.withColumn("Score", F.lit(1)).withColumn("predicted", F.lit("p")), labels)
    assert kept.columns == [*docs.columns, "Score", "predicted"] and all(r.predicted == "p" for r in kept.collect())


def test_media(docs, rows):
    got = media.features(media.correct(media.store_texts(docs))).collect()
    raw = [(i, (t or "").encode()) for i, t in rows]
    want = [(i, len(b), hashlib.sha256(b + bytes(max(1, -(-len(b) // 64)) * 64 - len(b))).hexdigest()) for i, b in raw]
    assert sorted(((r.doc_id, r.n_bytes, r.payload_sha256) for r in got), key=str) == sorted(want, key=str)
    of = {}
    for r in got:
        assert of.setdefault(r.payload_sha256, r.feature) == r.feature


def test_near_duplicates(docs, rows):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in bagminhash.near_duplicates(docs).collect()), key=str)
    n = lambda t: max(len(split(t)) - 4, min(1, len(split(t))))
    home = {1: 1, 4: 1, 6: 1, 11: 10}
    base = rows[0][1]
    assert got == sorted(((i, n(t), c := 1 if t == base else home.get(i, i), i == c) for i, t in rows), key=str)
    kept = bagminhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _ in rows if i not in (4, 6, 11))


def test_vectors(spark):
    e = 1e-200
    v = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1e200, 1e190]), (3, [e, 0.0]), (4, [-e, 0.0]), (5, [0.0, 5e-324]), (None, [1.0, 0.0]), (7, None)]
    df = spark.createDataFrame([(i, x, None, "p") for i, x in v], "vec_id long, embedding array<double>, label int, part string")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in projections.near_vectors(df).collect()), key=str)
    # rows of one id count each, and share a component
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (1, 1, 1, True), (2, 3, 1, False), (3, 3, 1, False), (4, 0, 4, True), (5, 1, 1, False), (None, 0, None, True), (7, 0, 7, True)], key=str)
