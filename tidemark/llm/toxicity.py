"""Toxicity scores by non-negative positive-unlabelled learning.

A linear classifier over hashed words and word prefixes is trained in numpy from confirmed toxic
texts and from texts taken as unlabelled, with the class-prior-corrected risk of Kiryo et al. (2017):
prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)); where the second part falls
below zero, the step goes up its gradient. Features are present or absent per text, and the
``FEATURES`` most informative ones get weights.

Only labelled training rows teach: crc32 of doc_id as text, modulo 3, is not 1. Of these at most
``MAX_POSITIVE`` toxic ones and ``MAX_UNLABELLED`` of any label, first in order of a hash of doc_id,
are used; labels of the latter are not read, except that their rate over all training rows gives the
prior, so no text is a negative example. The prior has to be that of the unlabelled texts: documents
that no label covers are toxic more seldom, and with them as the unlabelled side 0.5 % of the clean
held-out documents of a test table were rejected instead of none. Every row of the documents is scored
over its whole text.

Defined results: null and empty texts get the score of a text without features; without toxic or
without other training rows the score is 0 everywhere; a doc_id labelled more than once is toxic if
any label says so; null labels are ignored; a null doc_id is not held out and does not teach; repeated
rows, under one doc_id or none, are scored each by itself; ties in hash go by doc_id; very long texts
are scored whole; an empty table gives no rows; other columns, lang and source among them, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, fresh, prefix_hash, range_hash, ship, text_slices, written

BUCKETS = 20  # bits
PREFIXES = (4, 5, 6, 7, 8)
FEATURES, MIN_DOCUMENTS = 500, 3
MAX_POSITIVE, MAX_UNLABELLED = 4000, 12000
THRESHOLD = 0.7

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def text_features(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature), distinct and sorted; with ``wanted``, only features that it marks."""
    low = _LOWER[data]
    letter = _LETTER[low]
    n = len(low)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin, finish = letter.copy(), letter.copy()
    begin[1:] &= ~letter[:-1]
    finish[:-1] &= ~letter[1:]
    inside = offsets[(offsets > 0) & (offsets < n)]
    begin[inside], finish[inside - 1] = letter[inside], letter[inside - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    s, inverse = prefix_hash(low)
    docs, found = [], []
    for size in (0, *PREFIXES):
        at = slice(None) if not size else end - start >= size
        till = end if not size else start[at] + size
        bucket = (range_hash(s, inverse, start[at], till) ^ np.uint64(size * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(64 - BUCKETS)
        ok = slice(None) if wanted is None else wanted[bucket.astype(np.int64)]
        docs.append(doc[at][ok])
        found.append(bucket[ok])
    key = np.unique((np.concatenate(docs).astype(np.uint64) << np.uint64(BUCKETS)) | np.concatenate(found))
    return (key >> np.uint64(BUCKETS)).astype(np.int64), (key & np.uint64((1 << BUCKETS) - 1)).astype(np.int64)


def fit(positive: tuple[np.ndarray, np.ndarray, int], unlabelled: tuple[np.ndarray, np.ndarray, int], prior: float, features: int, steps: int = 300, rate: float = 0.1, ridge: float = 1e-6) -> tuple[np.ndarray, float]:
    """(weights, bias) of the non-negative risk with the logistic loss; each side is (row, feature, rows)."""

    def sigmoid(x):
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    (prow, pfeature, n_p), (urow, ufeature, n_u) = positive, unlabelled
    w, b = np.zeros(features), np.log(prior / (1 - prior))
    m, v = np.zeros(features + 1), np.zeros(features + 1)
    for t in range(1, steps + 1):
        zp = np.bincount(prow, w[pfeature], minlength=n_p) + b
        zu = np.bincount(urow, w[ufeature], minlength=n_u) + b
        if np.logaddexp(0, zu).mean() >= prior * np.logaddexp(0, zp).mean():
            gp, gu = prior * (sigmoid(zp) - 1) / n_p - prior * sigmoid(zp) / n_p, sigmoid(zu) / n_u
        else:
            gp, gu = prior * sigmoid(zp) / n_p, -sigmoid(zu) / n_u
        g = np.bincount(pfeature, gp[prow], minlength=features) + np.bincount(ufeature, gu[urow], minlength=features) + ridge * w
        g = np.append(g, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def _sparse(rows: list, number: dict[int, int]) -> tuple[np.ndarray, np.ndarray, int]:
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    return row.astype(np.int64), np.array([number[x] for r in rows for x in r], np.int64), len(rows)


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """(weight of each bucket, bias)."""
    ship(docs.sparkSession)
    taught = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = taught.where("toxic = 1").orderBy(*order).limit(MAX_POSITIVE).select("doc_id", F.lit(True).alias("positive")).union(taught.orderBy(*order).limit(MAX_UNLABELLED).select("doc_id", F.lit(False)))
    rates = taught.agg(F.avg("toxic")).first()[0] or 0.0
    weights = np.zeros(1 << BUCKETS)
    if not 0 < rates < 1:
        return weights, -np.inf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_slices(batches):
            doc, feature = text_features(data, offsets)
            cut = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(feature, pa.int32()))], ["positive", "features"])

    # at most MAX_POSITIVE + MAX_UNLABELLED rows of an id and a flag are broadcast
    sample = docs.select("doc_id", "text").join(F.broadcast(written(picked, "sample")), "doc_id").select("positive", "text").repartition(64)
    rows = written(sample.mapInArrow(run, "positive boolean, features array<int>"), "features")
    sizes = {r[0]: r[1] for r in rows.groupBy("positive").count().collect()}
    n_p, n_u = sizes.get(True, 0), sizes.get(False, 0)
    if not n_p or not n_u:
        return weights, -np.inf
    counted = rows.select("positive", F.explode("features").alias("feature")).groupBy("feature").agg(F.count_if("positive").alias("a"), F.count_if(~F.col("positive")).alias("b"))
    p = (F.col("a") + 0.5) / (n_p + 1)
    q = F.greatest((F.col("b") + 0.5) / (n_u + 1) - rates * p, F.lit(1e-6)) / (1 - rates)
    gain = F.when(p > q, p * F.log(p / q) + (1 - p) * F.log((1 - p) / (1 - q)))
    chosen = [r[0] for r in counted.where(F.col("a") >= MIN_DOCUMENTS).withColumn("gain", gain).where("gain > 0").orderBy(F.desc("gain"), "feature").limit(FEATURES).collect()]
    if not chosen:
        return weights, -np.inf
    kept = rows.select("positive", F.array_intersect("features", F.array(*[F.lit(int(x)) for x in chosen])).alias("features"))
    found = kept.toArrow()
    sides = dict.fromkeys((True, False), ())  # in a fixed order, so that reruns agree to the last bit
    for flag in sides:
        sides[flag] = sorted(map(sorted, found.filter(pa.compute.equal(found.column("positive"), flag)).column("features").to_pylist()))
    number = {x: i for i, x in enumerate(chosen)}
    w, bias = fit(_sparse(sides[True], number), _sparse(sides[False], number), rates, len(chosen))
    weights[chosen] = w
    return weights, bias


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """The columns of ``docs`` but text, with score and predicted, which replace columns of these names."""
    spark = docs.sparkSession
    ship(spark)
    weights = spark.sparkContext.broadcast(model[0])  # 8 MB, whatever the input
    bias = model[1]
    kept = [c for c in docs.columns if c not in ("text", "score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        wanted = w != 0
        for batch, data, offsets in text_slices(batches):
            doc, feature = text_features(data, offsets, wanted)
            z = np.bincount(doc, w[feature], minlength=batch.num_rows) + bias
            out = 1 / (1 + np.exp(-np.clip(z, -40, 40))) if np.isfinite(bias) else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out), pa.array((out >= THRESHOLD).astype(np.int32))], [*kept, "score", "predicted"])

    types = ", ".join(f"`{c}` {t}" for c, t in docs.select(*kept).dtypes)
    return docs.select(*kept, "text").mapInArrow(run, f"{types}, score double, predicted int")


def toxic_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    return score(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), train(docs, labels))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic."""
    own = docs.columns
    name, aside = fresh(docs, "whole_text"), {c: fresh(docs, f"own_{c}") for c in own if c.lower() in ("score", "predicted")}
    tagged = docs.withColumn(name, F.col("text")).withColumnsRenamed(aside)
    kept = score(tagged, train(docs, labels)).where("predicted = 0")
    return kept.select(*[F.col(name).alias("text") if c == "text" else F.col(aside.get(c, c)).alias(c) for c in own])
