"""Exact token-length histogram with suffix sums.

Each task counts its documents by encoded length; the counts add up to one row per distinct length.
Suffix sums over the histogram then answer, for every context limit: how many documents reach it,
how many tokens they hold, and how many tokens are left when every document is cut there. The sums
run in two levels (inside blocks of lengths, then over block totals), so no task sorts all lengths.

Defined results: null and empty texts have length 0; repeated rows count each time, under one doc_id
or a null one too; very long texts are encoded whole; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import ship, text_slices, written

BLOCK = 256


def token_lengths(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, length) of every row, under a byte-level vocabulary."""
    tokenizer = tokenizer or tokens.default_path("byte_bpe_50k.tiktoken")
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.byte_bpe(tokenizer).encode_ordinary
        for batch, _, _ in text_slices(batches):
            lengths = [len(encode(x)) if x else 0 for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int64())], ["doc_id", "length"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, length long")


def histogram(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(length, n_docs, n_tokens) with one row per distinct encoded length."""
    tokenizer = tokenizer or tokens.default_path("byte_bpe_50k.tiktoken")
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.byte_bpe(tokenizer).encode_ordinary
        for batch, _, _ in text_slices(batches):
            lengths = [len(encode(x)) if x else 0 for x in batch.column("text").to_pylist()]
            value, n = np.unique(np.array(lengths, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n)], ["length", "n"])

    counts = docs.select("text").mapInArrow(run, "length long, n long")
    hist = counts.groupBy("length").agg(F.sum("n").alias("n_docs")).withColumn("n_tokens", F.col("length") * F.col("n_docs"))
    return written(hist, "lengths")  # which is read more than once; else the texts would be


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length L of the histogram: documents and tokens at L or above (docs_ge, tokens_ge),
    tokens left when documents are cut at L (truncated_tokens), tokens of the table, and the share of
    documents no longer than L (doc_quantile)."""
    h = hist.withColumn("block", F.expr(f"length div {BLOCK}"))
    totals = h.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("n_tokens").alias("block_tokens"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    ever = Window.partitionBy()
    blocks = totals.select(
        "block",
        F.coalesce(F.sum("block_docs").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("block_tokens").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("block_docs").over(ever).alias("all_docs"),
        F.sum("block_tokens").over(ever).alias("all_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    return (
        h.withColumn("docs_in", F.sum("n_docs").over(inside))
        .withColumn("tokens_in", F.sum("n_tokens").over(inside))
        .join(blocks, "block")
        .select(
            "length",
            "n_docs",
            "n_tokens",
            (F.col("docs_in") + F.col("docs_above")).alias("docs_ge"),
            (F.col("tokens_in") + F.col("tokens_above")).alias("tokens_ge"),
            "all_docs",
            "all_tokens",
        )
        .withColumn("truncated_tokens", F.expr("all_tokens - tokens_ge + docs_ge * length"))
        .withColumn("doc_quantile", F.expr("(all_docs - docs_ge + n_docs) / all_docs"))
    )


def total_at(sums: DataFrame, limit: int) -> DataFrame:
    """One row: tokens left when every document is cut at ``limit``, for any limit. The suffix sums at
    the smallest length above the limit answer it; where none is above, all tokens stay."""
    over = sums.where(F.col("length") > limit).agg(F.min_by(F.struct("docs_ge", "tokens_ge"), "length").alias("x"))
    total = sums.agg(F.max("all_tokens").alias("all_tokens"))
    return total.crossJoin(over).select(F.expr(f"all_tokens - coalesce(x.tokens_ge, 0) + coalesce(x.docs_ge, 0) * {int(limit)}").alias("tokens"))
