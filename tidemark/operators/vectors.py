"""Exact vector search over arrays of numbers (V1-V7, K6)."""

from __future__ import annotations

import hashlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_embedding(text: Column, dim: int) -> Column:
    """V1: counts of sha1(token) modulo ``dim``, scaled to length 1; all zero without a token. A batch of rows
    at a time; a token that a worker has met of late is not hashed again."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        out = np.zeros((len(texts), dim))
        for row, s in zip(out, texts):
            found = Counter((s or "").split())
            np.add.at(row, [_sha1(t) % dim for t in found], list(found.values()))
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return pd.Series(list(out / np.where(norm > 0, norm, 1.0)))

    return embed(text)


@lru_cache(maxsize=1 << 17)
def _sha1(token: str) -> int:
    return int.from_bytes(hashlib.sha1(token.encode()).digest(), "big")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def top_k(vectors: DataFrame, query: list[float], k: int, embedding: str = "embedding", id_: str = "vec_id") -> DataFrame:
    """The k largest inner products, as one scan that keeps k rows per task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.where(F.col(embedding).isNotNull()).withColumn("score", F.bround(dot(F.col(embedding), q), 4)).orderBy(F.desc("score"), id_).limit(k)


def top_k_then_filter(vectors: DataFrame, query: list[float], k: int, keep: Column, **names) -> DataFrame:
    """V3: the filter sees only the k found and may leave fewer."""
    return top_k(vectors, query, k, **names).where(keep)


def top_k_per_query(vectors: DataFrame, queries: DataFrame, k: int, embedding: str = "embedding", id_: str = "vec_id") -> DataFrame:
    """V4, V5: the k best of every query, at least max(10, 20 // queries) wide for ``k`` 0.

    Queries (query_id, query) are a stated, small set: at most 1,000, which is checked, go as one array
    into the scan. Each task keeps its k best per query before anything is shuffled.
    """
    asked = queries.select("query_id", "query").limit(1001).collect()
    if len(asked) > 1000:
        raise ValueError("top_k_per_query takes at most 1000 queries; split them into blocks")
    k = k or max(10, 20 // max(1, len(asked)))
    blocks = F.array(*[F.struct(F.lit(r[0]).alias("query_id"), F.array(*[F.lit(float(x)) for x in r[1]]).alias("query")) for r in asked])
    pairs = vectors.where(F.col(embedding).isNotNull()).select(id_, embedding, F.explode(blocks).alias("q"))
    scored = pairs.select(F.col("q.query_id").alias("query_id"), id_, F.bround(dot(F.col(embedding), F.col("q.query")), 4).alias("score"))
    part = F.row_number().over(Window.partitionBy("query_id", F.spark_partition_id()).orderBy(F.desc("score"), id_))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id_))
    return scored.withColumn("_n", part).where(F.col("_n") <= k).withColumn("rank", rank).where(F.col("rank") <= k).drop("_n")


def merged_hits(hits: DataFrame, id_: str = "vec_id") -> DataFrame:
    """V4: each vector once, under the first query that found it, best score first."""
    first = F.row_number().over(Window.partitionBy(id_).orderBy("query_id", F.desc("score")))
    return hits.withColumn("_n", first).where("_n = 1").drop("_n").orderBy(F.desc("score"), id_)


def passage(text: Column, query: bool = False) -> Column:
    """V6: the prefix that dense encoders expect."""
    return F.concat(F.lit("query: " if query else "passage: "), text)


def index_rows(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """Current, embedded chunks with names where they lack one."""
    rows = chunks.where(F.coalesce(F.col("is_latest"), F.lit(False)) & F.col("valid_to").isNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    return rows.join(names.select("corp_code", F.col("corp_name").alias("_name")), "corp_code", "left").withColumn("corp_name", F.coalesce(F.nullif("corp_name", F.lit("")), "_name")).drop("_name")
