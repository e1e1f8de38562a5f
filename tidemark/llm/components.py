"""Connected components by alternating large-star and small-star steps, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def apart(aggregated: DataFrame, key: str, name: str) -> DataFrame:
    """An aggregate with its key renamed by an expression, so that a join on it deals both sides out anew.
    Joined as it stands it would pin the other side's hot keys to one task each; so adaptive execution
    may split them."""
    return aggregated.select(F.shiftleft(F.col(key), 0).alias(name), *[c for c in aggregated.columns if c != key])


def components(edges: DataFrame, most: int = 40) -> DataFrame:
    """(id, component) of every node of ``edges`` (u, v); the component is its smallest node. Loops
    and repeated edges do no harm; no edges give no rows. Each step is written to the shared folder,
    where it replaces the one before, and the loop ends when a step changes nothing, at the latest after
    ``most`` steps, which raises."""
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    sign = None
    for _ in range(most):
        pairs = _both(now)
        least = apart(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "u", "k")
        large = pairs.join(least, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = apart(large.groupBy("u").agg(F.min("v").alias("m")), "u", "k")
        small = large.join(least, F.col("u") == F.col("k")).select(F.explode(F.array(F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        before, now = now, written(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        discard(before)
        was, sign = sign, now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v"))).first()
        if sign == was:
            break
    else:
        raise RuntimeError(f"components did not settle in {most} steps")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
