"""Mixing sources to target weights by whole repeats and one hash-seeded draw.

Sizes add up per source; the target shares come from cyclic weights over the sources in code-point
order, a source stops at ``cap`` times its size and the excess goes to the others by weight (the
level of this water-filling has a closed form over the sources sorted by cap / weight). The rate is
target / size; a document is taken floor(rate) times and once more if its hash draw is below the
fraction. The draw depends on the seed and doc_id alone, so reruns agree and rows with equal ids
share it. Only built-in functions run; the source table is broadcast while it has at most
``BROADCAST_SOURCES`` rows, else joined.

Defined results: a null text has size 0; a null source is a source of its own, after all others; a
source without words has target 0 and its documents are not taken; an empty table gives no rows; a
null doc_id draws like the text 'null'; columns of ``docs`` are kept by ``mix`` and clash with none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, written

BROADCAST_SOURCES = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, size)."""
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    cycle = F.array(*[F.lit(w) for w in weights])
    return (
        sizes.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.get(cycle, (F.row_number().over(by_source) - 1) % len(weights)))
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("level", F.col("most") / F.col("weight"))
        .withColumn("before", F.coalesce(F.sum("most").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("try", (F.col("total") - F.col("before")) / F.col("open"))
        .withColumn("water", F.min_by(F.when(F.col("try") <= F.col("level"), F.col("try")), F.when(F.col("try") <= F.col("level"), F.col("level"))).over(everything))
        .select("source", "source_size", F.least("most", F.col("weight") * F.coalesce("water", F.lit(float("inf")))).alias("target"))
    )


def _draw(seed: str):
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _joined(left: DataFrame, table: DataFrame) -> DataFrame:
    name = fresh(left, "source_key")
    table = written(table.withColumnRenamed("source", name), "sources")
    small = table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return left.join(F.broadcast(table) if small else table, F.col("source").eqNullSafe(F.col(name))).drop(name)


def _copies(seed: str, size: str = "source_size", target: str = "target"):
    rate = F.when(F.col(size) > 0, F.col(target) / F.col(size)).otherwise(F.lit(0.0))
    return (F.floor(rate) + (_draw(seed) < rate - F.floor(rate)).cast("long")).cast("long")


def taken(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0, seed: str = "mix") -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of every row."""
    sizes = sized(docs)
    return _joined(sizes, targets(sizes, weights, cap)).withColumn("copies", _copies(seed)).select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0, seed: str = "mix") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    own = docs.columns
    size, target, copy = (fresh(docs, c) for c in ("source_size", "target", "copy"))
    joined = _joined(docs, targets(sized(docs), weights, cap).withColumnsRenamed({"source_size": size, "target": target}))
    copies = _copies(seed, size, target)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.greatest(copies, F.lit(1)).cast("int")))).where(copies >= F.col(copy)).select(*own)
