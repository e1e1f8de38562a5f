"""Tables that lie in order, for pages far from the first one.

Rows are dealt to ranges of the order and sorted inside, and each range is cut into slices; beside them lies how many
rows each slice has. A page's place then follows from these counts, and only the slices that it touches are
read and sorted, wherever it lies. There are far fewer ranges than slices, as the borders of ranges come from a sample
that the driver gets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

ROWS_A_SLICE = 500_000
#: A range has so many slices, but not more than ``ROWS_A_RANGE`` rows if a slice has fewer.
SLICES_A_RANGE, ROWS_A_RANGE = 50, 500_000
#: Bits of a slice's number that count slices within its range; the others are the range.
_BITS = 20


def write_ordered(df: DataFrame, path: str, order: list[Column], rows_a_slice: int = ROWS_A_SLICE) -> None:
    """Write ``df`` in slices of at most ``rows_a_slice`` rows; ``order`` must be total."""
    spark = df.sparkSession
    ranges = max(1, -(-df.count() // max(rows_a_slice, min(ROWS_A_RANGE, SLICES_A_RANGE * rows_a_slice))))
    place = F.monotonically_increasing_id()  # the range and, in its 33 low bits, the row's place there
    slice_ = F.shiftleft(F.shiftright(place, 33), _BITS) + F.floor(place.bitwiseAND(F.lit((1 << 33) - 1)) / rows_a_slice)
    dealt = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("slice", slice_)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("slice").parquet(f"{path}/rows")
    schema = StructType(df.schema.fields).add("slice", LongType())
    counts = spark.read.schema(schema).parquet(f"{path}/rows").groupBy("slice").agg(F.count(F.lit(1)).alias("n"))
    counts.coalesce(1).write.mode("overwrite").parquet(f"{path}/counts")
    spark.createDataFrame([], df.schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/schema")


def slices_of(counts: list[tuple[int, int]], begin: int, end: int) -> tuple[list[int], int]:
    """The slices that hold the rows from ``begin`` to before ``end``, and how many of theirs come before;
    ``counts`` has (slice, rows) in order."""
    wanted, before, skip = [], 0, 0
    for piece, n in counts:
        if before < end and before + n > begin:
            if not wanted:
                skip = begin - before
            wanted.append(piece)
        before += n
    return wanted, skip


def read_page(spark: SparkSession, path: str, order: list[Column], number: int, size: int) -> tuple[DataFrame, dict[str, int]]:
    """The rows of page ``number``, from 1, in order, and {total, total_pages}; a page beyond the last one is empty."""
    counts = sorted(tuple(r) for r in spark.read.parquet(f"{path}/counts").collect())  # a row a slice
    begin, end = (number - 1) * size, number * size
    wanted, skip = slices_of(counts, begin, end)
    total = sum(n for _, n in counts)
    schema = spark.read.parquet(f"{path}/schema").schema
    rows = spark.createDataFrame([], schema).withColumn("slice", F.lit(0))
    if wanted:
        rows = spark.read.schema(StructType(schema.fields).add("slice", LongType())).option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/slice={x}" for x in wanted])
    page = rows.where(F.col("slice").isin(wanted) if wanted else F.lit(False)).drop("slice").orderBy(*order).offset(skip).limit(size)
    return page, {"total": total, "total_pages": -(-total // size)}
