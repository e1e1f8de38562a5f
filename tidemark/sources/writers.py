"""Writers: partitioned Parquet, keyed month rewrites, manifests, archives."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.merge import latest, merge


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _as_text(spark: SparkSession, path: str, parts: list[str]) -> DataFrame:
    """A partitioned table with its partition values as they are spelled: '01' stays '01'."""
    schema = spark.read.parquet(path).schema
    return spark.read.schema(StructType([StructField(f.name, StringType()) if f.name in parts else f for f in schema])).parquet(path)


def write_partitioned(df: DataFrame, path: str, parts: list[str], mode: str = "append") -> None:
    """K1: blank partition values become NA; rows of a partition meet before the write, so that a
    partition gets few files, and AQE splits the large ones."""
    out = df.withColumns({c: F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", "NA").otherwise(F.col(c).cast("string")) for c in parts})
    out.hint("rebalance", *parts).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def rewrite_months(spark: SparkSession, path: str, source: DataFrame, keys: list[str], parts: list[str], order: list[str]) -> None:
    """Merge into the partitions that the source touches, and overwrite only these.
"""
    touched = source.select(*parts).distinct()
    if _exists(spark, path):
        target = _as_text(spark, path, parts)
        target = target.withColumns({c: F.col(c).cast(source.schema[c].dataType) for c in parts})
        merged = merge(target.join(touched, parts, "left_semi"), source, keys)
    else:
        merged = source
    _replace(merged.hint("rebalance", *parts).sortWithinPartitions(*parts, *order), path, parts)


def _replace(rows: DataFrame, path: str, parts: list[str]) -> None:
    """Write whole partitions over a table that ``rows`` are read from: first to a staging folder of this
    run's own, then from there over the table. After a crash in between, the same call does no harm: staged
    rows are never read by others, and a merge of the same source gives the same rows."""
    spark = rows.sparkSession
    staging = f"{path.rstrip('/')}__staging-{uuid.uuid4().hex}"
    rows.write.partitionBy(*parts).parquet(staging)
    spark.read.schema(rows.schema).parquet(staging).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)
    _remove(spark, staging)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def export_by_month(df: DataFrame, path: str, date: str) -> None:
    """K4: one partition per month, whatever the date format."""
    from ..functions.dates import iso_date

    write_partitioned(df.withColumn("dt", F.substring(iso_date(F.col(date).cast("string")), 1, 7)), path, ["dt"], "overwrite")


def export_csv(df: DataFrame, path: str) -> None:
    """K5: with header and, in each file, a byte-order mark in the first column's name."""
    first = df.columns[0]
    df.withColumnRenamed(first, "﻿" + first).write.mode("overwrite").option("header", True).csv(path)


def log_run(df: DataFrame, path: str, run_id: str, table: str) -> None:
    """One row per run and table."""
    df.agg(F.lit(run_id).alias("run_id"), F.lit(table).alias("table"), F.count(F.lit(1)).alias("rows")).coalesce(1).write.mode("append").parquet(path)


def compact_partitions(spark: SparkSession, path: str, keys: list[str], parts: list[str]) -> None:
    """K8: of equal keys the row of the last file by name stays; partitions are rewritten in place."""
    df = _as_text(spark, path, parts)
    named = df.withColumn("_file", F.col("_metadata.file_name"))
    kept = latest(named, [*parts, *keys], [F.desc("_file")]).drop("_file")
    _replace(kept.hint("rebalance", *parts), path, parts)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
