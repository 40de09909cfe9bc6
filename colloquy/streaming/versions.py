"""Newest versions of keyed records, in buckets of the key.

    <log>/bucket=<k>/batch=<n>/

A batch reads and writes only the buckets its keys fall into: the bucket list is
a partition filter, so the rest of the log is not listed, read or shuffled.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators.freshness import latest_versions
from colloquy.session import cut_lineage
from colloquy.sources import tables
from colloquy.sources.buckets import BUCKETS, bucket_of


def log(spark: SparkSession, folder: str, touched: list[int] | None = None) -> DataFrame | None:
    """The version log, of the ``touched`` buckets only where they are given."""
    # A batch that failed before its first commit leaves a folder without buckets.
    if not tables.any_of(spark, posixpath.join(folder, "bucket=*")):
        return None
    rows = spark.read.option("mergeSchema", False).parquet(folder)
    return rows if touched is None else rows.filter(F.col("bucket").isin(touched))


def current(spark: SparkSession, folder: str, key: str = "comment_id", order: str = "last_modified_date") -> DataFrame:
    """The newest version of each record."""
    return latest_versions(log(spark, folder).drop("bucket", "batch"), key, order)


def earlier(spark: SparkSession, folder: str, batch_id: int, touched: list[int], key: str, order: str) -> DataFrame | None:
    """The newest versions, in the touched buckets, that batches before stored."""
    rows = log(spark, folder, touched)
    return None if rows is None else latest_versions(rows.filter(F.col("batch") < batch_id).drop("bucket", "batch"), key, order)


def append(batch: DataFrame, batch_id: int, folder: str, key: str = "comment_id", order: str = "last_modified_date", buckets: int = BUCKETS) -> tuple[DataFrame, list[int]]:
    """Log the versions of a batch that are newer than what is stored; returns
    them and the buckets their batch falls into.

    Replaying a batch replaces its own part of those buckets.  Only keys and
    dates of the touched buckets are read, and only they meet the batch."""
    spark = batch.sparkSession
    newest = cut_lineage(latest_versions(batch.filter(F.col(key).isNotNull()), key, order).withColumn("bucket", bucket_of(key, buckets)))
    touched = sorted(r.bucket for r in newest.select("bucket").distinct().collect())  # at most ``buckets``
    known = log(spark, folder, touched) if touched else None
    if known is not None:
        held = known.filter(F.col("batch") < batch_id).groupBy("bucket", key).agg(F.max(order).alias("known"))
        newest = newest.join(held, ["bucket", key], "left").filter(F.col("known").isNull() | (F.col(order) > F.col("known"))).drop("known")
    new = cut_lineage(newest)
    part = new.withColumn("batch", F.lit(batch_id)).repartition("bucket")
    part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(folder)
    return new.drop("bucket"), touched


def compact(spark: SparkSession, folder: str, target: str, key: str = "comment_id", order: str = "last_modified_date", buckets: int = BUCKETS) -> None:
    """Rewrite a version log as its newest versions, into another folder."""
    rows = current(spark, folder, key, order).withColumns({"bucket": bucket_of(key, buckets), "batch": F.lit(0)})
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket", "batch").parquet(target)
