"""Tables in a fixed number of key buckets, replaced bucket by bucket."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.session import cut_lineage
from colloquy.sources.tables import exists, remove

BUCKETS = 64


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def _digest(*columns: str) -> list[Column]:
    """Count, sum and parity of row digests: the order of rows does not matter."""
    row = F.xxhash64(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    return [
        F.count(F.lit(1)).alias("n"), F.sum(row.cast("decimal(38,0)")).cast("string").alias("total"),
        F.bit_xor(row).alias("parity"),
    ]


def replace_changed(rows: DataFrame, folder: str, key: str, made: dict[str, Column] | None = None, buckets: int = BUCKETS) -> dict[str, list[int]]:
    """Make ``folder`` hold ``rows``, touching only the buckets whose content
    differs; returns which were ``written`` and which ``removed``.

    ``made`` names columns added on writing (a time, say) that content does not
    count.  Digests are stored after the rows: a run that fails in between
    writes its buckets again.  An empty bucket leaves no folder behind."""
    spark = rows.sparkSession
    store, digests = posixpath.join(folder, "rows"), posixpath.join(folder, "digests")
    columns = sorted(rows.columns)
    placed = cut_lineage(rows.withColumn("bucket", bucket_of(key, buckets)))
    new = cut_lineage(placed.groupBy("bucket").agg(*_digest(*columns)))
    facts = F.struct("n", "total", "parity")
    known = spark.read.parquet(digests) if exists(spark, digests) else new.limit(0)
    # One small row a bucket.
    pairs = (
        known.select("bucket", facts.alias("old")).join(new.select("bucket", facts.alias("new")), "bucket", "full")
        .select("bucket", F.col("new").isNull().alias("gone"), F.col("old").eqNullSafe(F.col("new")).alias("same")).collect()
    )
    written = sorted(p.bucket for p in pairs if not p.gone and not p.same)
    removed = sorted(p.bucket for p in pairs if p.gone)
    if written:
        changed = placed.filter(F.col("bucket").isin(written)).withColumns(made or {})
        changed.repartition(min(len(written), buckets), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(store)
    for bucket in removed:
        remove(spark, posixpath.join(store, f"bucket={bucket}"))
    if written or removed:
        new.coalesce(1).write.mode("overwrite").parquet(digests)
    return {"written": written, "removed": removed}


def stored(spark: SparkSession, folder: str) -> DataFrame | None:
    """What ``replace_changed`` keeps; None before its first row."""
    store = posixpath.join(folder, "rows")
    if not exists(spark, posixpath.join(folder, "digests")) or spark.read.parquet(posixpath.join(folder, "digests")).isEmpty():
        return None
    return spark.read.parquet(store).drop("bucket")
