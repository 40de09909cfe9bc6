"""Joins in which a few keys hold much of one side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAVY, SALT = "_heavy", "_salt"


def heavy_keys(rows: DataFrame, key: str, share: float) -> DataFrame:
    """Keys that hold more than ``share`` of all rows: under ``1 / share`` of
    them, whatever the table.  Counted by partial aggregation over the key alone."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar()
    return counts.withColumn("total", total).filter(F.col("n") > share * F.col("total")).select(key)


def salted_join(left: DataFrame, right: DataFrame, key: str, share: float = 0.01, salts: int = 32) -> DataFrame:
    """The inner join on ``key`` of a skewed ``left`` with ``right``, which holds
    each key few times: the same rows, whatever the skew.

    Rows of heavy keys are spread over ``salts`` by a hash of the whole row, and
    their few partners are copied to every salt; all other rows have salt 0.  The
    heavy keys are under ``1 / share`` rows, so they are broadcast."""
    heavy = F.broadcast(heavy_keys(left, key, share).withColumn(HEAVY, F.lit(True)))
    spread = F.when(F.col(HEAVY), F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    every = F.when(F.col(HEAVY), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    a = left.join(heavy, key, "left").withColumn(SALT, spread).drop(HEAVY)
    b = right.join(heavy, key, "left").withColumn(SALT, F.explode(every)).drop(HEAVY)
    return a.join(b, [key, SALT]).drop(SALT)


ROWS_A_TASK = 250_000


def dealt_by_size(df: DataFrame, rows: int | None, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` to a task for every ``ROWS_A_TASK`` of its
    ``rows``, where that is more tasks than the session would make: sorts and
    hash tables of joins and groupings on these keys then stay as large as they
    are, and more rows make more tasks.  Else, or of unknown size, as it is."""
    tasks = -(-(rows or 0) // ROWS_A_TASK)
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *keys) if tasks > usual else df


def ordered_by_size(df: DataFrame, rows: int | None, *keys: Column) -> DataFrame:
    """``df`` in the order of ``keys``, as ``orderBy`` has it, sorted in a task for
    every ``ROWS_A_TASK`` rows where that is more tasks than the session would
    make: a task's sort then spills nothing however many rows there are."""
    tasks = -(-(rows or 0) // ROWS_A_TASK)
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys) if tasks > usual else df.orderBy(*keys)
