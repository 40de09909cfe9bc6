"""Compare two labelling runs over the same segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy import vocab

KEYS = ["comment_id", "segment_id"]


def mismatched(production: DataFrame, shadow: DataFrame) -> DataFrame:
    """Comments labelled by both runs, but from different inputs."""
    return production.select("comment_id", F.col("input_hash").alias("production_hash")).join(
        shadow.select("comment_id", F.col("input_hash").alias("shadow_hash")), "comment_id"
    ).filter(~F.col("production_hash").eqNullSafe(F.col("shadow_hash"))).select("comment_id")


def aligned(production: DataFrame, shadow: DataFrame, positions: DataFrame) -> DataFrame:
    """Segments labelled in both runs from the same input.

    Runs: ``comment_id, input_hash, segment_id, response_type`` rows."""
    left = production.select(*KEYS, "input_hash", F.col("response_type").alias("production"))
    right = shadow.select(*KEYS, F.col("input_hash").alias("shadow_hash"), F.col("response_type").alias("shadow"))
    return (
        left.join(right, KEYS)
        .filter(F.col("input_hash").eqNullSafe(F.col("shadow_hash")))
        .join(positions.select(*KEYS, "question_ids"), KEYS)
        .filter("production is not null and shadow is not null")
        .select(*KEYS, "production", "shadow", "question_ids")
    )


def agreement(pairs: DataFrame) -> DataFrame:
    return pairs.agg(
        F.count("*").alias("segments"),
        F.count_if(F.col("production") == F.col("shadow")).alias("agreed"),
    ).withColumn("agreement", F.round(F.try_divide("agreed", "segments"), 4))


def agreement_by_type(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(F.col("production").alias("response_type")).agg(
        F.count("*").alias("segments"), F.count_if(F.col("production") == F.col("shadow")).alias("agreed")
    ).withColumn("agreement", F.round(F.col("agreed") / F.col("segments"), 4))


def confusion(pairs: DataFrame, top: int = 8, order=None) -> DataFrame:
    """The most common disagreements; vocabulary order decides ties."""
    values = vocab.RESPONSE_TYPES if order is None else order
    return (
        pairs.filter("production <> shadow")
        .groupBy("production", "shadow")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), vocab.ordinal(values, F.col("production")), vocab.ordinal(values, F.col("shadow")))
        .limit(top)
    )


def disagreements(pairs: DataFrame) -> DataFrame:
    return pairs.filter("production <> shadow")


def dominant_shift(pairs: DataFrame, counted: str = "comment_id", order=None, greatest_name: bool = False) -> DataFrame:
    """Per question, the type with most distinct ``counted`` in each run, and
    whether it changes.  Vocabulary order decides ties, or the greatest name."""
    values = vocab.RESPONSE_TYPES if order is None else order
    runs = F.array(*[
        F.struct(F.lit(run).alias("run"), F.col(run).alias("type")) for run in ("production", "shadow")
    ])
    labels = (
        pairs.select(counted, F.explode("question_ids").alias("question_id"), runs.alias("runs"))
        .select(counted, "question_id", F.inline("runs"))
    )
    # First one row per commenter and type, then the count: both combine map-side.
    per_type = labels.groupBy("question_id", "run", "type", counted).agg(F.lit(1).alias("one")).groupBy(
        "question_id", "run", "type"
    ).agg(F.count("*").alias("n"))
    tie = F.col("type") if greatest_name else -F.coalesce(vocab.ordinal(values, F.col("type")), F.lit(99))

    def best(run):
        rank = F.when(F.col("run") == run, F.struct("n", tie.alias("tie")))
        return F.max_by(F.struct("type", "n"), rank).alias(run)

    return per_type.groupBy("question_id").agg(best("production"), best("shadow")).select(
        "question_id",
        F.col("production.type").alias("production"),
        F.col("production.n").alias("production_n"),
        F.col("shadow.type").alias("shadow"),
        F.col("shadow.n").alias("shadow_n"),
        (F.col("production.type") != F.col("shadow.type")).alias("changes"),
    )
