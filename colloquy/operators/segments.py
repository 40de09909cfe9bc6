"""Passages found in a submission: filter, merge repeats, number them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy import vocab
from colloquy.functions import text as T

# Rows of one comment are numbered in ranges of this many ordinals, so that no
# single task has to sort all of a very long comment.
NUMBERING_RANGE = 4096


def chunk_plan(texts: DataFrame, size: int = vocab.CHUNK_CHARS,
               overlap: int = vocab.CHUNK_OVERLAP_CHARS) -> DataFrame:
    """One row per chunk of each text: number (from 1), total, bounds, text."""
    bounds = T.chunk_bounds(F.col("text"), size, overlap)
    return (
        texts.withColumn("bounds", bounds)
        .withColumn("chunk_total", F.size("bounds"))
        .select("*", F.posexplode("bounds").alias("at", "b"))
        .select(
            "comment_id", (F.col("at") + 1).alias("chunk_index"), "chunk_total", "b.start", "b.stop",
            F.substring("text", F.col("b.start") + 1, F.col("b.stop") - F.col("b.start")).alias("chunk"),
        )
    )


def substantive(found: DataFrame) -> DataFrame:
    """Drop background, passages without a valid question, and short ones.
    Adds ``mask``, the set of valid questions."""
    passage = T.strip(F.coalesce("source_passage", F.lit("")))
    return (
        found.filter(~F.coalesce("is_background_only", F.lit(False)))
        .withColumn("source_passage", passage)
        .withColumn("mask", vocab.question_mask(F.coalesce("question_ids", F.array().cast("array<string>"))))
        .filter((F.col("mask") != 0) & (F.length("source_passage") >= vocab.MIN_PASSAGE_CHARS))
    )


def merge_passages(found: DataFrame) -> DataFrame:
    """One row per distinct passage of a comment: the first occurrence, with the
    questions of all occurrences.  The group state has a fixed size."""
    return (
        substantive(found)
        .groupBy("comment_id", T.passage_key(F.col("source_passage")).alias("passage_key"))
        .agg(
            F.min_by(
                F.struct("source_passage", T.strip(F.coalesce("position_gist", F.lit(""))).alias("position_gist")), "ord"
            ).alias("first"),
            F.min("ord").alias("first_ord"),
            F.bit_or("mask").alias("mask"),
        )
        .select("comment_id", "first_ord", vocab.mask_questions(F.col("mask")).alias("question_ids"), "first.*")
    )


def numbered(rows: DataFrame, group: str, order: str) -> DataFrame:
    """``row_number`` by ``order`` (an integer) within ``group``, in two levels:
    within ranges of the order, plus how many rows earlier ranges hold."""
    ranged = rows.withColumn("_range", F.floor(F.col(order) / NUMBERING_RANGE))
    sizes = ranged.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(group, "_range").orderBy(order))
    return (
        ranged.withColumn("_inside", inside)
        .join(offsets, [group, "_range"])
        .withColumn("number", F.col("_inside") + F.col("_before"))
        .drop("_range", "_inside", "_before")
    )


def segment_name(number: Column) -> Column:
    digits = number.cast("string")
    return F.concat(F.lit("seg-"), F.lpad(digits, F.greatest(F.lit(3), F.length(digits)), F.lit("0")))


def segments(found: DataFrame) -> DataFrame:
    """Merged passages with sequential segment ids in first-seen order."""
    return numbered(merge_passages(found), "comment_id", "first_ord").select(
        "comment_id", segment_name(F.col("number")).alias("segment_id"), "question_ids", "source_passage", "position_gist"
    )


def coerce_stakeholder(column: Column) -> Column:
    return F.when(vocab.is_known(vocab.STAKEHOLDER_TYPES, column), column).otherwise(F.lit("other"))
