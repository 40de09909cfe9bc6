"""Labels from a scorer: parse, coerce to the vocabularies, fill, represent."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy import vocab
from colloquy.functions import text as T

NO_ANSWER = "no_clear_answer"


def parse_answers(answers: DataFrame, schema: str, column: str = "answer") -> DataFrame:
    """Parse JSON answers, with or without a code fence around them.

    Adds ``parsed`` and ``malformed``; nothing is dropped."""
    fenced = T.strip(F.coalesce(F.col(column), F.lit("")))
    bare = F.regexp_replace(fenced, r"^```(?:json)?\s*|\s*```$", "")
    envelope = f"struct<value:{schema}, _corrupt_record:string>"
    parsed = F.from_json(
        F.concat(F.lit('{"value":'), bare, F.lit("}")), envelope,
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"},
    )
    return (
        answers.withColumn("_parsed", parsed)
        .withColumn("malformed", (bare == "") | F.col("_parsed._corrupt_record").isNotNull() | F.col("_parsed.value").isNull())
        .withColumn("parsed", F.when(~F.col("malformed"), F.col("_parsed.value")))
        .drop("_parsed")
    )


def coerce_analysis(scored: DataFrame) -> DataFrame:
    """Scored fields of a segment, brought into the vocabularies.

    Input: comment and segment columns (``comment_id, segment_id, question_ids,
    source_passage``) and the scorer's answer as the struct ``scored``."""
    own = F.coalesce("question_ids", F.array().cast("array<string>"))
    given = F.coalesce("scored.question_ids", F.array().cast("array<string>"))
    questions = vocab.once(vocab.question_mask(given), lambda mask: vocab.mask_questions(
        F.when(mask != 0, mask).otherwise(vocab.question_mask(own))
    ))
    primary = F.when(
        vocab.is_known(vocab.ISSUES, F.col("scored.primary_issue")), F.col("scored.primary_issue")
    ).otherwise(F.lit("regulatory_scope"))
    secondary = F.when(
        vocab.is_known(vocab.ISSUES, F.col("scored.secondary_issue")) & (F.col("scored.secondary_issue") != primary),
        F.col("scored.secondary_issue"),
    )
    tags = F.slice(
        F.array_distinct(F.filter(
            F.coalesce("scored.gap_tags", F.array().cast("array<string>")), lambda t: vocab.is_known(vocab.GAPS, t)
        )), 1, vocab.MAX_GAP_TAGS,
    )
    told = F.coalesce("scored.gap_explanations", F.array().cast("array<struct<gap:string,explanation:string>>"))

    def explained(kept):
        # The last explanation given for a gap counts.
        return F.map_from_entries(F.transform(kept, lambda t: F.struct(t, F.coalesce(
            F.try_element_at(F.filter(told, lambda e: e["gap"] == t), F.lit(-1))["explanation"], F.lit("")
        ))))

    def tagged(kept):
        return F.struct(kept.alias("tags"), explained(kept).alias("explanations"))

    summary = T.limit_words(T.strip_quotes(F.col("scored.public_summary")), vocab.SUMMARY_MAX_WORDS)
    return (
        scored.withColumn("gaps", vocab.once(tags, tagged))
        .withColumn("summary", summary)
        .select(
            "comment_id",
            "segment_id",
            questions.alias("question_ids"),
            F.col("scored.position").alias("position"),
            primary.alias("primary_issue"),
            secondary.alias("secondary_issue"),
            T.strip(F.coalesce("scored.stakeholder_concern", F.lit(""))).alias("stakeholder_concern"),
            T.strip(F.coalesce("scored.requested_fda_action", F.lit(""))).alias("requested_fda_action"),
            F.coalesce("scored.confidence", F.lit("low")).alias("confidence"),
            F.col("gaps.tags").alias("gap_tags"),
            F.col("gaps.explanations").alias("gap_explanations"),
            F.col("summary.text").alias("public_summary"),
            F.col("summary.cut").alias("summary_cut"),
            "source_passage",
        )
    )


def fill_response_types(wanted: DataFrame, answers: DataFrame) -> DataFrame:
    """Every wanted segment gets one valid type.  The last answer for a segment
    (greatest ``ord``) counts; a missing or unknown one is defaulted."""
    last = answers.groupBy("comment_id", "segment_id").agg(F.max_by("response_type", "ord").alias("given"))
    known = vocab.is_known(vocab.RESPONSE_TYPES, F.col("given"))
    return (
        wanted.select("comment_id", "segment_id")
        .join(last, ["comment_id", "segment_id"], "left")
        .select(
            "comment_id", "segment_id",
            F.when(known, F.col("given")).otherwise(F.lit(NO_ANSWER)).alias("response_type"),
            (~known).alias("defaulted"),
        )
    )


def represent(kind: str = "full") -> Column:
    """Text form of a position for a scorer: ``full``, ``compact`` or ``summary``."""
    if kind == "full":
        return F.to_json(F.struct(
            "segment_id", "question_ids", F.col("position").alias("stance"), F.col("public_summary").alias("summary"),
            F.col("stakeholder_concern").alias("concern"), "requested_fda_action",
        ))
    head = F.concat("segment_id", F.lit(" | stance="), "position", F.lit(" | "))
    if kind == "compact":
        return F.concat(
            head, F.lit("summary: "), "public_summary", F.lit(" | concern: "), "stakeholder_concern",
            F.lit(" | asks FDA to: "), "requested_fda_action",
        )
    if kind == "summary":
        return F.concat(head, "public_summary")
    raise ValueError(f"unknown representation {kind}")


def touching(positions: DataFrame, question_ids: list[str]) -> DataFrame:
    """All positions of the comments that have one on any given question."""
    wanted = F.array(*[F.lit(q) for q in question_ids])
    hits = positions.filter(F.arrays_overlap("question_ids", wanted)).select("comment_id")
    return positions.join(hits, "comment_id", "left_semi")


Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def label_rows(pending: DataFrame, scorer: Scorer, schema: str, tasks: int | None = None) -> DataFrame:
    """Run the caller's ``scorer`` over pending rows, an Arrow batch at a time.

    ``tasks`` sets how many batches are in flight at once; row order and ids are
    the caller's columns, so results need no reassembly."""
    spread = pending.repartition(tasks) if tasks else pending

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield scorer(batch)

    return spread.mapInPandas(score, schema)
