"""From stage tables to publishable submissions, commenters and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy import schemas, vocab
from colloquy.functions import text as T
from colloquy.operators.skew import ordered_by_size, salted_join

# Reason codes and the wording listed next to an excluded id.
WITHDRAWN = "withdrawn"
NO_USABLE_TEXT = "no_usable_text"
NOT_YET_CLASSIFIED = "not_yet_classified"
REASON_TEXT = {
    WITHDRAWN: "withdrawn",
    NO_USABLE_TEXT: "no usable text",
    NOT_YET_CLASSIFIED: "classification pending",
}
NO_POSITION_LEFT = "submissions_without_published_positions"


def join_stages(comments: DataFrame, text_meta: DataFrame, identities: DataFrame,
                analyzed: DataFrame) -> DataFrame:
    """One row per comment with what every stage knows about it.

    All four frames are keyed by ``comment_id``; one hash partitioning on that
    key serves the three joins."""
    return (
        comments.join(text_meta.select("comment_id", "usable"), "comment_id", "left")
        .join(identities.withColumn("identified", F.lit(True)), "comment_id", "left")
        .join(analyzed.select("comment_id", F.lit(True).alias("analyzed")), "comment_id", "left")
        .withColumn("usable", F.coalesce("usable", F.lit(False)))
        .withColumn("identified", F.coalesce("identified", F.lit(False)))
        .withColumn("analyzed", F.coalesce("analyzed", F.lit(False)))
    )


def exclusion_reason() -> Column:
    """First reason that keeps a submission out, null for an accepted one."""
    return (
        F.when(F.coalesce("withdrawn", F.lit(False)), F.lit(WITHDRAWN))
        .when(~F.coalesce("usable", F.lit(False)), F.lit(NO_USABLE_TEXT))
        .when(~(F.col("identified") & F.col("analyzed")), F.lit(NOT_YET_CLASSIFIED))
    )


def accepted(candidates: DataFrame) -> DataFrame:
    return candidates.filter(exclusion_reason().isNull())


def excluded(candidates: DataFrame) -> DataFrame:
    wording = vocab.literal_map(REASON_TEXT)
    return (
        candidates.select("comment_id", exclusion_reason().alias("reason_code"))
        .filter("reason_code is not null")
        .withColumn("reason", F.element_at(wording, F.col("reason_code")))
    )


# --- commenters -------------------------------------------------------------

def commenter_key() -> Column:
    """Organizations are one commenter across submissions; individuals, and
    authors without an organization, are one per comment."""
    organization = T.strip(F.coalesce("organization", F.lit("")))
    merged = (organization != "") & (F.col("stakeholder_type") != "individual")
    return F.when(merged, F.concat(F.lit("org:"), T.full_slug(organization))).otherwise(
        F.concat(F.lit("comment:"), F.col("comment_id"))
    )


def commenter_id() -> Column:
    """Id made from the key alone, so no lookup is needed.  Where the slug shown
    loses something of the key (length, letters outside ASCII), 64 bits of a digest
    of the key follow, so distinct keys keep distinct ids."""
    key = commenter_key()
    tail = F.lower(F.regexp_replace(key, "^(org|comment):", ""))
    shown = F.when(F.startswith(key, F.lit("org:")), T.slug(tail)).otherwise(F.substring(tail, 1, 60))
    short = F.concat(F.lit("c-"), shown)
    return F.when(shown != tail, F.concat(short, F.lit("-"), F.substring(F.sha2(key, 256), 1, 16))).otherwise(short)


def commenters(accepted_rows: DataFrame) -> DataFrame:
    """One row per commenter; the earliest comment id supplies the name."""
    organization = T.strip(F.coalesce("organization", F.lit("")))
    shown = F.coalesce(
        F.nullif(F.col("display_name"), F.lit("")), F.nullif(organization, F.lit("")), F.lit("Individual commenter")
    )
    facts = F.struct(shown.alias("display_name"), organization.alias("organization"), "stakeholder_type")
    return (
        accepted_rows.groupBy(commenter_id().alias("commenter_id"))
        .agg(F.min_by(facts, F.col("comment_id")).alias("first"))
        .select("commenter_id", "first.*")
    )


def submissions(accepted_rows: DataFrame) -> DataFrame:
    return accepted_rows.select(
        F.concat(F.lit("s-"), F.lower("comment_id")).alias("submission_id"),
        F.col("comment_id").alias("regulations_gov_comment_id"),
        commenter_id().alias("commenter_id"),
        F.substring("received_date", 1, 10).alias("received_date"),
        F.substring("posted_date", 1, 10).alias("posted_date"),
        "source_url",
        "attachment_urls",
    )


# --- positions --------------------------------------------------------------

def is_unclear() -> Column:
    return F.coalesce((F.col("position") == "unclear") & (F.col("confidence") == "low"), F.lit(False))


def has_summary() -> Column:
    return F.coalesce(F.col("public_summary"), F.lit("")) != ""


def publishable(positions: DataFrame) -> DataFrame:
    return positions.filter(~is_unclear() & has_summary())


def position_exclusions(positions: DataFrame) -> DataFrame:
    """How many positions each rule drops; the first rule that applies counts."""
    reason = F.when(is_unclear(), F.lit("unclear_low_confidence_positions")).when(
        ~has_summary(), F.lit("positions_without_summary")
    )
    return (
        positions.select(reason.alias("reason"))
        .filter("reason is not null")
        .groupBy("reason")
        .agg(F.count("*").alias("n"))
    )


def is_featured() -> Column:
    return F.coalesce(
        (F.col("confidence") == "high") & F.length("source_passage").between(40, 420), F.lit(False)
    )


def attach_response_types(positions: DataFrame, labels: DataFrame) -> DataFrame:
    """Add the response type of each segment from the fresh label rows."""
    return positions.join(
        labels.select("comment_id", "segment_id", "response_type"), ["comment_id", "segment_id"], "left"
    )


def built_positions(positions: DataFrame) -> DataFrame:
    """Publishable positions in build shape, keyed to their submission."""
    return publishable(positions).select(
        F.concat(F.lit("p-"), F.lower("comment_id"), F.lit("-"), F.col("segment_id")).alias("position_id"),
        F.concat(F.lit("s-"), F.lower("comment_id")).alias("submission_id"),
        "question_ids",
        "position",
        "response_type",
        "primary_issue",
        "secondary_issue",
        "stakeholder_concern",
        "requested_fda_action",
        "public_summary",
        F.col("source_passage").alias("supporting_text"),
        F.col("confidence").alias("model_confidence"),
        "gap_tags",
        is_featured().alias("featured"),
    )


def authored_submissions(subs: DataFrame, authors: DataFrame, heavy_share: float | None = None) -> DataFrame:
    """Submissions whose commenter exists, with the commenter's facts.  Built
    once, before positions join, so the big side is shuffled a single time.  With
    ``heavy_share``, commenters with more than that share of all submissions are
    spread over several tasks (``skew.salted_join``)."""
    mine = subs.select("submission_id", "commenter_id")
    return mine.join(authors, "commenter_id") if heavy_share is None else salted_join(mine, authors, "commenter_id", heavy_share)


def linked_positions(positions: DataFrame, authored: DataFrame) -> DataFrame:
    """Positions whose submission and commenter exist, with both attached."""
    return positions.join(authored, "submission_id")


def public_positions(linked: DataFrame) -> DataFrame:
    """Allow-listed columns only; confidence never leaves this layer."""
    return linked.select(
        *[
            F.nullif(F.col(c), F.lit("")).alias(c) if c in ("secondary_issue", "response_type")
            else F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c) if c == "gap_tags"
            else F.coalesce(F.col(c), F.lit(False)).alias(c) if c == "featured"
            else F.col(c)
            for c in schemas.PUBLIC_POSITION_COLUMNS
        ]
    )


def public_submissions(subs: DataFrame) -> DataFrame:
    return subs.select(
        "submission_id", "regulations_gov_comment_id", "commenter_id", "received_date", "posted_date",
        "source_url", (F.size(F.coalesce("attachment_urls", F.array().cast("array<string>"))) > 0).alias("has_attachments"),
    )


def public_commenters(authors: DataFrame, subs: DataFrame) -> DataFrame:
    """Commenters with at least one submission."""
    return authors.select(*schemas.PUBLIC_COMMENTER_COLUMNS).join(
        subs.select("commenter_id"), "commenter_id", "left_semi"
    )


def submissions_without_positions(subs: DataFrame, positions: DataFrame) -> DataFrame:
    return subs.join(positions.select("submission_id"), "submission_id", "left_anti")


#: Columns of question rows, and what they are called in linked positions.
QUESTION_ROW = {
    "position_id": "position_id", "commenter_id": "commenter_id", "commenter": "display_name",
    "stakeholder_type": "stakeholder_type", "submission_id": "submission_id", "response_type": "response_type",
    "stance": "position", "primary_issue": "primary_issue", "summary": "public_summary",
}


def question_rows(linked: DataFrame, columns=tuple(QUESTION_ROW)) -> DataFrame:
    """One row per (position, question), commenter attached."""
    return linked.select(F.explode("question_ids").alias("question_id"), *[F.col(QUESTION_ROW[c]).alias(c) for c in columns])


def positions_by_question(linked: DataFrame, rows: int | None = None) -> DataFrame:
    """``question_rows`` in reading order: question, commenter name, position;
    ``rows``: about how many they are, where that is known."""
    return ordered_by_size(
        question_rows(linked), rows, vocab.question_number(F.col("question_id")), F.lower("commenter"), F.col("position_id")
    )


def evidence_lookup(ids: DataFrame, linked: DataFrame, subs: DataFrame) -> DataFrame:
    """Full evidence rows for the requested ``position_id``s."""
    return (
        linked.join(ids.select("position_id").distinct(), "position_id", "left_semi")
        .join(subs.drop("commenter_id", "attachment_urls"), "submission_id")
    )
