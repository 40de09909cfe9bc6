"""The registered queries: each runs over the whole driver tables.

Results hold scalars only; maps and arrays are rendered as ordered strings so
that another engine's answer can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy import vocab
from colloquy.operators import assemble, stats
from colloquy.plans.docket import Docket
from colloquy.session import cut_lineage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def docket_query(fn: Callable[[Docket], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Docket.from_driver_tables(spark, sf_dir))

    QUERIES[fn.__name__] = run
    return run


def show_map(column) -> Column:
    entries = F.map_entries(F.col(column) if isinstance(column, str) else column)
    return F.array_join(
        F.transform(entries, lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ";"
    )


def show_list(column) -> Column:
    return F.array_join(column, ",")


# --- assembly ---------------------------------------------------------------

@docket_query
def exclusions(d):
    by_submission = (
        assemble.excluded(d.candidates).groupBy(F.col("reason_code").alias("reason")).agg(F.count("*").alias("n"))
    )
    return by_submission.unionByName(assemble.position_exclusions(d.analysis))


@docket_query
def excluded_comments(d):
    return assemble.excluded(d.candidates).select("comment_id", "reason")


@docket_query
def commenter_resolution(d):
    return d.commenters


@docket_query
def public_submissions(d):
    return assemble.public_submissions(d.submissions)


@docket_query
def public_positions(d):
    return assemble.public_positions(d.linked).withColumns(
        {"question_ids": show_list("question_ids"), "gap_tags": show_list("gap_tags")}
    )


@docket_query
def public_commenters(d):
    return assemble.public_commenters(d.commenters, d.submissions)


@docket_query
def submissions_without_positions(d):
    return assemble.submissions_without_positions(d.submissions, d.positions).select(
        "submission_id", "regulations_gov_comment_id"
    )


@docket_query
def featured_positions(d):
    return d.positions.filter("featured").select(
        "position_id", F.length("supporting_text").cast("bigint").alias("passage_chars")
    )


@docket_query
def positions_by_question(d):
    # A position is on two questions at most.
    return assemble.positions_by_question(d.linked, 2 * (d.size or 0))


@docket_query
def theme_lookup(d):
    """The themes of all questions that a position is on."""
    labels = {t.id: t.label for t in vocab.THEMES}
    return d.questions.join(d.question_rows.select("question_id"), "question_id", "left_semi").select(
        "question_id", "theme", vocab.label(labels, F.col("theme")).alias("label"), "question_number"
    )


@docket_query
def evidence_lookup(d):
    wanted = d.question_rows.groupBy("question_id").agg(F.min("position_id").alias("position_id"))
    return assemble.evidence_lookup(wanted, d.linked, d.submissions).select(
        "position_id", "commenter_id", "display_name", "stakeholder_type", "received_date",
        "regulations_gov_comment_id", "source_url", "supporting_text",
    )


# --- statistics -------------------------------------------------------------

@docket_query
def question_stats(d):
    return stats.question_stats(d.question_rows, d.questions).withColumns({
        c: show_map(c) for c in ("stakeholder_mix", "position_distribution", "response_type_commenters")
    })


def _exploded(d, column, key, value):
    rows = stats.question_stats(d.question_rows, d.questions)
    return rows.select("question_id", F.explode(column).alias(key, value))


@docket_query
def stakeholder_mix(d):
    return _exploded(d, "stakeholder_mix", "stakeholder_type", "commenters")


@docket_query
def stance_distribution(d):
    return _exploded(d, "position_distribution", "stance", "positions")


@docket_query
def response_type_commenters(d):
    return _exploded(d, "response_type_commenters", "response_type", "commenters")


@docket_query
def eligibility(d):
    return stats.question_stats(d.question_rows, d.questions).select(
        "question_id", "tension_eligible", "conclusion_eligible"
    )


@docket_query
def response_type_distribution(d):
    return stats.response_type_distribution(d.question_rows).select(
        "question_id", show_map("by_distinct_commenters").alias("by_distinct_commenters"),
        show_map("by_positions").alias("by_positions"),
    )


@docket_query
def comparable_groups(d):
    return stats.comparable_groups(d.question_rows).withColumn("comparable_groups", show_list("comparable_groups"))


@docket_query
def dominant_type(d):
    return stats.dominant_type(d.question_rows)


@docket_query
def gap_stats(d):
    return stats.gap_stats(d.linked, d.gaps).select(
        "ordinal", "gap_id", "title", "distinct_commenters", "positions",
        show_list("stakeholder_types").alias("stakeholder_types"), show_list("question_ids").alias("question_ids"),
    )


@docket_query
def gap_top_questions(d):
    return stats.gap_top_questions(d.linked)


@docket_query
def gap_examples(d):
    return stats.gap_examples(d.linked)


@docket_query
def docket_metrics(d):
    return stats.docket_metrics(d.submissions, d.linked, d.questions).select(
        "comments_analyzed", "commenters_represented", "positions_identified", "questions_tracked"
    )


@docket_query
def stance_totals(d):
    return stats.stance_totals(d.linked)


@docket_query
def docket_pattern(d):
    return stats.docket_pattern(stats.question_stats(d.question_rows, d.questions), stats.stance_totals(d.linked))


@docket_query
def most_discussed(d):
    rows = stats.question_stats(d.question_rows, d.questions)
    return stats.most_discussed(rows.join(d.questions.select("question_id", "short_title"), "question_id")).select(
        "question_id", "short_title", "distinct_commenters", "positions"
    )


@docket_query
def theme_rollup(d):
    return stats.theme_rollup(stats.question_stats(d.question_rows, d.questions))


@docket_query
def blind_spot(d):
    best = F.max_by(F.struct("gap_id", "distinct_commenters"), F.struct("distinct_commenters", (-F.col("ordinal")).alias("late")))
    return stats.gap_totals(d.linked, d.gaps).filter("distinct_commenters > 0").agg(best.alias("g")).select("g.*")


@docket_query
def signal_cards(d):
    linked = d.kept("question_ids", "commenter_id", "submission_id", "stakeholder_type", "response_type", "position", "gap_tags")
    return stats.signal_cards(
        d.questions,
        cut_lineage(stats.question_stats(d.rolled_up(linked), d.questions)),
        cut_lineage(stats.gap_stats(linked, d.gaps, max_examples=0)),
        cut_lineage(stats.stance_totals(linked)),
    ).select("category", "headline", "evidence", "target_question_id")
