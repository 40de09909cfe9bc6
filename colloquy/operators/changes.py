"""What changed materially on each question since the previous build."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from colloquy import vocab
from colloquy.operators import skew

# Fixed values.
STATE_VERSION = "1.0.0"
SYNTHESIS_CHANGE_RATIO = 0.6
UNKNOWN = "unknown"

SYNTHESIS_STATE = [
    "dominant_response_type", "disagreement_exists", "disagreement_about", "stakeholder_divide_exists",
    "saying", "synthesis_status",
]


def no_synthesis(questions: DataFrame) -> DataFrame:
    """Synthesis state of questions before any synthesis ran."""
    return questions.select(
        "question_id",
        F.lit(None).cast("string").alias("dominant_response_type"),
        F.lit(False).alias("disagreement_exists"),
        F.array().cast("array<string>").alias("disagreement_about"),
        F.lit(False).alias("stakeholder_divide_exists"),
        F.lit("").alias("saying"),
        F.lit("pending").alias("synthesis_status"),
    )


def snapshot(rows: DataFrame, questions: DataFrame, synthesis: DataFrame | None = None, size: int | None = None) -> DataFrame:
    """Per question: distinct commenters, groups, commenters per issue, issue and
    response-type combinations, and the synthesis state.

    Everything kept is bounded by the vocabularies.  Who the commenters are is
    a table of its own, ``snapshot_commenters``.  ``size``, about as many as the
    rows are, lets tasks grow in number with them."""
    facts = rows.select(
        "question_id", "commenter_id", "stakeholder_type", "primary_issue",
        F.coalesce("response_type", F.lit(UNKNOWN)).alias("response_type"),
    )
    # Dealt so, all groupings down to a commenter need no further shuffle.
    combos = skew.dealt_by_size(facts, size, "question_id", "commenter_id").groupBy(*facts.columns).agg(F.lit(1).alias("one"))
    per_issue = combos.groupBy("question_id", "commenter_id", "stakeholder_type", "primary_issue").agg(
        F.collect_set("response_type").alias("types")
    )
    issues = per_issue.groupBy("question_id", "primary_issue").agg(
        F.count("*").alias("n"),
        F.array_distinct(F.flatten(F.collect_set("types"))).alias("types"),
    )
    shown = F.transform("types", lambda t: F.concat("primary_issue", F.lit("|"), t))
    by_question = issues.groupBy("question_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("primary_issue", "n")))).alias("issue_commenters"),
        F.array_sort(F.flatten(F.collect_list(shown))).alias("combos"),
    )
    people = facts.groupBy("question_id", "commenter_id", "stakeholder_type").agg(F.lit(1).alias("one"))
    counted = people.groupBy("question_id").agg(
        F.count("*").alias("distinct_commenters"),
        F.array_sort(F.collect_set("stakeholder_type")).alias("stakeholder_groups"),
    )
    state = synthesis if synthesis is not None else no_synthesis(questions)
    base = questions.select(
        "question_id", "question_number",
        F.coalesce(F.col("has_tension_block"), F.lit(False)).alias("has_curated_read"),
    )
    strings = "array<string>"
    return (
        base.join(counted, "question_id", "left").join(by_question, "question_id", "left")
        .join(state.select("question_id", *SYNTHESIS_STATE), "question_id", "left")
        .select(
            "question_id",
            "question_number",
            F.coalesce("distinct_commenters", F.lit(0).cast("bigint")).alias("distinct_commenters"),
            F.coalesce("stakeholder_groups", F.array().cast(strings)).alias("stakeholder_groups"),
            F.coalesce("issue_commenters", F.create_map().cast("map<string,bigint>")).alias("issue_commenters"),
            F.coalesce("combos", F.array().cast(strings)).alias("combos"),
            "dominant_response_type",
            F.coalesce("disagreement_exists", F.lit(False)).alias("disagreement_exists"),
            F.coalesce("disagreement_about", F.array().cast(strings)).alias("disagreement_about"),
            F.coalesce("stakeholder_divide_exists", F.lit(False)).alias("stakeholder_divide_exists"),
            F.coalesce("saying", F.lit("")).alias("saying"),
            F.coalesce("synthesis_status", F.lit("pending")).alias("synthesis_status"),
            "has_curated_read",
        )
    )


def snapshot_commenters(rows: DataFrame) -> DataFrame:
    return rows.select("question_id", "commenter_id").distinct()


def _ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a or "", b or "", autojunk=False).ratio()


@F.pandas_udf(DoubleType())
def wording_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two syntheses; at most one row per question comes here."""
    return pd.Series([_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def _issue_of(combo: Column) -> Column:
    return F.split_part(combo, F.lit("|"), F.lit(1))


def _reason(condition: Column, name, detail: Column) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    return F.when(condition, F.struct(name.alias("reason"), detail.alias("detail")))


def compare_snapshots(prior: DataFrame, new: DataFrame) -> DataFrame:
    """New snapshots with ``reasons``, the material changes against the prior one
    (empty when a question has no prior snapshot)."""
    old = prior.select("question_id", F.struct(*[c for c in prior.columns if c != "question_id"]).alias("old"))
    joined = new.join(old, "question_id", "left")
    known = F.col("old").isNotNull()

    new_groups = F.array_except("stakeholder_groups", "old.stakeholder_groups")
    typed = F.exists("old.combos", lambda c: ~F.endswith(c, F.lit(f"|{UNKNOWN}")))
    old_issues = F.transform("old.combos", _issue_of)
    new_combos = F.array_sort(F.when(typed, F.array_except("combos", "old.combos")).otherwise(
        F.filter("combos", lambda c: ~F.array_contains(old_issues, _issue_of(c)))
    ))
    shown_combos = F.array_join(F.transform("new_combos", lambda c: F.replace(c, F.lit("|"), F.lit(" / "))), ", ")

    comparable = (
        (F.col("old.synthesis_status") != "pending") & (F.col("old.saying") != "")
        & (F.col("synthesis_status") != "pending")
    )
    enough = vocab.MIN_COMMENTERS_FOR_CONCLUSION
    crossed = F.map_keys(F.map_filter("issue_commenters", lambda issue, n: (n >= enough) & (
        F.coalesce(F.try_element_at("old.issue_commenters", issue), F.lit(0).cast("bigint")) < enough
    )))
    topics = F.when(F.size("disagreement_about") > 0, F.col("disagreement_about")).when(
        F.size("old.disagreement_about") > 0, F.col("old.disagreement_about")
    ).otherwise(F.array(F.lit("unspecified")))
    said = (F.col("old.saying") != "") & (F.col("saying") != "") & (F.col("old.saying") != F.col("saying"))

    prepared = joined.withColumns({
        "new_groups": F.when(known, F.array_sort(new_groups)).otherwise(F.array().cast("array<string>")),
        "new_combos": F.when(known, new_combos).otherwise(F.array().cast("array<string>")),
        "crossed": F.when(known & comparable, crossed).otherwise(F.array().cast("array<string>")),
        "ratio": F.when(known & comparable & said, wording_ratio(F.col("old.saying"), F.col("saying"))),
        "comparable": F.coalesce(known & comparable, F.lit(False)),
    })
    both = F.col("comparable")
    reasons = F.array(
        _reason(F.size("new_groups") > 0, "new_stakeholder_group",
                F.concat(F.lit("new group(s): "), F.array_join("new_groups", ", "))),
        _reason(F.size("new_combos") > 0, "new_substantive_position",
                F.concat(F.lit("new issue and response-type combination(s): "), shown_combos)),
        _reason(both & (F.col("old.dominant_response_type") != F.col("dominant_response_type")),
                "dominant_response_type_changed",
                F.concat("old.dominant_response_type", F.lit(" -> "), "dominant_response_type")),
        _reason(both & (F.col("old.disagreement_exists") != F.col("disagreement_exists")),
                F.when(F.col("disagreement_exists"), F.lit("disagreement_emerged")).otherwise(F.lit("disagreement_resolved")),
                F.concat(F.lit("about: "), F.array_join(topics, ", "))),
        _reason(both & (F.col("old.stakeholder_divide_exists") != F.col("stakeholder_divide_exists")),
                "stakeholder_divide_changed",
                F.concat(F.lit("a stakeholder divide is now "),
                         F.when(F.col("stakeholder_divide_exists"), F.lit("reported")).otherwise(F.lit("no longer supported")))),
        _reason(F.size("crossed") > 0, "issue_crossed_threshold",
                F.concat(F.array_join("crossed", ", "), F.lit(f" now raised by at least {enough} distinct commenters"))),
        _reason(F.col("ratio") < SYNTHESIS_CHANGE_RATIO, "synthesis_changed",
                F.concat(F.lit("synthesis text similarity "), F.format_number("ratio", 2))),
        _reason(both & (F.col("synthesis_status") == "stale") & (F.col("old.synthesis_status") != "stale"),
                "synthesis_stale", F.lit("positions changed since the synthesis was generated")),
    )
    return prepared.withColumn("reasons", F.array_compact(reasons)).withColumn(
        "prior_distinct_commenters", F.col("old.distinct_commenters")
    ).drop("old", "ratio", "comparable", "crossed")


def review_queue(prior: DataFrame, new: DataFrame) -> DataFrame:
    """Questions with at least one material change, in question order."""
    return (
        compare_snapshots(prior, new)
        .filter(F.size("reasons") > 0)
        .select(
            "question_id",
            "question_number",
            "reasons",
            F.array_join(F.transform("reasons", lambda r: r["detail"]), "; ").alias("what_changed"),
            "prior_distinct_commenters",
            F.col("distinct_commenters").alias("new_distinct_commenters"),
            F.col("new_groups").alias("new_stakeholder_groups"),
            F.col("has_curated_read").alias("curated_read_may_need_review"),
        )
        .orderBy("question_number")
    )
