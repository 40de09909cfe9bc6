"""Registered queries on freshness, changes, run comparison, search, guards
and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy import schemas, vocab
from colloquy.operators import assemble, changes, compare, facets, freshness, guards, stats, validate
from colloquy.plans.catalog import docket_query, query, show_list, show_map
from colloquy.session import cut_lineage, stored
from colloquy.sources import driver_tables as src

PROMPT, PROCESSING, MODEL = "1.0.0", "2026.1", "scorer-a"

# --- freshness --------------------------------------------------------------


def _inputs(spark, sf_dir):
    return src.table(spark, sf_dir, "orders").selectExpr(
        "cast(o_orderkey AS string) AS comment_id", "substring(md5(o_orderstatus), 1, 16) AS input_hash"
    )


def _records(spark, sf_dir):
    """Stored records: some missing, some of another input, version or model."""
    return src.table(spark, sf_dir, "orders").filter("o_orderkey % 10 <> 0").selectExpr(
        "cast(o_orderkey AS string) AS comment_id",
        "substring(md5(CASE WHEN o_orderkey % 9 = 0 THEN 'old' ELSE o_orderstatus END), 1, 16) AS input_hash",
        "CASE WHEN o_orderkey % 8 = 0 THEN '0.9' ELSE '1.0.0' END AS prompt_version",
        "'2026.1' AS processing_version",
        "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'scorer-a' END AS model",
    )


@query
def freshness_flags(spark, sf_dir):
    return freshness.with_freshness(_inputs(spark, sf_dir), _records(spark, sf_dir), PROMPT, PROCESSING, MODEL).select(
        "comment_id", "fresh"
    )


@query
def pending_rows(spark, sf_dir):
    flagged = freshness.with_freshness(_inputs(spark, sf_dir), _records(spark, sf_dir), PROMPT, PROCESSING, MODEL)
    return freshness.pending(flagged).select("comment_id", "input_hash")


@query
def pending_counts(spark, sf_dir):
    return freshness.counts(
        freshness.with_freshness(_inputs(spark, sf_dir), _records(spark, sf_dir), PROMPT, PROCESSING, MODEL)
    )


def _arrivals(spark, sf_dir):
    return src.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("comment_id"), F.col("ts").cast("string").alias("last_modified_date"), "event_id", "event_type"
    )


@query
def latest_version(spark, sf_dir):
    return freshness.latest_versions(_arrivals(spark, sf_dir)).select("comment_id", "event_id", "event_type")


@query
def changed_comments(spark, sf_dir):
    """Newest versions that differ from the newest ones of all but one type."""
    arrivals = _arrivals(spark, sf_dir)
    stored = freshness.latest_versions(arrivals.filter("event_type <> 'click'"))
    return freshness.changed_comments(freshness.latest_versions(arrivals), stored).select("comment_id", "event_id")


@query
def text_refresh(spark, sf_dir):
    orders = src.table(spark, sf_dir, "orders")
    fetched = orders.selectExpr("cast(o_orderkey AS string) AS comment_id", "o_orderpriority AS fetched_at")
    taken = orders.filter("o_orderkey % 6 <> 0").selectExpr(
        "cast(o_orderkey AS string) AS comment_id",
        "CASE WHEN o_orderkey % 4 = 0 THEN 'earlier' ELSE o_orderpriority END AS fetched_at",
    )
    return freshness.needs_text(fetched, taken).select("comment_id")


@query
def record_hash(spark, sf_dir):
    return src.table(spark, sf_dir, "part").select(
        "p_partkey", freshness.hash_of_record("p_partkey", "p_name", "p_brand").alias("record_hash")
    )


@docket_query
def fresh_response_types(d):
    """Positions with response types, taken only from records that are fresh."""
    hashes = d.analysis.select("comment_id").distinct().withColumn("input_hash", F.md5("comment_id"))
    stale = F.col("comment_id").cast("bigint") % 5 == 0
    labels = d.analysis.groupBy("comment_id").agg(
        F.map_from_entries(F.collect_list(F.struct("segment_id", "response_type"))).alias("response_types")
    ).withColumns({
        "input_hash": F.md5(F.when(stale, F.lit("old")).otherwise(F.col("comment_id"))),
        "prompt_version": F.lit(PROMPT), "processing_version": F.lit(PROCESSING), "model": F.lit(MODEL),
    })
    rows, _ = freshness.fresh_response_types(labels, hashes, PROMPT, PROCESSING, MODEL)
    joined = assemble.attach_response_types(d.analysis.drop("response_type"), rows)
    return joined.groupBy("response_type").agg(F.count("*").alias("n"))


# --- changes between builds -------------------------------------------------
EARLY = "1995-02-15"


_SNAPSHOT = ("commenter_id", "stakeholder_type", "submission_id", "response_type", "stance", "primary_issue")


def dated_rows(d) -> DataFrame:
    """Linked positions with what snapshots read and the date of their submission,
    written once for the builds of several dates."""
    subs = d.submissions.select("submission_id", "commenter_id", "received_date").join(d.commenters, "commenter_id")
    linked = assemble.linked_positions(d.dealt(d.positions, "submission_id"), subs)
    return stored(linked.select("received_date", "question_ids", *[assemble.QUESTION_ROW[c] for c in _SNAPSHOT]), "dated")


def _build(d, before=None, dated=None):
    """Snapshot of the docket as it was before a date; ``dated``: ``dated_rows``,
    where several builds share them."""
    if dated is not None:
        rows = assemble.question_rows(dated.filter(F.col("received_date") < before) if before else dated, _SNAPSHOT)
    else:
        subs = d.submissions.filter(F.col("received_date") < before) if before else d.submissions
        rows = assemble.question_rows(
            assemble.linked_positions(d.dealt(d.positions, "submission_id"), assemble.authored_submissions(subs, d.commenters))
        )
    state = stats.response_type_distribution(rows).select(
        "question_id",
        stats.dominant_of("by_distinct_commenters").alias("dominant_response_type"),
        (F.col("distinct_commenters") % 2 == 1).alias("disagreement_exists"),
        F.array(F.lit("scope")).alias("disagreement_about"),
        (F.col("distinct_commenters") % 3 == 0).alias("stakeholder_divide_exists"),
        F.lit("Commenters differ.").alias("saying"),
        F.when(F.col("positions") % 4 == 0, F.lit("stale")).otherwise(F.lit("generated")).alias("synthesis_status"),
    )
    return changes.snapshot(rows, d.questions, state, d.size)


@docket_query
def snapshot(d):
    return _build(d).select(
        "question_id", "distinct_commenters", show_list("stakeholder_groups").alias("stakeholder_groups"),
        show_map("issue_commenters").alias("issue_commenters"), show_list("combos").alias("combos"),
        "dominant_response_type", "disagreement_exists", "synthesis_status",
    )


@docket_query
def snapshot_commenters(d):
    return changes.snapshot_commenters(d.question_rows)


@docket_query
def change_queue(d):
    return changes.review_queue(_build(d, EARLY), _build(d)).select(
        "question_id", "question_number",
        show_list(F.transform("reasons", lambda r: r["reason"])).alias("reasons"), "what_changed",
        "prior_distinct_commenters", "new_distinct_commenters",
        show_list("new_stakeholder_groups").alias("new_stakeholder_groups"), "curated_read_may_need_review",
    )


# --- comparison of labelling runs -------------------------------------------

def _runs(d):
    base = d.analysis.select("comment_id", "segment_id", "response_type", "confidence", "question_ids")
    key = F.col("comment_id").cast("bigint")
    production = base.withColumn("input_hash", F.md5("comment_id"))
    other = F.when(F.col("confidence") == "low", F.lit("concern")).when(
        F.col("confidence") == "medium", F.lit("recommendation")
    ).otherwise(F.col("response_type"))
    shadow = base.filter(F.substring("segment_id", 1, 2) != "07").select(
        "comment_id", "segment_id", other.alias("response_type"),
        F.md5(F.when(key % 11 == 0, F.lit("old")).otherwise(F.col("comment_id"))).alias("input_hash"),
    )
    return production, shadow, base


def _pairs(d):
    return compare.aligned(*_runs(d))


@docket_query
def label_mismatches(d):
    production, shadow, _ = _runs(d)
    one = ["comment_id", "input_hash"]
    return compare.mismatched(production.select(*one).distinct(), shadow.select(*one).distinct())


@docket_query
def label_agreement(d):
    return compare.agreement(_pairs(d))


@docket_query
def label_agreement_by_type(d):
    return compare.agreement_by_type(_pairs(d))


@docket_query
def label_confusion(d):
    return compare.confusion(_pairs(d))


@docket_query
def label_disagreements(d):
    return compare.disagreements(_pairs(d)).withColumn("question_ids", show_list("question_ids"))


@docket_query
def dominant_shift(d):
    return compare.dominant_shift(_pairs(d))


# --- search -----------------------------------------------------------------
SEARCH = facets.Facets(stakeholder="academic_research", search=" Widget ")
BY_TOPIC = facets.Facets(stance="oppose", search="human factors", theme="premarket")
TENSIONS = facets.Facets(view="tensions", theme="risk", stance="mixed")


@docket_query
def search_haystack(d):
    return facets.with_haystack(d.linked).select("position_id", F.md5("haystack").alias("digest"))


@docket_query
def facet_filter(d):
    return facets.facet_filter(facets.with_haystack(d.linked), d.questions, SEARCH)


@docket_query
def filtered_summary(d):
    rows = facets.searched_rows(facets.with_haystack(d.linked), d.questions, SEARCH)
    return facets.filtered_summary(rows).withColumns(
        {c: show_map(c) for c in ("stakeholder_mix", "position_distribution")}
    )


@docket_query
def faceted_view(d):
    return facets.view(facets.with_haystack(d.linked), d.questions, BY_TOPIC)


@docket_query
def tension_view(d):
    return facets.view(facets.with_haystack(d.linked), d.questions, TENSIONS)


@docket_query
def result_count(d):
    return facets.result_count(facets.with_haystack(d.linked), d.questions, BY_TOPIC)


@docket_query
def section_rollup(d):
    return facets.section_rollup(facets.view(facets.with_haystack(d.linked), d.questions, SEARCH))


@docket_query
def commenter_cards(d):
    rows = d.linked.withColumn("question_id", F.explode("question_ids"))
    return facets.commenter_cards(rows).withColumns(
        {"stances": show_list("stances"), "other_questions": show_list("other_questions")}
    )


@docket_query
def gap_lines(d):
    return facets.gap_lines(stats.gap_stats(d.linked, d.gaps))


# --- guards -----------------------------------------------------------------

def guarded_rows(d) -> DataFrame:
    """Question rows with what claims and their guards read, written once for both."""
    return assemble.question_rows(d.kept("question_ids", *[assemble.QUESTION_ROW[c] for c in guards.GUARDED]), guards.GUARDED)


def claims_of(rows: DataFrame) -> DataFrame:
    """One claim per question made from its positions: two sides, one of them
    repeated on every fourth question, evidence with one unknown id."""
    ends = rows.groupBy("question_id").agg(
        F.min("position_id").alias("first"), F.max("position_id").alias("last"),
        *[f(F.when(F.col("stance") == s, F.col("position_id"))).alias(f"{s}_{n}")
          for s in ("support", "oppose") for n, f in (("first", F.min), ("last", F.max))],
    )
    number = vocab.question_number(F.col("question_id"))
    support, oppose = F.array("support_first", "support_last"), F.array("oppose_first", "oppose_last")
    return ends.select(
        "question_id",
        F.repeat(F.concat(F.lit("Positions on "), "question_id", F.lit(" vary. ")), number).alias("saying"),
        F.when(number % 2 == 0, F.lit("concern")).otherwise(F.lit("bogus")).alias("dominant_response_type"),
        F.struct(
            F.lit(True).alias("exists"), F.array(F.lit("scope"), F.lit("bogus"), F.lit("timing")).alias("about"),
            F.lit("They differ \\u2014 on scope.").alias("text"),
            F.array(
                F.struct(F.lit("for").alias("summary"), support.alias("position_ids")),
                F.struct(F.lit("against").alias("summary"), F.when(number % 4 == 0, support).otherwise(oppose).alias("position_ids")),
            ).alias("sides"),
        ).alias("disagreement"),
        F.struct(
            (number % 3 != 0).alias("claimed"), F.array(F.lit("academic_research"), F.lit("investor_vc")).alias("groups"),
            F.lit("Two groups differ.").alias("text"),
        ).alias("stakeholder_divide"),
        F.array("last", F.lit("p-bogus"), "first").alias("evidence_position_ids"),
    )


@docket_query
def side_resolution(d):
    return guards.resolved_sides(claims_of(d.question_rows), d.question_rows).select("question_id", F.inline("sides")).select(
        "question_id", "side", "summary", show_list("position_ids").alias("position_ids"),
        show_list("commenter_ids").alias("commenter_ids"),
    )


@docket_query
def disagreement_guard(d):
    rows = guarded_rows(d)
    return guards.guard(cut_lineage(claims_of(rows)), rows, written=True).select(
        "question_id", "saying", "dominant_response_type", F.col("disagreement.exists").alias("disagreement_exists"),
        F.col("disagreement.text").alias("disagreement_text"), show_list("disagreement.about").alias("about"),
        F.col("stakeholder_divide.exists").alias("divide_exists"), F.col("stakeholder_divide.note").isNotNull().alias("has_note"),
        "distinct_commenters", "positions", show_list("quality_flags").alias("quality_flags"),
    )


@docket_query
def evidence_guard(d):
    rows = guarded_rows(d)
    return guards.guard(cut_lineage(claims_of(rows)), rows, written=True).select(
        "question_id", show_list("evidence_position_ids").alias("evidence"), show_list("downgrades").alias("downgrades")
    )


@docket_query
def input_fingerprint(d):
    return guards.input_fingerprint(d.question_rows, d.questions)


@docket_query
def position_lines(d):
    return guards.position_lines(d.question_rows).select("question_id", "position_id", F.md5("line").alias("digest"))


def _published(d):
    number = vocab.question_number(F.col("question_id"))
    # Claims, guards and counts read the same rows and roll-up: each is made once.
    rows = guarded_rows(d)
    rollup = stored(stats.commenter_rollup(rows), "rollup")
    records = guards.guard(cut_lineage(claims_of(rows)), rows, rollup, written=True)
    return guards.published(d.questions, rows, records.filter(number % 5 != 0).withColumn("fresh", number % 3 != 0), rollup)


@docket_query
def question_analyses(d):
    return _published(d).select(
        "question_id", "status", "dominant_response_type", F.col("disagreement.exists").alias("disagreement_exists"),
        "distinct_commenters", "positions", "broken",
    )


@docket_query
def synthesis_report(d):
    return guards.report(d.questions, cut_lineage(_published(d)), d.linked).select(
        "question_id", "status", "at", "position_id", "short_title", "display_name", "stakeholder_type", "response_type",
        "public_summary",
    )


# --- validation -------------------------------------------------------------

@docket_query
def violations(d):
    """All rules over a docket with faults of many kinds put in."""
    fault = F.substring("comment_id", -2, 2).cast("int")

    def put(condition, value, column):
        return F.when(condition, value).otherwise(F.col(column))

    raw = d.dealt(assemble.publishable(d.analysis), "comment_id").withColumn("fault", fault)
    positions = raw.join(d.submissions.select(F.col("regulations_gov_comment_id").alias("comment_id"), "commenter_id"),
                         "comment_id", "left").select(
        F.concat_ws("-", F.lit("p"), "comment_id", F.substring("segment_id", 1, 2)).alias("position_id"),
        F.concat(F.lit("s-"), "comment_id").alias("submission_id"),
        put(F.col("fault") == 1, F.lit("c-wrong"), "commenter_id").alias("commenter_id"),
        put(F.col("fault") == 2, F.array(F.lit("q99")), "question_ids").alias("question_ids"),
        put(F.col("fault") == 3, F.lit("bogus"), "position").alias("position"),
        put(F.col("fault") == 4, F.lit("bogus"), "response_type").alias("response_type"),
        put(F.col("fault") == 5, F.lit("bogus"), "primary_issue").alias("primary_issue"),
        put(F.col("fault") == 6, F.lit("bogus"), "secondary_issue").alias("secondary_issue"),
        put(F.col("fault") == 7, F.array(F.lit("bogus")), "gap_tags").alias("gap_tags"),
        put(F.col("fault") == 8, F.lit(" "), "source_passage").alias("supporting_text"),
        put(F.col("fault") == 9, F.repeat(F.lit("word "), 46), "public_summary").alias("public_summary"),
    )
    authors = d.commenters.withColumn(
        "stakeholder_type", F.when(F.endswith("commenter_id", F.lit("77")), F.lit("bogus")).otherwise(F.col("stakeholder_type"))
    )
    subs = assemble.public_submissions(d.submissions).withColumn(
        "source_url", F.when(F.endswith("submission_id", F.lit("55")), F.lit("")).otherwise(F.col("source_url"))
    )
    questions = d.questions.withColumns({"source_url": F.lit("https://example.org"), "question_text": F.lit("")})
    return validate.violations(
        questions, authors, subs, positions, stats.question_stats(d.question_rows, d.questions)
    )


@docket_query
def clean_docket_violations(d):
    """The docket as published, with its gaps and cards: no rule is broken."""
    linked = d.kept(*schemas.PUBLIC_POSITION_COLUMNS, "display_name", "stakeholder_type")
    positions = assemble.public_positions(linked)
    per_question = cut_lineage(stats.question_stats(d.rolled_up(linked), d.questions))
    gaps = cut_lineage(stats.gap_stats(linked, d.gaps))
    metrics = stats.docket_metrics(d.submissions, linked, d.questions)
    cards = stats.signal_cards(d.questions, per_question, gaps, cut_lineage(stats.stance_totals(linked)))
    found = validate.union([
        validate.commenter_rules(d.commenters),
        validate.submission_rules(assemble.public_submissions(d.submissions), d.commenters),
        validate.position_rules(positions, d.submissions),
        validate.count_rules(per_question),
        validate.gap_rules(gaps, positions, d.commenters),
        validate.summary_rules(metrics, positions, d.submissions),
        validate.card_rules(cards),
    ])
    return found.groupBy("rule").agg(F.count("*").alias("n"))


@docket_query
def analysis_violations(d):
    """Rules on published analyses, with faults put in by question."""
    number = vocab.question_number(F.col("question_id"))
    # One row per question, read by every rule: kept instead of recomputed.
    analyses = cut_lineage(_published(d)).withColumns({
        "status": F.when(number == 4, F.lit("draft")).otherwise(F.col("status")),
        "saying": F.when(number == 7, F.lit("The market — decides")).otherwise(F.col("saying")),
        "evidence_position_ids": F.when(number == 8, F.array(F.lit("p-gone"))).otherwise(F.col("evidence_position_ids")),
    })
    return validate.analysis_rules(analyses, assemble.public_positions(d.linked), d.questions).select(
        "rule", "severity", "entity", "entity_id", "detail"
    )


# --- run metrics ------------------------------------------------------------

@query
def run_cost(spark, sf_dir):
    """Usage and cost of scorer calls, from the event log."""
    metrics = src.table(spark, sf_dir, "events").selectExpr(
        "event_type AS stage", "concat('model-', user_id % 3) AS model", "value",
        "cast(get_json_object(props, '$.k') AS bigint) AS k",
    ).groupBy("stage", "model").agg(
        F.count("*").alias("llm_calls"), F.count_if(F.col("k") > 90).alias("retries"), F.sum("k").alias("input_tokens"),
        (F.sum("k") * 2).alias("output_tokens"), (F.sum("k") * 4).alias("cache_read_tokens"),
        F.lit(0).cast("bigint").alias("cache_write_tokens"), F.lit(1.25).alias("elapsed_seconds"),
    )
    prices = spark.createDataFrame(
        [("model-0", 5.0, 25.0, 0.5, 6.25), ("model-1", 1.0, 5.0, 0.1, 1.25)],
        "model string, input double, output double, cache_read double, cache_write double",
    )
    costs = stats.stage_costs(metrics, prices)
    totals = stats.run_totals(costs).select(F.lit("all").alias("stage"), F.lit(None).cast("string").alias("model"), *costs.columns[2:])
    return costs.unionByName(totals)
