"""Registered queries on running text, passages and labels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from colloquy import vocab
from colloquy.functions import text as T
from colloquy.operators import consolidate, labels, segments
from colloquy.plans.catalog import docket_query, query, show_list, show_map
from colloquy.sources import comments, driver_tables as src


def _digest(spark, sf_dir, column):
    """Length and digest of a transformed text, so results stay small."""
    return src.documents(spark, sf_dir).select("doc_id", column.alias("t")).select(
        "doc_id", F.length("t").cast("bigint").alias("chars"), F.md5("t").alias("digest")
    )


@query
def text_normalize(spark, sf_dir):
    return _digest(spark, sf_dir, T.normalize(F.replace("text", F.lit("\n"), F.lit(" \t\r\n\r\n\n"))))


@query
def usable_text(spark, sf_dir):
    body = F.when(F.col("doc_id") % 10 == 0, F.lit("Please see attached file.")).otherwise(F.col("text"))
    whole = F.when(F.col("doc_id") % 20 == 0, F.concat(body, F.lit("\n\n"), F.col("text"))).otherwise(body)
    return src.documents(spark, sf_dir).select("doc_id", T.is_usable(body, whole).alias("usable"))


@query
def content_hash(spark, sf_dir):
    return src.documents(spark, sf_dir).select(
        "doc_id", T.content_hash(F.col("text")).alias("content_hash"),
        T.content_hash(F.col("source"), F.col("text")).alias("sourced_hash"),
    )


@query
def word_count(spark, sf_dir):
    return src.documents(spark, sf_dir).select("doc_id", T.word_count(F.col("text")).cast("bigint").alias("words"))


@query
def sentence_cut(spark, sf_dir):
    return src.documents(spark, sf_dir).select(
        "doc_id", T.sentence_cut(F.col("text"), vocab.SUMMARY_MAX_WORDS).alias("summary"),
        (T.word_count(F.col("text")) > vocab.SUMMARY_MAX_WORDS).alias("cut"),
    )


@query
def passage_key(spark, sf_dir):
    return src.documents(spark, sf_dir).select("doc_id", T.passage_key(F.col("text")).alias("passage_key"))


@query
def match_norm(spark, sf_dir):
    return _digest(spark, sf_dir, T.match_norm(F.col("text")))


@query
def slug(spark, sf_dir):
    return src.documents(spark, sf_dir).select("doc_id", T.slug(F.col("text")).alias("slug"))


@query
def text_cleanup(spark, sf_dir):
    """Literal escapes and dashes are put in first, so there is work to do."""
    marked = F.replace(F.replace("text", F.lit(", "), F.lit(" \\u2014 ")), F.lit("; "), F.lit(" – "))
    return src.documents(spark, sf_dir).select("doc_id", marked.alias("m")).select(
        "doc_id", F.md5(T.clean_text(F.col("m"))).alias("digest"), T.has_broken_escapes(F.col("m")).alias("broken")
    )


@query
def chunk_plan(spark, sf_dir):
    texts = src.documents(spark, sf_dir).select(F.col("doc_id").alias("comment_id"), "text")
    return segments.chunk_plan(texts).select(
        F.col("comment_id").alias("doc_id"), F.col("chunk_index").cast("bigint").alias("chunk_index"),
        F.col("chunk_total").cast("bigint").alias("chunk_total"), F.col("start").cast("bigint").alias("start"),
        F.md5("chunk").alias("digest"),
    )


@query
def txt_decode(spark, sf_dir):
    """Texts encoded two ways, read back without being told which."""
    content = F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(F.encode("text", "UTF-16"))
    files = src.documents(spark, sf_dir).select(
        "doc_id", F.concat(F.lit("/in/"), "doc_id", F.when(F.col("doc_id") % 7 == 0, F.lit(".pdf")).otherwise(F.lit(".TXT")))
        .alias("path"), content.alias("content"),
    )
    return comments.extract_text(files).select("doc_id", "status", F.md5("text").alias("digest"), "error")


@query
def assembled_text(spark, sf_dir):
    talk = src.table(spark, sf_dir, "conversations")
    bodies = talk.filter("turn = 0").select(F.col("conv_id").alias("comment_id"), F.col("text").alias("body"))
    files = talk.filter("turn > 0").select(
        F.col("conv_id").alias("comment_id"), F.col("turn").alias("ord"), F.col("turn").cast("string").alias("id"),
        F.when(F.col("turn") % 2 == 0, F.lit("")).otherwise(F.col("role")).alias("title"),
        F.when(F.col("turn") % 5 == 4, F.lit("error")).otherwise(F.lit("ok")).alias("status"), "text",
    )
    return comments.assembled_text(bodies, files).select(
        "comment_id", F.md5("text").alias("digest"), "content_hash", F.col("body_chars").cast("bigint").alias("body_chars"),
        F.col("total_chars").cast("bigint").alias("total_chars"), "usable", "exclusion_reason",
    )


@query
def attachment_flatten(spark, sf_dir):
    pages = src.table(spark, sf_dir, "pages")
    included = F.expr(
        "array(named_struct('type', if(page_id % 7 = 0, 'users', 'attachments'), 'id', concat('a', page_id), 'title', url, 'fileFormats', array("
        "named_struct('format', 'PDF', 'size', cast(length(html) AS bigint), 'fileUrl', concat(url, '/f.PDF')), "
        "named_struct('format', cast(NULL AS string), 'size', cast(NULL AS bigint), 'fileUrl', concat(url, '/g.DocX')), "
        "named_struct('format', 'txt', 'size', 1L, 'fileUrl', CASE WHEN page_id % 3 = 0 THEN NULL ELSE url END))))"
    )
    rows = comments.attachment_rows(pages.select(F.col("page_id").cast("string").alias("comment_id"), included.alias("included")))
    return rows.select("comment_id", "attachment_id", "title", "format", "size", "file_url", "extension", "local_path")


# --- passages ---------------------------------------------------------------

@query
def segment_dedupe(spark, sf_dir):
    return segments.merge_passages(src.segment_stream(spark, sf_dir)).select(
        "comment_id", "first_ord", show_list("question_ids").alias("question_ids"),
        F.md5("source_passage").alias("digest"), "position_gist",
    )


@query
def segment_ids(spark, sf_dir):
    return segments.segments(src.segment_stream(spark, sf_dir)).select(
        "comment_id", "segment_id", show_list("question_ids").alias("question_ids"), F.md5("source_passage").alias("digest")
    )


@docket_query
def stakeholder_coercion(d):
    told = F.when(F.col("comment_id").cast("bigint") % 3 == 0, F.lit("martian")).otherwise(F.col("stakeholder_type"))
    return d.candidates.select(told.alias("told")).groupBy(
        segments.coerce_stakeholder(F.col("told")).alias("stakeholder_type")
    ).agg(F.count("*").alias("n"))


# --- labels -----------------------------------------------------------------

@query
def analysis_coercion(spark, sf_dir):
    return labels.coerce_analysis(src.scored_segments(spark, sf_dir)).select(
        "comment_id", "segment_id", show_list("question_ids").alias("question_ids"), "primary_issue", "secondary_issue",
        "stakeholder_concern", "requested_fda_action", "confidence", show_list("gap_tags").alias("gap_tags"),
        show_map("gap_explanations").alias("gap_explanations"), "public_summary", "summary_cut",
    )


@query
def summary_limit(spark, sf_dir):
    limited = T.limit_words(T.strip_quotes(F.col("text")), vocab.CLAIM_MAX_WORDS)
    return src.documents(spark, sf_dir).select("doc_id", limited.alias("s")).select(
        "doc_id", F.md5("s.text").alias("digest"), F.col("s.cut").alias("cut")
    )


def _label_answers(spark, sf_dir):
    """Answers for most segments: some unknown types, some given twice."""
    scored = src.analysis_positions(spark, sf_dir).select("comment_id", "segment_id", "response_type", "confidence")
    line = F.substring("segment_id", 1, 2).cast("int")
    first = scored.filter(line % 3 != 0).select("comment_id", "segment_id", "response_type", F.lit(1).alias("ord"))
    second = scored.filter(line % 4 == 0).select(
        "comment_id", "segment_id",
        F.when(F.col("confidence") == "low", F.lit("bogus")).otherwise(F.lit("concern")).alias("response_type"),
        F.lit(2).alias("ord"),
    )
    return first.unionByName(second)


@query
def label_fill(spark, sf_dir):
    return labels.fill_response_types(src.analysis_positions(spark, sf_dir), _label_answers(spark, sf_dir))


@query
def answer_parsing(spark, sf_dir):
    """JSON answers, a third of them in a code fence, some cut short."""
    raw = F.col("props")
    answer = (
        F.when(F.col("event_id") % 5 == 0, F.substring(raw, F.lit(1), F.length(raw) - 2))
        .when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), raw, F.lit("\n```")))
        .otherwise(raw)
    )
    events = src.table(spark, sf_dir, "events").select("event_id", answer.alias("answer"))
    return labels.parse_answers(events, "struct<k:bigint>").select("event_id", F.col("parsed.k").alias("k"), "malformed")


@docket_query
def label_representations(d):
    return d.analysis.select(
        "comment_id", "segment_id", F.md5(labels.represent("compact")).alias("compact"),
        F.md5(labels.represent("summary")).alias("summary"), F.md5(labels.represent("full")).alias("full"),
    )


@docket_query
def touching_questions(d):
    return labels.touching(d.analysis, ["q1", "q13"]).select("comment_id", "segment_id")


def length_scorer(batch: pd.DataFrame) -> pd.DataFrame:
    """A stand-in scorer: the type follows from the length of the summary."""
    types = ["direct_answer", "recommendation", "concern"]
    kinds = batch.public_summary.str.len() % len(types)
    return pd.DataFrame({
        "comment_id": batch.comment_id, "segment_id": batch.segment_id, "response_type": kinds.map(lambda k: types[k]),
    })


@docket_query
def scored_rows(d):
    rows = d.analysis.select("comment_id", "segment_id", "public_summary")
    return labels.label_rows(rows, length_scorer, "comment_id string, segment_id string, response_type string")


# --- near-duplicates --------------------------------------------------------

@query
def dup_candidate_counts(spark, sf_dir):
    return consolidate.candidate_counts(src.passage_positions(spark, sf_dir))


def _members(positions, rules):
    return consolidate.cluster_members(consolidate.near_duplicate_links(positions, rules))


def _root_segment(members):
    return members.select("submission_id", "segment_id", F.element_at(F.split("root", "\n"), 2).alias("root_segment"))


@query
def dup_passage_clusters(spark, sf_dir):
    return _root_segment(_members(src.passage_positions(spark, sf_dir), ("passage",)))


@query
def dup_clusters(spark, sf_dir):
    return _root_segment(_members(src.passage_positions(spark, sf_dir), ("passage", "summary")))


@query
def dup_survivors(spark, sf_dir):
    positions = src.passage_positions(spark, sf_dir)
    return consolidate.clusters(positions, _members(positions, ("passage",))).select(
        "submission_id", "kept_segment_id", "merged", show_list(vocab.mask_questions(F.col("mask"))).alias("question_ids"),
        "position",
    )


@query
def dup_merged(spark, sf_dir):
    positions = src.passage_positions(spark, sf_dir)
    return consolidate.consolidate(positions, _members(positions, ("passage",))).select(
        "submission_id", "segment_id", show_list("question_ids").alias("question_ids"), show_list("gap_tags").alias("gap_tags"),
        show_map("gap_explanations").alias("gap_explanations"),
    )


@query
def dup_provenance(spark, sf_dir):
    positions = src.passage_positions(spark, sf_dir)
    members = _members(positions, ("passage",))
    return consolidate.merged_segments(members, consolidate.clusters(positions, members))


@query
def dup_evidence(spark, sf_dir):
    positions = src.passage_positions(spark, sf_dir)
    links = consolidate.near_duplicate_links(positions)
    return consolidate.link_evidence(links, positions).withColumn("shared_question_ids", show_list("shared_question_ids"))


@query
def consolidation_counts(spark, sf_dir):
    positions = src.passage_positions(spark, sf_dir)
    return consolidate.consolidation_counts(consolidate.clusters(positions, _members(positions, ("passage",))))
