"""The TPC-H-style tables seen as a comment docket.

orders are submissions, customers their authors, lineitems the positions taken
in them, parts supply issues and response types.  Documents and conversations
supply running text.  The same mapping is written in SQL in
``colloquy.plans.oracle``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from colloquy import vocab
from colloquy.operators import skew

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
STANCE_OF_FLAGS = {
    "RF": "support",
    "RO": "support_with_modification",
    "AF": "oppose",
    "AO": "mixed",
    "NF": "unclear",
    "NO": "support_with_modification",
}
RESPONSE_OF_PART = {
    "STANDARD": "direct_answer",
    "MEDIUM": "recommendation",
    "PROMO": "concern",
    "LARGE": "proposed_criterion",
    "SMALL": "evidence_suggestion",
    "ECONOMY": "no_clear_answer",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan over all cores when it has fewer splits than cores, as one
    small file has.  A large table has more splits and is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _pick(values, index: str) -> str:
    """The ``index``-th (0-based) of a closed list, in SQL."""
    return f"element_at({vocab.sql_array(values)}, cast(({index}) + 1 AS int))"


def _lookup(mapping: dict, key: str) -> str:
    return f"try_element_at({vocab.sql_map(mapping)}, {key})"


def questions(spark: SparkSession) -> DataFrame:
    labels = list(vocab.ISSUES.values())
    topic = _pick(labels, f"(question_number - 1) % {len(labels)}")
    return vocab.questions_frame(spark).selectExpr(
        "*",
        f"concat('Topic ', question_number, ': ', {topic}) AS short_title",
        f"array(theme, lower({topic})) AS tags",
        "true AS has_tension_block",
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per submission before any exclusion, with the author's identity."""
    kind = _pick(
        vocab.STAKEHOLDER_TYPES,
        f"(array_position({vocab.sql_array(SEGMENTS)}, c_mktsegment) - 1) * 2 + c_nationkey % 2",
    )
    orders = spread(table(spark, sf_dir, "orders"))
    customer = table(spark, sf_dir, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey, "left").selectExpr(
        "cast(o_orderkey AS string) AS comment_id",
        "o_orderstatus = 'P' AND o_orderkey % 7 = 0 AS withdrawn",
        "o_totalprice >= 10000 AS usable",
        "NOT (o_orderpriority = '4-NOT SPECIFIED' AND o_orderkey % 3 = 0) AS analyzed",
        "c_custkey IS NOT NULL AS identified",
        "CASE WHEN o_custkey % 5 = 0 THEN '' WHEN o_orderkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS organization",
        "'' AS display_name",
        f"coalesce({kind}, 'other') AS stakeholder_type",
        "cast(cast(o_orderdate AS date) AS string) AS received_date",
        "cast(date_add(cast(o_orderdate AS date), 2) AS string) AS posted_date",
        "concat('https://example.org/comment/', o_orderkey) AS source_url",
        "CASE WHEN o_orderkey % 4 = 0 THEN array('a.txt') ELSE cast(array() AS array<string>) END AS attachment_urls",
    )


def analysis_positions(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """One row per position before any filter.  ``together`` deals the rows out by
    ``comment_id`` before their texts are made, so that grouping by it shuffles none."""
    line = table(spark, sf_dir, "lineitem")
    rows = line.count()
    line = spread(skew.dealt_by_size(line, rows, "l_partkey"))
    part = table(spark, sf_dir, "part")
    given = line.join(part, line.l_partkey == part.p_partkey, "left").selectExpr("cast(l_orderkey AS string) AS comment_id", "*")
    if together:
        dealt = skew.dealt_by_size(given, rows, "comment_id")
        given = given.repartition("comment_id") if dealt is given else dealt
    n = vocab.N_QUESTIONS
    quantity = "cast(l_quantity AS int)"
    brand = "cast(substring(p_brand, 7) AS int)"
    tags = ", ".join(_pick(vocab.GAPS, f"(l_suppkey + {step}) % {len(vocab.GAPS)}") for step in (0, 2, 5))
    issues = len(vocab.ISSUES)
    return given.selectExpr(
        "comment_id",
        "concat_ws('-', lpad(cast(l_linenumber AS string), 2, '0'), l_partkey, l_suppkey, "
        "cast(cast(l_shipdate AS date) AS string)) AS segment_id",
        f"CASE WHEN l_partkey % {n} = l_suppkey % {n} THEN array(concat('q', l_partkey % {n} + 1)) "
        f"ELSE array(concat('q', least(l_partkey % {n}, l_suppkey % {n}) + 1), "
        f"concat('q', greatest(l_partkey % {n}, l_suppkey % {n}) + 1)) END AS question_ids",
        f"{_lookup(STANCE_OF_FLAGS, 'concat(l_returnflag, l_linestatus)')} AS position",
        f"{_pick(vocab.CONFIDENCE, f'{quantity} % 3')} AS confidence",
        f"{_pick(vocab.ISSUES, f'{brand} % {issues}')} AS primary_issue",
        f"CASE WHEN {quantity} % 5 = 0 THEN NULL ELSE {_pick(vocab.ISSUES, f'({brand} + 3) % {issues}')} END AS secondary_issue",
        f"CASE WHEN p_size % 10 = 0 THEN NULL ELSE {_lookup(RESPONSE_OF_PART, 'p_type')} END AS response_type",
        "concat('worry about ', p_name) AS stakeholder_concern",
        "concat('act on ', p_name) AS requested_fda_action",
        f"slice(array({tags}), 1, {quantity} % 4) AS gap_tags",
        f"CASE WHEN {quantity} = 50 THEN '' ELSE concat('Asks for a ', p_name, ' rule of size ', p_size, '.') END AS public_summary",
        "concat('We ask the agency for a ', p_name, ' rule, item ', l_linenumber, '.') AS source_passage",
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def segment_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found passages in order: the lines of each document."""
    n = vocab.N_QUESTIONS
    lines = documents(spark, sf_dir).selectExpr("doc_id", "posexplode(split(text, '\\n', -1)) AS (ord, line)")
    return lines.selectExpr(
        "cast(doc_id AS string) AS comment_id",
        "cast(ord AS bigint) AS ord",
        f"array(concat('q', (doc_id + ord) % 30), concat('q', (doc_id * 7 + ord) % {n} + 1)) AS question_ids",
        "line AS source_passage",
        "substring(line, 1, 40) AS position_gist",
        "(doc_id + ord) % 11 = 0 AS is_background_only",
    )


LANG_STANCE = {"en": "support", "fr": "oppose", "de": "mixed", "es": "support_with_modification"}


def passage_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions with running text: the lines of each document, which repeat
    and vary within a document as points do within a submission."""
    from pyspark.sql import functions as F

    from colloquy.functions import text as T

    n = vocab.N_QUESTIONS
    lines = (
        documents(spark, sf_dir)
        .selectExpr("doc_id", "lang", "posexplode(split(text, '\\n', -1)) AS (ord, line)")
        .filter(f"length(line) >= {vocab.MIN_PASSAGE_CHARS}")
    )
    tags = ", ".join(_pick(vocab.GAPS, f"(length(line) + {step}) % {len(vocab.GAPS)}") for step in (0, 2, 5))
    rows = lines.selectExpr(
        "cast(doc_id AS string) AS submission_id",
        "concat('seg-', lpad(cast(ord + 1 AS string), greatest(3, length(cast(ord + 1 AS string))), '0')) AS segment_id",
        f"array(concat('q', doc_id % {n} + 1), concat('q', length(line) % {n} + 1)) AS question_ids",
        f"coalesce({_lookup(LANG_STANCE, 'lang')}, 'unclear') AS position",
        f"{_pick(vocab.CONFIDENCE, 'ord % 3')} AS confidence",
        f"slice(array({tags}), 1, cast(ord % 4 AS int)) AS gap_tags",
        "line AS source_passage",
    )
    return rows.select(
        "submission_id", "segment_id", F.array_distinct("question_ids").alias("question_ids"), "position", "confidence",
        "gap_tags", F.map_from_entries(F.transform("gap_tags", lambda t: F.struct(t, F.concat("segment_id", F.lit(" on "), t))))
        .alias("gap_explanations"),
        T.sentence_cut(F.col("source_passage"), vocab.SUMMARY_MAX_WORDS).alias("public_summary"), "source_passage",
    )


def scored_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with a scorer's raw answer, valid and invalid values mixed."""
    line = spread(table(spark, sf_dir, "lineitem"))
    part = table(spark, sf_dir, "part")
    n, issues, gaps = vocab.N_QUESTIONS, len(vocab.ISSUES), len(vocab.GAPS)
    quantity = "cast(l_quantity AS int)"
    brand = "cast(substring(p_brand, 7) AS int)"
    gap = _pick(vocab.GAPS, f"l_suppkey % {gaps}")
    other = _pick(vocab.GAPS, f"l_partkey % {gaps}")
    third = _pick(vocab.GAPS, f"(l_partkey + 4) % {gaps}")
    fourth = _pick(vocab.GAPS, f"(l_partkey + 6) % {gaps}")
    primary = f"CASE WHEN p_size % 7 = 0 THEN 'bogus' ELSE {_pick(vocab.ISSUES, f'{brand} % {issues}')} END"
    return line.join(part, line.l_partkey == part.p_partkey, "left").selectExpr(
        "cast(l_orderkey AS string) AS comment_id",
        "concat_ws('-', lpad(cast(l_linenumber AS string), 2, '0'), l_partkey, l_suppkey, "
        "cast(cast(l_shipdate AS date) AS string)) AS segment_id",
        f"array(concat('q', l_suppkey % {n} + 1)) AS question_ids",
        "concat('passage about ', p_name) AS source_passage",
        "named_struct("
        f"'question_ids', CASE WHEN {quantity} % 4 = 0 THEN array('q0', 'x') ELSE "
        f"array(concat('q', l_partkey % 30), concat('q', l_suppkey % {n} + 1)) END, "
        f"'position', {_lookup(STANCE_OF_FLAGS, 'concat(l_returnflag, l_linestatus)')}, "
        f"'primary_issue', {primary}, "
        f"'secondary_issue', {_pick(vocab.ISSUES, f'({brand} + {quantity} % 2) % {issues}')}, "
        "'stakeholder_concern', concat('  ', p_name, ' '), "
        "'requested_fda_action', cast(NULL AS string), "
        "'confidence', cast(NULL AS string), "
        f"'gap_tags', array({gap}, 'bogus', {gap}, {other}, {third}, {fourth}), "
        f"'gap_explanations', array(named_struct('gap', {gap}, 'explanation', 'first'), "
        f"named_struct('gap', {gap}, 'explanation', p_name)), "
        f"'public_summary', concat('\"', repeat(concat(p_name, ' notes. '), {quantity}), '\"')) AS scored",
    )
