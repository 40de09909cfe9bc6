"""Evidence guards: what a generated claim may say, given the record.

A claim about a question is kept only as far as positions on that question
support it.  Claims are few (one per question); the positions behind them are
many, so every rule reduces the positions by aggregation before it meets the
claim.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from colloquy import vocab
from colloquy.functions import text as T
from colloquy.operators import stats
from colloquy.session import stored

STRINGS = "array<string>"
UNSUPPORTED_NOTE = "Too few commenters on each side to compare groups on this question so far."


def tidy(text: Column) -> Column:
    return T.clean_text(T.strip_quotes(text))


def cited_ids(claims: DataFrame, rows: DataFrame) -> DataFrame:
    """Every position id a claim cites that is on its question, with its
    commenter: ``side`` numbers the sides, -1 marks evidence.  One join serves
    sides and evidence; claims are few, positions are not, and what is cited is
    written first: Spark then knows its size before it would shuffle positions."""
    sides = claims.select("question_id", F.posexplode("disagreement.sides").alias("side", "s")).select(
        "question_id", "side", F.col("s.summary").alias("summary"), F.posexplode("s.position_ids").alias("at", "position_id")
    )
    evidence = claims.select(
        "question_id", F.lit(-1).alias("side"), F.lit(None).cast("string").alias("summary"),
        F.posexplode("evidence_position_ids").alias("at", "position_id"),
    )
    cited = stored(sides.unionByName(evidence), "cited")
    return rows.select("question_id", "position_id", "commenter_id").join(cited, ["question_id", "position_id"])


def citations(found: DataFrame) -> DataFrame:
    """Per question: ``sides`` with their ids and distinct commenters, the same
    ids flat as ``sided``, and the ``given`` evidence, all in claimed order.  Sides without an id on
    the question are gone."""
    per_side = found.groupBy("question_id", "side").agg(
        F.first("summary").alias("summary"),
        F.array_sort(F.collect_list(F.struct("at", "position_id", "commenter_id"))).alias("cited"),
        F.array_sort(F.collect_set("commenter_id")).alias("commenter_ids"),
    )
    pairs = F.transform("cited", lambda c: F.struct(
        c["position_id"].alias("position_id"), c["commenter_id"].alias("commenter_id")
    ))
    side = F.struct(
        "side",
        tidy_side("summary").alias("summary"),
        F.transform("cited", lambda c: c["position_id"]).alias("position_ids"),
        "commenter_ids",
    )
    sided = F.transform("cited", lambda c: F.struct(
        F.col("side").alias("side"), c["position_id"].alias("position_id"), c["commenter_id"].alias("commenter_id")
    ))
    return per_side.groupBy("question_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("side") >= 0, side))).alias("sides"),
        F.flatten(F.array_sort(F.collect_list(F.when(F.col("side") >= 0, sided)))).alias("sided"),
        F.first(F.when(F.col("side") < 0, pairs), ignorenulls=True).alias("given"),
    )


def resolved_sides(claims: DataFrame, rows: DataFrame) -> DataFrame:
    """Sides of each claimed disagreement, reduced to ids on the question."""
    return citations(cited_ids(claims, rows)).select("question_id", "sides")


def tidy_side(summary: str) -> Column:
    return T.clean_text(T.strip(F.coalesce(summary, F.lit(""))))


def disagreement_supported(sides: str = "sides") -> Column:
    """At least two sides and two commenters, neither of the first two sides
    within the other."""
    s = F.col(sides)
    first, second = F.try_element_at(s, F.lit(1))["commenter_ids"], F.try_element_at(s, F.lit(2))["commenter_ids"]
    everyone = F.array_distinct(F.flatten(F.transform(s, lambda x: x["commenter_ids"])))
    return F.coalesce(
        (F.size(s) >= 2) & (F.size(everyone) >= 2)
        & (F.size(F.array_except(first, second)) > 0) & (F.size(F.array_except(second, first)) > 0),
        F.lit(False),
    )


def fill_candidates(rows: DataFrame) -> DataFrame:
    """Per question, the rows evidence can be filled from: the first few by
    rank, and the first rows of the first few commenters.  Both are top-k by
    window, which Spark limits per task before the shuffle."""
    rank = F.struct(
        (F.coalesce("response_type", F.lit("")) == "no_clear_answer").alias("late"), F.col("position_id").alias("position_id")
    )
    k = vocab.MAX_EVIDENCE
    ranked = rows.select("question_id", "commenter_id", rank.alias("rank"))
    order = Window.partitionBy("question_id").orderBy("rank")
    top = ranked.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).drop("n")
    firsts = ranked.groupBy("question_id", "commenter_id").agg(F.min("rank").alias("rank"))
    first = firsts.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).drop("n")
    both = top.unionByName(first.select(top.columns)).distinct()
    listed = F.array_sort(F.collect_list(F.struct("rank", "commenter_id")))
    return both.groupBy("question_id").agg(
        F.transform(listed, lambda r: F.struct(r["rank"]["position_id"].alias("position_id"), r["commenter_id"].alias("commenter_id")))
        .alias("fill")
    )


def choose(given, sides, fill, n_commenters, limit=vocab.MAX_EVIDENCE, least=vocab.MIN_EVIDENCE):
    """Evidence for one claim: ids in order, and whether any had to be added.

    ``given`` and ``fill`` are (id, commenter) pairs, ``sides`` lists of them.
    Places for one id of each side, and for a second commenter, are set aside
    first; given ids take the rest in their order."""
    commenter = dict(fill) | dict(given) | {p: c for side in sides for p, c in side}
    given_ids = list(dict.fromkeys(p for p, _ in given))
    required = []
    for side in sides:
        ids = [p for p, _ in side]
        if not any(p in required for p in ids):
            required.append(next((p for p in given_ids if p in ids), ids[0]))
    required = required[:limit]
    need = min(2, n_commenters)
    if need == 2 and len({commenter[p] for p in required} | {commenter[p] for p in given_ids}) >= 2:
        # The second commenter is among the ids at hand: keep a place for it.
        seen = {commenter[p] for p in required}
        for p in given_ids:
            if len(seen) >= 2 or len(required) >= limit:
                break
            if p not in required and commenter[p] not in seen:
                required.append(p)
                seen.add(commenter[p])
    spare = limit - len(required)
    if len({commenter[p] for p in required + given_ids}) < need:
        spare -= 1
    kept = [p for p in given_ids if p not in required][:max(spare, 0)]
    chosen = [p for p in given_ids if p in required or p in kept] + [p for p in required if p not in given_ids]
    filled = False
    for p, c in fill:
        seen = {commenter[x] for x in chosen}
        if (len(chosen) >= least and len(seen) >= need) or len(chosen) >= limit:
            break
        if p not in chosen and (len(chosen) < least or c not in seen):
            chosen.append(p)
            filled = True
    return chosen, filled


_CHOSEN = StructType([StructField("ids", ArrayType(StringType())), StructField("filled", BooleanType())])


@F.pandas_udf(_CHOSEN)
def _choose(given: pd.Series, sided: pd.Series, fill: pd.Series, n: pd.Series) -> pd.DataFrame:
    def listed(items):
        return items if items is not None else []

    def pairs(items):
        return [(x["position_id"], x["commenter_id"]) for x in listed(items)]

    def by_side(items):
        sides = {}
        for x in listed(items):
            sides.setdefault(x["side"], []).append((x["position_id"], x["commenter_id"]))
        return [sides[k] for k in sorted(sides)]

    out = [choose(pairs(g), by_side(s), pairs(f), int(k)) for g, s, f, k in zip(given, sided, fill, n)]
    return pd.DataFrame(out, columns=["ids", "filled"])


#: What a guard reads of question rows, besides the question.
GUARDED = ("position_id", "commenter_id", "stakeholder_type", "submission_id", "response_type", "stance")


def guard(claims: DataFrame, rows: DataFrame, rollup: DataFrame | None = None, written: bool = False) -> DataFrame:
    """Claims after all guards, one row per claimed question, with the counts
    behind them, ``quality_flags`` and ``downgrades``.  ``rollup``: the
    ``commenter_rollup`` of the rows, where it is at hand; ``written``: the rows
    lie written, so that reading them again costs no joins."""
    asked = stored(claims.select("question_id").distinct(), "asked")
    # Facts, citations and fill all read these rows: their narrow columns are written once.
    on_claimed = rows.join(asked, "question_id", "left_semi").select("question_id", *GUARDED)
    on_claimed = on_claimed if written else stored(on_claimed, "claimed")
    joined = (
        claims.join(stats.question_facts(on_claimed) if rollup is None else stats.rolled_up_facts(rollup), "question_id", "left")
        .join(citations(cited_ids(claims, on_claimed)), "question_id", "left")
        .join(fill_candidates(on_claimed), "question_id", "left")
    )
    limit = vocab.CLAIM_MAX_WORDS
    zero = F.lit(0).cast("bigint")
    known_topic = F.slice(
        F.filter(F.coalesce("disagreement.about", F.array().cast(STRINGS)), lambda t: vocab.is_known(vocab.DISAGREEMENT_TOPICS, t)), 1, 3
    )
    claimed = F.coalesce("disagreement.exists", F.lit(False))
    step = joined.withColumns({
        "n_commenters": F.coalesce("distinct_commenters", zero),
        "said": T.limit_words(tidy(F.col("saying")), limit),
        "argued": T.limit_words(tidy(F.col("disagreement.text")), limit),
        "about": known_topic,
        "sides": F.coalesce("sides", F.array().cast(
            "array<struct<side:int,summary:string,position_ids:array<string>,commenter_ids:array<string>>>"
        )),
        "known_type": vocab.is_known(vocab.RESPONSE_TYPES, F.col("dominant_response_type")),
        "claimed_disagreement": claimed,
    }).withColumn("exists", F.col("claimed_disagreement") & disagreement_supported())
    unsupported = F.col("claimed_disagreement") & ~F.col("exists")
    topics = F.coalesce(
        F.nullif(F.array_join(F.transform("about", lambda t: F.lower(vocab.label(vocab.DISAGREEMENT_TOPICS, t))), ", "), F.lit("")),
        F.lit("how to apply the approach"),
    )
    groups = F.filter(F.coalesce("stakeholder_divide.groups", F.array().cast(STRINGS)),
                      lambda g: vocab.is_known(vocab.STAKEHOLDER_TYPES, g))
    comparable = F.coalesce("comparable_groups", F.array().cast(STRINGS))
    divide_claimed = F.coalesce("stakeholder_divide.claimed", F.lit(False))
    divide = (
        divide_claimed & F.col("exists") & (F.size(groups) >= 2)
        & F.forall(groups, lambda g: F.array_contains(comparable, g))
        & F.forall("sides", lambda s: F.size(s["commenter_ids"]) >= vocab.MIN_COMMENTERS_PER_SIDE)
    )
    step = step.withColumns({
        "divide": divide,
        "divide_claimed": divide_claimed,
        "groups": groups,
        "evidence": _choose(
            F.col("given"), F.when(F.col("exists"), F.col("sided")), F.col("fill"), F.col("n_commenters")
        ),
        "text": F.when(unsupported, F.concat(
            F.lit("No material disagreement between distinct commenters is on record so far; the debate concerns "),
            topics, F.lit("."),
        )).otherwise(F.col("argued.text")),
    })
    flags = F.concat(
        F.array_compact(F.array(F.when(F.col("said.cut"), F.lit("saying_cut_at_sentence")))),
        T.phrase_flags(F.col("said.text"), F.col("n_commenters")),
        F.array_compact(F.array(F.when(F.col("argued.cut"), F.lit("disagreement_cut_at_sentence")))),
    )
    downgrades = F.array_compact(F.array(
        F.when(~F.col("known_type"), F.lit("dominant_response_type_recomputed")),
        F.when(unsupported, F.lit("disagreement_unsupported")),
        F.when(F.col("divide_claimed") & ~F.col("divide"), F.lit("stakeholder_divide_unsupported")),
        F.when(F.col("evidence.filled"), F.lit("evidence_filled")),
    ))
    shown_sides = F.when(F.col("exists"), F.transform("sides", lambda s: F.struct(
        s["summary"].alias("summary"), s["position_ids"].alias("position_ids"), s["commenter_ids"].alias("commenter_ids")
    ))).otherwise(F.array().cast("array<struct<summary:string,position_ids:array<string>,commenter_ids:array<string>>>"))
    return step.select(
        "question_id",
        F.col("said.text").alias("saying"),
        F.when(F.col("known_type"), F.col("dominant_response_type")).otherwise(
            F.coalesce(stats.dominant_of("by_distinct_commenters"), F.lit("no_clear_answer"))
        ).alias("dominant_response_type"),
        F.struct(F.coalesce("by_distinct_commenters", F.create_map().cast("map<string,bigint>")).alias("by_distinct_commenters"),
                 F.coalesce("by_positions", F.create_map().cast("map<string,bigint>")).alias("by_positions"))
        .alias("response_type_distribution"),
        F.struct(F.col("exists"), F.col("about"), F.col("text"), shown_sides.alias("sides")).alias("disagreement"),
        F.struct(
            F.col("divide").alias("exists"),
            F.when(F.col("divide"), F.col("groups")).otherwise(F.array().cast(STRINGS)).alias("groups"),
            F.when(F.col("divide"), tidy_side("stakeholder_divide.text")).otherwise(F.lit("")).alias("text"),
            F.when(F.col("divide_claimed") & ~F.col("divide"), F.lit(UNSUPPORTED_NOTE)).alias("note"),
        ).alias("stakeholder_divide"),
        F.col("evidence.ids").alias("evidence_position_ids"),
        F.col("n_commenters").alias("distinct_commenters"),
        F.coalesce("distinct_submissions", zero).alias("distinct_submissions"),
        F.coalesce("positions", zero).alias("positions"),
        comparable.alias("comparable_groups"),
        flags.alias("quality_flags"),
        downgrades.alias("downgrades"),
    )


# --- inputs and published records -------------------------------------------

def position_lines(rows: DataFrame) -> DataFrame:
    """One text line per position on a question, as a scorer would read it."""
    group = F.coalesce(vocab.label(vocab.STAKEHOLDER_TYPES, F.col("stakeholder_type")), F.col("stakeholder_type"))
    line = F.concat_ws(
        " | ", "position_id",
        F.concat("commenter", F.lit(" ("), group, F.lit("; group id "), "stakeholder_type", F.lit(")")),
        F.concat(F.lit("response_type="), F.coalesce("response_type", F.lit("unknown"))),
        F.concat(F.lit("stance="), "stance"), F.concat(F.lit("issue="), "primary_issue"), "summary",
    )
    return rows.select("question_id", "position_id", F.lower("commenter").alias("reading_order"), line.alias("line"))


def input_fingerprint(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """Hash of everything a claim about a question is made from: the question's
    text (``short_title`` of ``questions``) and every position on it, with its
    commenter and submission.

    Row digests are summed, so the hash ignores row order, changes with any row
    and needs constant state per question instead of a list of its rows."""
    fields = ["position_id", "commenter_id", "submission_id", "commenter", "stakeholder_type", "response_type", "stance", "primary_issue", "summary"]
    row = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c), F.lit("\x1e")) for c in fields]))

    def part(start):
        return F.conv(F.substring(row, start, 15), 16, 10).cast("decimal(20,0)")

    sums = rows.groupBy("question_id").agg(
        F.count("*").alias("n"), F.sum(part(1)).alias("high"), F.sum(part(16)).alias("low")
    )
    asked = questions.select("question_id", F.md5(F.coalesce("short_title", F.lit(""))).alias("asked"))
    digest = F.concat_ws("|", "question_id", "asked", "n", F.col("high").cast("string"), F.col("low").cast("string"))
    return sums.join(asked, "question_id").select("question_id", T.content_hash(digest).alias("input_hash"))


def published(questions: DataFrame, rows: DataFrame, records: DataFrame, rollup: DataFrame | None = None) -> DataFrame:
    """One public record per question: generated, stale or pending.

    ``records`` are guarded claims with ``fresh``; ``rollup`` as in ``guard``.  Text is cleaned again, and
    commenter ids do not leave the sides.  ``broken`` marks text whose cleanup
    was lossy."""
    counts = (stats.commenter_rollup(rows) if rollup is None else rollup).groupBy("question_id").agg(
        F.count("*").alias("n_commenters"), F.sum("positions").alias("n_positions")
    )
    record = F.struct(*[F.col(c) for c in records.columns if c != "question_id"])
    joined = (
        questions.select("question_id", "question_number").join(counts, "question_id", "left")
        .join(records.select("question_id", record.alias("r")), "question_id", "left")
    )
    pending = F.col("r").isNull() | F.col("n_positions").isNull()
    status = F.when(pending, F.lit("pending")).when(F.col("r.fresh"), F.lit("generated")).otherwise(F.lit("stale"))
    zero = F.lit(0).cast("bigint")
    text = F.col("r.disagreement.text")

    def kept(column):
        return F.when(~pending, column)

    return joined.select(
        "question_id",
        "question_number",
        status.alias("status"),
        kept(T.clean_text(F.col("r.saying"))).alias("saying"),
        kept(F.col("r.dominant_response_type")).alias("dominant_response_type"),
        kept(F.struct(
            F.col("r.disagreement.exists"), F.col("r.disagreement.about"), T.clean_text(text).alias("text"),
            F.transform("r.disagreement.sides", lambda s: F.struct(
                T.clean_text(s["summary"]).alias("summary"), s["position_ids"].alias("position_ids")
            )).alias("sides"),
        )).alias("disagreement"),
        kept(F.col("r.stakeholder_divide")).alias("stakeholder_divide"),
        kept(F.col("r.evidence_position_ids")).alias("evidence_position_ids"),
        F.when(pending, F.coalesce("n_commenters", zero)).otherwise(F.col("r.distinct_commenters")).alias("distinct_commenters"),
        F.when(pending, F.coalesce("n_positions", zero)).otherwise(F.col("r.positions")).alias("positions"),
        (~pending & (T.has_broken_escapes(F.col("r.saying")) | T.has_broken_escapes(text))).alias("broken"),
    )


def report(questions: DataFrame, analyses: DataFrame, linked: DataFrame) -> DataFrame:
    """Evidence rows of every claim that is not pending, commenter attached."""
    cited = analyses.filter("status <> 'pending'").select(
        "question_id", "status", "saying", "dominant_response_type", "distinct_commenters",
        F.posexplode("evidence_position_ids").alias("at", "position_id"),
    )
    # Written, so that its size is known: positions nobody cites then leave before any join.
    wanted = stored(cited.select("position_id").distinct(), "wanted")
    facts = linked.select("position_id", "display_name", "stakeholder_type", "response_type", "public_summary").join(
        wanted, "position_id", "left_semi"
    )
    return cited.join(questions.select("question_id", "question_number", "short_title"), "question_id").join(
        facts, "position_id", "left"
    )
