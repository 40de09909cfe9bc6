"""Counts that keep commenters, submissions and positions apart.

The per-question figures all come from one roll-up.  A submission has one
commenter, so counting in three steps -- submission, commenter, question --
yields every distinct count with plain, map-side-combinable sums: no
``count(distinct)`` expansion, and no group larger than its partial results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy import vocab
from colloquy.functions import text as T

UNKNOWN = "unknown"
_TYPES = [*vocab.RESPONSE_TYPES, UNKNOWN]


def _counts(prefix: str, values, column: str) -> list[Column]:
    return [F.expr(f"count_if({column} <=> '{v}') AS {prefix}_{v}") for v in values]


def _sums(columns) -> list[Column]:
    return [F.expr(f"sum({c}) AS {c}") for c in columns]


#: What the roll-up reads of question rows, besides the question.
ROLLED_UP = ("commenter_id", "stakeholder_type", "submission_id", "response_type", "stance")


def commenter_rollup(rows: DataFrame) -> DataFrame:
    """One row per (question, commenter): submissions, positions, positions by
    stance and by response type.  Columns nobody reads are pruned by Catalyst."""
    per_submission = rows.groupBy("question_id", "commenter_id", "stakeholder_type", "submission_id").agg(
        F.count("*").alias("positions"),
        *_counts("stance", vocab.STANCES, "stance"),
        *_counts("type", _TYPES, f"coalesce(response_type, '{UNKNOWN}')"),
    )
    summed = ["positions", *[f"stance_{s}" for s in vocab.STANCES], *[f"type_{t}" for t in _TYPES]]
    return per_submission.groupBy("question_id", "commenter_id", "stakeholder_type").agg(
        F.count("*").alias("submissions"), *_sums(summed)
    )


def _ordered_map(values, prefix: str) -> Column:
    """``id -> count`` in vocabulary order, zero counts left out."""
    pairs = ", ".join(f"'{v}', coalesce({prefix}_{v}, 0L)" for v in values)
    return F.expr(f"map_filter(map({pairs}), (id, n) -> n > 0)")


def _question_totals(rollup: DataFrame, keys: list[str]) -> DataFrame:
    """All per-question counters as flat columns, from the commenter roll-up."""
    return rollup.groupBy(*keys).agg(
        F.count("*").alias("distinct_commenters"),
        F.sum("submissions").alias("distinct_submissions"),
        F.sum("positions").alias("positions"),
        *_counts("group", vocab.STAKEHOLDER_TYPES, "stakeholder_type"),
        *_sums(f"stance_{s}" for s in vocab.STANCES),
        *[F.expr(f"count_if(type_{t} > 0) AS by_commenters_{t}") for t in _TYPES],
        *[F.expr(f"sum(type_{t}) AS by_positions_{t}") for t in _TYPES],
    )


def tension_eligible(commenters: Column, groups: Column) -> Column:
    return (commenters >= vocab.MIN_COMMENTERS_FOR_TENSION) & (groups >= vocab.MIN_GROUPS_FOR_TENSION)


def conclusion_eligible(commenters: Column) -> Column:
    return commenters >= vocab.MIN_COMMENTERS_FOR_CONCLUSION


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0).cast("bigint"))


def question_stats(rows: DataFrame, questions: DataFrame) -> DataFrame:
    """Per-question counts, maps and eligibility; every question has a row."""
    totals = _question_totals(commenter_rollup(rows), ["question_id"])
    mix = _ordered_map(vocab.STAKEHOLDER_TYPES, "group")
    return questions.select("question_id", "question_number", "theme").join(
        totals, "question_id", "left"
    ).select(
        "question_id",
        "question_number",
        "theme",
        _zero("distinct_commenters").alias("distinct_commenters"),
        _zero("distinct_submissions").alias("distinct_submissions"),
        _zero("positions").alias("positions"),
        mix.alias("stakeholder_mix"),
        _ordered_map(vocab.STANCES, "stance").alias("position_distribution"),
        _ordered_map(vocab.RESPONSE_TYPES, "by_commenters").alias("response_type_commenters"),
        tension_eligible(_zero("distinct_commenters"), F.size(mix)).alias("tension_eligible"),
        conclusion_eligible(_zero("distinct_commenters")).alias("conclusion_eligible"),
    )


def question_facts(rows: DataFrame) -> DataFrame:
    """What a claim about a question rests on, in one pass: counts, response
    types by distinct commenters and by positions (unknown last), and the groups
    with enough distinct commenters to be compared."""
    return rolled_up_facts(commenter_rollup(rows))


def rolled_up_facts(rollup: DataFrame) -> DataFrame:
    """``question_facts`` of rows that ``commenter_rollup`` was made of."""
    totals = _question_totals(rollup, ["question_id"])
    mix = _ordered_map(sorted(vocab.STAKEHOLDER_TYPES), "group")
    enough = F.map_filter(mix, lambda _, n: n >= vocab.MIN_COMMENTERS_FOR_TENSION)
    return totals.select(
        "question_id",
        "distinct_commenters",
        "distinct_submissions",
        "positions",
        _ordered_map(_TYPES, "by_commenters").alias("by_distinct_commenters"),
        _ordered_map(_TYPES, "by_positions").alias("by_positions"),
        F.map_keys(enough).alias("comparable_groups"),
    )


def response_type_distribution(rows: DataFrame) -> DataFrame:
    return question_facts(rows).drop("comparable_groups")


def comparable_groups(rows: DataFrame) -> DataFrame:
    return question_facts(rows).select("question_id", "comparable_groups")


def dominant_of(by_commenters: str, values=None) -> Column:
    """Type with most commenters in a count map; the earliest type on ties."""
    ranked = ", ".join(
        f"struct(coalesce(try_element_at({by_commenters}, '{v}'), 0L) AS n, {-i} AS late, '{v}' AS id)"
        for i, v in enumerate(_TYPES if values is None else values)
    )
    best = F.expr(f"array_max(array({ranked}))")
    return F.when(best["n"] > 0, best["id"])


def dominant_type(rows: DataFrame) -> DataFrame:
    dist = response_type_distribution(rows)
    return dist.select("question_id", dominant_of("by_distinct_commenters").alias("dominant_response_type"))


# --- cross-cutting gaps -----------------------------------------------------

def gap_stats(linked: DataFrame, gaps: DataFrame, max_examples: int = 3) -> DataFrame:
    """Per gap: counts, groups, most related questions and example excerpts.

    ``gaps`` is the gap dimension (``ordinal, gap_id, title, explanation``); every
    gap keeps a row.  With no ``max_examples`` there is no column ``examples``."""
    totals = _gap_totals(linked)
    related = gap_top_questions(linked).groupBy("gap_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "question_id"))), lambda r: r["question_id"])
        .alias("question_ids")
    )
    stats = gaps.join(totals, "gap_id", "left").join(related, "gap_id", "left")
    shown = [
        "ordinal",
        "gap_id",
        "title",
        "explanation",
        F.coalesce("question_ids", F.array().cast("array<string>")).alias("question_ids"),
        _zero("distinct_commenters").alias("distinct_commenters"),
        _zero("positions").alias("positions"),
        F.coalesce("stakeholder_types", F.array().cast("array<string>")).alias("stakeholder_types"),
    ]
    if not max_examples:
        return stats.select(*shown)
    examples = gap_examples(linked, max_examples).groupBy("gap_id").agg(
        F.array_sort(F.collect_list(F.struct(
            "rank", "position_id", "commenter_id", "display_name", "question_id", "excerpt"
        ))).alias("examples")
    )
    return stats.join(examples, "gap_id", "left").select(*shown, "examples")


def _gap_totals(linked: DataFrame) -> DataFrame:
    per_commenter = (
        linked.select(F.explode("gap_tags").alias("gap_id"), "commenter_id", "stakeholder_type")
        .groupBy("gap_id", "commenter_id", "stakeholder_type")
        .agg(F.count("*").alias("positions"))
    )
    totals = per_commenter.groupBy("gap_id").agg(
        F.count("*").alias("distinct_commenters"),
        F.sum("positions").alias("positions"),
        *_counts("group", vocab.STAKEHOLDER_TYPES, "stakeholder_type"),
    )
    groups = ", ".join(
        f"struct(-group_{g} AS n, {i} AS late, '{g}' AS id)" for i, g in enumerate(vocab.STAKEHOLDER_TYPES)
    )
    return totals.select(
        "gap_id", "distinct_commenters", "positions",
        F.expr(f"transform(array_sort(filter(array({groups}), r -> r.n < 0)), r -> r.id) AS stakeholder_types"),
    )


def gap_totals(linked: DataFrame, gaps: DataFrame) -> DataFrame:
    return gaps.join(_gap_totals(linked), "gap_id", "left").select(
        "ordinal",
        "gap_id",
        _zero("distinct_commenters").alias("distinct_commenters"),
        _zero("positions").alias("positions"),
        F.coalesce("stakeholder_types", F.array().cast("array<string>")).alias("stakeholder_types"),
    )


def gap_top_questions(linked: DataFrame, top: int = 3) -> DataFrame:
    """The questions most often raised with each gap, lowest number on ties."""
    counted = (
        linked.select(F.explode("gap_tags").alias("gap_id"), "question_ids")
        .select("gap_id", F.explode("question_ids").alias("question_id"))
        .groupBy("gap_id", "question_id")
        .agg(F.count("*").alias("positions"))
    )
    # At most gaps x questions rows are left here, so the sort is small.
    best = F.slice(F.array_sort(F.collect_list(F.struct(
        (-F.col("positions")).alias("n"), vocab.question_number(F.col("question_id")).alias("number"), "question_id"
    ))), 1, top)
    return counted.groupBy("gap_id").agg(best.alias("best")).select(
        "gap_id", F.posexplode("best").alias("rank", "q")
    ).select("gap_id", (F.col("rank") + 1).alias("rank"), "q.question_id", (-F.col("q.n")).alias("positions"))


def gap_examples(linked: DataFrame, top: int = 3) -> DataFrame:
    """Up to ``top`` excerpts per gap, one per commenter, featured first."""
    from pyspark.sql import Window

    pick = F.struct((~F.col("featured")).alias("late"), F.col("position_id").alias("position_id"))
    per_commenter = (
        linked.filter(F.coalesce("supporting_text", F.lit("")) != "")
        .select(
            F.explode("gap_tags").alias("gap_id"), "commenter_id", "display_name", pick.alias("pick"),
            F.element_at("question_ids", 1).alias("question_id"), F.col("supporting_text").alias("excerpt"),
        )
        .groupBy("gap_id", "commenter_id")
        .agg(F.min(F.struct("pick", "display_name", "question_id", "excerpt")).alias("best"))
    )
    # A rank filter on a window lets Spark keep only ``top`` rows per gap and
    # task before the shuffle.
    order = Window.partitionBy("gap_id").orderBy("best.pick.late", "best.pick.position_id")
    return (
        per_commenter.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top)
        .select("gap_id", "rank", "best.pick.position_id", "commenter_id", "best.display_name",
                "best.question_id", "best.excerpt")
    )


# --- docket level -----------------------------------------------------------

def docket_metrics(subs: DataFrame, linked: DataFrame, questions: DataFrame) -> DataFrame:
    """The headline figures, one row."""
    represented = linked.groupBy("commenter_id").agg(F.count("*").alias("n"))
    return (
        represented.agg(
            F.count("*").alias("commenters_represented"),
            F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("positions_identified"),
        )
        .withColumn("comments_analyzed", subs.agg(F.count("*")).scalar())
        .withColumn("questions_tracked", questions.agg(F.count("*")).scalar())
        .withColumn("min_commenters_for_conclusion", F.lit(vocab.MIN_COMMENTERS_FOR_CONCLUSION))
        .withColumn("min_commenters_for_tension", F.lit(vocab.MIN_COMMENTERS_FOR_TENSION))
        .withColumn("min_groups_for_tension", F.lit(vocab.MIN_GROUPS_FOR_TENSION))
    )


def stance_totals(positions: DataFrame) -> DataFrame:
    """Positions by stance, each position once however many questions it is on."""
    return positions.groupBy(F.col("position").alias("stance")).agg(F.count("*").alias("n"))


def theme_rollup(stats: DataFrame) -> DataFrame:
    """Positions and questions per theme, from the per-question counts."""
    return stats.groupBy("theme").agg(
        F.sum("positions").alias("positions"), F.count("*").alias("questions")
    )


def most_discussed(stats: DataFrame) -> DataFrame:
    """The question with most commenters, then positions, then lowest number."""
    best = F.struct("distinct_commenters", "positions", (-F.col("question_number")).alias("late"))
    return stats.agg(F.max_by(F.struct(*[F.col(c) for c in stats.columns]), best).alias("q")).select("q.*")


def docket_pattern(stats: DataFrame, totals: DataFrame) -> DataFrame:
    """Whether positions overwhelmingly accept the direction and argue terms:
    modification leads on every eligible question, more than half of all
    positions ask for it and fewer than a tenth oppose.  One row."""
    modify = "support_with_modification"

    def on_question(stance):
        return f"coalesce(try_element_at(position_distribution, '{stance}'), 0L)"

    rest = ", ".join(on_question(s) for s in vocab.STANCES if s != modify)
    per_question = stats.agg(
        F.count_if("conclusion_eligible").alias("eligible_questions"),
        F.expr(f"count_if(conclusion_eligible AND {on_question(modify)} <= greatest({rest})) AS not_led"),
        F.count("*").alias("questions"),
    )
    overall = totals.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("positions"),
        F.coalesce(F.sum(F.when(F.col("stance") == modify, F.col("n"))), F.lit(0)).cast("bigint").alias("modify"),
        F.coalesce(F.sum(F.when(F.col("stance") == "oppose", F.col("n"))), F.lit(0)).cast("bigint").alias("oppose"),
    )
    # Two one-row frames meet on a constant.
    joined = per_question.withColumn("one", F.lit(1)).join(
        F.broadcast(overall.withColumn("one", F.lit(1))), "one"
    ).drop("one")
    holds = (
        (F.col("eligible_questions") > 0) & (F.col("positions") > 0) & (F.col("not_led") == 0)
        & (F.col("modify") * 2 > F.col("positions")) & (F.col("oppose") * 10 < F.col("positions"))
    )
    return joined.select(
        holds.alias("holds"), "modify", "oppose", "positions", "eligible_questions", "questions"
    )


def _q_code(question_id: Column) -> Column:
    return F.concat(F.lit("Q"), vocab.question_number(question_id).cast("string"))


BLIND_SPOT_CLAIM = 900  # after every card of its own, before the stand-ins
CARD = ["category", "label", "headline", "detail", "evidence", "target_question_id"]


def signal_cards(questions: DataFrame, stats: DataFrame, gaps: DataFrame, totals: DataFrame,
                 curated: DataFrame | None = None) -> DataFrame:
    """Exactly three signal cards with their rank.

    Inputs hold one row per question, gap, stance and curated card.  Candidates
    in order of claim: most discussed, pattern, curated cards, blind spot (only
    when a place is left), then stand-ins for categories that are missing."""
    enough = vocab.MIN_COMMENTERS_FOR_CONCLUSION
    titled = stats.join(questions.select("question_id", "short_title"), "question_id")
    top = most_discussed(titled)
    ranges = vocab.literal_map({t.id: f"{t.label} ({t.question_range})" for t in vocab.THEMES})
    themes = theme_rollup(stats).select(
        "theme", F.col("positions").alias("theme_positions"), F.col("questions").alias("theme_questions")
    )

    discussed = top.filter("distinct_commenters > 0").join(themes, "theme").select(
        F.lit(0).alias("claim"),
        F.lit("most_discussed").alias("category"),
        F.lit("Most discussed").alias("label"),
        F.col("short_title").alias("headline"),
        F.concat(
            F.element_at(ranges, F.col("theme")), F.lit(" holds "), F.col("theme_positions").cast("string"),
            F.lit(" positions on "), F.col("theme_questions").cast("string"), F.lit(" questions; most commenters are on "),
            _q_code(F.col("question_id")), F.lit("."),
        ).alias("detail"),
        F.concat(
            _q_code(F.col("question_id")), F.lit(" · "), F.col("distinct_commenters").cast("string"),
            F.lit(" commenters · "), F.col("positions").cast("string"), F.lit(" positions"),
        ).alias("evidence"),
        F.col("question_id").alias("target_question_id"),
    )

    lead = top.select(F.lit(1).alias("one"), F.col("question_id").alias("lead_question"))
    found = docket_pattern(stats, totals).filter("holds").withColumn("one", F.lit(1)).join(
        F.broadcast(lead), "one"
    )
    pattern = found.select(
        F.lit(1).alias("claim"),
        F.lit("pattern").alias("category"),
        F.lit("Notable pattern").alias("label"),
        F.lit("The debate is about how, not whether").alias("headline"),
        F.lit("Few positions reject the proposed direction; most argue about its terms.").alias("detail"),
        F.concat(
            F.col("modify").cast("string"), F.lit(" of "), F.col("positions").cast("string"),
            F.lit(" positions ask for modification · "), F.col("oppose").cast("string"),
            F.lit(" oppose · plurality on "), F.col("eligible_questions").cast("string"), F.lit(" of "),
            F.col("questions").cast("string"), F.lit(" questions"),
        ).alias("evidence"),
        F.col("lead_question").alias("target_question_id"),
    )

    spot = gaps.filter("distinct_commenters > 0").agg(
        F.max_by(
            F.struct("title", "explanation", "distinct_commenters", "question_ids"),
            F.struct("distinct_commenters", (-F.col("ordinal")).alias("late")),
        ).alias("g")
    ).filter("g is not null").select("g.*")
    codes = F.array_join(F.transform("question_ids", _q_code), ", ")
    blind_spot = spot.select(
        F.lit(BLIND_SPOT_CLAIM).alias("claim"),
        F.lit("blind_spot").alias("category"),
        F.lit("Emerging blind spot").alias("label"),
        F.col("title").alias("headline"),
        F.col("explanation").alias("detail"),
        F.concat(
            F.when(F.col("distinct_commenters") >= enough,
                   F.concat(F.col("distinct_commenters").cast("string"), F.lit(" commenters · ")))
            .otherwise(F.lit("Limited data · ")),
            codes,
        ).alias("evidence"),
        F.coalesce(F.try_element_at("question_ids", F.lit(1)), F.lit("q1")).alias("target_question_id"),
    )

    stand_ins = [
        ("most_discussed", "Most discussed", "No positions yet",
         "The most discussed question appears here once comments are classified."),
        ("pattern", "Notable pattern", "Not enough comments yet",
         f"Patterns are reported once questions have at least {enough} distinct commenters."),
        ("blind_spot", "Emerging blind spot", "Not enough comments yet",
         "Issues that cut across questions appear here once commenters raise them."),
    ]
    fillers = reduce(DataFrame.unionByName, [
        top.select(
            F.lit(1000 + i).alias("claim"), *[F.lit(v).alias(n) for n, v in zip(CARD, card)],
            F.lit("Limited data").alias("evidence"), F.col("question_id").alias("target_question_id"),
        )
        for i, card in enumerate(stand_ins)
    ])

    frames = [discussed, pattern]
    if curated is not None:
        frames.append(_curated_cards(curated, stats, gaps))
    cards = reduce(DataFrame.unionByName, [*frames, blind_spot, fillers])

    # A dozen rows at most: gather, drop a stand-in whose category is already
    # claimed.  The blind spot and stand-ins only fill up to the number shown;
    # what is left is put in display order and then cut.
    ordered = F.array_sort(F.collect_list(F.struct("claim", *CARD)))
    claimed = F.transform(F.filter(ordered, lambda c: c["claim"] < 1000), lambda c: c["category"])
    kept = F.filter(
        F.col("ordered"), lambda c: (c["claim"] < 1000) | ~F.array_contains(F.col("claimed"), c["category"])
    )
    own = F.size(F.filter(F.col("ordered"), lambda c: c["claim"] < BLIND_SPOT_CLAIM))
    enough = F.slice(kept, F.lit(1), F.greatest(own, F.lit(vocab.SIGNAL_COUNT)))
    place = F.coalesce(vocab.ordinal(vocab.SIGNAL_ORDER, F.col("category")), F.lit(99))
    shown = cards.agg(ordered.alias("ordered"), claimed.alias("claimed")).select(F.explode(enough).alias("c")).select("c.*")
    return shown.withColumn("display_order", place).orderBy("display_order", "claim").limit(vocab.SIGNAL_COUNT).drop("claim")


def _curated_cards(curated: DataFrame, stats: DataFrame, gaps: DataFrame) -> DataFrame:
    """Curated cards with their sample stated from the live counts."""
    per_card = (
        curated.withColumn("card", F.monotonically_increasing_id())
        .withColumn("cited", F.explode_outer("question_ids"))
        .join(stats.select(F.col("question_id").alias("cited"), F.col("distinct_commenters").alias("on_question")),
              "cited", "left")
        .groupBy("card")
        .agg(
            *[F.first(c).alias(c) for c in ("category", "label", "headline", "detail", "gap_id")],
            F.first("target_question_id").alias("target"),
            F.first(F.filter("question_ids", vocab.is_question_id)).alias("cited_ids"),
            F.coalesce(F.sum("on_question"), F.lit(0).cast("bigint")).alias("on_questions"),
        )
        .join(gaps.select("gap_id", F.col("distinct_commenters").alias("on_gap")), "gap_id", "left")
    )
    n = F.coalesce("on_gap", "on_questions")
    where = F.coalesce(
        F.nullif(F.array_join(F.transform("cited_ids", _q_code), ", "), F.lit("")), F.lit("the docket")
    )
    return per_card.select(
        (F.lit(2) + F.row_number().over(_by("card"))).alias("claim"),
        "category", "label", "headline", "detail",
        F.when(n >= vocab.MIN_COMMENTERS_FOR_CONCLUSION,
               F.concat(F.lit("Drawn from "), where, F.lit(" · "), n.cast("string"), F.lit(" commenters")))
        .otherwise(F.concat(F.lit("Limited data · "), T.plural(n, "commenter"), F.lit(" so far on "), where))
        .alias("evidence"),
        F.coalesce("target", F.try_element_at("cited_ids", F.lit(1)), F.lit("q1")).alias("target_question_id"),
    )


def _by(column: str):
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0)).orderBy(column)


# --- run metrics ------------------------------------------------------------

USAGE = ["llm_calls", "retries", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens"]


def stage_costs(metrics: DataFrame, prices: DataFrame) -> DataFrame:
    """Per-stage usage with its cost in USD; an unpriced model costs null.

    ``prices``: model, input, output, cache_read, cache_write per million tokens."""
    priced = metrics.join(prices, "model", "left")
    usd = (
        F.col("input_tokens") * F.col("input")
        + F.col("output_tokens") * F.col("output")
        + F.col("cache_read_tokens") * F.col("cache_read")
        + F.col("cache_write_tokens") * F.col("cache_write")
    ) / 1_000_000
    return priced.select(
        "stage", "model", *USAGE, F.round("elapsed_seconds", 1).alias("elapsed_seconds"),
        F.round(usd, 4).alias("estimated_cost_usd"),
    )


def run_totals(costs: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return costs.agg(
        *[F.coalesce(F.sum(c), zero).alias(c) for c in USAGE],
        F.round(F.coalesce(F.sum("elapsed_seconds"), F.lit(0.0)), 1).alias("elapsed_seconds"),
        F.round(F.coalesce(F.sum("estimated_cost_usd"), F.lit(0.0)), 4).alias("estimated_cost_usd"),
    )
