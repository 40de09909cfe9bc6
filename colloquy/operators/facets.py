"""Faceted and text search over published positions."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy import vocab
from colloquy.functions import text as T
from colloquy.operators import stats
from colloquy.session import stored

VIEWS = ["questions", "tensions", "missed"]


@dataclass(frozen=True)
class Facets:
    """A search: ``None`` means no restriction."""

    view: str = "questions"
    theme: str | None = None
    stakeholder: str | None = None
    stance: str | None = None
    search: str = ""

    @property
    def term(self) -> str:
        return self.search.strip().lower()

    @property
    def filtering(self) -> bool:
        return bool(self.stakeholder or self.stance or self.term)


def facets_from(view=None, theme=None, stakeholder=None, position=None, search=None, **_) -> Facets:
    """Facets from page parameters: slugs become ids, unknown values are
    ignored and the search text is limited."""
    def by_slug(vocabulary, slug):
        return next((key for key, value in vocabulary.items() if value[1] == slug), None)

    themes = {t.slug: t.id for t in vocab.THEMES}
    return Facets(
        view=view if view in VIEWS else "questions",
        theme=themes.get(theme),
        stakeholder=by_slug(vocab.STAKEHOLDER_TYPES, stakeholder),
        stance=by_slug(vocab.STANCES, position),
        search=(search or "")[:vocab.SEARCH_MAX_CHARS],
    )


def parameters_of(facets: Facets) -> dict[str, str]:
    """The page parameters that lead to these facets; defaults are left out."""
    slugs = {t.id: t.slug for t in vocab.THEMES}
    out = {
        "view": facets.view if facets.view != "questions" else "",
        "theme": slugs.get(facets.theme, ""),
        "stakeholder": vocab.STAKEHOLDER_TYPES.get(facets.stakeholder, ("", ""))[1],
        "position": vocab.STANCES.get(facets.stance, ("", ""))[1],
        "search": facets.search.strip(),
    }
    return {k: v for k, v in out.items() if v}


def requested_question(value) -> int | None:
    """A question number from a page parameter, None when out of range."""
    text = str(value or "").lower().lstrip("#").removeprefix("q")
    return int(text) if text.isdigit() and 1 <= int(text) <= vocab.N_QUESTIONS else None


def with_haystack(linked: DataFrame) -> DataFrame:
    """Positions with their search text; store it with the public table."""
    return linked.withColumn("haystack", T.position_haystack(
        F.col("display_name"), F.col("organization"), F.col("primary_issue"), F.col("secondary_issue"),
        F.col("response_type"), F.col("gap_tags"), F.col("public_summary"),
    ))


def question_haystack() -> Column:
    return F.lower(F.concat_ws(" ", "short_title", F.array_join("tags", " ")))


def position_facets_match(facets: Facets) -> Column:
    """The facets a position decides alone; the search term is not one."""
    match = F.lit(True)
    if facets.stakeholder:
        match = match & (F.col("stakeholder_type") == facets.stakeholder)
    if facets.stance:
        match = match & (F.col("position") == facets.stance)
    return match


def _mask_of(questions: DataFrame, condition: Column) -> Column:
    """The questions that meet a condition as a constant of 26 bits."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("question_number") - 1)
    return questions.filter(condition).agg(F.coalesce(F.bit_or(bit), F.lit(0).cast("bigint"))).scalar()


def searched_rows(positions: DataFrame, questions: DataFrame, facets: Facets, only_matching: bool = True, themed: bool = False) -> DataFrame:
    """(position, question) rows with ``shown``: does the row pass the facets?

    With ``only_matching`` the facet and term filters run before the questions
    are exploded, so rows that cannot match never reach a shuffle; with
    ``themed`` so does the theme: other questions are never exploded."""
    term = facets.term
    asked = questions.select("question_id", "question_number", "theme", "short_title", "tags", "has_tension_block")
    rows = positions
    if themed and facets.theme:
        rows = rows.withColumn("of_theme", _mask_of(asked, F.col("theme") == facets.theme))
        rows = rows.filter(vocab.question_mask(F.col("question_ids")).bitwiseAND(F.col("of_theme")) != 0)
        rows = rows.withColumn("question_ids", F.filter("question_ids", lambda q: F.getbit(F.col("of_theme"), vocab.question_number(q) - 1) == 1))
    if term:
        # Which questions themselves carry the term.
        hits = _mask_of(asked, F.contains(question_haystack(), F.lit(term)))
        rows = rows.withColumn("in_text", F.contains("haystack", F.lit(term))).withColumn("hit_questions", hits)
    passes = position_facets_match(facets)
    if only_matching and facets.filtering:
        rows = rows.filter(passes)
        if term:
            rows = rows.filter(
                F.col("in_text") | (vocab.question_mask(F.col("question_ids")).bitwiseAND(F.col("hit_questions")) != 0)
            )
    exploded = rows.withColumn("question_id", F.explode("question_ids"))
    if term:
        on_question = F.getbit(F.col("hit_questions"), vocab.question_number(F.col("question_id")) - 1) == 1
        passes = passes & (F.col("in_text") | on_question)
    exploded = exploded.withColumn("shown", passes)
    return exploded.filter("shown") if only_matching else exploded


def facet_filter(positions: DataFrame, questions: DataFrame, facets: Facets) -> DataFrame:
    """The (position, question) rows a search shows."""
    return searched_rows(positions, questions, facets).select("question_id", "position_id", "commenter_id")


def filtered_summary(rows: DataFrame) -> DataFrame:
    """Counts, groups and stances of any subset of (position, question) rows."""
    counted = rows.groupBy("question_id", "commenter_id", "stakeholder_type").agg(
        F.count("*").alias("positions"), *stats._counts("stance", vocab.STANCES, "position")
    )
    totals = counted.groupBy("question_id").agg(
        F.count("*").alias("distinct_commenters"),
        F.sum("positions").alias("positions"),
        *stats._counts("group", vocab.STAKEHOLDER_TYPES, "stakeholder_type"),
        *stats._sums(f"stance_{s}" for s in vocab.STANCES),
    )
    return totals.select(
        "question_id", "distinct_commenters", "positions",
        stats._ordered_map(vocab.STAKEHOLDER_TYPES, "group").alias("stakeholder_mix"),
        stats._ordered_map(vocab.STANCES, "stance").alias("position_distribution"),
    )


def view(positions: DataFrame, questions: DataFrame, facets: Facets) -> DataFrame:
    """The questions a view shows, with their counts before and after filters."""
    rows = searched_rows(positions, questions, facets, only_matching=False, themed=True)
    per_commenter = rows.groupBy("question_id", "commenter_id", "stakeholder_type").agg(
        F.count("*").alias("all"), F.count_if("shown").alias("shown")
    )
    totals = per_commenter.groupBy("question_id").agg(
        F.count("*").alias("all_commenters"),
        F.sum("all").alias("all_positions"),
        F.count_if(F.col("shown") > 0).alias("shown_commenters"),
        F.sum("shown").alias("shown_positions"),
        *stats._counts("group", vocab.STAKEHOLDER_TYPES, "stakeholder_type"),
    )
    groups = " + ".join(f"cast(group_{g} > 0 AS int)" for g in vocab.STAKEHOLDER_TYPES)
    counts = ["all_commenters", "all_positions", "shown_commenters", "shown_positions"]
    joined = questions.join(totals.withColumn("groups", F.expr(groups)), "question_id", "left").fillna(
        0, [*counts, "groups"]
    )
    out = joined.withColumn(
        "has_tension",
        F.coalesce("has_tension_block", F.lit(False)) & stats.tension_eligible(F.col("all_commenters"), F.col("groups")),
    )
    if facets.theme:
        out = out.filter(F.col("theme") == facets.theme)
    if facets.filtering:
        out = out.filter("shown_positions > 0")
    if facets.view == "tensions":
        out = out.filter("has_tension")
    return out.select("question_id", "question_number", "theme", *counts, "has_tension").orderBy("question_number")


def result_count(positions: DataFrame, questions: DataFrame, facets: Facets) -> DataFrame:
    """Visible questions and distinct positions on them, one row.

    A position on several visible questions counts once.  Its questions are in
    one row before they are exploded, so the count needs no shuffle of ids.  Two
    passes read the positions: what they need is written once, of the search text
    only the term, where it holds it."""
    kept = ["question_ids", "commenter_id", "stakeholder_type", "position"]
    if facets.term:
        found = F.when(F.contains("haystack", F.lit(facets.term)), F.lit(facets.term)).otherwise(F.lit(""))
        positions = positions.select(*kept, F.when(F.col("haystack").isNotNull(), found).alias("haystack"))
    positions = stored(positions.select(*positions.columns if facets.term else kept), "searched")
    visible = view(positions, questions, facets)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("question_number") - 1)
    zero = F.lit(0).cast("bigint")
    shown = visible.agg(F.count("*").alias("questions"), F.coalesce(F.bit_or(bit), zero).alias("mask"))
    reachable = vocab.question_mask(F.col("question_ids"))
    rows = positions.withColumn("visible", shown.select("mask").scalar())
    if facets.term:
        hits = questions.filter(F.contains(question_haystack(), F.lit(facets.term))).agg(
            F.coalesce(F.bit_or(bit), zero)
        ).scalar()
        by_question = F.when(F.contains("haystack", F.lit(facets.term)), reachable).otherwise(
            reachable.bitwiseAND(F.col("hits"))
        )
        rows = rows.withColumn("hits", hits)
    else:
        by_question = reachable
    matching = rows.filter(position_facets_match(facets) & (by_question.bitwiseAND(F.col("visible")) != 0))
    return matching.agg(F.count("*").alias("positions")).withColumn(
        "questions", shown.select("questions").scalar()
    )


def section_rollup(visible: DataFrame) -> DataFrame:
    return visible.groupBy("theme").agg(F.count("*").alias("questions"))


def commenter_cards(rows: DataFrame) -> DataFrame:
    """One card per (question, commenter): how many points, which stances, and
    for a single point the other questions it is on.

    The points themselves stay rows (``facet_filter``), so a commenter with
    very many of them never becomes one oversized value."""
    stances = [F.when(F.max(F.col("position") == s), F.lit(s)) for s in vocab.STANCES]
    return (
        rows.groupBy("question_id", "commenter_id", "display_name", "stakeholder_type")
        .agg(
            F.count("*").alias("points"),
            F.array_compact(F.array(*stances)).alias("stances"),
            F.min(F.struct("position_id", "question_ids")).alias("only"),
        )
        .select(
            "question_id", "commenter_id", "display_name", "stakeholder_type", "points", "stances",
            F.when(
                F.col("points") == 1,
                F.filter("only.question_ids", lambda q: q != F.col("question_id")),
            ).otherwise(F.array().cast("array<string>")).alias("other_questions"),
        )
    )


def gap_lines(gaps: DataFrame) -> DataFrame:
    """The statistics line of each gap, cautious below the threshold."""
    asked = T.plural(F.size("question_ids"), "FDA question")
    enough = F.col("distinct_commenters") >= vocab.MIN_COMMENTERS_FOR_CONCLUSION
    return gaps.select(
        "gap_id",
        F.when(enough, F.concat(asked, F.lit(" · "), F.col("distinct_commenters").cast("string"),
                                F.lit(" commenters raising related concerns")))
        .otherwise(F.concat(asked, F.lit(" · Limited data: "), T.plural(F.col("distinct_commenters"), "commenter"), F.lit(" so far")))
        .alias("line"),
    )


def visibility(positions: DataFrame, questions: DataFrame, states: list[Facets], question_id: str) -> list[bool]:
    """Under which of several facet states (62 at most) a question is shown, in one scan.

    Each state is a bit; a position sets the bits of the states that show it, and
    the bits are folded by commenter and then over the question.  Only positions
    on the question are read further."""
    if len(states) > 62:
        raise ValueError("at most 62 states fit one scan")
    asked = questions.filter(F.col("question_id") == question_id).select(
        "theme", F.coalesce("has_tension_block", F.lit(False)).alias("block"), question_haystack().alias("haystack")).first()
    if asked is None:
        return [False] * len(states)
    here = positions.filter(F.array_contains("question_ids", F.lit(question_id)))
    bits = F.lit(0).cast("bigint")
    for i, state in enumerate(states):
        shows = position_facets_match(state)
        if state.term and state.term not in asked.haystack:
            shows = shows & F.contains("haystack", F.lit(state.term))
        bits = bits.bitwiseOR(F.when(F.coalesce(shows, F.lit(False)), F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    group = vocab.ordinal(vocab.STAKEHOLDER_TYPES, F.col("stakeholder_type"))
    folded = here.withColumn("bits", bits).groupBy("commenter_id", "stakeholder_type").agg(F.bit_or("bits").alias("bits")).agg(
        F.count("*").alias("voices"), F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), group.cast("int")))).alias("groups"),
        F.coalesce(F.bit_or("bits"), F.lit(0).cast("bigint")).alias("bits"))
    seen = folded.select("*", (F.lit(asked.block) & stats.tension_eligible(F.col("voices"), F.col("groups"))).alias("tension")).first()

    def shown(i: int, state: Facets) -> bool:
        return (state.theme in (None, asked.theme)) and (not state.filtering or bool(seen.bits >> i & 1)) and (state.view != "tensions" or bool(seen.tension))

    return [shown(i, state) for i, state in enumerate(states)]


def relax_for(positions: DataFrame, questions: DataFrame, facets: Facets, question_id: str) -> Facets:
    """The nearest facets under which a question is visible: leave a view it is
    not in, drop a theme it is not in, then clear the filters if need be."""
    asked = questions.filter(F.col("question_id") == question_id).select("theme").first()
    if asked is None:
        return facets
    fitting = facets if facets.theme in (None, asked.theme) else replace(facets, theme=None)
    stays = fitting if fitting.view != "missed" else replace(fitting, view="questions")
    leaves = replace(fitting, view="questions")
    as_given, kept, left = visibility(positions, questions, [facets, stays, leaves], question_id)
    out, seen = (stays, kept) if facets.view == "questions" or (facets.view == "tensions" and as_given) else (leaves, left)
    return out if seen else replace(out, stakeholder=None, stance=None, search="")
