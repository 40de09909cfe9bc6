"""Fold near-duplicate positions of one submission into one.

Two positions of a submission are near-duplicates when they hold the same
stance, share a question, and either the shorter passage is largely contained
in the longer or their summaries are close.  Clusters are transitive.

The obvious plan joins every position with every other one of its submission.
This one never lists such pairs:

1. Equal texts are linked to their first copy, a star: linear in the copies.
2. Passages that can match share a fingerprint (see ``functions.matching``).
   In each fingerprint group every member is scored against the longest one
   only, and what matches is merged into components.
3. Members of a group that are in *different* components are scored next.  The
   largest component of a group is never paired with itself, so a group of
   near-copies, however large, is finished after step 2.  Fingerprints common
   to very many passages are skipped for a short side whose other characters
   decide the outcome anyway; that loses no match.
4. The summary rule has no such filter: two summaries may be close without any
   long common run.  Here blocks are cut into tiles of bounded size, every
   pair of tiles is one unit of work, and a unit emits only what matches.
   Pairs already in one component are left out as in step 3.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy import vocab
from colloquy.functions import matching as M
from colloquy.functions import similarity as S
from colloquy.functions import text as T
from colloquy.operators.components import connected_components
from colloquy.session import cut_lineage

RULE_VERSION = "1.0.0"
BLOCK = ["submission_id", "stance", "question"]
GROUP = [*BLOCK, "fp"]
COMMON_FINGERPRINT = 32
TILE_ROWS = 256
LARGE_CHARS = 2_000_000


# --- candidate counts -------------------------------------------------------

def candidate_counts(positions: DataFrame) -> DataFrame:
    """How many pairs per submission share a stance and a question, without
    listing them: positions are first counted by their question set."""
    sets = positions.select(
        "submission_id", F.col("position").alias("stance"), vocab.question_mask(F.col("question_ids")).alias("mask")
    ).groupBy("submission_id", "stance", "mask").agg(F.count("*").alias("n"))
    within = sets.filter("mask <> 0").select("submission_id", F.expr("n * (n - 1) div 2 AS pairs"))
    left = sets.select("submission_id", "stance", F.col("mask").alias("left_mask"), F.col("n").alias("left_n"))
    across = left.join(sets, ["submission_id", "stance"]).filter("left_mask < mask AND (left_mask & mask) <> 0").select(
        "submission_id", F.expr("left_n * n AS pairs")
    )
    return (
        within.unionByName(across).groupBy("submission_id").agg(F.sum("pairs").alias("pairs")).filter("pairs > 0")
    )


# --- links ------------------------------------------------------------------

def _records(positions: DataFrame, rules=("passage", "summary")) -> DataFrame:
    """Positions with the normalized texts that the rules compare."""
    texts = {"passage": "source_passage", "summary": "public_summary"}
    return positions.select(
        "submission_id",
        "segment_id",
        F.col("position").alias("stance"),
        vocab.question_mask(F.col("question_ids")).alias("mask"),
        F.length("source_passage").alias("given_chars"),
        *(T.match_norm(F.col(texts[rule])).alias(rule) for rule in rules),
    )


def _node(segment: str) -> Column:
    return F.concat_ws("\n", "submission_id", segment)


def _texts(records: DataFrame, text: str) -> DataFrame:
    return records.withColumns({"text_id": F.md5(text), "chars": F.length(text)})


def _by_question(records: DataFrame) -> DataFrame:
    return records.select(
        "submission_id", "stance", "segment_id", "text_id", "chars",
        F.explode(vocab.mask_questions(F.col("mask"))).alias("question"),
    )


def _text_members(records: DataFrame) -> DataFrame:
    """Per block and distinct text: the first and last segment that holds it."""
    return _by_question(records).groupBy(*BLOCK, "text_id", "chars").agg(
        F.min("segment_id").alias("first_segment"), F.max("segment_id").alias("last_segment")
    )


def _copy_links(records: DataFrame, members: DataFrame) -> DataFrame:
    """Every further copy of a text in a block, linked to the first one."""
    repeated = members.filter("first_segment <> last_segment").drop("chars")
    return _by_question(records).join(repeated, [*BLOCK, "text_id"]).filter("segment_id <> first_segment").select(
        "submission_id", F.col("first_segment").alias("a"), F.col("segment_id").alias("b")
    ).distinct()


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


_INVOLVED = (
    "submission_id string, segment_id string, stance string, mask long, text_id string, chars int, "
    "passage string, fp array<long>, start array<int>, stop array<int>"
)


def _involved(records: DataFrame) -> DataFrame:
    """Records whose passage shares a fingerprint with another one of their
    submission, or is a copy of one; all others match nothing.  One record of
    each sharing text holds the ``passage`` and its shared fingerprints as
    parallel arrays, the others hold null there.

    Fingerprints are larger than the text they come from, so the texts of a
    submission are brought together and only shared fingerprints leave the
    task.  A submission of more than ``LARGE_CHARS`` is no one task's work: its
    fingerprints are shuffled instead."""
    # Short passages are left out where the normalized text is at hand: a filter
    # on it here would be pushed into the scan, and normalize every passage twice.
    rows = records.filter(F.col("submission_id").isNotNull()).select("submission_id", "segment_id", "stance", "mask", "passage")
    # At most one row for LARGE_CHARS of input, so fit to be broadcast.
    large = cut_lineage(
        records.groupBy("submission_id").agg(F.sum("given_chars").alias("chars"))
        .filter(F.col("chars") > LARGE_CHARS).select("submission_id")
    )
    split = not large.isEmpty()
    small = rows.join(F.broadcast(large), "submission_id", "left_anti") if split else rows
    found = (
        small.repartition(_tasks(small), "submission_id")
        .sortWithinPartitions("submission_id")
        .mapInPandas(M.shared_fingerprints, _INVOLVED)
    )
    if split:
        found = found.unionByName(_involved_in_large(rows.join(F.broadcast(large), "submission_id", "left_semi")))
    return found


def _involved_in_large(rows: DataFrame) -> DataFrame:
    rows = cut_lineage(_texts(rows, "passage")).filter(F.col("chars") >= M.MIN_RUN)
    texts = rows.groupBy("submission_id", "text_id").agg(
        F.first("passage").alias("passage"), F.min("segment_id").alias("segment_id"), F.count("*").alias("copies")
    )
    # Short texts make long lists: adaptive execution would judge by their bytes
    # and merge tasks, so the number of tasks is stated.
    spread = texts.repartition(_tasks(texts), "submission_id", "text_id")
    prints = spread.withColumn("prints", S.fingerprints(F.col("passage"))).select(
        "submission_id", "text_id", F.inline(F.arrays_zip("prints.fp", "prints.start", "prints.stop"))
    )
    # Most fingerprints belong to one text.  A first pass over narrow rows finds
    # the few that do not; the second pass keeps only those.
    spot = F.xxhash64("submission_id", "fp").alias("spot")
    held = prints.select(spot, F.xxhash64("text_id").alias("holder")).groupBy("spot").agg(
        F.min("holder").alias("least"), F.max("holder").alias("most")
    ).filter("least <> most").select("spot")
    shared = prints.withColumn("spot", spot).join(held, "spot", "left_semi").groupBy("submission_id", "text_id").agg(
        F.collect_list(F.struct("fp", "start", "stop")).alias("prints")
    )
    found = texts.join(shared, ["submission_id", "text_id"], "left").filter("prints IS NOT NULL OR copies > 1")
    lead = (F.col("segment_id") == F.col("lead")) & F.col("prints").isNotNull()
    return rows.drop("passage").join(
        found.select("submission_id", "text_id", F.col("segment_id").alias("lead"), "passage", "prints"), ["submission_id", "text_id"]
    ).select(
        "submission_id", "segment_id", "stance", "mask", "text_id", "chars", F.when(lead, F.col("passage")).alias("passage"),
        *(F.when(lead, F.col(f"prints.{c}")).alias(c) for c in ("fp", "start", "stop")),
    )


def _fingerprint_rows(sharing: DataFrame, members: DataFrame) -> DataFrame:
    """Fingerprints that at least two texts of a block share, one row per text."""
    prints = sharing.select("submission_id", "text_id", F.inline(F.arrays_zip("fp", "start", "stop")))
    rows = prints.join(members, ["submission_id", "text_id"])
    shared = rows.groupBy(*GROUP).agg(
        F.count("*").alias("holders"),
        F.min("text_id").alias("least"),
        F.max(F.struct("chars", "text_id", "first_segment", "last_segment")).alias("pivot"),
        F.max("text_id").alias("most"),
    ).filter("least <> most").drop("least", "most")
    return rows.join(shared, GROUP)


def _score_passages(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Keep the pairs ``(submission_id, a, b)`` whose passages match."""
    def side(name):
        return texts.select("submission_id", F.col("text_id").alias(f"text_{name}"), F.col("passage").alias(f"passage_{name}"))

    scored = pairs.join(side("a"), ["submission_id", "text_a"]).join(side("b"), ["submission_id", "text_b"])
    return scored.filter(
        S.passage_containment("passage_a", "passage_b") >= M.PASSAGE_CONTAINMENT
    ).select("submission_id", "a", "b")


def _both_orders(first: str, second: str) -> Column:
    """Segment pairs in which two texts of equal length meet.  The score may
    depend on which comes first, so where both orders occur both are scored."""
    def pair(a, b):
        return F.when(F.col(f"{a}.first_segment") < F.col(f"{b}.last_segment"), F.struct(
            F.col(f"{a}.first_segment").alias("a"), F.col(f"{b}.last_segment").alias("b"),
            F.col(f"{a}.text_id").alias("text_a"), F.col(f"{b}.text_id").alias("text_b"),
        ))

    return F.array_compact(F.array(pair(first, second), pair(second, first)))


_TEXT = ["text_id", "chars", "first_segment", "last_segment"]


def _pairs_of(joined: DataFrame) -> DataFrame:
    """Segment pairs to score for rows holding two text structs ``x`` and ``y``."""
    one_order = F.slice(_both_orders("x", "y"), 1, 1)
    pairs = F.when(F.col("x.chars") == F.col("y.chars"), _both_orders("x", "y")).otherwise(one_order)
    return joined.select("submission_id", F.inline(pairs)).distinct()


def _pivot_pairs(rows: DataFrame) -> DataFrame:
    met = rows.filter("text_id <> pivot.text_id").select("submission_id", F.struct(*_TEXT).alias("x"), F.col("pivot").alias("y"))
    return _pairs_of(met)


def _with_component(rows: DataFrame, components: DataFrame) -> DataFrame:
    """Add the component of each row's text; a lone text is its own."""
    return rows.withColumn("node", _node("first_segment")).join(components, "node", "left").withColumn(
        "root", F.coalesce("root", "node")
    ).drop("node")


def _undecided(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of groups that span several components, with ``light`` set on all
    rows outside the group's largest component."""
    sizes = rows.groupBy(*keys, "root").agg(F.count("*").alias("n"))
    groups = sizes.groupBy(*keys).agg(
        F.count("*").alias("parts"), F.max_by("root", F.struct("n", "root")).alias("heavy")
    ).filter("parts > 1")
    return rows.join(groups, keys).withColumn("light", F.col("root") != F.col("heavy"))


def _skippable(rows: DataFrame) -> DataFrame:
    """Texts of a block that common fingerprints alone cannot decide: their
    windows cover less of the text than a match needs."""
    common = rows.filter(F.col("holders") > COMMON_FINGERPRINT)
    spans = F.array_sort(F.collect_list(F.struct("start", "stop")))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("covered"))
    covered = F.aggregate("spans", start, lambda acc, s: F.struct(
        F.greatest(acc["end"], s["stop"]).alias("end"),
        (acc["covered"] + F.greatest(F.lit(0), s["stop"] - F.greatest(acc["end"], s["start"]))).alias("covered"),
    ))["covered"]
    return (
        common.groupBy(*BLOCK, "text_id", "chars").agg(spans.alias("spans"))
        .filter(covered < (M.PASSAGE_CONTAINMENT - 0.0005) * F.col("chars"))
        .select(*BLOCK, "text_id", F.lit(True).alias("skip_common"))
    )


def _cross_pairs(rows: DataFrame, components: DataFrame) -> DataFrame:
    """Pairs that share a deciding fingerprint but no component yet."""
    open_rows = _undecided(_with_component(rows, components), GROUP)
    flagged = open_rows.join(_skippable(rows), [*BLOCK, "text_id"], "left")
    flagged = flagged.withColumn(
        "short_role", ~(F.coalesce("skip_common", F.lit(False)) & (F.col("holders") > COMMON_FINGERPRINT))
    )
    facts = F.struct(*_TEXT, "root", "light", "short_role")
    x = flagged.filter("light").select(*GROUP, facts.alias("x")).distinct()
    y = flagged.select(*GROUP, facts.alias("y")).distinct()
    met = x.join(y, GROUP).filter(
        "x.root <> y.root AND (NOT y.light OR x.text_id < y.text_id) AND "
        "((x.chars <= y.chars AND x.short_role) OR (y.chars <= x.chars AND y.short_role))"
    )
    return _pairs_of(met)


# --- summary rule -----------------------------------------------------------

_PAIR = "submission_id string, a string, b string"


def _summary_links(records: DataFrame, members: DataFrame, components: DataFrame) -> DataFrame:
    rows = _undecided(_with_component(members, components), BLOCK)
    tiles = rows.groupBy(*BLOCK).agg(
        F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("right_tiles"),
        F.ceil(F.count_if("light") / TILE_ROWS).cast("int").alias("left_tiles"),
    )
    texts = records.select(
        "submission_id", F.col("segment_id").alias("first_segment"), "summary"
    )
    placed = rows.join(tiles, BLOCK).join(texts, ["submission_id", "first_segment"])
    own = F.xxhash64("text_id")
    left_tile, right_tile = F.pmod(own, "left_tiles"), F.pmod(own, "right_tiles")
    kept = [*BLOCK, *_TEXT, "root", "light", "summary"]
    lefts = placed.filter("light").select(
        *kept, F.lit(True).alias("is_left"), left_tile.cast("int").alias("left_tile"),
        F.explode(F.sequence(F.lit(0), F.col("right_tiles") - 1)).alias("right_tile"),
    )
    rights = placed.select(
        *kept, F.lit(False).alias("is_left"),
        F.explode(F.sequence(F.lit(0), F.col("left_tiles") - 1)).alias("left_tile"),
        right_tile.cast("int").alias("right_tile"),
    )
    return (
        lefts.unionByName(rights.select(lefts.columns))
        .repartition(_tasks(lefts), *M.UNIT)
        .sortWithinPartitions(*M.UNIT)
        .mapInPandas(M.tile_matches, _PAIR)
    )


# --- clusters ---------------------------------------------------------------

def near_duplicate_links(positions: DataFrame, rules=("passage", "summary")) -> DataFrame:
    """Links ``(submission_id, a, b)`` whose transitive closure is exactly that
    of the near-duplicate relation."""
    links, sharing, summaries = [], None, None
    if "passage" in rules:
        # Both are read several times below; only what may match is left in them.
        involved = cut_lineage(_involved(_records(positions, ("passage",))))
        sharing = involved.filter("fp IS NOT NULL").select("submission_id", "text_id", "passage", "fp", "start", "stop")
        passages = _text_members(involved)
        fingerprint_rows = cut_lineage(_fingerprint_rows(sharing, passages))
        links.append(_copy_links(involved, passages))
        links.append(_score_passages(_pivot_pairs(fingerprint_rows), sharing))
    if "summary" in rules:
        # Normalized summaries are read by every step: written once.
        # Empty ones leave after that: a filter before it would make them twice.
        told = _texts(cut_lineage(_records(positions, ("summary",))).filter("summary <> ''"), "summary")
        summaries = _text_members(told)
        links.append(_copy_links(told, summaries))
    found = cut_lineage(_union(links))
    components = connected_components(found.select(_node("a").alias("a"), _node("b").alias("b")))
    links = [found]
    if sharing is not None:
        links.append(_score_passages(_cross_pairs(fingerprint_rows, components), sharing))
    if summaries is not None:
        links.append(_summary_links(told, summaries, components))
    return _union(links).select(
        "submission_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    ).distinct()


def _union(frames):
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def link_evidence(links: DataFrame, positions: DataFrame) -> DataFrame:
    """Both scores and the shared questions of each link."""
    # Few positions are in a link: their texts are made once, for both ends.
    links = cut_lineage(links)
    ends = links.select("submission_id", F.explode(F.array("a", "b")).alias("segment_id")).distinct()
    records = cut_lineage(_records(positions.join(ends, ["submission_id", "segment_id"], "left_semi")))

    def side(name):
        return records.select(
            "submission_id", F.col("segment_id").alias(name), F.col("mask").alias(f"mask_{name}"),
            F.col("passage").alias(f"passage_{name}"), F.col("summary").alias(f"summary_{name}"),
        )

    return links.join(side("a"), ["submission_id", "a"]).join(side("b"), ["submission_id", "b"]).select(
        "submission_id",
        F.col("a").alias("first_segment_id"),
        F.col("b").alias("second_segment_id"),
        vocab.mask_questions(F.col("mask_a").bitwiseAND(F.col("mask_b"))).alias("shared_question_ids"),
        S.passage_containment("passage_a", "passage_b").alias("passage_containment"),
        S.text_similarity("summary_a", "summary_b").alias("summary_similarity"),
    )


def cluster_members(links: DataFrame) -> DataFrame:
    """``(submission_id, segment_id, root)`` of every clustered position."""
    nodes = connected_components(links.select(_node("a").alias("a"), _node("b").alias("b")))
    parts = F.split("node", "\n", 2)
    return nodes.select(parts[0].alias("submission_id"), parts[1].alias("segment_id"), "root")


def completeness() -> Column:
    """Order of survival: least first."""
    rank = F.coalesce(vocab.ordinal(vocab.CONFIDENCE, F.col("confidence")), F.lit(99))
    tags = F.coalesce(F.size("gap_tags"), F.lit(0))
    return F.struct(
        rank.alias("confidence"),
        (-F.length(F.coalesce("source_passage", F.lit("")))).alias("passage"),
        (-tags).alias("gaps"),
        (-F.length(F.coalesce("public_summary", F.lit("")))).alias("summary"),
        F.col("segment_id").alias("segment_id"),
    )


def _clustered(positions: DataFrame, members: DataFrame, *more: str) -> DataFrame:
    """What folding needs of every clustered position: lengths instead of texts,
    so that no text is shuffled."""
    facts = positions.select(
        "submission_id", "segment_id", completeness().alias("place"), vocab.question_mask(F.col("question_ids")).alias("mask"),
        "position", *more,
    )
    return facts.join(members, ["submission_id", "segment_id"])


def clusters(positions: DataFrame, members: DataFrame) -> DataFrame:
    """One row per cluster: survivor, number merged, questions of all members."""
    return _folded(_clustered(positions, members))


def _folded(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("submission_id", "root").agg(
        F.min("place")["segment_id"].alias("kept_segment_id"),
        (F.count("*") - 1).alias("merged"),
        F.bit_or("mask").alias("mask"),
        F.first("position").alias("position"),
    )


def merged_segments(members: DataFrame, found: DataFrame) -> DataFrame:
    """Provenance: one row per segment folded into another."""
    return members.join(found.select("submission_id", "root", "kept_segment_id"), ["submission_id", "root"]).filter(
        "segment_id <> kept_segment_id"
    ).select("submission_id", "kept_segment_id", F.col("segment_id").alias("merged_segment_id"))


def _merged_gaps(clustered: DataFrame) -> DataFrame:
    """The gap tags of each cluster in survival order, at most three.

    A cluster's distinct tags are found by aggregation on (cluster, tag), so no
    list ever holds more than the nine gaps, however many members merge."""
    told = F.try_element_at("gap_explanations", F.col("tag"))
    tagged = (
        clustered
        .select("root", "place", "gap_explanations", F.posexplode("gap_tags").alias("at", "tag"))
        .groupBy("root", "tag")
        .agg(F.min(F.struct("place", "at", F.coalesce(told, F.lit("")).alias("told"))).alias("first"))
    )
    in_order = F.slice(F.array_sort(F.collect_list(
        F.struct(F.col("first.place").alias("place"), F.col("first.at").alias("at"), "tag", F.col("first.told").alias("told"))
    )), 1, vocab.MAX_GAP_TAGS)
    return tagged.groupBy("root").agg(in_order.alias("merged_tags"))


def consolidate(positions: DataFrame, members: DataFrame) -> DataFrame:
    """Positions with every cluster folded into its survivor, which gains the
    questions and gap tags of the others."""
    # Positions are shuffled for their clusters once; few of them are in any.
    clustered = cut_lineage(_clustered(positions, members, "gap_tags", "gap_explanations"))
    found = _folded(clustered).select("submission_id", "root", "kept_segment_id", "mask")
    kept = found.join(_merged_gaps(clustered), "root", "left").select(
        "submission_id", F.col("kept_segment_id").alias("segment_id"), "mask", "merged_tags"
    )
    folded = merged_segments(members, found).select("submission_id", F.col("merged_segment_id").alias("segment_id"))
    survivors = positions.join(folded, ["submission_id", "segment_id"], "left_anti").join(
        kept, ["submission_id", "segment_id"], "left"
    )
    own = F.coalesce("gap_explanations", F.create_map().cast("map<string,string>"))
    explained = F.map_from_entries(F.transform("merged_tags", lambda t: F.struct(
        t["tag"],
        F.coalesce(F.nullif(t["told"], F.lit("")), F.try_element_at(own, t["tag"]), F.lit("")),
    )))
    tags = F.transform("merged_tags", lambda t: t["tag"])
    return survivors.withColumns({
        "question_ids": F.when(F.col("mask").isNotNull(), vocab.mask_questions(F.col("mask"))).otherwise(F.col("question_ids")),
        "gap_tags": F.when(F.col("merged_tags").isNotNull(), tags).otherwise(F.col("gap_tags")),
        "gap_explanations": F.when(F.col("merged_tags").isNotNull(), explained).otherwise(F.col("gap_explanations")),
    }).drop("mask", "merged_tags")


def consolidation_log(found: DataFrame) -> DataFrame:
    """Clusters and merged positions of each submission that has any."""
    return found.groupBy("submission_id").agg(
        F.count("*").alias("clusters"), F.sum("merged").alias("positions_merged")
    )


def consolidation_counts(found: DataFrame) -> DataFrame:
    return consolidation_log(found).agg(
        F.count("*").alias("submissions_affected"),
        F.coalesce(F.sum("clusters"), F.lit(0).cast("bigint")).alias("clusters"),
        F.coalesce(F.sum("positions_merged"), F.lit(0).cast("bigint")).alias("positions_merged"),
    )
