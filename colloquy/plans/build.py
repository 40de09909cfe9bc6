"""A build: from stage rows or landed files to published tables, snapshot and manifest."""

from __future__ import annotations

import json
import posixpath
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import assemble, changes, consolidate, facets, guards, stats, validate
from colloquy.plans.docket import Docket
from colloquy.session import cut_lineage
from colloquy.sources import buckets, landed, publication

#: Commenters with more than this share of all submissions are spread over several tasks.
HEAVY_SHARE = 0.01

#: The statuses of a question's analysis, and what a manifest calls the rules that drop positions.
STATUSES = ("generated", "stale", "pending")
NO_POSITION_TEXT = "analyzed, but no substantive position survived classification"


class Build(Docket):
    """A docket whose near-duplicates are folded and whose results are written.

    Frames that several outputs read are written once to the checkpoint folder:
    the cluster members, and the linked positions with their search text."""

    def __init__(self, candidates: DataFrame, analysis: DataFrame, questions: DataFrame, generated_at: str,
                 versions: dict[str, str], gaps: DataFrame | None = None, curated_cards: DataFrame | None = None,
                 records: DataFrame | None = None, build_id: str | None = None, without_types: DataFrame | None = None,
                 quarantine: DataFrame | None = None, analysis_hashes: DataFrame | None = None, curated: dict[str, DataFrame] | None = None):
        super().__init__(candidates, analysis, questions)
        spark = candidates.sparkSession
        self.generated_at = generated_at
        self.build_id = build_id or generated_at.replace(":", "-")
        self.versions = versions
        self.curated_cards = curated_cards
        self.records = records
        self.without_types = without_types if without_types is not None else spark.createDataFrame([], "comment_id string")
        self.quarantine = quarantine if quarantine is not None else spark.createDataFrame([], "source string, file string, problem string")
        self.analysis_hashes = analysis_hashes
        self.curated = curated or {}
        if gaps is not None:
            self.gaps = gaps

    @classmethod
    def from_landing(cls, spark: SparkSession, folder: str, questions: DataFrame, generated_at: str, versions: dict[str, str],
                     prompt_version: str, processing_version: str, model: str | None = None, one_a_file: bool = True, **settings) -> "Build":
        """A build of what lies in a folder of landed files.  Response types count
        only where they were made from the analysis as it is, by these versions."""
        read = landed.read_landing(spark, folder, one_a_file)
        analysis, missing = landed.positions(read, prompt_version, processing_version, model)
        return cls(
            cut_lineage(landed.candidates(read)), cut_lineage(analysis), questions, generated_at, versions,
            without_types=missing, quarantine=read.quarantine,
            analysis_hashes=read.analysis.select("comment_id", landed.analysis_hash().alias("analysis_hash")), **settings,
        )

    @cached_property
    def publishable(self) -> DataFrame:
        """Publishable positions of accepted submissions, keyed for folding.
        Written once; what its rules drop is counted on the way."""
        kept = self.accepted.select("comment_id")
        counted, self._dropped = publication.observed(
            self.analysis.join(kept, "comment_id", "left_semi"),
            F.count_if(assemble.is_unclear()).alias("unclear_low_confidence_positions"),
            F.count_if(~assemble.is_unclear() & ~assemble.has_summary()).alias("positions_without_summary"),
        )
        return cut_lineage(assemble.publishable(counted).withColumn("submission_id", F.col("comment_id")))

    @cached_property
    def links(self) -> DataFrame:
        return cut_lineage(consolidate.near_duplicate_links(self.publishable))

    @cached_property
    def members(self) -> DataFrame:
        return consolidate.cluster_members(self.links)

    @cached_property
    def clusters(self) -> DataFrame:
        return cut_lineage(consolidate.clusters(self.publishable, self.members))

    @cached_property
    def positions(self) -> DataFrame:
        return assemble.built_positions(consolidate.consolidate(self.publishable, self.members))

    @cached_property
    def linked(self) -> DataFrame:
        authored = assemble.authored_submissions(self.submissions, self.commenters, HEAVY_SHARE)
        return cut_lineage(facets.with_haystack(assemble.linked_positions(self.positions, authored)))

    @cached_property
    def question_stats(self) -> DataFrame:
        return cut_lineage(stats.question_stats(self.question_rows, self.questions))

    @cached_property
    def gap_table(self) -> DataFrame:
        return cut_lineage(stats.gap_stats(self.linked, self.gaps))

    @cached_property
    def metrics(self) -> DataFrame:
        return cut_lineage(stats.docket_metrics(self.submissions, self.linked, self.questions))

    @cached_property
    def signals(self) -> DataFrame:
        return cut_lineage(stats.signal_cards(
            self.questions, self.question_stats, self.gap_table, stats.stance_totals(self.linked), self.curated_cards
        ))

    @cached_property
    def analyses(self) -> DataFrame:
        """Published analyses; pending throughout when there are no records."""
        records = self.records
        if records is None:
            from colloquy import schemas

            none = self.questions.sparkSession.createDataFrame([], schemas.CLAIM)
            records = guards.guard(none, self.question_rows).withColumn("fresh", F.lit(False))
        return cut_lineage(guards.published(self.questions, self.question_rows, records))

    def tables(self) -> dict[str, DataFrame]:
        return {
            "positions": assemble.public_positions(self.linked),
            "submissions": assemble.public_submissions(self.submissions),
            "commenters": assemble.public_commenters(self.commenters, self.submissions),
            "question_stats": self.question_stats,
            "gaps": self.gap_table,
            "signals": self.signals,
            "metrics": self.metrics,
            "analyses": self.analyses,
        }

    @cached_property
    def state(self) -> DataFrame:
        """What the next build compares itself with: one row a question."""
        return cut_lineage(self.snapshot(self.synthesis()).withColumn("state_version", F.lit(changes.STATE_VERSION)))

    def synthesis(self) -> DataFrame:
        """The state of each question's analysis, as snapshots hold it."""
        strings = F.array().cast("array<string>")
        return self.analyses.select(
            "question_id", "dominant_response_type", F.coalesce("disagreement.exists", F.lit(False)).alias("disagreement_exists"),
            F.coalesce("disagreement.about", strings).alias("disagreement_about"),
            F.coalesce("stakeholder_divide.exists", F.lit(False)).alias("stakeholder_divide_exists"),
            F.coalesce("saying", F.lit("")).alias("saying"), F.col("status").alias("synthesis_status"),
        )

    def review_queue(self, prior: DataFrame | None) -> DataFrame:
        """Questions that changed since ``prior``; none against no prior state."""
        return changes.review_queue(prior if prior is not None else self.state.limit(0), self.state)

    @cached_property
    def excluded_submissions(self) -> DataFrame:
        silent = assemble.submissions_without_positions(self.submissions, self.linked).select(
            F.col("regulations_gov_comment_id").alias("comment_id"), F.lit(assemble.NO_POSITION_LEFT).alias("reason_code"),
            F.lit(NO_POSITION_TEXT).alias("reason"))
        return assemble.excluded(self.candidates).unionByName(silent)

    @cached_property
    def consolidation_log(self) -> DataFrame:
        return consolidate.consolidation_log(self.clusters)

    def provenance(self) -> DataFrame:
        """What was folded into what, with the links that connect each cluster
        and the analysis it was made from."""
        evidence = consolidate.link_evidence(self.links, self.publishable)
        roots = self.members.select("submission_id", F.col("segment_id").alias("first_segment_id"), "root")
        kept = self.clusters.select("submission_id", "root", "kept_segment_id")
        rows = evidence.join(roots, ["submission_id", "first_segment_id"]).join(kept, ["submission_id", "root"]).drop("root")
        rows = rows.withColumnRenamed("submission_id", "comment_id").withColumn("rule_version", F.lit(consolidate.RULE_VERSION))
        if self.analysis_hashes is None:
            return rows.withColumn("analysis_hash", F.lit(None).cast("string"))
        return rows.join(self.analysis_hashes, "comment_id", "left")

    def publish(self, folder: str, fmt: str = "parquet") -> publication.Publication:
        """Write everything under a folder of its own, then point readers to it.

        Changes are judged against the newest other build published before this
        one; publishing this build again gives the same queue and state.  The
        manifest is made of what was seen while the tables were written."""
        spark = self.candidates.sparkSession
        prior = publication.before(spark, folder, self.build_id)
        written = {
            **self.tables(), "question_state": self.state, "excluded_submissions": self.excluded_submissions,
            "review_queue": self.review_queue(publication.table_of(spark, prior, "question_state") if prior else None),
            "consolidation_log": self.consolidation_log, "without_response_types": self._accepted_without_types(), "quarantine": self.quarantine,
        }
        made = publication.publish(
            written, folder, self.build_id, self.generated_at, lambda seen: self._manifest(seen, prior), fmt, self._measures())
        buckets.replace_changed(self.provenance(), posixpath.join(folder, "provenance"), "comment_id", {"created_at": F.lit(self.generated_at)})
        return made

    def _accepted_without_types(self) -> DataFrame:
        return self.without_types.join(self.accepted.select("comment_id"), "comment_id", "left_semi")

    @staticmethod
    def _measures() -> dict:
        reasons = [assemble.WITHDRAWN, assemble.NO_USABLE_TEXT, assemble.NOT_YET_CLASSIFIED, assemble.NO_POSITION_LEFT]
        return {
            "metrics": [F.max(F.to_json(F.struct(F.col("*")))).alias("counts")],
            "excluded_submissions": [F.count_if(F.col("reason_code") == r).alias(r) for r in reasons],
            "consolidation_log": [F.sum("positions_merged").alias("positions_merged")],
            "analyses": [F.count_if(F.col("status") == s).alias(s) for s in STATUSES],
            "review_queue": [F.array_join(F.array_sort(F.collect_list("question_number")), ",").alias("flagged")],
            "quarantine": [F.count_if(F.col("source") == s).alias(s) for s in landed.FOLDERS],
        }

    def _manifest(self, seen: dict[str, dict], prior: publication.Publication | None) -> dict:
        """One build in numbers.  Lists that grow with the docket are tables of
        the publication; the manifest says how long they are."""
        excluded, merged = seen["excluded_submissions"], seen["consolidation_log"].get("positions_merged") or 0
        dropped = {k: v for k, v in self._dropped.get.items() if k != "rows"}
        reasons = {k: v for k, v in excluded.items() if k != "rows"} | dropped | {"near_duplicate_positions_consolidated": merged}
        flagged = seen["review_queue"].get("flagged") or ""
        return {
            "build_id": self.build_id, "generated_at": self.generated_at, "versions": self.versions,
            "counts": json.loads(seen["metrics"].get("counts") or "{}"),
            "exclusions": {k: v for k, v in sorted(reasons.items()) if v},
            "excluded_submissions": excluded["rows"],
            "consolidation": {
                "rule_version": consolidate.RULE_VERSION, "submissions_affected": seen["consolidation_log"]["rows"], "positions_merged": merged},
            "response_types": {"submissions_without_fresh_response_types": seen["without_response_types"]["rows"]},
            "question_analyses": {s: seen["analyses"].get(s, 0) for s in STATUSES},
            "review_queue": {
                "flagged_questions": [f"q{n}" for n in flagged.split(",") if n], "baseline": prior is None,
                "compared_against": prior.generated_at if prior else None},
            "quarantine": {k: v for k, v in seen["quarantine"].items() if k != "rows" and v},
            "tables": {name: s["rows"] for name, s in sorted(seen.items())},
        }

    def snapshot(self, synthesis: DataFrame | None = None) -> DataFrame:
        return changes.snapshot(self.question_rows, self.questions, synthesis)

    def exclusions(self) -> DataFrame:
        """Counts of everything a build leaves out, by reason."""
        by_submission = assemble.excluded(self.candidates).groupBy(F.col("reason_code").alias("reason")).agg(
            F.count("*").alias("n")
        )
        of_accepted = self.analysis.join(self.accepted.select("comment_id"), "comment_id", "left_semi")
        folded = consolidate.consolidation_counts(self.clusters).select(
            F.lit("near_duplicate_positions_consolidated").alias("reason"), F.col("positions_merged").alias("n")
        )
        silent = assemble.submissions_without_positions(self.submissions, self.linked).agg(
            F.count("*").alias("n")
        ).select(F.lit(assemble.NO_POSITION_LEFT).alias("reason"), "n")
        return by_submission.unionByName(assemble.position_exclusions(of_accepted)).unionByName(folded).unionByName(
            silent
        ).filter("n > 0")

    def violations(self) -> DataFrame:
        published = self.tables()
        return validate.union([
            validate.violations(
                self.questions, published["commenters"], published["submissions"], published["positions"],
                self.question_stats, self.gap_table,
            ),
            validate.summary_rules(self.metrics, published["positions"], published["submissions"]),
            validate.card_rules(self.signals),
            validate.analysis_rules(self.analyses, published["positions"], self.questions),
            *([validate.curated_rules(**self.curated)] if self.curated else []),
        ])


def build(candidates: DataFrame, analysis: DataFrame, questions: DataFrame, **settings) -> Build:
    return Build(candidates, analysis, questions, **settings)
