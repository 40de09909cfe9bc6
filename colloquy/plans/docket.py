"""The docket's standard frames, wired once from candidates and positions."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy import vocab
from colloquy.operators import assemble, skew, stats
from colloquy.session import stored
from colloquy.sources import driver_tables


def gap_dimension(spark: SparkSession, explanations: dict | None = None) -> DataFrame:
    """The gap dimension; titles default to the labels."""
    rows = [
        (i, gap, title, (explanations or {}).get(gap, ""))
        for i, (gap, title) in enumerate(vocab.GAPS.items(), start=1)
    ]
    return spark.createDataFrame(rows, "ordinal int, gap_id string, title string, explanation string")


class Docket:
    """Lazily built frames over one set of candidates and analysis positions.

    Nothing runs here: every property is a plan, and plans that read the same
    exchanges share them through Spark's exchange reuse."""

    def __init__(self, candidates: DataFrame, analysis: DataFrame, questions: DataFrame, size: int | None = None):
        self.candidates = candidates
        self.analysis = analysis
        self.questions = questions
        self.size = size  # rows of the analysis, where they are known without running it

    @classmethod
    def from_driver_tables(cls, spark: SparkSession, sf_dir: str) -> "Docket":
        return cls(
            driver_tables.candidates(spark, sf_dir),
            driver_tables.analysis_positions(spark, sf_dir),
            driver_tables.questions(spark),
            # Answered by the files' footers.
            driver_tables.table(spark, sf_dir, "lineitem").count(),
        )

    @cached_property
    def accepted(self) -> DataFrame:
        return assemble.accepted(self.candidates)

    @cached_property
    def commenters(self) -> DataFrame:
        return assemble.commenters(self.accepted)

    @cached_property
    def submissions(self) -> DataFrame:
        return assemble.submissions(self.accepted)

    @cached_property
    def positions(self) -> DataFrame:
        return assemble.built_positions(self.analysis)

    def dealt(self, df: DataFrame, *keys: str) -> DataFrame:
        """``df``, of about as many rows as the analysis, dealt out by ``keys`` so
        that a task's share does not grow with the docket."""
        return skew.dealt_by_size(df, self.size, *keys)

    @cached_property
    def linked(self) -> DataFrame:
        authored = assemble.authored_submissions(self.submissions, self.commenters)
        return assemble.linked_positions(self.dealt(self.positions, "submission_id"), authored)

    def kept(self, *columns: str) -> DataFrame:
        """Columns of the linked positions for readers that each take others of them,
        and so share no exchange: the joins behind them run once."""
        return stored(self.linked.select(*columns), "linked")

    def rolled_up(self, kept: DataFrame) -> DataFrame:
        """Question rows of ``kept`` with what the roll-up counts, dealt by submission
        before they are many."""
        return assemble.question_rows(self.dealt(kept.select("question_ids", *self._COUNTED), "submission_id"), stats.ROLLED_UP)

    _COUNTED = tuple(assemble.QUESTION_ROW[c] for c in stats.ROLLED_UP)

    @cached_property
    def question_rows(self) -> DataFrame:
        return assemble.question_rows(self.linked)

    @cached_property
    def gaps(self) -> DataFrame:
        return gap_dimension(self.candidates.sparkSession)
