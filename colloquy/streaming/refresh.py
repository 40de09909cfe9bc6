"""Scheduled refreshes as Structured Streaming over landed files.

A refresh takes what arrived since the last one (``availableNow``) and stops.
Writes are keyed by batch id: a replayed batch replaces its own part, so a
restart leaves the same tables.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import changes
from colloquy.operators.freshness import latest_versions
from colloquy.session import cut_lineage
from colloquy.sources import tables
from colloquy.sources.buckets import BUCKETS
from colloquy.streaming import versions


def _run(incoming: DataFrame, store, checkpoint: str):
    query = incoming.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def refresh_comments(spark: SparkSession, landed: str, schema: str, log: str, checkpoint: str, fmt: str = "json",
                     key: str = "comment_id", order: str = "last_modified_date", on_batch=None, buckets: int = BUCKETS, **options):
    """Stream landed comments into the version log; returns the finished query.

    ``on_batch(new_rows, batch_id)`` runs after each batch is stored."""
    incoming = spark.readStream.schema(schema).options(**options).format(fmt).load(landed)

    def store(batch: DataFrame, batch_id: int) -> None:
        fresh, _ = versions.append(batch, batch_id, log, key, order, buckets)
        if on_batch is not None:
            on_batch(fresh, batch_id)

    return _run(incoming, store, checkpoint)


def question_rows(analyses: DataFrame) -> DataFrame:
    """(position, question) rows of analysis records: ``comment_id,
    commenter_id, stakeholder_type, positions``."""
    rows = analyses.select("comment_id", "commenter_id", "stakeholder_type", F.inline("positions"))
    return rows.select(
        F.explode("question_ids").alias("question_id"), F.concat_ws("-", F.lit("p"), F.lower("comment_id"), "segment_id").alias("position_id"),
        "commenter_id", "stakeholder_type", "response_type", "primary_issue",
    )


def touched_questions(new: DataFrame, old: DataFrame | None) -> DataFrame:
    """Questions that changed records are on now, or were on before."""
    every = F.array_distinct(F.flatten(F.transform("positions", lambda p: p["question_ids"])))
    asked = new.select(F.explode(every).alias("question_id"))
    if old is not None:
        asked = asked.unionByName(old.join(new.select("comment_id"), "comment_id", "left_semi").select(F.explode(every).alias("question_id")))
    return asked.distinct()


def refresh_analyses(spark: SparkSession, landed: str, schema: str, log: str, snapshots: str, queue: str, questions: DataFrame, checkpoint: str,
                     fmt: str = "json", key: str = "comment_id", order: str = "last_modified_date", buckets: int = BUCKETS, **options):
    """Stream analysis records into the version log and, in the same batch,
    bring the snapshots of the questions they touch up to date.

    The touched questions come from the batch itself: the question sets of its
    new versions, and of the versions they replace.  Every step is keyed by the
    batch id and reads only what earlier batches stored, so a batch that is
    replayed, whole or from the middle, leaves the same tables."""
    incoming = spark.readStream.schema(schema).options(**options).format(fmt).load(landed)
    return _run(incoming, lambda batch, batch_id: apply_analyses(batch, batch_id, log, snapshots, queue, questions, key, order, buckets), checkpoint)


def apply_analyses(batch: DataFrame, batch_id: int, log: str, snapshots: str, queue: str, questions: DataFrame,
                   key: str = "comment_id", order: str = "last_modified_date", buckets: int = BUCKETS) -> None:
    """One batch of ``refresh_analyses``."""
    spark = batch.sparkSession
    fresh, hit = versions.append(batch, batch_id, log, key, order, buckets)
    if fresh.isEmpty():
        return
    touched = cut_lineage(touched_questions(fresh, versions.earlier(spark, log, batch_id, hit, key, order)))
    # As of this batch: a replay does not see what later batches brought.
    stored = versions.log(spark, log).filter(F.col("batch") <= batch_id).drop("bucket", "batch")
    update_snapshots(question_rows(latest_versions(stored, key, order)), questions, touched, batch_id, snapshots, queue)


def update_snapshots(rows: DataFrame, questions: DataFrame, touched: DataFrame, batch_id: int, snapshot_log: str,
                     queue_log: str, synthesis: DataFrame | None = None) -> None:
    """Recompute snapshots of the touched questions and log their changes.

    ``rows`` are all current (position, question) rows; only those of touched
    questions are read further.  Snapshots are versioned by batch, the queue is
    keyed by (question, batch)."""
    spark = rows.sparkSession
    asked = touched.select("question_id").distinct()
    new = cut_lineage(changes.snapshot(
        rows.join(asked, "question_id", "left_semi"), questions.join(asked, "question_id", "left_semi"), synthesis
    ))
    if tables.exists(spark, snapshot_log):
        stored = spark.read.parquet(snapshot_log).filter(F.col("batch") < batch_id)
        prior = latest_versions(stored, "question_id", "batch").drop("batch")
        queue = changes.review_queue(prior, new)
        queue.write.mode("overwrite").parquet(posixpath.join(queue_log, f"batch={batch_id}"))
    new.write.mode("overwrite").parquet(posixpath.join(snapshot_log, f"batch={batch_id}"))
