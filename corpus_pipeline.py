"""A corpus made ready for training: five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import bpe_words, decontaminate, line_sets, simhash_variants, toxicity
from colloquy.llm.queries import read, toxicity_model, vocabulary_path
from colloquy.llm.shared import shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_harmless(docs, toxicity_model(docs, read(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``n_chars`` follows the text that is left."""
    kept = line_sets.drop_repeated_lines(docs)
    return kept.withColumn("n_chars", _length(kept)) if "n_chars" in kept.columns else kept


def _length(docs: DataFrame):
    return F.length("text").cast(docs.schema["n_chars"].dataType)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies share five-word shingles to 0.8 or more; ``op10_simhash`` has another rule."""
    return simhash_variants.keep_dissimilar(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_words.encode_and_decode(docs, vocabulary_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_copies),
    ("decontamination", drop_benchmark_passages),
    ("bpe", encode),
]

#: No stage but the line join can be put in SQL; the tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written under the shared folder."""
    docs = read(spark, sf_dir, "documents")
    folder = shared_folder(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
