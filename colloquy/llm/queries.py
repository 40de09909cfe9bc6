"""The operators as queries over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import (
    bpe_words, collision_search, decontaminate, hard_negatives, interpolated_lm, line_sets, quality_rules, simhash_variants, spelling_variants,
    substring_cover, token_files, toxicity, url_rules,
)
from colloquy.llm.shared import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: The rules that ``op2_url_filters`` is asked to apply.
RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path() -> str:
    """Where the installed public vocabulary lies; on every machine alike."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def remainder(doc_id: str, by: int) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(by))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Learned only from documents outside the held-out fifth."""
    return toxicity.fit(docs.filter(remainder("doc_id", 5) != 0), labels)


@query
def op1_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = toxicity_model(docs, read(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), toxicity.toxicity(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query
def op2_url_filters(spark, sf_dir):
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return url_rules.judge(read(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


@query
def op3_bpe(spark, sf_dir):
    out = bpe_words.encode_and_decode(read(spark, sf_dir, "documents"), vocabulary_path(), with_ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded_equal")


@query
def op4_substring_dedup(spark, sf_dir):
    out = substring_cover.remove_repeats(read(spark, sf_dir, "documents"), min_words=20, with_text=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op5_decontamination(spark, sf_dir):
    return decontaminate.find_passages(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op6_nearest_neighbours(spark, sf_dir):
    return collision_search.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query
def op7_language_model(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    scored = interpolated_lm.score_documents(docs, remainder("doc_id", 7) != 2)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op8_line_dedup(spark, sf_dir):
    return line_sets.line_report(read(spark, sf_dir, "documents"))


@query
def op9_token_files(spark, sf_dir):
    folder = shared_folder(spark, "tokens")
    token_files.write_tokens(read(spark, sf_dir, "documents"), folder, vocabulary_path())
    return token_files.checksums(token_files.read_tokens(spark, folder))


@query
def op10_simhash(spark, sf_dir):
    return simhash_variants.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op11_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


@query
def op12_spelling_variants(spark, sf_dir):
    counts = spelling_variants.count_words(read(spark, sf_dir, "documents"), slip=97)
    return spelling_variants.variants(counts.filter("n >= 3"))


def quality_model(docs: DataFrame, labels: DataFrame) -> quality_rules.Model:
    """Learned only from documents outside the held-out quarter."""
    return quality_rules.fit(docs.filter(remainder("doc_id", 4) != 2), labels)


@query
def op13_quality(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = quality_model(docs, read(spark, sf_dir, "labels"))
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    scored = quality_rules.scored(docs, model).select("doc_id", held_out, "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
