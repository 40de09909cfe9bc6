"""Read landed comments, their text and stage records."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from colloquy import schemas
from colloquy.functions import text as T


def raw_comments(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON document per comment.  The schema is given, so nothing is
    inferred and attributes outside the allow-list are never read.  A file that
    is not whole JSON fails the read: it never becomes a row without an id."""
    return (
        spark.read.schema(schemas.RAW_COMMENT)
        .option("mode", "FAILFAST")
        .option("multiLine", True)
        .option("pathGlobFilter", "*.json")
        .json(folder)
        .withColumnRenamed("regulations_gov_comment_id", "comment_id")
    )


def _stem(suffix: str) -> Column:
    name = F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1)
    return F.url_decode(F.regexp_replace(name, suffix, ""))


def text_meta(spark: SparkSession, folder: str) -> DataFrame:
    return (
        spark.read.schema(schemas.TEXT_META).option("multiLine", True).option("mode", "FAILFAST")
        .option("pathGlobFilter", "*.meta.json").json(folder)
    )


def raw_text(spark: SparkSession, folder: str) -> DataFrame:
    """Whole text files as ``comment_id, text``."""
    files = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    return files.select(_stem(r"\.txt$").alias("comment_id"), F.col("value").alias("text"))


def with_text(comments: DataFrame, texts: DataFrame, meta: DataFrame) -> DataFrame:
    """Comments with their text (empty when there is none) and usability."""
    return (
        comments.join(texts, "comment_id", "left")
        .join(meta.select("comment_id", "usable", "content_hash", "exclusion_reason"), "comment_id", "left")
        .withColumn("text", F.coalesce("text", F.lit("")))
        .withColumn("usable", F.coalesce("usable", F.lit(False)))
    )


def stage(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Stage records, one JSON document each; a broken one fails the read."""
    reader = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST")
    return reader.option("pathGlobFilter", "*.json").json(folder)


def stage_rows(records: DataFrame) -> DataFrame:
    """The ``positions`` of stage records as rows, envelope kept."""
    return records.select("comment_id", "input_hash", "prompt_version", "processing_version", "model",
                          F.inline("positions"))


def kept_attributes(raw: DataFrame, attributes: str = "attributes") -> DataFrame:
    """Reduce an attribute struct to the allow-list; what is absent stays null."""
    present = set(raw.schema[attributes].dataType.fieldNames())
    kept = [F.col(f"{attributes}.{a}").alias(a) for a in schemas.KEPT_ATTRIBUTES if a in present]
    return raw.withColumn(attributes, F.struct(*kept))


def attachment_rows(comments: DataFrame) -> DataFrame:
    """One row per attachment and file format with an address.

    Input: ``comment_id`` and ``included``, an array of items of which those of
    ``type`` "attachments" count; their ``fileFormats`` hold ``format``, ``size``
    and ``fileUrl``."""
    every = comments.select("comment_id", F.posexplode("included").alias("item_no", "item"))
    items = every.filter("item.type = 'attachments'").select(
        "comment_id", "item_no", "item.id", "item.title", F.posexplode("item.fileFormats").alias("format_no", "f")
    )
    url = F.col("f.fileUrl")
    # Without a format name the part after the last dot of the address counts.
    suffix = F.regexp_extract(url, r"([^.]*)$", 1)
    kind = F.lower(F.coalesce(F.nullif(F.col("f.format"), F.lit("")), suffix))
    extension = F.concat(F.lit("."), F.regexp_replace(kind, r"^\.+|\.+$", ""))
    return items.filter(F.coalesce(url, F.lit("")) != "").select(
        "comment_id", "item_no", "format_no", F.col("id").alias("attachment_id"), "title",
        F.col("f.format").alias("format"), F.col("f.size").alias("size"), url.alias("file_url"), extension.alias("extension"),
        F.concat_ws("/", "comment_id", F.concat("id", extension)).alias("local_path"),
    )


def decode_bytes(content: bytes | None) -> str:
    """UTF-8, else UTF-16, else Latin-1."""
    for encoding in ("utf-8", "utf-16"):
        try:
            return bytes(content or b"").decode(encoding)
        except UnicodeDecodeError:
            continue
    return bytes(content or b"").decode("latin-1")


@F.pandas_udf(StringType())
def _decode(content: pd.Series) -> pd.Series:
    return content.map(decode_bytes)


def extract_text(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Text of plain-text files as ``status, text, error``; other formats are
    reported as unsupported, empty text as an error.  Nothing is dropped.

    Valid UTF-8 is decoded natively; Python sees the bytes of other text files
    only, and null for everything else."""
    extension = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    supported = extension == ".txt"
    as_utf8 = F.col(content).cast("string")
    valid = F.coalesce(F.is_valid_utf8(as_utf8), F.lit(True))
    other = _decode(F.when(supported & ~valid, F.col(content)))
    raw = F.coalesce(F.when(valid, as_utf8).otherwise(other), F.lit(""))
    text = F.when(supported, T.normalize(raw)).otherwise(F.lit(""))
    return files.withColumn("text", text).withColumns({
        "status": F.when(~supported, F.lit("unsupported")).when(F.col("text") == "", F.lit("error")).otherwise(F.lit("ok")),
        "error": F.when(~supported, F.concat(F.lit("unsupported format "), extension)).when(
            F.col("text") == "", F.lit("no extractable text (scanned image?)")
        ),
    })


def read_attachments(spark: SparkSession, folder: str) -> DataFrame:
    """Attachment files as ``comment_id, attachment_id, path, content``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    parts = F.split("path", "/")
    return files.select(
        F.try_element_at(parts, F.lit(-2)).alias("comment_id"),
        F.regexp_replace(F.try_element_at(parts, F.lit(-1)), r"\.[^.]*$", "").alias("attachment_id"),
        "path", "content",
    )


def assembled_text(bodies: DataFrame, attachments: DataFrame) -> DataFrame:
    """Canonical text of each comment: the body, then every readable attachment
    under a line with its title, with the usability verdict.

    ``bodies``: comment_id, body.  ``attachments``: comment_id, ord, id, title,
    status, text."""
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("id"))
    part = F.concat(F.lit("[Attachment: "), title, F.lit("]\n"), F.col("text"))
    parts = attachments.filter("status = 'ok'").groupBy("comment_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", part.alias("part")))), lambda p: p["part"]).alias("parts")
    )
    body = T.normalize(F.coalesce("body", F.lit("")))
    joined = bodies.withColumn("body", body).join(parts, "comment_id", "left")
    every = F.concat(
        F.when(F.col("body") != "", F.array("body")).otherwise(F.array().cast("array<string>")),
        F.coalesce("parts", F.array().cast("array<string>")),
    )
    usable = T.is_usable(F.col("body"), F.col("text"))
    return joined.withColumn("text", F.array_join(every, "\n\n")).select(
        "comment_id", "text", T.content_hash(F.col("text")).alias("content_hash"),
        F.length("body").alias("body_chars"), F.length("text").alias("total_chars"), usable.alias("usable"),
        F.when(~usable, F.lit("no usable text extracted")).alias("exclusion_reason"),
    )
