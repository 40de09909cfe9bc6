"""Token ids as Parquet list columns, in document order.

Documents are dealt to blocks by ranges of their id, so each block is a
contiguous stretch of the output and becomes its own folder; nothing of the
size of the ids is shuffled.  Row groups and pages are sized by parameters;
list elements are delta-encoded (or dictionary-encoded), and the format's page
indexes let a reader fetch the metadata columns, or some documents' tokens,
without the rest.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.llm import bpe
from colloquy.llm.blocks import blobs, block_count, pack
from colloquy.llm.shared import shared_folder

NO_ID = np.iinfo(np.int64).min
BLOCK_CHARS = 12 << 20
SAMPLE_PER_BLOCK, SAMPLE_MOST = 1024, 1_000_000
WORDS_AT_ONCE = 1 << 18
#: Text crosses the network once, so it is packed quickly; rows of a batch that a task hands back.
PACKING, ROWS_AT_ONCE = 2, 512


def _bounds(rows: DataFrame, blocks: int) -> list[tuple[int, int]]:
    """Upper ends of all blocks but the last, from a sample of places weighted
    by text size (at most about ``SAMPLE_MOST`` rows; they shape the blocks, not
    the result)."""
    if blocks == 1:
        return []
    n = rows.count()
    share = min(1.0, min(SAMPLE_PER_BLOCK * blocks, SAMPLE_MOST) / max(n, 1))
    seen = rows.select("doc_id", "tie", F.length("text").alias("n")).sample(share, 17).collect()
    seen = sorted((NO_ID if r.doc_id is None else r.doc_id, r.tie, (r.n or 0) + 16) for r in seen)
    if not seen:
        return []
    weight = np.cumsum([s[2] for s in seen])
    at = np.searchsorted(weight, weight[-1] * np.arange(1, blocks) / blocks)
    return sorted({seen[i][:2] for i in at.tolist()})


def _by_range(bounds: list[tuple[int, int]]):
    def assign(table: pa.Table) -> np.ndarray:
        places = zip(table["doc_id"].fill_null(NO_ID).to_pylist(), table["tie"].to_pylist())
        return np.array([bisect.bisect_left(bounds, p) for p in places], np.int32)

    return assign


def _flat(ids_of: pa.ListArray, number: np.ndarray) -> np.ndarray:
    """The ids of words, one after the other, put together in slices: what is
    needed besides the result does not grow with the block."""
    offsets, values = ids_of.offsets.to_numpy(), ids_of.values.to_numpy()
    sizes = np.diff(offsets)
    cuts = range(0, len(number), WORDS_AT_ONCE)
    out, at = np.empty(sum(int(sizes[number[s : s + WORDS_AT_ONCE]].sum()) for s in cuts), np.int32), 0
    for s in cuts:
        own = number[s : s + WORDS_AT_ONCE]
        n = sizes[own]
        ends = np.cumsum(n)
        place = np.repeat(offsets[own] - ends + n, n)
        place += np.arange(len(place), dtype=place.dtype)
        out[at : at + len(place)] = values[place].view(np.int32)
        at += len(place)
    return out


def _encode(path: str, end_id: int | None):
    """Encode a block: each of its distinct words once.  The end id is one more
    word behind each document's own."""

    def encode(docs: pa.Table) -> pa.Table:
        block = docs["block"][0].as_py()
        rows = pa.concat_tables(blobs(docs)).combine_chunks()
        rows = rows.append_column("place", rows["doc_id"].fill_null(NO_ID)).sort_by([("place", "ascending"), ("tie", "ascending")])
        words, first = bpe.cut(rows["text"].combine_chunks())
        doc_id = rows["doc_id"].combine_chunks()
        number = words.dictionary_encode()
        del rows, words
        ids_of = bpe.encode_distinct(path, number.dictionary)
        number = number.indices.to_numpy()
        if end_id is not None:
            number = np.insert(number, first[1:], len(ids_of))
            first = first + np.arange(len(first))
            ids_of = pa.concat_arrays([ids_of, pa.array([[end_id]], ids_of.type)])
        sizes = np.append(np.int64(0), np.cumsum(np.diff(ids_of.offsets.to_numpy())[number], dtype=np.int64))
        offsets = sizes[first]
        flat = _flat(ids_of, number)
        del number, ids_of, sizes
        whole = pa.table({
            "doc_id": doc_id,
            "ordinal": pa.array(np.arange(len(doc_id)), pa.int64()),
            "start_in_block": pa.array(offsets[:-1], pa.int64()),
            "n_tokens": pa.array(np.diff(offsets), pa.int64()),
            "tokens": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)),
            "block": pa.array(np.full(len(doc_id), block), pa.int32()),
        })
        return pa.concat_tables([whole.slice(i, ROWS_AT_ONCE) for i in range(0, len(whole), ROWS_AT_ONCE)] or [whole])

    return encode


def write_tokens(
    docs: DataFrame, path: str, vocabulary: str, end_id: int | None = 0, doc_id: str = "doc_id", text: str = "text",
    encoding: str = "delta", row_group_bytes: int = 16 << 20, page_bytes: int = 64 << 10, page_rows: int = 1000,
) -> None:
    """Write ``doc_id, ordinal, start_in_block, n_tokens, tokens`` under ``path``,
    ascending by document id across the folders ``block=<n>`` and within each.

    A null text is an empty one (the end id alone).  A null id comes first; rows
    with one id come in the order of a hash of their texts.  An empty table
    leaves a folder without rows.  Other columns of ``docs`` are not read."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("tie"))
    bounds = _bounds(rows, block_count(rows, "text", BLOCK_CHARS))
    encoded = pack(rows, _by_range(bounds), PACKING).groupBy("block").applyInArrow(
        _encode(vocabulary, end_id), "doc_id long, ordinal long, start_in_block long, n_tokens long, tokens array<int>, block int"
    )
    writer = encoded.write.partitionBy("block").option("compression", "zstd").option("parquet.block.size", row_group_bytes)
    writer = writer.option("parquet.page.size", page_bytes).option("parquet.page.row.count.limit", page_rows)
    if encoding == "delta":
        writer = writer.option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "false")
    writer.parquet(path)


SCHEMA = "doc_id long, ordinal long, start_in_block long, n_tokens long, tokens array<int>, block int"


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows written, with ``start``: how many ids all documents before hold.
    Block offsets come from the metadata columns alone: one small row a block,
    written first, so that Spark sees their size and shuffles no tokens while
    they are small."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    sizes = rows.groupBy("block").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    folder = shared_folder(spark, "block-offsets")
    sizes.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")).write.parquet(folder)
    offsets = spark.read.schema("block int, offset long").parquet(folder)
    return rows.join(offsets, "block").select(
        "doc_id", "block", "ordinal", (F.col("offset") + F.col("start_in_block")).alias("start"), "n_tokens", "tokens"
    )


def checksums(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of rows read back: the CRC of the
    ids as little-endian unsigned 32-bit integers."""

    def rows(batches):
        for batch in batches:
            lists = batch["tokens"]
            offsets, data = lists.offsets.to_pylist(), lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            crc = [zlib.crc32(data[s:e].tobytes()) for s, e in zip(offsets, offsets[1:])]
            n = [e - s for s, e in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["start"], pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return tokens.select("doc_id", "start", "tokens").mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")
