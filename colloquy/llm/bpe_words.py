"""Byte-pair encoding through a table of distinct words, and decoding.

Documents are dealt to bounded blocks.  Each block sends its distinct words,
dealt by a hash of the word; a word's bucket encodes it once, however many
blocks ask, and answers each block in the order asked.  Blocks then put ids
in the place of words, and decode by joining ids to the pieces of the
vocabulary file (fixed in size).  The vocabulary's path is a parameter; the
file has to be on every executor.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import bpe
from colloquy.llm.blocks import blobs, block_count, from_blob, give_back, hashed_block, pack, to_blob


def _texts(part: pa.Table):
    for chunk in part["text"].chunks:
        for start in range(0, len(chunk), 256):
            yield from chunk.slice(start, 256).to_pylist()


def _numbered(docs: pa.Table) -> bpe.Numbered:
    held = bpe.Numbered()
    for part in blobs(docs):
        for text in _texts(part):
            held.add(text)
    return held


def _dealt(words: list[str], buckets: int) -> dict[int, list[str]]:
    out: dict[int, list[str]] = {}
    for w in words:
        out.setdefault(zlib.crc32(w.encode()) % buckets, []).append(w)
    return out


def _ask(buckets: int):
    def ask(docs: pa.Table) -> pa.Table:
        give_back()
        block = docs["block"][0].as_py()
        dealt = sorted(_dealt(sorted(_numbered(docs).place), buckets).items())
        return pa.table({
            "bucket": pa.array([b for b, _ in dealt], pa.int32()), "block": pa.array([block] * len(dealt), pa.int32()),
            "words": pa.array([to_blob(pa.table({"word": w})) for _, w in dealt], pa.binary()),
        })

    return ask


def _answer(path: str):
    """Encode each distinct word of a bucket once."""

    def answer(asked: pa.Table) -> pa.Table:
        give_back()
        words = [from_blob(w.as_buffer())["word"].combine_chunks() for w in asked["words"]]
        every = pa.concat_arrays(words).dictionary_encode()
        ids = bpe.encode_words(path, every.dictionary.to_pylist())
        place, out = 0, []
        for own in words:
            mine = ids.take(every.indices.slice(place, len(own)))
            place += len(own)
            out.append(to_blob(pa.table({"ids": mine.cast(pa.list_(pa.uint32()))})))
        return pa.table({"block": asked["block"].combine_chunks(), "bucket": asked["bucket"].combine_chunks(), "ids": pa.array(out, pa.binary())})

    return answer


def _encode(path: str, buckets: int, with_ids: bool):
    def encode(docs: pa.Table, answers: pa.Table) -> pa.Table:
        give_back()
        out: dict[str, list] = {"doc_id": [], "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "decoded_equal": [], "ids": []}
        if docs.num_rows:
            held = _numbered(docs)
            dealt = _dealt(sorted(held.place), buckets)
            told = {b: i for i, b in enumerate(answers["bucket"].to_pylist())}
            parts = [from_blob(answers["ids"][told[b]].as_buffer())["ids"].combine_chunks() for b in dealt]
            ids_of = pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.uint32()))
            # From the numbers given here to the order in which the words were asked.
            asked = np.empty(len(held.place), np.int64)
            asked[[held.place[w] for ws in dealt.values() for w in ws]] = np.arange(len(asked))
            texts = iter(held.texts)
            for part in blobs(docs):
                out["doc_id"] += part["doc_id"].to_pylist()
                for text in _texts(part):
                    ids = bpe.text_ids(ids_of, asked[next(texts)])
                    decoded = bpe.decode(path, ids)
                    out["n_tokens"].append(len(ids))
                    out["ids_sha256"].append(hashlib.sha256(ids.tobytes()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
                    out["decoded_equal"].append(decoded == (text or "").encode())
                    out["ids"].append(ids.view(np.int32) if with_ids else None)
            del held, texts, dealt, parts, ids_of, asked
            give_back()
        return pa.table({
            "doc_id": pa.array(out["doc_id"], pa.int64()), "n_tokens": pa.array(out["n_tokens"], pa.int64()),
            "ids_sha256": pa.array(out["ids_sha256"], pa.string()), "decoded_sha256": pa.array(out["decoded_sha256"], pa.string()),
            "decoded_equal": pa.array(out["decoded_equal"], pa.bool_()), "ids": pa.array(out["ids"], pa.list_(pa.int32())),
        })

    return encode


def encode_and_decode(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, ids_sha256, decoded_sha256,
    decoded_equal, ids`` (``ids`` null when ``with_ids`` is off).

    Ids are those of the tokenizers library on the whole text, no special
    tokens added, specials in the text recognised; digests are of the ids as
    little-endian unsigned 32-bit integers and of the decoded text in UTF-8.  A
    null text is an empty one: no ids, the digests of nothing.  Null or repeated
    ids are kept row by row.  Other columns of ``docs`` are not read."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    blocks = block_count(rows, "text")
    packed = pack(rows.withColumn("block", hashed_block(blocks, "doc_id", "text")))
    answers = (
        packed.groupBy("block").applyInArrow(_ask(blocks), "bucket int, block int, words binary")
        .groupBy("bucket").applyInArrow(_answer(vocabulary), "block int, bucket int, ids binary")
    )
    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _encode(vocabulary, blocks, with_ids),
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, decoded_equal boolean, ids array<int>",
    )
