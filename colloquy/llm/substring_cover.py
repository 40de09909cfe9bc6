"""Substring dedup with difference-cover anchors.

Any two equal runs of ``min_words`` words, wherever they start, hold one equal
anchor window that begins at a cover position (modulo the period) in both: a
difference cover has, for every shift, two members that far apart.  So only
windows at cover positions are hashed and exchanged.  Where an anchor recurs,
it is extended: the whole windows around it are compared over all documents
and every one but the first is marked.

Blocks ask and buckets answer as in :mod:`colloquy.llm.blocks`; a passage that
a third of all documents share reaches its bucket once from each block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.blocks import (
    blobs, block_count, hashed_block, pack, slices, squeeze, squeeze_keys, unsqueeze, unsqueeze_keys,
)
from colloquy.llm.rolling import Words, chunks, prefix, spans
from colloquy.session import cut_lineage

#: Perfect difference sets, period to members.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
RECURS, FIRST = 0, 1
NO_ID = np.iinfo(np.int64).min


def cover_for(min_words: int) -> tuple[int, tuple[int, ...]]:
    """The longest period whose anchors keep at least two fifths of the window."""
    fit = [p for p in COVERS if min_words - p + 1 >= max(2, 2 * min_words // 5)]
    return (max(fit), COVERS[max(fit)]) if fit else (1, (0,))


def _texts(part: pa.Table):
    for chunk in part["text"].chunks:
        for start in range(0, len(chunk), 256):
            yield from (None if v is None else v.encode() for v in chunk.slice(start, 256).to_pylist())


class _Chunk:
    """Words of a chunk with prefix sums over word values."""

    def __init__(self, texts: list[bytes], min_words: int):
        self.words = Words(texts)
        self.sums, self.min_words = prefix(self.words.hashes), min_words
        self.n = np.diff(self.words.first)
        self.owner = self.words.owner()
        self.place = np.arange(len(self.owner)) - self.words.first[self.owner] if len(self.owner) else np.zeros(0, np.int64)
        self.left = self.n[self.owner] - self.place if len(self.owner) else np.zeros(0, np.int64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Word indexes of the anchors and their keys."""
        period, cover = cover_for(self.min_words)
        size = self.min_words - period + 1
        chosen = np.isin(np.arange(period), cover)
        at = np.flatnonzero(chosen[self.place % period] & (self.left >= size) & (self.n[self.owner] >= self.min_words))
        return at, spans(self.sums, at, at + size)

    def windows(self, recurring: np.ndarray) -> np.ndarray:
        """Starts of whole windows that hold an anchor marked in ``recurring``
        (one boolean per word)."""
        period, _ = cover_for(self.min_words)
        marked = np.zeros(len(recurring) + period + 1, np.int64)
        np.cumsum(recurring, out=marked[1 : len(recurring) + 1])
        marked[len(recurring) + 1 :] = marked[len(recurring)]
        i = np.arange(len(recurring))
        return np.flatnonzero((marked[i + period] > marked[i]) & (self.left >= self.min_words))

    def identity(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits for each window."""
        end = at + self.min_words
        second = spans(prefix(self.words.hashes, 1), at, end, 1)
        return spans(self.sums, at, end), (second >> np.uint64(32)).astype(np.uint32)


def _ask_anchors(buckets: int, min_words: int):
    def ask(table: pa.Table) -> pa.Table:
        keys, counts = _anchor_counts(table, min_words)
        block = table["block"][0].as_py()
        rows = [
            {"bucket": b, "block": block, "keys": squeeze_keys(keys[s:e]), "many": np.packbits(counts[s:e] > 1).tobytes()}
            for b, s, e in slices(keys, buckets)
        ]
        return pa.Table.from_pylist(rows, pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("many", pa.binary())]))

    return ask


def _anchor_counts(table: pa.Table, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    parts = [_Chunk(texts, min_words).anchors()[1] for part in blobs(table) for _, texts in chunks(_texts(part))]
    return np.unique(np.concatenate(parts or [np.zeros(0, np.uint64)]), return_counts=True)


def _answer_anchors(table: pa.Table) -> pa.Table:
    """A bit for each key of each block: does it occur twice or more in the corpus?"""
    asked = [unsqueeze_keys(k.as_py()) for k in table["keys"]]
    many = np.concatenate([np.unpackbits(np.frombuffer(m.as_py(), np.uint8), count=len(k)) for k, m in zip(asked, table["many"])])
    keys, at, counts = np.unique(np.concatenate(asked), return_inverse=True, return_counts=True)
    recurs = (counts > 1) | (np.bincount(at, many, len(keys)) > 0)
    return _bit_rows(table, recurs[at], [len(k) for k in asked], RECURS)


def _bit_rows(table: pa.Table, bits: np.ndarray, sizes: list[int], kind: int) -> pa.Table:
    ends = np.cumsum([0, *sizes])
    return pa.table({
        "block": table["block"].combine_chunks(), "kind": pa.array([kind] * table.num_rows, pa.int32()), "bucket": table["bucket"].combine_chunks(),
        "bits": pa.array([np.packbits(bits[s:e]).tobytes() for s, e in zip(ends, ends[1:])], pa.binary()),
        "n": pa.array(sizes, pa.int64()),
    })


def _told(answers: pa.Table, kind: int) -> np.ndarray:
    """The bits for a block's keys of one kind, in key order."""
    rows = sorted(
        (b, i) for i, (k, b) in enumerate(zip(answers["kind"].to_pylist(), answers["bucket"].to_pylist())) if k == kind
    )
    parts = [np.unpackbits(np.frombuffer(answers["bits"][i].as_py(), np.uint8), count=answers["n"][i].as_py()) for _, i in rows]
    return np.concatenate(parts or [np.zeros(0, np.uint8)]).astype(bool)


def _marked_chunks(docs: pa.Table, answers: pa.Table, min_words: int):
    """Each chunk with its part, first document and the starts of windows that
    hold a recurring anchor."""
    keys, _ = _anchor_counts(docs, min_words)
    keys = keys[_told(answers, RECURS)]
    for part in blobs(docs):
        for first, texts in chunks(_texts(part)):
            chunk = _Chunk(texts, min_words)
            at, own = chunk.anchors()
            recurring = np.zeros(len(chunk.owner), bool)
            if len(keys):
                found = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                recurring[at[keys[found] == own]] = True
            yield part, first, chunk, chunk.windows(recurring)


def _local_firsts(docs: pa.Table, answers: pa.Table, min_words: int):
    """The distinct candidate windows of a block in key order, each with the
    place where it starts first; a place is (document, tie, word).  Last come
    the numbers of these among all candidates in the order met."""
    fields = ([], [], [], [], [])
    for part, first, chunk, at in _marked_chunks(docs, answers, min_words):
        rows = part.slice(first, len(chunk.n))
        doc = rows["doc_id"].fill_null(NO_ID).to_numpy()
        tie = rows["tie"].to_numpy()
        who = chunk.owner[at]
        key, check = chunk.identity(at)
        for held, values in zip(fields, (key, check, doc[who], tie[who], chunk.place[at].astype(np.int32))):
            held.append(values)
    key, check, doc, tie, place = (
        np.concatenate(held or [np.zeros(0, t)]) for held, t in zip(fields, (np.uint64, np.uint32, np.int64, np.int64, np.int32))
    )
    order = np.lexsort((place, tie, doc, check, key))
    key, check = key[order], check[order]
    lead = np.ones(len(key), bool)
    lead[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
    order = order[lead]
    return key[lead], check[lead], doc[order], tie[order], place[order], order


_FIRST_FIELDS = (("checks", np.uint32), ("docs", np.int64), ("ties", np.int64), ("places", np.int32))


def _ask_firsts(buckets: int, min_words: int):
    schema = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("keys", pa.binary())] + [(n, pa.binary()) for n, _ in _FIRST_FIELDS])

    def ask(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        keys, *rest, _ = _local_firsts(docs, answers, min_words)
        block = docs["block"][0].as_py()
        rows = [
            {"bucket": b, "block": block, "keys": squeeze_keys(keys[s:e])} | {n: squeeze(v[s:e]) for (n, _), v in zip(_FIRST_FIELDS, rest)}
            for b, s, e in slices(keys, buckets)
        ]
        return pa.Table.from_pylist(rows, schema)

    return ask


def _answer_firsts(table: pa.Table) -> pa.Table:
    """A bit for each block's window: does it start first here, over all blocks?"""
    asked = [unsqueeze_keys(k.as_py()) for k in table["keys"]]
    key = np.concatenate(asked)
    check, doc, tie, place = (np.concatenate([unsqueeze(v.as_py(), t) for v in table[n]]) for n, t in _FIRST_FIELDS)
    order = np.lexsort((place, tie, doc, check, key))
    k, c = key[order], check[order]
    lead = np.ones(len(k), bool)
    lead[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    bits = np.zeros(len(k), bool)
    bits[order[lead]] = True
    return _bit_rows(table, bits, [len(a) for a in asked], FIRST)


def set_bits(numbers: np.ndarray):
    """``stays(start, end)``: which numbers of the range are in ``numbers``."""
    numbers = np.sort(numbers)

    def stays(start: int, end: int) -> np.ndarray:
        out = np.zeros(end - start, bool)
        s, e = np.searchsorted(numbers, (start, end))
        out[numbers[s:e] - start] = True
        return out

    return stays


def _remove(min_words: int, with_text: bool):
    def remove(docs: pa.Table, answers: pa.Table) -> pa.Table:
        out = {"doc_id": [], "n_words": [], "n_removed": [], "kept_sha256": [], "kept_text": []}
        if docs.num_rows:
            *_, order = _local_firsts(docs, answers, min_words)
            stays = set_bits(order[_told(answers, FIRST)])
            met = 0
            for part, begin, chunk, at in _marked_chunks(docs, answers, min_words):
                ids = part["doc_id"].slice(begin, len(chunk.n)).to_pylist()
                covered = np.zeros(len(chunk.owner) + min_words + 1, np.int64)
                later = ~stays(met, met + len(at))
                met += len(at)
                starts = at[later]
                np.add.at(covered, starts, 1)
                np.add.at(covered, starts + min_words, -1)
                gone = np.cumsum(covered)[: len(chunk.owner)] > 0
                raw, words = chunk.words.buf.tobytes(), chunk.words
                for d, (s, e) in enumerate(zip(words.first.tolist(), words.first[1:].tolist())):
                    kept = np.flatnonzero(~gone[s:e]) + s
                    text = b" ".join([raw[a:b] for a, b in zip(words.starts[kept].tolist(), words.ends[kept].tolist())])
                    out["doc_id"].append(ids[d])
                    out["n_words"].append(e - s)
                    out["n_removed"].append(e - s - len(kept))
                    out["kept_sha256"].append(hashlib.sha256(text).hexdigest())
                    out["kept_text"].append(text.decode() if with_text else None)
        return pa.table({
            "doc_id": pa.array(out["doc_id"], pa.int64()), "n_words": pa.array(out["n_words"], pa.int64()),
            "n_removed": pa.array(out["n_removed"], pa.int64()), "kept_sha256": pa.array(out["kept_sha256"], pa.string()),
            "kept_text": pa.array(out["kept_text"], pa.string()),
        })

    return remove


def remove_repeats(docs: DataFrame, min_words: int = 20, doc_id: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """Remove every word covered by a window of ``min_words`` words that also
    starts earlier: in a smaller document id, or earlier in the same document.

    One row per document: ``doc_id, n_words, n_removed, kept_sha256,
    kept_text`` (kept words joined by one space; null when ``with_text`` is
    off).  Windows are judged on the input.  A null or empty text has no words
    and keeps the empty text.  A null id comes before all others.  Rows with
    one id come in the order of a hash of their texts; of rows alike in both,
    one keeps its words.  Other columns of ``docs`` are not read."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("tie"))
    blocks = block_count(rows, "text")
    packed = pack(rows.withColumn("block", hashed_block(blocks, "doc_id", "text")))
    bits = "block int, kind int, bucket int, bits binary, n long"
    recurring = cut_lineage(
        packed.groupBy("block").applyInArrow(_ask_anchors(blocks, min_words), "bucket int, block int, keys binary, many binary")
        .groupBy("bucket").applyInArrow(_answer_anchors, bits)
    )
    firsts = cut_lineage(
        packed.groupBy("block").cogroup(recurring.groupBy("block"))
        .applyInArrow(_ask_firsts(blocks, min_words), "bucket int, block int, keys binary, checks binary, docs binary, ties binary, places binary")
        .groupBy("bucket").applyInArrow(_answer_firsts, bits)
    )
    return packed.groupBy("block").cogroup(recurring.unionByName(firsts).groupBy("block")).applyInArrow(
        _remove(min_words, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    )
