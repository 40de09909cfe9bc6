"""Documents dealt to blocks of bounded size, and sorted keys exchanged between them.

A block holds about ``BLOCK_CHARS`` characters, whatever the corpus, so a task
that works on one block has bounded memory.  Blocks are packed before the
shuffle (compressed Arrow streams): text crosses the network once per use at a
third of its size.

Blocks that need corpus-wide facts about their keys send each distinct key
once, in key order, cut by key range into as many buckets as there are blocks.
A bucket sees every block's slice of its range and answers each slice in the
order in which it came, so answers carry no keys.  However often a key occurs,
a bucket receives it at most once from each block.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_CHARS = 16 << 20
CODEC, LEVEL = "zstd", 6


def block_count(docs: DataFrame, text: str, block_chars: int = BLOCK_CHARS) -> int:
    """Blocks for the whole text; one for none."""
    total = docs.agg(F.sum(F.length(text).cast("long") + 16)).first()[0] or 0
    return max(1, -(-total // block_chars))


def hashed_block(blocks: int, *cols: str) -> Column:
    """An even deal: rows alike in every column share a block, others part."""
    return F.pmod(F.xxhash64(*cols), F.lit(blocks)).cast("int")


def pack(df: DataFrame, assign=None, level: int = LEVEL) -> DataFrame:
    """``(block, blob)`` rows from rows with an int column ``block``, or from
    any rows with ``assign(table)`` giving a block number for each."""

    def rows(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            block = table["block"].to_numpy() if assign is None else assign(table)
            order = np.argsort(block, kind="stable")
            table, block = table.drop_columns("block" if assign is None else []).take(pa.array(order)), block[order]
            cuts = np.flatnonzero(np.diff(block, prepend=block[:1] - 1)) if len(block) else []
            for at, end in zip(cuts, [*cuts[1:], len(block)]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block[at]], pa.int32()), pa.array([to_blob(table.slice(at, end - at), level)], pa.binary())],
                    ["block", "blob"],
                )

    return df.mapInArrow(rows, "block int, blob binary")


def give_back() -> None:
    """Hand freed memory to the system: Python workers serve one task after the
    other, and Arrow and the C library keep what a large block took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # glibc
        trim(0)


def to_blob(table: pa.Table, level: int = LEVEL) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec(CODEC, compression_level=level))) as writer:
        writer.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def from_blob(blob) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all()


def blobs(table: pa.Table, name: str = "blob"):
    """The packed parts of a group one by one, so that one is unpacked at a time."""
    for chunk in table[name].chunks:
        for value in chunk:
            yield from_blob(value.as_buffer())


def squeeze(values: np.ndarray) -> bytes:
    """Compress a numeric array byte plane by byte plane."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes() if len(values) else b""
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec=CODEC, asbytes=True) if raw else b"")


def unsqueeze(data: bytes, dtype) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    if not size:
        return np.zeros(0, dtype)
    raw = pa.decompress(data[8:], decompressed_size=size, codec=CODEC, asbytes=True)
    item = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(item, -1).T).view(dtype).ravel()


def squeeze_keys(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys, as differences."""
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def unsqueeze_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(data, np.uint64), dtype=np.uint64)


def slices(keys: np.ndarray, buckets: int):
    """``(bucket, start, end)`` of ascending keys cut into equal ranges of the key space."""
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
    return [(b, s, e) for b, (s, e) in enumerate(zip(cuts, cuts[1:])) if e > s]
