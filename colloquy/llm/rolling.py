"""Vectorised word spans and span hashes inside tasks.

A span's hash is a polynomial over 64-bit values, taken from prefix sums, so
that every span of a chunk costs two look-ups whatever its length.  Chunks are
bounded (``CHUNK_BYTES``, or one longer document), so memory is too.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

CHUNK_BYTES = 1 << 20
_MASK = (1 << 64) - 1
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole 64-bit word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _power_tables(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    up, down = _powers.get(which, (np.ones(0, np.uint64), np.ones(0, np.uint64)))
    if len(up) < n:
        size = max(n, 2 * len(up), 1 << 16)
        tables = []
        for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        up, down = _powers[which] = tuple(tables)
    return up, down


def prefix(values: np.ndarray, which: int = 0) -> np.ndarray:
    up, _ = _power_tables(len(values) + 1, which)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:], dtype=np.uint64)
    return out


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of ``values[start:end]``, equal for equal contents anywhere."""
    _, down = _power_tables(len(sums) + 1, which)
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of some documents (UTF-8 bytes).

    ``starts``/``ends`` are byte places in ``buf``; ``first[d]:first[d + 1]``
    are the words of document ``d``; ``hashes`` has one value per word."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        if lower:
            buf = buf | (((buf >= 65) & (buf <= 90)).astype(np.uint8) << 5)
        blank = ((buf == 32) | ((buf >= 9) & (buf <= 13))).view(np.int8)
        turn = np.diff(blank, prepend=np.int8(1))
        self.buf, self.starts, self.ends = buf, np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)
        places = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=places[1:])
        self.first = np.searchsorted(self.starts, places)
        self.hashes = spans(prefix(BYTE_VALUES[buf]), self.starts, self.ends)

    def owner(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def chunks(texts: Iterable[bytes | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of documents of about ``CHUNK_BYTES``, with the index of the first; null is empty."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        text = text or b""
        if held and size + len(text) > CHUNK_BYTES:
            yield first, held
            first, held, size = i, [], 0
        held.append(text)
        size += len(text) + 1
    if held:
        yield first, held
