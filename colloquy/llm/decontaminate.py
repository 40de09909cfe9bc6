"""Benchmark passages in documents, up to a budget of edits, by the q-gram lemma.

An item of n characters that occurs with at most k edits shares at least
n - q + 1 - k q of its q-grams with the place, all within k + 1 neighbouring
diagonals.  Shared q-grams are counted in overlapping bands of diagonals; bands
that reach the bound are kept, and an alignment confined to the band decides.

Items are taken in blocks of bounded size, each sent to all tasks; documents
stay where they are and are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Q, EDIT_SHARE = 10, 0.06
BLOCK_CHARS = 1 << 20
_TABLE_BITS = 22
_CLASS = 1.2
_STEP = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
MATCH = "array<struct<item_id:bigint,start:int,end:int,edits:int,shared:int>>"


def normalized(text: str | None) -> str:
    """Lower case, white space squeezed to single blanks."""
    return " ".join((text or "").lower().split())


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(points: np.ndarray, q: int) -> np.ndarray:
    if len(points) < q:
        return np.zeros(0, np.uint64)
    out = points[: len(points) - q + 1].astype(np.uint64)
    for i in range(1, q):
        out *= _BASE
        out += points[i : len(points) - q + 1 + i]
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(31))


@dataclass
class Items:
    """A block of benchmark items with the places of their q-grams."""

    ids: np.ndarray
    texts: list[str]
    points: list[np.ndarray]
    budgets: np.ndarray
    bounds: np.ndarray
    keys: np.ndarray  # ascending, with repeats
    item: np.ndarray
    offset: np.ndarray
    present: np.ndarray
    classes: list[tuple[int, int]]  # (least bound, longest reach) of items of like length

    @classmethod
    def of(cls, rows: list[tuple[int, str]], q: int = Q, edit_share: float = EDIT_SHARE) -> Items:
        rows = sorted((i, t) for i, t in {(i, normalized(t)) for i, t in rows} if len(t) >= q)
        points = [_points(t) for _, t in rows]
        lengths = np.array([len(p) for p in points], np.int64)
        budgets = np.minimum((edit_share * lengths).astype(np.int64), (lengths - q) // q)
        bounds = lengths - q + 1 - budgets * q
        grams = [_grams(p, q) for p in points]
        keys = np.concatenate(grams or [np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(points)), [len(g) for g in grams]) if grams else np.zeros(0, np.int64)
        offset = np.concatenate([np.arange(len(g)) for g in grams] or [np.zeros(0, np.int64)])
        order = np.argsort(keys, kind="stable")
        present = np.zeros(1 << _TABLE_BITS, bool)
        present[keys >> np.uint64(64 - _TABLE_BITS)] = True
        level = (np.log(np.maximum(lengths, 1)) / np.log(_CLASS)).astype(int) if len(lengths) else []
        classes = [(int(bounds[level == c].min()), int((lengths + budgets)[level == c].max())) for c in sorted(set(level))]
        return cls(np.array([i for i, _ in rows], np.int64), [t for _, t in rows], points, budgets, bounds, keys[order], item[order], offset[order], present, classes)

    def hits(self, points: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in the document whose q-gram some item has, and the q-grams."""
        at, found = [], []
        for start in range(0, len(points) - q + 1, _STEP):
            grams = _grams(points[start : start + _STEP + q - 1], q)
            maybe = np.flatnonzero(self.present[grams >> np.uint64(64 - _TABLE_BITS)])
            keys = grams[maybe]
            place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            real = self.keys[place] == keys
            at.append(maybe[real] + start)
            found.append(keys[real])
        return np.concatenate(at), np.concatenate(found)

    def dense(self, at: np.ndarray) -> np.ndarray:
        """Hits in a stretch with enough hits for some item of a length class:
        what one item shares is no more than what all share."""
        keep = np.zeros(len(at) + 1, np.int64)
        for least, reach in self.classes:
            if len(at) < least:
                break
            starts = np.flatnonzero(at[least - 1 :] - at[: len(at) - least + 1] < reach)
            if len(starts):
                keep += np.bincount(starts, minlength=len(keep)) - np.bincount(np.searchsorted(at, at[starts] + reach), minlength=len(keep))
        return np.cumsum(keep[:-1]) > 0

    def bands(self, at: np.ndarray, keys: np.ndarray) -> list[tuple[int, int, int, int]]:
        """``(item, first diagonal, last diagonal, shared)`` of runs of bands
        that meet the bound.  Bands are two budgets wide and overlap by half, so
        any k + 1 neighbouring diagonals lie within one."""
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        sizes = high - low
        rows = np.repeat(low, sizes) + (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))
        item = self.item[rows]
        width = self.budgets[item] + 1
        half = (np.repeat(at, sizes) - self.offset[rows]) // width
        cells, n = np.unique((item << np.int64(36)) + half + (1 << 35), return_counts=True)
        # A band is its half and the next one; bands are named by their first half.
        names = np.unique(np.concatenate([cells, cells - 1]))
        count = lambda cell: np.where(cells[p := np.minimum(np.searchsorted(cells, cell), len(cells) - 1)] == cell, n[p], 0)
        shared = count(names) + count(names + 1)
        owner = names >> np.int64(36)
        good = shared >= self.bounds[np.minimum(owner, len(self.bounds) - 1)]
        names, shared, owner = names[good], shared[good], owner[good]
        out = []
        for name, got, i in zip(names.tolist(), shared.tolist(), owner.tolist()):
            w = int(self.budgets[i]) + 1
            first = ((name & ((1 << 36) - 1)) - (1 << 35)) * w
            if out and out[-1][0] == i and out[-1][2] >= first - 1:
                out[-1] = (i, out[-1][1], first + 2 * w - 1, max(out[-1][3], got))
            else:
                out.append((i, first, first + 2 * w - 1, got))
        return out

    def aligned(self, i: int, points: np.ndarray, first: int, last: int) -> tuple[int, int, int]:
        """Least edits of item ``i`` against any stretch of the diagonals from
        ``first`` to ``last``, k either way; ``(edits, start, end)``."""
        want, k = self.points[i], int(self.budgets[i])
        begin = max(0, first - k)
        have = points[begin : max(0, last + len(want) + 2 * k)]
        n = np.arange(len(have) + 1)
        cost, origin = np.zeros(len(have) + 1, np.int64), n.copy()
        for row, c in enumerate(want):
            other = cost + 1
            step = cost[:-1] + (have != c)
            better = step <= other[1:]
            best = other
            best[1:] = np.where(better, step, other[1:])
            from_ = origin.copy()
            from_[1:] = np.where(better, origin[:-1], origin[1:])
            # Gaps in the item: carry the least of everything to the left.
            packed = ((best - n) << 32) | np.arange(len(n))
            least = np.minimum.accumulate(packed) & 0xFFFFFFFF
            cost, origin = best[least] - least + n, from_[least]
            if cost.min() > k:
                return k + 1, 0, 0
        end = int(np.argmin(cost))
        return int(cost[end]), begin + int(origin[end]), begin + end

    def matches(self, text: str | None, q: int = Q) -> list[tuple[int, int, int, int, int]]:
        """The best place of each item found in a text, places in the
        normalized text: ``(item_id, start, end, edits, shared)``."""
        if not len(self.keys):
            return []
        whole = normalized(text)
        points = _points(whole)
        if len(points) < q:
            return []
        at, keys = self.hits(points, q)
        kept = self.dense(at)
        if not kept.any():
            return []
        best: dict[int, tuple] = {}
        for i, first, last, shared in self.bands(at[kept], keys[kept]):
            place = whole.find(self.texts[i]) if i not in best or best[i][0] else -1
            edits, s, e = (0, place, place + len(self.texts[i])) if place >= 0 else self.aligned(i, points, first, last)
            if edits <= self.budgets[i] and (i not in best or (edits, s) < best[i][:2]):
                best[i] = (edits, s, e, shared)
        return sorted((int(self.ids[i]), s, e, edits, shared) for i, (edits, s, e, shared) in best.items())


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_chars: int) -> list[list[tuple[int, str]]]:
    """Items in blocks of about ``block_chars`` characters, one block at a time."""
    items = benchmark.filter(F.col(item_id).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    total = items.agg(F.sum(F.length("t").cast("long"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    for b in range(n):
        yield [tuple(r) for r in items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect()]


def _found(items: Items, text: Column) -> Column:
    @F.pandas_udf(MATCH)
    def find(texts: pd.Series) -> pd.Series:
        names = ("item_id", "start", "end", "edits", "shared")
        return pd.Series([[dict(zip(names, m)) for m in items.matches(t)] for t in texts], dtype=object)

    return find(text)


def find_passages(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    q: int = Q, edit_share: float = EDIT_SHARE, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``doc_id, item_id, start, end, edits, shared``: the best place of each
    item in each document that holds it with at most ``edit_share`` of its
    characters edited (places in the text lower-cased with white space
    squeezed).

    Items shorter than ``q`` characters hold no q-gram and are left out, as are
    items without an id; null and short texts hold nothing.  An item given
    twice is found once; repeated documents are each reported."""
    parts = [
        docs.select(F.col(doc_id).alias("doc_id"), F.explode(_found(Items.of(rows, q, edit_share), F.col(text))).alias("m")).select("doc_id", "m.*")
        for rows in _blocks(benchmark, item_id, item_text, block_chars)
    ]
    return reduce(DataFrame.unionByName, parts)


def keep_clean(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    q: int = Q, edit_share: float = EDIT_SHARE, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The rows that hold no item, all columns unchanged."""
    for rows in _blocks(benchmark, item_id, item_text, block_chars):
        docs = docs.filter(F.size(_found(Items.of(rows, q, edit_share), F.col(f"`{text}`"))) == 0)
    return docs
