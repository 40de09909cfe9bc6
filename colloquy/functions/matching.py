"""Exact similarity of two texts: the helpers that run inside tasks.

Scores are those of the classic longest-run matching: take the longest common
run (leftmost on ties), then recurse to its left and right.  Catalyst cannot
express that recursion, so Spark first narrows the pairs and these helpers
score the ones that are left.
"""

from __future__ import annotations

import bisect
import hashlib
from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd

# Fixed values of the duplicate rule.
MIN_RUN = 20
PASSAGE_CONTAINMENT = 0.6
SUMMARY_SIMILARITY = 0.6

# Fingerprints: among the 12-character grams of every 20-character window the
# one with the least hash is kept.  Equal windows keep equal grams, so texts
# that share a run of 20 characters always share a fingerprint.
GRAM = 12
_WINDOW = MIN_RUN - GRAM + 1
_HASH_BASE = np.uint64(0x9E3779B97F4A7C15)


#: Characters whose fingerprints are taken at once: bounds memory, not results.
PRINT_CHARS = 1 << 16


def fingerprint_text(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints, and where the characters their windows cover start and stop."""
    return fingerprint_texts([text])[:3]


def fingerprint_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of many texts one after the other, where their windows start
    and stop in the text, and how many each text has."""
    parts, some, chars = [], [], 0
    for text in texts:
        if some and chars + len(text) > PRINT_CHARS:
            parts.append(_fingerprints_at_once(some))
            some, chars = [], 0
        some.append(text)
        chars += len(text)
    parts.append(_fingerprints_at_once(some))
    return tuple(np.concatenate(c) for c in zip(*parts))


def _fingerprints_at_once(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    whole = np.maximum(lengths - MIN_RUN + 1, 0)
    codes = np.frombuffer("".join(texts).encode("ascii"), dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    if not whole.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    grams = np.zeros(len(codes) - GRAM + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for offset in range(GRAM):
            grams *= _HASH_BASE
            grams += codes[offset:offset + len(grams)]
        grams ^= grams >> np.uint64(29)
        grams *= _HASH_BASE
        grams ^= grams >> np.uint64(32)
    # The first of the least grams of every window, then only windows within one text.
    least = grams[:len(grams) - _WINDOW + 1].copy()
    ahead = np.zeros(len(least), dtype=np.int64)
    for step in range(1, _WINDOW):
        later = grams[step:step + len(least)]
        lower = later < least
        np.copyto(least, later, where=lower)
        np.copyto(ahead, step, where=lower)
    chosen = np.arange(len(least)) + ahead
    holder = np.repeat(np.arange(len(texts)), whole)
    opens = np.cumsum(whole) - whole
    place = np.arange(len(holder)) - opens[holder]
    chosen = chosen[(np.cumsum(lengths) - lengths)[holder] + place]
    first = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (holder[1:] != holder[:-1])])
    last = np.r_[first[1:] - 1, len(chosen) - 1]
    return (
        grams[chosen[first]].astype(np.int64), place[first].astype(np.int32), (place[last] + MIN_RUN).astype(np.int32),
        np.bincount(holder[first], minlength=len(texts)),
    )


_SHARED = ["submission_id", "segment_id", "stance", "mask", "text_id", "chars", "passage", "fp", "start", "stop"]


def _sharing(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows whose text shares a fingerprint with another text of their
    submission, or is held by several rows.  The first row of a text carries the
    text and the fingerprints it shares."""
    rows = rows[rows.passage.str.len() >= MIN_RUN]
    if not len(rows):
        return pd.DataFrame(columns=_SHARED, dtype=object)
    text = rows.groupby(["submission_id", "passage"], sort=False).ngroup().to_numpy()
    first, copies = np.unique(text, return_index=True, return_counts=True)[1:]
    *columns, held = fingerprint_texts(rows.passage.iloc[first].tolist())
    holder = np.repeat(np.arange(len(first)), held)
    group = pd.factorize(rows.submission_id.iloc[first])[0][holder]
    order = np.lexsort((holder, columns[0], group))
    key, part, own = columns[0][order], group[order], holder[order]
    opens = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
    sizes = np.diff(np.r_[opens, len(key)])
    shared = np.zeros(len(key), dtype=bool)
    shared[order] = np.repeat(own[opens] != own[opens + sizes - 1], sizes)
    kept = np.bincount(holder[shared], minlength=len(first))
    at = np.flatnonzero(((kept > 0) | (copies > 1))[text])
    texts, leads = text[at], (first[text[at]] == at) & (kept[text[at]] > 0)
    passages = rows.passage.iloc[at].tolist()
    out = {c: rows[c].iloc[at].tolist() for c in ("submission_id", "segment_id", "stance", "mask")}
    out["text_id"] = [hashlib.md5(p.encode()).hexdigest() for p in passages]
    out["chars"] = [len(p) for p in passages]
    out["passage"] = [p if lead else None for p, lead in zip(passages, leads)]
    for name, column in zip(("fp", "start", "stop"), columns):
        parts = np.split(column[shared], np.cumsum(kept)[:-1])
        out[name] = [parts[i] if lead else None for i, lead in zip(texts, leads)]
    return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in out.items()})


def shared_fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk rows sorted by submission; hold the last submission of a batch
    until the next one shows where it ends."""
    held = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(rows):
            continue
        last = (rows.submission_id == rows.submission_id.iloc[-1]).to_numpy()
        held = rows[last]
        if not last.all():
            yield _sharing(rows[~last])
    if held is not None:
        yield _sharing(held)


def common_runs(a: str, b: str, size: int = MIN_RUN) -> list[tuple[int, int, int]]:
    """All maximal common runs of at least ``size`` characters: (i, j, length)."""
    places = defaultdict(list)
    for j in range(len(b) - size + 1):
        places[b[j:j + size]].append(j)
    runs = []
    for i in range(len(a) - size + 1):
        for j in places.get(a[i:i + size], ()):
            if i and j and a[i - 1] == b[j - 1]:
                continue
            k = size
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            runs.append((i, j, k))
    return runs


def covered_chars(a: str, b: str) -> int:
    """Characters of ``a`` inside matched runs of at least ``MIN_RUN``."""
    if a == b:
        return len(a) if len(a) >= MIN_RUN else 0
    runs, covered = common_runs(a, b), 0
    pending = [(0, len(a), 0, len(b), runs)]
    while pending:
        a_low, a_high, b_low, b_high, inside = pending.pop()
        clipped = []
        for i, j, k in inside:
            skip = max(0, a_low - i, b_low - j)
            length = min(k, a_high - i, b_high - j) - skip
            if length >= MIN_RUN:
                clipped.append((i + skip, j + skip, length))
        if not clipped:
            continue
        i, j, k = max(clipped, key=lambda r: (r[2], -r[0], -r[1]))
        covered += k
        pending.append((a_low, i, b_low, j, clipped))
        pending.append((i + k, a_high, j + k, b_high, clipped))
    return covered


def containment_of(a: str, b: str) -> float:
    """Share of the shorter normalized text covered by runs of the longer."""
    if not a or not b:
        return 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    return round(min(1.0, covered_chars(short, long) / len(short)), 3)


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    masks = defaultdict(int)
    for place, char in enumerate(a):
        masks[char] |= 1 << place
    full = (1 << len(a)) - 1
    state = full
    for char in b:
        hit = state & masks.get(char, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def similarity_of(a: str, b: str, at_least: float = 0.0) -> float | None:
    """Matching ratio rounded to 3 places, or None as soon as it is certain to
    stay below ``at_least``.

    What is matched so far plus an upper bound for every open stretch bounds
    the final figure, so most unrelated pairs are dropped after a run or two."""
    if not a or not b:
        return 0.0 if at_least <= 0 else None
    if a == b:
        return 1.0
    total = len(a) + len(b)
    need = (at_least - 0.0005) * total / 2 if at_least > 0 else -1
    if min(len(a), len(b)) < need:
        return None
    if need > 0 and common_subsequence(a, b) < need:
        return None
    matcher = SequenceMatcher(None, a, b, autojunk=False)
    matched, pending, possible = 0, [(0, len(a), 0, len(b))], min(len(a), len(b))
    while pending:
        a_low, a_high, b_low, b_high = pending.pop()
        possible -= min(a_high - a_low, b_high - b_low)
        i, j, k = matcher.find_longest_match(a_low, a_high, b_low, b_high)
        if k == 0:
            if matched + possible < need:
                return None
            continue
        matched += k
        for part in ((a_low, i, b_low, j), (i + k, a_high, j + k, b_high)):
            room = min(part[1] - part[0], part[3] - part[2])
            if room:
                pending.append(part)
                possible += room
        if matched + possible < need:
            return None
    ratio = round(2.0 * matched / total, 3)
    return ratio if ratio >= at_least else None


UNIT = ["submission_id", "stance", "question", "left_tile", "right_tile"]
_ALPHABET = " abcdefghijklmnopqrstuvwxyz0123456789"
_PLACE = np.zeros(128, dtype=np.int64)
_PLACE[[ord(c) for c in _ALPHABET]] = np.arange(len(_ALPHABET))


def _letter_counts(texts) -> np.ndarray:
    size = len(_ALPHABET)
    codes = np.frombuffer("".join(texts).encode("ascii"), dtype=np.uint8)
    rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return np.bincount(rows * size + _PLACE[codes], minlength=len(texts) * size).reshape(-1, size).astype(np.int32)


class _Beside:
    """Texts laid side by side as the bits of one number, with an empty bit after
    each that ends its carries: a text's longest common subsequences with all of
    them are found in one walk over its characters."""

    def __init__(self, texts: list[str]):
        codes = np.frombuffer("".join(t + "\0" for t in texts).encode("ascii"), dtype=np.uint8)
        self.sizes = np.array([len(t) for t in texts])
        self.opens = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.bits = len(codes)
        self.full = self._number(codes != 0)
        self.masks = {chr(c): self._number(codes == c) for c in np.unique(codes[codes != 0])}

    @staticmethod
    def _number(bits: np.ndarray) -> int:
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    def common(self, text: str, first: int) -> np.ndarray:
        """``common_subsequence`` of ``text`` with each text from the ``first`` on."""
        low = int(self.opens[first])
        masks = {c: self.masks[c] >> low for c in set(text) if c in self.masks}
        full = self.full >> low
        state = full
        for char in text:
            if char in masks:
                hit = state & masks[char]
                state = ((state + hit) | (state - hit)) & full
        bits = self.bits - low
        left = np.unpackbits(np.frombuffer(state.to_bytes(-(-bits // 8), "little"), dtype=np.uint8), count=bits, bitorder="little")
        return self.sizes[first:] - np.add.reduceat(left, self.opens[first:] - low, dtype=np.int64)


def _compare_tiles(rows: dict[str, list], counts: np.ndarray, low: int, high: int) -> list[tuple]:
    """Matching summaries of the two tiles in rows ``low`` to ``high``.  Length,
    letter counts and common subsequences bound the score of many pairs at once;
    the rest are scored one by one."""
    out = []
    is_left, light, ids, texts, roots = (rows[c] for c in ("is_left", "light", "text_id", "summary", "root"))
    # A light text meets the light ones of a later id and all heavy ones: these come last.
    rights = sorted((r for r in range(low, high) if not is_left[r]), key=lambda r: (not light[r], ids[r]))
    if not rights:
        return out
    light_ids = [ids[r] for r in rights if light[r]]
    right_counts, right_chars = counts[rights], np.array([len(texts[r]) for r in rights])
    right_roots, beside = np.array([roots[r] for r in rights], dtype=object), None
    for row in range(low, high):
        first = bisect.bisect_right(light_ids, ids[row]) if is_left[row] else len(rights)
        if first == len(rights):
            continue
        x = texts[row]
        overlap = np.minimum(right_counts[first:], counts[row]).sum(axis=1)
        need = (SUMMARY_SIMILARITY - 0.0005) * (right_chars[first:] + len(x)) / 2
        open_pair = (right_roots[first:] != roots[row]) & (overlap >= need)
        met = np.flatnonzero(open_pair)
        if len(met) > 1 + len(need) // 32:
            beside = beside or _Beside([texts[r] for r in rights])
            met = np.flatnonzero(open_pair & (beside.common(x, first) >= need))
        for at in met:
            y = rights[first + at]
            orders = []
            if rows["first_segment"][row] < rows["last_segment"][y]:
                orders.append((x, texts[y], rows["first_segment"][row], rows["last_segment"][y]))
            if rows["first_segment"][y] < rows["last_segment"][row]:
                orders.append((texts[y], x, rows["first_segment"][y], rows["last_segment"][row]))
            for a, b, one, other in orders:
                if similarity_of(a, b, SUMMARY_SIMILARITY) is not None:
                    out.append((rows["submission_id"][row], one, other))
                    break
    return out


_COMPARED = ["submission_id", "is_left", "light", "text_id", "summary", "root", "first_segment", "last_segment"]


def tile_matches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk rows sorted by unit of work; hold one unit at a time."""
    held = None

    def score(rows, starts, stops):
        lists = {c: rows[c].tolist() for c in _COMPARED}
        counts, matches = _letter_counts(lists["summary"]), []
        for low, high in zip(starts, stops):
            matches += _compare_tiles(lists, counts, low, high)
        return pd.DataFrame(matches, columns=["submission_id", "a", "b"])

    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        starts = np.flatnonzero((rows[UNIT] != rows[UNIT].shift()).any(axis=1).to_numpy()).tolist()
        if len(starts) > 1:
            yield score(rows.iloc[:starts[-1]], starts[:-1], starts[1:])
        held = rows.iloc[starts[-1]:] if len(starts) else rows
    if held is not None and len(held):
        yield score(held, [0], [len(held)])
