"""What the two byte-pair operators share: words of a text, their ids, and the way back.

A word here ends before a blank that stands alone between two other characters;
that blank opens the next word.  The library's own pattern never joins anything
across such a place, so a text's ids are those of its words, one after the other.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: White space other than the blank and the line end.
_RARE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SLICE, _RUN = 4096, 256
_HELD_WORDS = 1 << 18


def words(text: str) -> list[str]:
    """The words of a text in order; together they are the text."""
    plain = not ("  " in text or " \n" in text or "\n " in text) and not any(c in text for c in _RARE)
    parts = text.split(" ") if plain else _BETWEEN.split(text)
    return parts[:1] + [" " + p for p in parts[1:]]


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def _in_runs(words: pa.LargeStringArray) -> np.ndarray:
    """Whether each word opens with a blank and then no white space."""
    places, raw = _bytes(words)
    at, long = places[:-1], np.diff(places) > 1
    found = long.copy()
    found[long] = raw[at[long]] == 0x20
    second = raw[at[found] + 1]
    unsure = np.flatnonzero(found)[~_OPENS[second]]
    found[unsure] = [not w[1].isspace() for w in words.take(pa.array(unsure)).to_pylist()]
    return found


def _bytes(words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and the last one ends, in the bytes of them all."""
    if not len(words):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    places = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    return places, np.frombuffer(words.buffers()[2] or b"", np.uint8)


def encode_words(path: str, words: list[str] | pa.Array) -> pa.ListArray:
    """Ids of each word, by the library.

    Words that open with a blank and then no white space are encoded in runs,
    each as one text: the library itself parts them there, and the lengths of
    the pieces tell whose ids are whose."""
    words = pa.array(words, pa.large_string()) if isinstance(words, list) else words.cast(pa.large_string())
    in_run = _in_runs(words)
    runs, alone = np.flatnonzero(in_run), np.flatnonzero(~in_run)
    joined, lonely = words.take(pa.array(runs)), words.take(pa.array(alone))
    places, raw = _bytes(joined)
    sizes, flat = [np.zeros(0, np.int32)], [np.zeros(0, np.uint32)]

    def keep(own: list[list[int]]) -> None:
        sizes.append(np.fromiter(map(len, own), np.int32, len(own)))
        flat.append(np.fromiter((i for ids in own for i in ids), np.uint32, int(sizes[-1].sum())))

    for at in range(0, len(runs), _RUN):
        own = places[at : at + _RUN + 1]
        text = raw[own[0] : own[-1]].tobytes().decode()
        ids = np.array(tokenizer(path).encode(text, add_special_tokens=False).ids, np.uint32)
        ends, wanted = np.cumsum(piece_lengths(path)[ids]), own[1:] - own[0]
        last = np.searchsorted(ends, wanted)
        if last[-1] != len(ids) - 1 or (ends[last] != wanted).any():
            keep([e.ids for e in tokenizer(path).encode_batch(joined.slice(at, _RUN).to_pylist(), add_special_tokens=False)])
            continue
        sizes.append(np.diff(last, prepend=-1).astype(np.int32))
        flat.append(ids)
    for at in range(0, len(alone), _SLICE):
        keep([e.ids for e in tokenizer(path).encode_batch(lonely.slice(at, _SLICE).to_pylist(), add_special_tokens=False)])
    offsets = np.append(np.int32(0), np.cumsum(np.concatenate(sizes), dtype=np.int32))
    place = np.empty(len(words), np.int64)
    place[np.concatenate([runs, alone])] = np.arange(len(words))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat))).take(pa.array(place))


#: By vocabulary, words of the blocks a worker had before, and their ids.
_HELD: dict[str, tuple[pa.Array, pa.ListArray]] = {}


def encode_distinct(path: str, words: pa.Array) -> pa.ListArray:
    """``encode_words`` for distinct words of a block; about half of them a worker
    has met in its last blocks.  It holds ``_HELD_WORDS`` of them at most, or one
    block's."""
    words = words.cast(pa.large_string())
    known, ids = _HELD.get(path, (words.slice(0, 0), pa.array([], pa.list_(pa.uint32()))))
    at = pc.index_in(words, value_set=known)
    new = words.filter(pc.is_null(at))
    every = pa.concat_arrays([ids, encode_words(path, new)])
    place = at.fill_null(0).to_numpy().astype(np.int64)
    place[at.is_null().to_numpy(zero_copy_only=False)] = len(known) + np.arange(len(new))
    found = every.take(pa.array(place))
    _HELD[path] = (pa.concat_arrays([known, new]), every) if len(every) <= _HELD_WORDS else (words, found)
    return found


#: Bytes that open a character which is surely no white space.
_OPENS = np.ones(256, bool)
_OPENS[:0x21] = _OPENS[[0xC2, 0xE1, 0xE2, 0xE3]] = False
_LETTER, _STOP, _SEEN = np.zeros((3, 256), bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
_STOP[[ord(c) for c in ",.;:!?)\n"]] = True
_SEEN[0x21:0x7F] = True


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after the other, and where each text's words
    begin and the last one's end.  Nothing is copied: words are places in the
    texts' own bytes.  Blanks next to white space never cut here, nor do those
    before a few scripts whose characters begin like a wide blank; a longer
    word gives the same ids.  Cuts also part an ASCII letter from a stop or line
    end behind it, and a single line end from what follows, as the library does;
    there are fewer distinct words then."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    places = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data, (low, high) = texts.buffers()[2], places[[0, -1]].tolist()
    if low == high:
        return pa.array([], pa.large_string()), np.zeros(len(texts) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[low:high]
    opens = np.zeros(len(raw), bool)
    opens[1:-1] = (raw[1:-1] == 0x20) & _OPENS[raw[2:]] & (raw[:-2] > 0x20)
    opens[1:] |= _LETTER[raw[:-1]] & _STOP[raw[1:]]
    opens[2:] |= _SEEN[raw[:-2]] & (raw[1:-1] == 0x0A) & _OPENS[raw[2:]]
    some = np.diff(places) > 0
    opens[places[1:][some] - low - 1] = False
    opens[places[:-1][some] - low] = True
    starts = np.flatnonzero(opens)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts + low, high)), data)
    return words, np.searchsorted(starts, places - low)


class Numbered:
    """Distinct words numbered in the order met, and texts as such numbers."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.texts: list[np.ndarray] = []

    def add(self, text: str | None) -> None:
        place = self.place
        self.texts.append(np.fromiter((place.setdefault(w, len(place)) for w in words(text or "")), np.int32))


def text_ids(ids: pa.ListArray, places: np.ndarray) -> np.ndarray:
    """The ids of words, one after the other."""
    offsets = ids.offsets.to_numpy()
    starts, sizes = offsets[places].astype(np.int64), (offsets[places + 1] - offsets[places]).astype(np.int64)
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return ids.values.to_numpy()[np.repeat(starts - ends + sizes, sizes) + np.arange(total)].astype("<u4")


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> pa.Array:
    """Bytes of each id; a byte-level vocabulary writes bytes as printable characters."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    vocabulary = tokenizer(path).get_vocab(with_added_tokens=True)
    table: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        known = all(c in byte_of for c in token)
        table[i] = bytes(byte_of[c] for c in token) if known else token.encode()
    return pa.array(table, pa.binary())


@functools.lru_cache(maxsize=2)
def piece_lengths(path: str) -> np.ndarray:
    return np.array([len(p) for p in pieces(path).to_pylist()], np.int64)


def decode(path: str, ids: np.ndarray) -> bytes:
    """The text of some ids as UTF-8: each id joined to its piece by position."""
    found = pieces(path).take(pa.array(ids))
    data = found.buffers()[2]
    raw = data.to_pybytes() if data is not None else b""
    return raw.decode("utf-8", errors="replace").encode()
