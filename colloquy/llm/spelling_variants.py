"""Spelling variants by PartEnum signatures over letter multisets.

A word is taken as the binary vector of its letter multiset: one dimension for
each letter and each time it occurs.  One replaced letter moves two dimensions,
one inserted or deleted letter moves one.  The dimensions are parted by a hash;
a signature is the word's vector without some of the parts, so two words whose
vectors differ only in the omitted parts share it exactly:

* equal lengths (distance two): every two of the parts omitted in turn;
* lengths one apart (distance one): every single part omitted in turn.

Words meet in an equality join on (length, omitted parts, rest) and are
verified by their edit distance inside the join, so no unverified pair leaves
it.  Signatures are 64-bit sums; a collision adds a candidate, never a link.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.session import cut_lineage

#: Parts of the dimensions: more parts, more signatures and fewer candidates.
PARTS = 7
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 1 << 18
#: U+00C0 to U+00FF begin with one byte in UTF-8, and no other code point does.
RUNS = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+").findall


def _slipped(run: bytes, h: int) -> bytes:
    letters = run.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def count_words(docs: DataFrame, slip: int | None = None, least_length: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n``: maximal runs of A-Z, a-z and U+00C0 to U+00FF in all whole
    texts, A-Z lower-cased, of ``least_length`` code points at least.

    With ``slip``, a run loses the code point number h modulo its length where
    ``slip`` divides h, the unsigned CRC-32 of ``<doc_id>:<run>``; what is left
    is counted.  A null text has no runs; a null id is written as nothing.
    Repeated rows count each time.  Other columns are not read."""

    def run(batches):
        held: Counter[bytes] = Counter()

        def rows():
            words = [w.decode() for w in held]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()

        for batch in batches:
            for own, body in zip(batch.column(0), batch.column(1)):
                if not body.is_valid:
                    continue
                seed = zlib.crc32(b"%s:" % (str(own.as_py()).encode() if own.is_valid else b""))
                # Equal runs of one document slip alike, so each is looked at once.
                for word, n in Counter(RUNS(body.as_buffer().to_pybytes().lower())).items():
                    if slip and not (h := zlib.crc32(word, seed)) % slip:
                        word = _slipped(word, h)
                    if len(word) >= least_length and (len(word) >= 2 * least_length or len(word.decode()) >= least_length):
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield from rows()
        yield from rows()

    own = F.col(f"`{doc_id}`").cast("string").alias("id")
    counted = docs.select(own, F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64 bits of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def part_sums(words: list[str], parts: int = PARTS) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each word, and for each word and part the sum of the
    hashes of its dimensions in that part."""
    size = np.fromiter((len(w) for w in words), np.int64, len(words))
    letter = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), size)
    order = np.lexsort((letter, word))
    letter, word = letter[order], word[order]
    new = np.append(True, (np.diff(letter) != 0) | (np.diff(word) != 0))[: len(letter)]
    start = np.flatnonzero(new)
    times = np.arange(len(letter)) - np.repeat(start, np.diff(np.append(start, len(letter))))
    dimension = _mixed((letter << np.uint64(32)) + times.astype(np.uint64) + np.uint64(1))
    sums = np.zeros((len(words), parts), np.uint64)
    np.add.at(sums, (word, ((dimension >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)), dimension)
    return size, sums


def _signatures(parts: int):
    """``same``: one for each two omitted parts; ``shorter`` and ``longer``: one
    for each omitted part, under the length of the shorter word."""
    pairs = np.array(list(itertools.combinations(range(parts), 2)))

    def run(batches):
        for batch in batches:
            size, sums = part_sums(batch.column("word").to_pylist(), parts)
            whole = sums.sum(axis=1, dtype=np.uint64)[:, None]

            def keyed(rest, length, first):
                omitted = np.arange(first, first + rest.shape[1], dtype=np.uint64)[None]
                return _mixed(_mixed(rest + (length.astype(np.uint64)[:, None] << np.uint64(8)) + omitted)).view(np.int64)

            same = keyed(whole - sums[:, pairs[:, 0]] - sums[:, pairs[:, 1]], size, 0)
            lists = [same, keyed(whole - sums, size, len(pairs)), keyed(whole - sums, size - 1, len(pairs))]
            arrays = [pa.ListArray.from_arrays(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32), pa.array(a.ravel())) for a in lists]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), *arrays], ["word", "n", "same", "shorter", "longer"])

    return run


def near_words(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """Pairs ``a, an, b, bn`` of ``words`` (``word, n``, each word once) that
    differ by exactly one inserted, deleted or replaced code point, each once.
    Where the lengths are equal ``a < b``; otherwise ``a`` is the shorter."""
    marked = words.mapInArrow(_signatures(parts), "word string, n long, same array<long>, shorter array<long>, longer array<long>")
    marked = cut_lineage(marked)

    def index(column, name, n):
        return marked.select(F.explode(column).alias("s"), F.col("word").alias(name), F.col("n").alias(n))

    one = F.levenshtein("a", "b", 1) == 1
    same = index("same", "a", "an").join(index("same", "b", "bn"), "s").filter((F.col("a") < F.col("b")) & one)
    other = index("shorter", "a", "an").join(index("longer", "b", "bn"), "s").filter(one)
    pair = ["a", "an", "b", "bn"]
    return same.select(*pair).unionByName(other.select(*pair)).distinct()


def variants(words: DataFrame, lead: float = 2.0, parts: int = PARTS, rounds: int = 30) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each of ``words`` (``word, n``,
    each word once; null words and counts take no part).

    ``form``: the near word of largest n, ties to the smallest in code-point
    order, if its n is at least ``lead`` times the word's own, else null.
    ``root``: the last word reached over forms; the word itself without any.
    A form is more frequent than its word by ``lead`` (above 1), so forms make
    no circle, and chains are as long as the logarithm of the largest count;
    each round halves what is left of them."""
    if lead <= 1:
        raise ValueError("lead must be above 1: forms could make a circle")
    known = cut_lineage(words.select("word", F.col("n").cast("long").alias("n")).filter("word IS NOT NULL AND n IS NOT NULL"))
    pairs = cut_lineage(near_words(known, parts))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("bn").alias("m")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("an").alias("m")))
    counted = both.groupBy("word").agg(F.count("*").alias("n_near"), F.max("m").alias("m"))
    # The smallest of the most frequent: aggregates alone, no sorted group.
    top = both.join(counted.select("word", "m"), ["word", "m"]).groupBy("word").agg(F.min("near").alias("near"))
    best = counted.join(top, "word").select("word", "n_near", "near", F.col("m").alias("near_n"))
    strong = F.col("near_n") >= F.lit(float(lead)) * F.col("n")
    formed = cut_lineage(known.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("near")).alias("form"), F.when(strong, F.col("near_n")).alias("form_n")))
    step = cut_lineage(formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    for _ in range(rounds):
        further = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut_lineage(step.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        step = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"forms did not end within {rounds} rounds")
    return formed.join(step, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
