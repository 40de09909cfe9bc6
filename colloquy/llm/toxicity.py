"""Toxicity by a counterfactually regularised linear classifier.

A logistic model over word and word-stem features is fitted to labelled texts
under one extra penalty: in each labelled text that names a group, the group's
term is swapped for another of its kind, and the squared change of the score
is paid for.  A neutral mention then cannot raise the score by itself.

Where labelled texts name no group there is nothing to swap.  A stated share of
those texts (``mention_share``, by a hash of the text, whatever its label) is
therefore learned from twice more, with a mention put in: once each member of a
swap, under the text's own label, and the pair of them pays for its difference.

The model is fitted on a bounded sample of labelled rows (``max_rows``) and has
``max_features`` learned features at most, besides those of the group terms;
other words weigh nothing.  Scoring runs over every whole text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.blocks import give_back

#: Terms that name groups, by kind and language (English, French, German, Spanish); parameters may replace them.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("female", "male"), ("girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "african", "latino"), ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("disabled", "blind", "deaf"), ("immigrants", "refugees", "foreigners", "citizens"), ("old", "young", "elderly"),
    ("femmes", "hommes"), ("femme", "homme"), ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "africains"), ("gays", "lesbiennes", "bisexuels"), ("aveugles", "sourds", "handicapés"),
    ("immigrés", "réfugiés", "étrangers", "citoyens"), ("vieux", "jeunes", "âgés"),
    ("frauen", "männer"), ("frau", "mann"), ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten", "afrikaner"), ("schwule", "lesben", "bisexuelle"), ("blinde", "gehörlose", "behinderte"),
    ("einwanderer", "flüchtlinge", "ausländer", "bürger"), ("alte", "junge"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "africanos"), ("homosexuales", "lesbianas", "bisexuales"), ("ciegos", "sordos", "discapacitados"),
    ("inmigrantes", "refugiados", "extranjeros", "ciudadanos"), ("viejos", "jóvenes", "ancianos"),
)
_WORD = re.compile(r"[^\W\d_]+").findall
STEMS = (4, 5, 6)
_CACHE_MOST, _SLICE = 50_000, 256


def features_of(word: str) -> tuple[str, ...]:
    """The word and its stems; a stem is told from a word by its closing mark."""
    return (word, *(word[:n] + "-" for n in STEMS if len(word) > n))


def words_of(text: str | None) -> set[str]:
    return set(_WORD((text or "").lower()))


def swapped(words: set[str], swap: dict[str, str]) -> set[str] | None:
    """The words with each group term replaced by the next of its kind; None without one."""
    return {swap.get(w, w) for w in words} if any(w in swap for w in words) else None


def _swaps(groups) -> dict[str, str]:
    return {term: group[(i + 1) % len(group)] for group in groups for i, term in enumerate(group)}


def mention(text: str | None, groups, share: float) -> tuple[str, str] | None:
    """The two terms to put into a text that names no group: for about
    ``share`` of all texts, chosen by a hash of the text alone."""
    h = zlib.crc32((text or "").encode())
    if not groups or h % 10_000 >= share * 10_000:
        return None
    group = groups[(h // 10_000) % len(groups)]
    at = (h // 7_919) % len(group)
    return group[at], group[(at + 1) % len(group)]


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float  # minus infinity: nothing was learned, every score is 0
    swapped: int = 0  # labelled texts in which a term of their own was swapped
    mentioned: int = 0  # labelled texts into which both members of a swap were put

    def score(self, text: str | None) -> float:
        if self.bias == -math.inf:
            return 0.0
        seen = {f for w in words_of(text) for f in features_of(w) if f in self.weights}
        return float(1 / (1 + math.exp(-max(-700.0, min(700.0, self.bias + sum(self.weights[f] for f in sorted(seen)))))))


def _labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, max_rows: int) -> DataFrame:
    """Texts with a label of 0 or 1, thinned by a hash of their id to about
    ``max_rows``; that many (id, label) rows are broadcast, and no text is shuffled."""
    known = labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("y")).filter("y IN (0, 1)")
    known = known.groupBy("__id").agg(F.max("y").alias("y"))
    n = known.count()
    kept = known.filter(F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) < math.ceil((1 << 20) * min(1.0, max_rows / max(n, 1))))
    return docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).join(F.broadcast(kept), "__id").select("text", "y")


def fit(
    docs: DataFrame, labels: DataFrame, identity_terms=IDENTITY_TERMS, penalty: float = 1.0, l2: float = 1e-3,
    max_rows: int = 20_000, max_features: int = 4096, min_rows: int = 5, rounds: int = 200, mention_share: float = 0.25,
    doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
) -> Model:
    """Learn from the rows of ``docs`` that ``labels`` marks 0 or 1 (a document
    marked both ways counts as 1; other marks are ignored).  Null texts are
    empty.  Without labelled rows every score is 0."""
    rows = _labelled(docs, labels, doc_id, text, label, max_rows)
    swap = _swaps(identity_terms)

    def count(parts):
        for part in parts:
            seen = {0: Counter(), 1: Counter()}
            for t, y in zip(part["text"], part["y"]):
                seen[y].update({f for w in words_of(t) for f in features_of(w)} | {""})
            every = list(seen[0].keys() | seen[1].keys())
            yield pd.DataFrame({"f": every, "n0": [seen[0][f] for f in every], "n1": [seen[1][f] for f in every]})

    stats = rows.mapInPandas(count, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    whole = stats.filter("f = ''").first()
    if whole is None:
        return Model({}, -math.inf)
    share = math.log((whole.n1 + 0.5) / (whole.n0 + 0.5))
    odds = F.log((F.col("n1") + 0.5) / (F.col("n0") + 0.5)) - share
    chosen = (
        stats.filter((F.col("f") != "") & (F.col("n0") + F.col("n1") >= min_rows))
        .select("f", (F.abs(odds) * F.sqrt(F.col("n0") + F.col("n1"))).alias("gain"))
        .orderBy(F.desc("gain"), "f").limit(max_features)
    )
    groups = tuple(tuple(group) for group in identity_terms if len(group) > 1)
    terms = {f for group in groups for term in group for f in features_of(term)} if mention_share else set()
    names = sorted({r.f for r in chosen.collect()} | terms)  # at most max_features and those of the terms
    place = {f: i for i, f in enumerate(names)}

    def project(parts):
        def at(words):
            return sorted({place[f] for w in words for f in features_of(w) if f in place})

        for part in parts:
            rows = []
            for text, y in zip(part["text"], part["y"]):
                words = words_of(text)
                other = swapped(words, swap)
                rows.append((y, at(words), None if other is None else at(other), False))
                if other is None and (both := mention(text, groups, mention_share)):
                    one, two = at(words | {both[0]}), at(words | {both[1]})
                    rows += [(y, one, two, True), (y, two, None, True)]
            yield pd.DataFrame(rows, columns=["y", "x", "z", "put"])

    data = rows.mapInPandas(project, "y int, x array<int>, z array<int>, put boolean").collect()  # about max_rows, and twice their share
    data.sort(key=lambda r: (r.y, r.x, r.z or [], r.put))
    weights, bias = descend(
        len(names), [r.x for r in data], np.array([r.y for r in data], float),
        [(i, r.z) for i, r in enumerate(data) if r.z is not None], share, penalty, l2, rounds,
    )
    pairs = [r.put for r in data if r.z is not None]
    return Model({f: float(w) for f, w in zip(names, weights) if w}, float(bias), pairs.count(False), pairs.count(True))


def descend(n: int, rows: list[list[int]], y: np.ndarray, pairs, bias: float, penalty: float, l2: float, rounds: int):
    """Adam on mean log loss + l2 |w|^2 / 2 + penalty * mean squared change of
    the raw score over the swapped pairs.  A row of the rarer label weighs more,
    by the fourth root of how much rarer it is."""
    rare = (max(len(y) - y.sum(), 1) / max(y.sum(), 1)) ** 0.25
    weight = np.where(y > 0, max(rare, 1), max(1 / rare, 1))
    weight /= max(weight.sum(), 1)
    def sparse(lists):
        return np.repeat(np.arange(len(lists)), [len(r) for r in lists]), np.fromiter((j for r in lists for j in r), np.int64)

    at, col = sparse(rows)
    zat, zcol = sparse([z for _, z in pairs])
    own = np.array([i for i, _ in pairs], np.int64)
    weights, step = np.zeros(n), 0.1
    first, second = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, rounds + 1):
        raw = bias + np.bincount(at, weights[col], len(rows))
        error = weight * (1 / (1 + np.exp(-np.clip(raw, -500, 500))) - y)
        if len(own):
            change = 2 * penalty / len(own) * (raw[own] - bias - np.bincount(zat, weights[zcol], len(own)))
            moved = np.zeros(len(rows))
            moved[own] = change
            slope = np.bincount(col, (error + moved)[at], n) - np.bincount(zcol, change[zat], n)
        else:
            slope = np.bincount(col, error[at], n)
        gradient = np.append(slope + l2 * weights, error.sum())
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        move = step * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights, bias


def scores(texts: pa.Array, model: Model) -> pa.Array:
    """Score of each whole text; null is scored as empty.  A batch of whole texts
    is large, so a few of them are Python strings at a time."""
    if model.bias == -math.inf:
        return pa.array(np.zeros(len(texts)))
    known: dict[str, tuple[str, ...]] = {}
    weights, out = model.weights, []
    for at in range(0, len(texts), _SLICE):
        for text in texts.slice(at, _SLICE).to_pylist():
            seen: set[str] = set()
            for w in words_of(text):
                hit = known.get(w)
                if hit is None:
                    if len(known) >= _CACHE_MOST:
                        known.clear()
                    hit = known[w] = tuple(f for f in features_of(w) if f in weights)
                if hit:
                    seen.update(hit)
            raw = model.bias + sum(weights[f] for f in sorted(seen))
            out.append(1 / (1 + math.exp(-max(-700.0, min(700.0, raw)))))
    return pa.array(out, pa.float64())


def toxicity(text: Column, model: Model) -> Column:
    """Score from 0 to 1 of each whole text; null is scored as empty."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        give_back()  # what the tasks before left in this worker
        return scores(texts, model)

    return score(text)


def keep_harmless(docs: DataFrame, model: Model, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows whose score is under ``threshold``, all columns unchanged."""
    return docs.filter(toxicity(F.col(f"`{text}`"), model) < threshold)
