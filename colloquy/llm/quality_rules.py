"""Text quality by a sparse ensemble of rules.

Shallow trees are grown on statistics of labelled texts.  Every path from a
root to a node is a conjunction of thresholds: a rule.  A logistic model with a
lasso penalty over the rules keeps few of them, and what is kept is compiled
into one Spark column expression over the statistics.

Trees and weights are fitted on a bounded sample of labelled rows
(``max_rows``); statistics are taken of every whole text, labelled or not.
"""

from __future__ import annotations

import math
import operator
import re
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.shared import fresh_name
from colloquy.session import cut_lineage

#: What is measured of a text, in this order; shares are of characters, words or lines.
STATISTICS = (
    "chars", "words", "word_length", "long_words", "short_words", "symbols", "digits", "capitals", "beyond_ascii", "ends", "bars",
    "distinct_words", "echoes", "commonest_word", "distinct_lines", "line_words", "distinct_chars",
)
SEED = 13
Rule = tuple[tuple[str, str, float], ...]


def statistics_of(text: str | None) -> tuple[float, ...]:
    """All zero for a null, empty or blank text."""
    words = (text or "").split()
    if not words:
        return (0.0,) * len(STATISTICS)
    n, signs, lines = len(text), Counter(text), [line for line in text.split("\n") if line.strip()]
    size, times = [len(w) for w in words], Counter(words)

    def share(of) -> float:
        return sum(k for c, k in signs.items() if of(c)) / n

    return (
        float(n), float(len(words)), sum(size) / len(words), sum(s > 15 for s in size) / len(words), sum(s < 4 for s in size) / len(words),
        share(lambda c: not c.isalnum() and not c.isspace()), share(str.isdigit), share(str.isupper), share(lambda c: ord(c) > 127),
        share(lambda c: c in ".!?"), share(lambda c: c in "|#{}<>\\"),
        len(times) / len(words), sum(map(operator.eq, words, words[1:])) / len(words), max(times.values()) / len(words),
        len(set(lines)) / len(lines), len(words) / len(lines), float(len(signs)),
    )


def statistics(text: Column) -> Column:
    """A struct of doubles named as ``STATISTICS``, of each whole text."""

    @F.pandas_udf(", ".join(f"{name} double" for name in STATISTICS))
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([statistics_of(t) for t in texts], columns=list(STATISTICS), dtype="float64")

    return of(text)


def _holds(stats: Column, rule: Rule) -> Column:
    held = F.lit(True)
    for name, side, threshold in rule:
        own = stats[name]
        held = held & (own <= threshold if side == "<=" else own > threshold)
    return held


@dataclass(frozen=True)
class Model:
    rules: tuple[tuple[Rule, float], ...]
    bias: float

    def column(self, stats: Column) -> Column:
        """The score from 0 to 1 as an expression over a struct of statistics."""
        raw = F.lit(self.bias)
        for rule, weight in self.rules:
            raw = raw + F.when(_holds(stats, rule), weight).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-raw))

    def score(self, text: str | None) -> float:
        own = dict(zip(STATISTICS, statistics_of(text)))
        raw = self.bias + sum(w for rule, w in self.rules if all(own[name] <= t if side == "<=" else own[name] > t for name, side, t in rule))
        return 1 / (1 + math.exp(-raw))


_STEP = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)$")


def rules_of(trees: list[str]) -> list[Rule]:
    """Distinct rules of printed trees: one for each branch, the thresholds from
    the root down to it, of equal statistic and side the tightest."""
    found: dict[Rule, None] = {}
    for tree in trees:
        path: list[tuple[int, tuple[str, str, float]]] = []
        for line in tree.splitlines():
            step = _STEP.match(line)
            if not step:
                continue
            depth = len(step[1])
            path = [p for p in path if p[0] < depth] + [(depth, (STATISTICS[int(step[2])], step[3], float(step[4])))]
            tight: dict[tuple[str, str], float] = {}
            for _, (name, side, t) in path:
                old = tight.get((name, side), t)
                tight[name, side] = min(old, t) if side == "<=" else max(old, t)
            found.setdefault(tuple(sorted((name, side, t) for (name, side), t in tight.items())))
    return list(found)


def _labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, max_rows: int) -> DataFrame:
    """Statistics and label of about ``max_rows`` labelled documents, by a hash of
    their id; that many (id, label) rows are broadcast, and no text is shuffled."""
    known = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)")
    known = cut_lineage(known.groupBy("id").agg(F.min("y").alias("y")))
    part = math.ceil((1 << 20) * min(1.0, max_rows / max(known.count(), 1)))
    kept = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < part)
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(kept), "id")
    return rows.select(statistics(F.col("text")).alias("s"), "y").select(*[f"s.{c}" for c in STATISTICS], F.col("y").cast("double").alias("y"))


def fit(
    docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, trees: int = 30, depth: int = 3, lasso: float = 0.002,
    doc_id: str = "doc_id", text: str = "text", label: str = "quality",
) -> Model:
    """Learn from the rows of ``docs`` that ``labels`` marks 0 or 1, of those
    about ``max_rows``; a document marked both ways counts as 0, other marks are
    ignored, a null text is an empty one.  Where only one label occurs the score
    is its smoothed share, and one half without any."""
    # At most about max_rows narrow rows, in one order whatever the partitions were: equal input, equal model.
    rows = cut_lineage(_labelled(docs, labels, doc_id, text, label, max_rows).repartition(1).sortWithinPartitions(*STATISTICS, "y"))
    seen = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    bad, good = seen.get(0.0, 0), seen.get(1.0, 0)
    if not bad or not good:
        return Model((), math.log((good + 0.5) / (bad + 0.5)))
    measured = rows.select(array_to_vector(F.array(*STATISTICS)).alias("features"), "y")
    forest = RandomForestClassifier(
        labelCol="y", numTrees=trees, maxDepth=depth, maxBins=64, minInstancesPerNode=5, featureSubsetStrategy="onethird",
        subsamplingRate=0.7, seed=SEED,
    ).fit(measured)
    rules = rules_of([tree.toDebugString for tree in forest.trees])
    if not rules:
        return Model((), math.log((good + 0.5) / (bad + 0.5)))
    stats = F.struct(*STATISTICS)
    held = F.array(*[_holds(stats, rule).cast("double") for rule in rules])
    lasso_model = LogisticRegression(labelCol="y", elasticNetParam=1.0, regParam=lasso, maxIter=100).fit(
        cut_lineage(rows.select(array_to_vector(held).alias("features"), "y")))
    kept = [(rule, float(w)) for rule, w in zip(rules, lasso_model.coefficients.toArray()) if w]
    return Model(tuple(kept), float(lasso_model.intercept))


def scored(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text, 0 to 1, in the column ``name``
    (one of that name is replaced); null, empty and blank texts are scored by
    statistics that are all zero.  All other columns and rows are kept."""
    own = fresh_name(docs.columns, "statistics")
    kept = [F.col(f"`{c}`") for c in docs.columns if c != name]
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns], statistics(F.col(f"`{text}`")).alias(own)).select(*kept, model.column(F.col(own)).alias(name))


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows whose score is at least ``threshold``, all columns unchanged."""
    own = fresh_name(docs.columns, "score")
    return scored(docs, model, text, own).filter(F.col(own) >= threshold).drop(own)
