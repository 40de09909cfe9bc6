"""Hard negatives, spelling variants and quality rules against plain versions."""
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import hard_negatives, quality_rules, queries, spelling_variants

# --- hard negatives ---------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, score long, leaf string, rank int"


def plain_negatives(rows, k=5):
    """``rows``: (id, label, integer vector)."""
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    for own, label, v in rows:
        if own % 100:
            continue
        others = [(-score(v, w), i, y) for i, y, w in rows if i != own and len(w) == len(v)]
        for p, pid, _ in sorted(o for o in others if o[2] == label)[:k]:
            fits = sorted(o for o in others if o[2] != label and 80 * -p <= 100 * -o[0] <= 100 * -p)[:k]
            out |= {(own, pid, i + 1, nid, -p, -n) for i, (n, nid, _) in enumerate(fits)}
    return out


def usable(rows):
    kept = {}
    for i, v, y in rows:
        if i is None or v is None or y is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own = (i, (y + 1) % 10 if i % 7 == 0 else y, [math.floor(256 * float(np.float32(x))) for x in v])
        kept[i] = min(kept.get(i, own), own)
    return list(kept.values())


def mined(spark, rows):
    df = spark.createDataFrame([(i, v, y, 1, "l", 2) for i, v, y in rows], VECTORS).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = [tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 100 == 0, label).collect()]
    assert len(got) == len(set(got))
    return set(got)


def some_vectors(kind, n, d, seed=3):
    rng = np.random.default_rng(seed)
    if kind == "clusters":
        centres = rng.standard_normal((12, d))
        x = centres[rng.integers(0, 12, n)] + 0.05 * rng.standard_normal((n, d))
    elif kind == "norms":
        x = rng.standard_normal((n, d)) * rng.lognormal(0, 1, (n, 1))
    elif kind == "equal":
        x = np.where(rng.random((n, 1)) < 0.4, 0.25, rng.standard_normal((n, d)))
    else:
        x = rng.standard_normal((n, d))
        x /= np.sqrt((x**2).sum(axis=1, keepdims=True))
    return [(i, [float(v) for v in row], int(rng.integers(0, 10))) for i, row in enumerate(x)]


@pytest.mark.parametrize("kind", ["unit", "clusters", "norms", "equal"])
def test_hard_negatives(spark, monkeypatch, kind):
    """Trees of several levels, many chunks and blocks."""
    monkeypatch.setattr(hard_negatives, "CHUNK_ROWS", 60)
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 2)
    monkeypatch.setattr(hard_negatives, "LEAF_ROWS", 16)
    rows = some_vectors(kind, 900, 6)
    assert mined(spark, rows) == plain_negatives(usable(rows))


def test_hard_negatives_of_awkward_rows(spark):
    rows = some_vectors("unit", 220, 4) + [
        (100, None, 1), (200, [1.0, float("nan"), 0.0, 0.0], 1), (300, [1.0, None, 0.0, 0.0], 1), (400, [0.0] * 4, 2), (401, [0.0] * 4, 2),
        (402, [float("inf")] * 4, 3), (None, [1.0] * 4, 3), (500, [0.5] * 4, None), (600, [0.5, 0.5], 4), (601, [0.5, 0.25], 4), (602, [0.5, 0.45], 5),
        (700, [], 1), (701, [], 1), (702, [], 2), (800, [-0.5] * 4, 3),
    ]
    rows += [rows[3], rows[3], (7, [9.0] * 4, 0)]
    assert mined(spark, rows) == plain_negatives(usable(rows))
    assert mined(spark, []) == set()


def test_hard_negatives_of_large_components(spark):
    """Beyond the exact range of floating point, up to what a long holds; above that a row takes no part."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.integers(-900_000, 900_000, 5)], int(i % 3)) for i in range(0, 600, 2)]
    assert mined(spark, rows + [(1000, [1e30] * 5, 1), (1002, [3e38] * 5, 1)]) == plain_negatives(usable(rows))


def test_subtrees_are_left_out():
    """On clustered rows the ranges exclude most of them, and none that a window holds."""
    rng = np.random.default_rng(0)
    x = (1000 * (rng.standard_normal((30, 8))[rng.integers(0, 30, 6000)] + 0.02 * rng.standard_normal((6000, 8)))).astype(np.int64)
    square = float((x.astype(float) ** 2).sum(axis=1).max())
    root = hard_negatives.grow(hard_negatives.lifted(x, square), 64)[0]
    asks, scores = x[:40], x[:40] @ x.T
    hi = np.sort(scores, axis=1)[:, -20]
    lo = np.ceil(0.95 * hi).astype(np.int64)
    seen, looked = defaultdict(set), 0

    def at_leaf(leaf, at):
        nonlocal looked
        looked += len(at) * len(leaf.rows)
        for q in at:
            seen[q].update(leaf.rows.tolist())

    hard_negatives.Queries(asks, lo, hi, square).walk(root, at_leaf)
    for q in range(40):
        assert set(np.flatnonzero((scores[q] >= lo[q]) & (scores[q] <= hi[q])).tolist()) <= seen[q]
    assert looked < 0.3 * 40 * 6000


# --- spelling variants ------------------------------------------------------

RUN = re.compile("[A-Za-zÀ-ÿ]+").findall


def plain_counts(rows, slip):
    counts = Counter()
    for i, text in rows:
        for run in RUN(text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if slip and h % slip == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    out, form = {}, {}
    for w, n in counts.items():
        near = [v for v in counts if one_apart(v, w)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
        out[w] = [form[w], None, n, len(near), counts[form[w]] if form[w] else None]
    for w in out:
        root = w
        while form[root]:
            root = form[root]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


@pytest.fixture(scope="module")
def writing():
    rng = random.Random(4)
    base = ["".join(rng.choice("abenstéÿ") for _ in range(rng.randint(4, 9))) for _ in range(60)]
    rows = []
    for i in range(300):
        words = []
        for _ in range(rng.randint(0, 40)):
            w = base[min(int(rng.expovariate(0.08)), 59)]
            if rng.random() < 0.3:
                at, kind = rng.randrange(len(w)), rng.randrange(3)
                w = w[:at] + ("" if kind == 0 else rng.choice("aeé")) + w[at + (kind != 1) :]
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, rng.choice([" ", ", ", "-", "×", "\n", "東", "7"]).join(words)))
    return rows + [(None, "abcde abcde ABCDE"), (900, None), (901, ""), (902, "a"), (5, rows[5][1]), (5, rows[5][1]), (903, "Über " * 3000)]


@pytest.mark.parametrize("slip", [None, 7])
def test_word_counts(spark, monkeypatch, writing, slip):
    monkeypatch.setattr(spelling_variants, "HELD_WORDS", 50)
    df = spark.createDataFrame([(i, t, "w", 3) for i, t in writing], "doc_id long, text string, word string, n int").repartition(4)
    got = {r.word: r.n for r in spelling_variants.count_words(df, slip=slip).collect()}
    assert got == plain_counts(writing, slip) and len(got) > 100


@pytest.mark.parametrize("parts", [3, 7])
def test_variants(spark, writing, parts):
    counts = plain_counts(writing, 7)
    words = spark.createDataFrame([*counts.items(), (None, 4), ("nothing", None)], "word string, n long")
    got = spelling_variants.variants(words, parts=parts).collect()
    expected = plain_variants(counts)
    assert len(got) == len(expected) and {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == expected
    assert sum(e[0] is not None for e in expected.values()) > 20 and any(e[0] and e[1] != e[0] for e in expected.values())


def test_every_near_pair_shares_a_signature(spark):
    """All one-letter changes of some words, letters repeated; anagrams are not near."""
    words = ["aaaaa", "abcab", "éeéee", "zzzyx"]
    every = {w[:i] + c + w[j:] for w in words for i in range(len(w) + 1) for j in (i, i + 1) if j <= len(w) for c in ("", "a", "b", "é", "z")} | set(words)
    df = spark.createDataFrame([(w, 1) for w in sorted(every)], "word string, n long")
    got = {tuple(sorted((r.a, r.b))) for r in spelling_variants.near_words(df).collect()}
    assert got == {(a, b) for a in every for b in every if a < b and one_apart(a, b)}


def test_variants_of_no_words(spark):
    none = spark.createDataFrame([], "word string, n long")
    assert spelling_variants.variants(none).count() == 0
    assert spelling_variants.count_words(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        spelling_variants.variants(none, lead=1.0)


# --- quality rules ----------------------------------------------------------

def plain_texts(n):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        kind = i % 8
        if kind == 0:
            words = [w + "###" for w in words]
        elif kind == 1:
            words = words[:1] * len(words)
        yield i, " ".join(words) + ".", int(kind > 1)


def test_rules_are_read_from_printed_trees():
    tree = "DecisionTree\n  If (feature 0 <= 5.5)\n   If (feature 0 <= 2.0)\n    Predict: 0.0\n   Else (feature 0 > 2.0)\n    Predict: 1.0\n  Else (feature 0 > 5.5)\n   Predict: 1.0\n"
    assert quality_rules.rules_of([tree, tree]) == [
        (("chars", "<=", 5.5),), (("chars", "<=", 2.0),), (("chars", "<=", 5.5), ("chars", ">", 2.0)), (("chars", ">", 5.5),)]


def test_quality_learns_and_column_equals_plain_score(spark):
    rows = list(plain_texts(800))
    odd = [(9000, None), (9001, ""), (9002, " \n "), (9003, "x"), (9003, "x"), (None, "word " * 30_000), (9004, "Ünï 東京 😀 !!\n\n|")]
    docs = spark.createDataFrame([(i, t, "s", 2.0, "k") for i, t in [(i, t) for i, t, _ in rows] + odd], "doc_id long, text string, statistics string, score double, `d.x` string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 400] + [(None, 0), (5, 7), (6, None)], "doc_id long, quality int")
    model = quality_rules.fit(docs, labels)
    assert 0 < len(model.rules) < 60
    scored = quality_rules.scored(docs, model)
    assert sorted(scored.columns) == sorted(docs.columns) and scored.count() == docs.count()
    got = defaultdict(list)
    for r in scored.collect():
        got[r.doc_id].append((r.score, model.score(r.text)))
    assert all(0 <= s <= 1 and math.isclose(s, p, rel_tol=1e-9) for many in got.values() for s, p in many)
    assert sum((got[i][0][0] >= 0.7) == bool(y) for i, _, y in rows if i >= 400) >= 396
    kept = quality_rules.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {i for i, _, y in rows if y and got[i][0][0] >= 0.7}
    again = quality_rules.fit(docs.repartition(7), labels)
    assert again == model


def test_quality_without_two_labels(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert math.isclose(quality_rules.fit(docs, labels).score("any"), 2.5 / 3)
    nothing = quality_rules.fit(docs, labels.limit(0))
    assert {r.score for r in quality_rules.scored(docs, nothing).collect()} == {0.5}
    assert quality_rules.scored(docs.limit(0), nothing).count() == 0


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    scored = {r.doc_id: r for r in queries.QUERIES["op13_quality"](spark, folder).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    held = [(scored[r.doc_id].predicted, r.quality) for r in labels if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 500 and sum(p == y for p, y in held) / len(held) > 0.98
    assert all(scored[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in labels)
