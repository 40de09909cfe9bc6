"""Clashing column names, vectors whose squares overflow, and the toxicity model in plain loops."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import collision_search, line_sets, simhash_variants, toxicity

NAMES = ["__tie", "__id", "__no", "no_id", "id", "tie", "gone_id", "gone_tie", "__places", "places", "__cut", "cut", "first", "H", "x.y"]


def test_clashing_names_lose_nothing(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80)]
    rows = []
    for i in range(30):
        text = " ".join(rng.choice(words) for _ in range(30))
        rows.append((i, text if i % 5 else rows[i - 1][1] + " more" if i else text))
    rows += [(None, rows[3][1]), (40, None), (41, ""), (42, rows[7][1] + "\n" + rows[8][1])]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    clashing = plain.select("*", *[F.lit(f"kept {n}").alias(n) for n in NAMES])
    for keep in (simhash_variants.keep_representatives, simhash_variants.keep_dissimilar, line_sets.drop_repeated_lines):
        got, expected = keep(clashing), keep(plain)
        assert got.columns == clashing.columns, keep
        held = got.collect()
        assert sorted((str(r.doc_id), str(r.text)) for r in held) == sorted((str(r.doc_id), str(r.text)) for r in expected.collect()) and len(held) > 20, keep
        assert all(r[n] == f"kept {n}" for r in held for n in NAMES), keep


@pytest.mark.parametrize("scale", [1e160, 1e150, 1e-160, 1e-300])
def test_neighbours_of_extreme_vectors(spark, scale):
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((200, 8)) * scale
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {}
    for r in collision_search.nearest(df, F.col("vec_id") % 20 == 0, k=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert set(got) == set(range(0, 200, 20)) and all(len(v) == 5 for v in got.values())
    if scale in (1e150, 1e-160):
        unit = vectors / scale
        hits = 0
        for q, found in got.items():
            score = unit @ unit[q]
            score[q] = -np.inf
            hits += len({v for _, v in found} & set(np.argsort(-score)[:5].tolist()))
        assert scale < 1 or hits / 50 >= 0.9


def plain_descend(n, rows, y, pairs, bias, penalty, l2, rounds):
    """The same objective and steps, one weight at a time."""
    rare = (max(len(y) - sum(y), 1) / max(sum(y), 1)) ** 0.25
    weight = [max(rare, 1) if v > 0 else max(1 / rare, 1) for v in y]
    weight = [w / sum(weight) for w in weight]
    theta, first, second = [0.0] * n + [bias], [0.0] * (n + 1), [0.0] * (n + 1)
    for t in range(1, rounds + 1):
        slope = [l2 * w for w in theta[:-1]] + [0.0]
        for own, target, share in zip(rows, y, weight):
            error = share * (1 / (1 + math.exp(-(theta[-1] + sum(theta[j] for j in own)))) - target)
            for j in own:
                slope[j] += error
            slope[-1] += error
        for i, other in pairs:
            change = 2 * penalty / len(pairs) * (sum(theta[j] for j in rows[i]) - sum(theta[j] for j in other))
            for j in rows[i]:
                slope[j] += change
            for j in other:
                slope[j] -= change
        for j, g in enumerate(slope):
            first[j], second[j] = 0.9 * first[j] + 0.1 * g, 0.999 * second[j] + 0.001 * g * g
            theta[j] -= 0.1 * (first[j] / (1 - 0.9**t)) / (math.sqrt(second[j] / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], theta[-1]


@pytest.mark.parametrize("penalty", [0.0, 3.0])
def test_descent_equals_plain_loops(penalty):
    rng = random.Random(3)
    rows = [sorted(rng.sample(range(12), rng.randint(0, 6))) for _ in range(40)]
    y = [float(0 in r or 3 in r) for r in rows]
    pairs = [(i, sorted(rng.sample(range(12), 3))) for i in range(0, 40, 4)] if penalty else []
    got = toxicity.descend(12, rows, np.array(y), pairs, -0.5, penalty, 1e-3, 60)
    expected = plain_descend(12, rows, y, pairs, -0.5, penalty, 1e-3, 60)
    assert np.allclose(got[0], expected[0], atol=1e-9) and abs(got[1] - expected[1]) < 1e-9


def test_the_penalty_acts_where_no_text_names_a_group(spark):
    """Mentions are put into a share of the texts; their two members then score alike, and do not make a clean text toxic."""
    rng = random.Random(6)
    plain = ["meets", "walks", "reads", "house", "garden", "letter", "paper", "music", "river", "stone"]
    rows = [(i, " ".join(rng.sample(plain, 5) + (["vile"] if i % 3 == 0 else [])), int(i % 3 == 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    none = toxicity.fit(docs, labels, mention_share=0.0)
    assert (none.swapped, none.mentioned) == (0, 0)
    gaps = {}
    for penalty in (0.0, 20.0):
        model = toxicity.fit(docs, labels, penalty=penalty, mention_share=0.5)
        assert model.swapped == 0 and 200 < model.mentioned < 400
        both = [(model.score(f"{a} meets garden"), model.score(f"{b} meets garden")) for group in toxicity.IDENTITY_TERMS for a, b in zip(group, group[1:])]
        gaps[penalty] = sum(abs(math.log(a / (1 - a)) - math.log(b / (1 - b))) for a, b in both) / len(both)
        assert all(max(pair) < 0.5 for pair in both) and model.score("vile river stone") > 0.5
    assert gaps[20.0] < gaps[0.0] / 2
    assert toxicity.mention("some text", (), 0.5) is None and toxicity.mention(None, (("a", "b"),), 1.0) in (("a", "b"), ("b", "a"))
