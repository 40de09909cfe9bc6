"""Near-duplicates: what bounds the work changes no result."""
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colloquy.functions import matching as M
from colloquy.functions import text as T
from colloquy.operators import consolidate

PARTS = "the and tion ing her ere ent for with are wh st an re on".split()


def told(rnd, n):
    return " ".join(rnd.choice(PARTS) + rnd.choice(["", *PARTS]) for _ in range(n))


def tile(rnd, n):
    """One tile against itself: light rows but for the first two, some alike."""
    texts = [told(rnd, rnd.randint(12, 30)) for _ in range(n)]
    texts[5], texts[9] = texts[4] + " re", "an " + texts[0]
    rows = []
    for k, text in enumerate(texts):
        row = {"submission_id": "d", "stance": "mixed", "question": "q1", "text_id": f"{rnd.random():.9f}", "chars": len(text),
               "first_segment": f"s{k:03d}", "last_segment": f"s{k:03d}", "root": "h" if k < 2 else f"r{k}", "light": k > 1, "summary": text,
               "left_tile": 0, "right_tile": 0}
        rows += [{**row, "is_left": True}] * (k > 1) + [{**row, "is_left": False}]
    return rows


def test_a_tile_is_bounded_for_many_pairs_at_once(monkeypatch):
    rows, calls, one = tile(random.Random(3), 60), [], M.common_subsequence
    monkeypatch.setattr(M, "common_subsequence", lambda a, b: calls.append(1) or one(a, b))
    got = {tuple(sorted(m)) for f in M.tile_matches(iter([pd.DataFrame(rows)])) for m in f[["a", "b"]].values.tolist()}
    right = [r for r in rows if not r["is_left"]]
    want = {(x["first_segment"], y["first_segment"]) for i, x in enumerate(right) for y in right[i + 1:]
            if x["root"] != y["root"] and M.similarity_of(x["summary"], y["summary"], M.SUMMARY_SIMILARITY) is not None}
    assert got == want and ("s004", "s005") in got
    assert len(calls) - 60 * 59 // 2 < 120  # the latter are this test's own


def test_texts_side_by_side_have_the_same_subsequences():
    rnd = random.Random(5)
    texts = [told(rnd, n) for n in (1, 3, 40, 7, 22)] + ["a", "zzz"]
    for first in range(len(texts)):
        for text in texts:
            assert M._Beside(texts).common(text, first).tolist() == [M.common_subsequence(text, t) for t in texts[first:]]


def test_fingerprints_do_not_depend_on_the_texts_beside(monkeypatch):
    rnd = random.Random(7)
    texts = [told(rnd, n) for n in (0, 1, 3, 60, 9, 200)] + ["x" * 19, "y" * 20, ""]
    alone = [M.fingerprint_text(t) for t in texts]
    for size in (1, 150, 1 << 16):
        monkeypatch.setattr(M, "PRINT_CHARS", size)
        *columns, held = M.fingerprint_texts(texts)
        assert held.tolist() == [len(a[0]) for a in alone] and held[3] and not held[-1]
        for i, column in enumerate(columns):
            assert column.tolist() == np.concatenate([a[i] for a in alone]).tolist()


@pytest.mark.parametrize("code", [0, 0x600, 0x1600, 0x2000, 0x3000])
def test_normal_form_of_every_kind_of_character(spark, code):
    texts = [f"A{chr(c)}b  {chr(c)}{chr(c)}9" for c in range(code, code + 0x200)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.match_norm(F.col("t")).alias("n")).collect()
    assert len(rows) == len(texts)
    for t, n in rows:
        assert n == re.sub(r"[^a-z0-9 ]+", " ", re.sub(rf"[{T.SPACES}]+", " ", t.lower())).strip(" "), repr(t)


def test_passages_are_normalized_once(spark):
    schema = "submission_id string, segment_id string, question_ids array<string>, position string, source_passage string"
    rows = [("a", f"s{i}", ["q1"], "mixed", "Ferries that berth at the north pier use shore power." + "!" * i) for i in range(3)] + [("a", "t", ["q1"], "mixed", "short")]
    records = consolidate._records(spark.createDataFrame(rows, schema), ("passage",))
    found = consolidate._involved(records)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == records._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(")
    assert {r.segment_id for r in found.collect()} == {"s0", "s1", "s2"}


def test_evidence_makes_the_texts_of_linked_positions_once(spark):
    schema = "submission_id string, segment_id string, question_ids array<string>, position string, public_summary string, source_passage string"
    rows = [("a", f"s{i}", ["q1"], "mixed", f"Summary {i % 2}.", "Ferries that berth at the pier use shore power." + "!" * i) for i in range(4)]
    positions = spark.createDataFrame(rows, schema)
    links = spark.createDataFrame([("a", "s0", "s2"), ("a", "s0", "s1")], "submission_id string, a string, b string")
    found = consolidate.link_evidence(links, positions)
    assert "regexp_replace(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.first_segment_id, r.second_segment_id, r.passage_containment, r.summary_similarity) for r in found.collect()) == [
        ("s0", "s1", 1.0, 0.889), ("s0", "s2", 1.0, 1.0)]
