"""Only shared fingerprints leave a task, however a submission is dealt out."""
import random

import pytest

from colloquy.operators import consolidate

SCHEMA = "submission_id string, segment_id string, stance string, mask long, passage string, given_chars int"


def _rows():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(400)]
    line = lambda n: " ".join(rng.choices(words, k=n))
    rows = []
    for s in range(40):
        lines = [line(30) for _ in range(6)]
        lines += [lines[0], lines[1] + " " + line(4), line(2) + " " + lines[1][40:150]] if s % 4 == 0 else []
        rows += [(f"s{s}", f"g{i:02d}", "support", 1, text, len(text)) for i, text in enumerate(lines)]
    return rows


def _shared(df):
    rows = consolidate._involved(df).collect()
    shared = [r for r in rows if r.fp is not None]
    assert len({(r.submission_id, r.text_id) for r in shared}) == len(shared) and all(r.chars == len(r.passage) for r in shared)
    return (
        {(r.submission_id, r.passage, tuple(sorted(zip(r.fp, r.start, r.stop)))) for r in shared},
        {(r.submission_id, r.segment_id, r.text_id, r.chars) for r in rows},
    )


def test_only_shared_fingerprints_are_kept(spark):
    from colloquy.functions.matching import fingerprint_text

    rows = _rows()
    holders = {}
    for s, _, _, _, text, _ in rows:
        for fp in fingerprint_text(text)[0]:
            holders.setdefault((s, int(fp)), set()).add(text)
    expected = set()
    for s, _, _, _, text, _ in rows:
        kept = tuple(sorted((int(f), int(a), int(b)) for f, a, b in zip(*fingerprint_text(text)) if len(holders[s, int(f)]) > 1))
        if kept:
            expected.add((s, text, kept))
    found, involved = _shared(spark.createDataFrame(rows, SCHEMA))
    assert found == expected and 20 <= len(found) < len(rows) / 4
    # Copies of one text match each other even where they share nothing with another one.
    given = [(r[0], r[4]) for r in rows]
    either = {(s, text) for s, text, _ in expected} | {key for key in given if given.count(key) > 1}
    assert {(s, g) for s, g, _, _ in involved} == {(s, g) for s, g, _, _, text, _ in rows if (s, text) in either}


@pytest.mark.parametrize("chars", [0, 1500])
def test_large_submissions_keep_the_same(spark, monkeypatch, chars):
    df = spark.createDataFrame(_rows(), SCHEMA)
    whole = _shared(df)
    monkeypatch.setattr(consolidate, "LARGE_CHARS", chars)
    assert _shared(df) == whole


@pytest.mark.parametrize("batch", [1, 3, 1000])
def test_submissions_may_span_batches(batch):
    import pandas as pd

    from colloquy.functions import matching

    rows = pd.DataFrame(sorted(_rows()), columns=["submission_id", "segment_id", "stance", "mask", "passage", "given_chars"])
    cut = lambda n: pd.concat(matching.shared_fingerprints(iter([rows[i:i + n] for i in range(0, len(rows), n)])))
    one, other = cut(len(rows)), cut(batch)
    key = lambda f: sorted((r.submission_id, r.segment_id, r.text_id, () if r.fp is None else tuple(r.fp), r.passage or "") for r in f.itertuples())
    assert key(one) == key(other) and len(one)
    assert not list(matching.shared_fingerprints(iter([rows[:0]])))
    assert not len(pd.concat(matching.shared_fingerprints(iter([rows[:1]]))))
