"""The prefix join of line dedup makes few rows of a large group of near copies."""
import random
import re

from colloquy.llm import line_sets


def near_copies(group):
    """Every line has a few rare words of its own, and shares the others."""
    rng = random.Random(5)
    base, rows = [f"base{j}" for j in range(72)], []
    for i in range(group):
        line = list(base)
        for at in rng.sample(range(72), rng.randrange(3, 11)):
            line[at] = f"x{rng.randrange(group // 4)}"
        rows.append((i, " ".join(line)))
    return rows


def test_rows_of_the_join_and_what_is_removed(spark, monkeypatch):
    rows, made, met = near_copies(500), [], line_sets._met

    def counted(x, y, threshold):
        pairs = met(x, y, threshold)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(line_sets, "_met", counted)
    got = {r.doc_id for r in line_sets.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [(i, set(text.split(" "))) for i, text in rows]
    gone = {b for n, (b, t) in enumerate(sets) if any(len(s & t) >= 0.8 * len(s | t) for _, s in sets[:n])}
    assert got == gone and 100 < len(gone) < 500
    assert sum(made) < 60 * len(rows)


def test_index_is_shuffled_once(spark):
    docs = spark.createDataFrame(near_copies(40), "doc_id long, text string")
    lines = line_sets._lines(docs, "doc_id", "text")
    distinct = line_sets._distinct_lines(lines, line_sets._rarity(docs.select("text")), 0.8)
    index = line_sets._index(distinct, (line_sets.F.col("id") % 3 > 0).cast("int"))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = line_sets._met(index, index, 0.8)
        met.collect()
        assert "ReusedExchange" in met._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_small_groups_have_no_leads(spark):
    """Lines that share words with a few others only are not met twice, and each pair of them is found all the same."""
    rows = [(i, " ".join([f"g{i // 3}x{j}" for j in range(12)] + [f"own{i % 3}"])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    distinct = line_sets._distinct_lines(line_sets._lines(docs, "doc_id", "text"), line_sets._rarity(docs.select("text")), 0.8)
    assert line_sets._met_leads(distinct, 0.8).count() == 0
    got = {r.doc_id for r in line_sets.repeated_lines(docs).collect()}
    assert got == {i for i in range(60) if i % 3}


def test_words_and_line_counts_of_any_white_space(spark):
    texts = ["", " ", "a", " a b ", "a  b", "\ta\x0bb\x0cc\rd ", "a\rb", "\r", " \t ", "é ö a", None]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.i: r.w for r in spark.createDataFrame(rows, "i long, t string").select("i", line_sets.words(line_sets.F.col("t")).alias("w")).collect()}
    for i, t in rows:
        assert got[i] == (None if t is None else re.findall(r"[^\x20\x09-\x0D]+", t) or [""])
    many = [(i, t) for i, t in enumerate(["", "\n", "a\n", "\n\na\nä\n", None, "x"])]
    found = {r.doc_id: r.n_lines for r in line_sets.line_report(spark.createDataFrame(many, "doc_id long, text string")).collect()}
    assert found == {i: 0 if t is None else len(t.split("\n")) for i, t in many}


def test_rarity_counts_every_word(spark):
    """One byte a cell: its lowest sign for a word met once, more for others; no Python runs in a task for it."""
    docs = spark.createDataFrame([("a b\nb c\tc c",), ("c\x0bd  a\n\nb",), (None,)], "text string")
    rarity = line_sets._rarity(docs)
    counts = {"a": 2, "b": 3, "c": 4, "d": 1, "none": 0}
    h = line_sets.F.xxhash64("w")
    at = {r.w: r.c for r in spark.createDataFrame([(w,) for w in counts], "w string").select("w", line_sets._cell(h).alias("c")).collect()}
    table = rarity.rows.first().table
    assert len(table) == line_sets.CELLS
    assert {w: table[c] for w, c in at.items()} == {"a": 33 + 4, "b": 33 + 6, "c": 33 + 8, "d": 33, "none": 33}
