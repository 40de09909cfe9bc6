"""Line dedup by an exact set-similarity join, in DataFrame operations only.

A line is the set of its words.  Words are ordered by rarity; two sets with
Jaccard similarity of at least ``threshold`` share a word among the rarest few
of both (prefix filter).  Sizes and positions bound what else they can share;
survivors are verified exactly.  A line goes when an earlier line matches it.

Rarity comes from counts in ``CELLS`` hash cells, one byte a cell, whatever the
corpus.  A cell that counted one word proves the word single: it can be shared
by no other line and leaves the index before anything is shuffled.

Equal lines are folded first.  Then lines meet a few early ones of a group that
shares one word of their prefixes, and what that settles is never compared with
other late lines again: a large group of near copies costs a few pairs a line and
not all pairs.  All other lines meet in one equality join on the words of
their prefixes.
"""

from __future__ import annotations

import functools
import operator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.shared import fresh_name, shared_folder
from colloquy.session import cut_lineage

#: Cells of the rarity table; steps to a doubling of the count, and the last step.
CELLS = 1 << 20
FINE, MOST = 4, 90
#: First sign of the table: a cell that counted one.
LOWEST = 33
#: Leads of a group at most, lines of a part of a group that has one; places from the end of a prefix whose words make groups.
LEADS, FEW, COMMON = 8, 3, (1, 3)
#: Parts of a line's partners, of each of which the likeliest is tried first.
PARTS = 8
#: Words from which a line has parities of 128 bits.
LONG_LINE = 48
#: Ids, in rows of two longs at most, up to which a join sends them to every task.
BROADCAST_ROWS = 500_000
BLANKS = " \t\n\x0b\x0c\r"


def _other_blanks(text: Column) -> Column:
    """Whether white space occurs that is neither blank nor line end; looked up byte
    by byte, which takes a fraction of a pattern's time."""
    return functools.reduce(operator.or_, [F.contains(text, F.lit(c)) for c in "\t\x0b\x0c\r"])


def words(line: Column) -> Column:
    """``[^\\x20\\x09-\\x0D]+`` in order; a blank line gives one empty string.
    Where all white space is single blanks, a plain cut does."""
    unlike = F.contains(line, F.lit("  ")) | _other_blanks(line)
    return F.when(unlike, F.split(F.trim(line, F.lit(BLANKS)), "[ \\t-\\r]+", -1)).otherwise(F.split(F.trim(line), " ", -1))


def _cell(h: Column) -> Column:
    return h.bitwiseAND(F.lit(CELLS - 1).cast("long")).cast("int")


class Rarity(NamedTuple):
    """One row with an array ``table`` of one byte a cell: ``LOWEST`` where one word
    fell on the cell, then steps of the logarithm of the count.  About a third of
    all words lie below the step ``third``.

    Stored, and read as a scalar: as a literal it would be spelt out in every
    text of a plan, which took the driver over 600 MB."""

    rows: DataFrame
    third: int


def _rarity(rows: DataFrame) -> Rarity:
    """Counted over all whole texts."""
    plain = F.split(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), " ", -1)
    every = F.when(_other_blanks(F.col("text")), F.split("text", "[ \\t-\\r]+", -1)).otherwise(plain)
    word = rows.select(F.explode(every).alias("w")).filter("w <> ''")
    counts = word.groupBy(_cell(F.xxhash64("w")).alias("c")).agg(F.count("*").alias("n"))
    step = F.least(F.floor(F.log2("n") * FINE), F.lit(MOST)).cast("tinyint")
    steps = counts.filter("n > 1").select("c", step.alias("step")).toArrow()  # CELLS rows of five bytes at most
    table = np.full(CELLS, LOWEST, np.int8)
    table[steps["c"].to_numpy()] = LOWEST + steps["step"].to_numpy()
    words_at = np.bincount(table - LOWEST, minlength=MOST + 1) * 2 ** (np.arange(MOST + 1) / FINE)
    below = np.cumsum(words_at) - words_at
    held = rows.sparkSession.createDataFrame(pa.table({"table": pa.array([table], pa.list_(pa.int8()))}))
    return Rarity(_stored(held.coalesce(1), "rarity"), LOWEST + int((below <= words_at.sum() / 3).sum()) - 1)


def _tokens(line: Column, table: Column) -> Column:
    """The distinct words of a line as longs: step of rarity, then 56 bits of
    hash; rarer ones are smaller."""
    def token(h):
        return F.shiftleft(F.get(table, _cell(h)).cast("long"), 56).bitwiseOR(F.shiftrightunsigned(h, 8))

    return F.transform(F.array_distinct(F.transform(words(line), lambda w: F.xxhash64(w))), token)


def _rarest(tokens: Column, rare: Column, k: Column) -> Column:
    """The ``k`` smallest tokens, in order; ``rare`` are those below a step, which
    need not all be sorted where they are enough."""
    return F.slice(F.sort_array(F.when(F.size(rare) >= k, rare).otherwise(tokens)), F.lit(1), k)


def _parity(tokens: Column) -> Column:
    """64 bits, each the parity of the words that fall on it: two sets that differ
    in ``d`` words differ in ``d`` bits at most."""
    one = F.lit(1).cast("long")
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda bits, t: bits.bitwiseXOR(
        F.call_function("shiftleft", one, t.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    ))


def _parities(tokens: Column, n: Column) -> list[Column]:
    """``even, odd``: 128 bits for a long line, half of its words in each; a short
    one has all words in ``even``.  The two together are the parity of all."""
    half = lambda bit: _parity(F.filter(tokens, lambda t: F.getbit(t, F.lit(6)) == bit))
    long = n > LONG_LINE
    return [F.when(long, half(0)).otherwise(_parity(tokens)).alias("even"), F.when(long, half(1)).otherwise(F.lit(0).cast("long")).alias("odd")]


def _least_overlap(a: Column, b: Column, threshold: float) -> Column:
    """Words two sets of sizes ``a`` and ``b`` must share."""
    return F.ceil(F.lit(threshold / (1 + threshold)) * (a + b) - 1e-9)


def _alike(threshold: float) -> Column:
    """Of rows ``x`` and ``y``: length filter, and the bound on how many words may
    differ held against the parities."""
    nx, ny = F.col("x.n"), F.col("y.n")
    even, odd = (F.col(f"x.{p}").bitwiseXOR(F.col(f"y.{p}")) for p in ("even", "odd"))
    both = F.least(nx, ny) > LONG_LINE
    differ = F.when(both, F.bit_count(even) + F.bit_count(odd)).otherwise(F.bit_count(even.bitwiseXOR(odd)))
    return (F.least(nx, ny) >= F.lit(threshold) * F.greatest(nx, ny) - 1e-9) & (differ <= nx + ny - 2 * _least_overlap(nx, ny, threshold))


def _in_place(threshold: float) -> Column:
    """Positional filter at the first word that ``x`` and ``y`` share: this word and
    those after it are all they can share.  At a word that is not the first the
    filter may fail; a pair is met at its first one all the same."""
    nx, ny, ax, ay = (F.col(c) for c in ("x.n", "y.n", "x.at", "y.at"))
    return F.least(nx - ax, ny - ay) >= _least_overlap(nx, ny, threshold)


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("tie"), "text")


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``h, doc_id, tie, place, line`` of every line with words."""
    return _cut(_rows(docs, doc_id, text))


def _cut(rows: DataFrame) -> DataFrame:
    lines = rows.select("doc_id", "tie", F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    blank = (F.trim("line") == "") | (_other_blanks(F.col("line")) & (F.trim("line", F.lit(BLANKS)) == ""))
    return lines.filter(~blank).select(F.xxhash64("line").alias("h"), "doc_id", "tie", "place", "line")


def _stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: Spark then knows its size."""
    folder = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _ids(df: DataFrame, name: str) -> DataFrame:
    """A few narrow columns of ids, stored and counted: broadcast up to
    ``BROADCAST_ROWS``, left to Spark's own choice of join beyond."""
    held = _stored(df, name)
    return F.broadcast(held) if held.count() <= BROADCAST_ROWS else held


def _marked(lines: DataFrame, rarity: Rarity, threshold: float) -> DataFrame:
    """``h, first, own`` of every line: what ``_distinct_lines`` keeps of one."""
    n, k = F.size("tokens"), F.col("k")
    # Read once only, so Spark puts the scalar where it is read and no row holds it.
    looking = lines.select("h", F.struct("doc_id", "tie", "place").alias("first"), "line", rarity.rows.scalar().alias("table"))
    marked = looking.select("h", "first", _tokens(F.col("line"), F.col("table")).alias("tokens"))
    marked = marked.select("h", "first", n.alias("n"), *_parities(F.col("tokens"), n), "tokens", (n - F.ceil(F.lit(threshold) * n - 1e-9) + 1).cast("int").alias("k"))
    rare = F.filter("tokens", lambda t: t < (rarity.third << 56))
    marked = marked.withColumn("rare", rare)
    shared = F.filter(_rarest(F.col("tokens"), F.col("rare"), k), lambda t: t >= ((LOWEST + 1) << 56))
    keys = F.transform(shared, lambda t: t.bitwiseAND(F.lit((1 << 31) - 1).cast("long")).cast("int"))
    return marked.select("h", "first", F.struct("n", "even", "odd", "k", keys.alias("keys")).alias("own"))


def _distinct_lines(lines: DataFrame, rarity: Rarity, threshold: float) -> DataFrame:
    """Each distinct line once: ``id``, its hash, its first place and how often
    it occurs; size, parity, and the words of its prefix that are not single
    (31 bits each), of which ``skip`` single ones come before."""
    marked = _marked(lines, rarity, threshold)
    folded = marked.groupBy("h").agg(F.min("first").alias("first"), F.count("*").alias("copies"), F.any_value("own").alias("own"))
    return _stored(folded.select(
        F.monotonically_increasing_id().alias("id"), "h", "first", "copies", "own.n", "own.even", "own.odd", (F.col("own.k") - F.size("own.keys")).alias("skip"), "own.keys"
    ), "distinct-lines")


def _doc() -> Column:
    return F.coalesce("first.doc_id", F.lit(-(1 << 63))).alias("doc")


def _met_leads(distinct: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``(a, b)`` of a line and a lead of its groups that might match it.  A
    group shares the word of the prefix whose hash is least, or one of two
    common ones: near copies share those where the words of their own are rare.  A
    group has ``LEADS`` leads at most, each the earliest line of one part of
    ``FEW`` lines or more; lines of smaller groups are left to the join on all words."""
    least = F.array_min(F.transform("keys", lambda k: F.xxhash64(k)))
    common = [F.xxhash64(F.element_at("keys", -F.least(F.size("keys"), F.lit(back)))) for back in COMMON]
    asked = distinct.filter("size(keys) > 0").select(F.explode(F.array_distinct(F.array(least, *common))).alias("key"), _doc(), "id", "n", "even", "odd")
    part = F.pmod(F.xxhash64("id"), F.lit(LEADS)).alias("part")
    # Of one row all four: they follow the same column, row by row. No struct, which Spark would sort for.
    leads = asked.groupBy("key", part).agg(F.count("*").alias("lines"), *[F.min_by(c, "doc").alias(c) for c in ("id", "n", "even", "odd")])
    leads = leads.filter(F.col("lines") >= FEW).select("key", "id", "n", "even", "odd")
    met = asked.alias("x").join(leads.alias("y"), "key").filter((F.col("x.id") != F.col("y.id")) & _alike(threshold))
    return met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def _verified(pairs: DataFrame, distinct: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """``id`` of the later line of each pair ``(a, b)`` that reaches the threshold.
    Only lines in pairs are fetched, one copy of each, and only the documents that
    hold one first are cut into lines."""
    pairs = cut_lineage(pairs.distinct())
    some = _ids(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "asked-lines")
    named = distinct.join(some, "id").select("id", "h", "first")
    wanted = _ids(named.select("id", "h", "first.doc_id", "first.tie"), "wanted-lines")
    holding = _ids(wanted.select(F.xxhash64("doc_id", "tie").alias("own")).distinct(), "wanted-documents")
    some_rows = rows.withColumn("own", F.xxhash64("doc_id", "tie")).join(holding, "own", "left_semi")
    held = _cut(some_rows).select("h", "line").join(wanted.select("id", "h"), "h").groupBy("id").agg(F.any_value("line").alias("line"))
    # A line in many pairs is cut into words once.
    sets = held.select("id", F.array_distinct(F.transform(words(F.col("line")), lambda w: F.xxhash64(w))).alias("words"))
    sets = _stored(sets.join(named.select("id", "first"), "id"), "line-sets")
    both = pairs.join(sets.alias("x"), F.col("a") == F.col("x.id")).join(sets.alias("y"), F.col("b") == F.col("y.id"))
    both = both.select("a", "b", F.col("x.first").alias("af"), F.col("y.first").alias("bf"), F.col("x.words").alias("s"), F.col("y.words").alias("t"))
    enough = F.size(F.array_intersect("s", "t")) >= _least_overlap(F.size("s"), F.size("t"), threshold)
    return both.filter(enough).select(F.when(F.col("af") < F.col("bf"), F.col("b")).otherwise(F.col("a")).alias("id")).distinct()


def _index(distinct: DataFrame, asks: Column) -> DataFrame:
    """A row for each word of a prefix that may be shared; ``asks``: 1 where the line
    looks for partners, 0 where it is only a partner."""
    placed = distinct.select("id", _doc(), "n", "even", "odd", "skip", asks.alias("asks"), F.posexplode("keys").alias("pos", "token"))
    return placed.select("token", "id", "doc", "n", "even", "odd", (F.col("pos") + F.col("skip")).alias("at"), "asks")


def _met(x: DataFrame, y: DataFrame, threshold: float) -> DataFrame:
    """``a, b, differ``: asking lines of ``x`` and other lines of ``y``, of no later
    document, that may match; once for each word that may be the first they share."""
    # That x asks, told by a column of both sides: with one index on both, Spark shuffles it once.
    asking = 2 * F.col("x.asks") + F.col("y.asks") > 1
    fits = (F.col("x.id") != F.col("y.id")) & (F.col("y.doc") <= F.col("x.doc")) & asking & _alike(threshold) & _in_place(threshold)
    differ = F.bit_count(F.col("x.even").bitwiseXOR(F.col("x.odd")).bitwiseXOR(F.col("y.even")).bitwiseXOR(F.col("y.odd")))
    return x.alias("x").join(y.alias("y"), "token").filter(fits).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), differ.alias("differ"))


def _likeliest(met: DataFrame) -> DataFrame:
    """For each line the likeliest partner in each of a few parts of all its
    partners, and whether those are ``every`` one it met.  A line settled by one of
    them needs no other, so a group of near copies gives few pairs a line."""
    aggregates = []
    for j in range(PARTS):
        aggregates += [F.expr(f"{e} FILTER (WHERE part = {j}) AS {name}{j}") for e, name in (("min_by(b, differ)", "best"), ("min(b)", "least"), ("max(b)", "most"))]
    rows = met.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(PARTS))).groupBy("a").agg(*aggregates)
    every = F.lit(True)
    for j in range(PARTS):
        every = every & F.col(f"least{j}").eqNullSafe(F.col(f"most{j}"))
    return rows.select("a", F.array_compact(F.array(*[f"best{j}" for j in range(PARTS)])).alias("best"), every.alias("every"))


def _repeated(docs: DataFrame, threshold: float, doc_id: str, text: str) -> DataFrame:
    """``repeated_lines``; repeated rows give repeated places."""
    rows = _rows(docs, doc_id, text)
    lines = _cut(rows)
    distinct = _distinct_lines(lines, _rarity(docs.select(F.col(f"`{text}`").alias("text"))), threshold)
    settled = _ids(_verified(_met_leads(distinct, threshold), distinct, rows, threshold), "settled-lines")

    # Lines still open meet each other and, as partners, the settled ones.
    open_ = F.col("done").isNull().cast("int")
    every = _index(distinct.join(settled.withColumn("done", F.lit(True)), "id", "left"), open_)
    likely = cut_lineage(_likeliest(_met(every, every, threshold)))
    found = _ids(_verified(likely.select("a", F.explode("best").alias("b")), distinct, rows, threshold), "found-lines")
    gone = settled.unionByName(found)
    # Lines with more partners than were tried, none of which settled them, meet all.
    left = _ids(likely.filter("NOT every").select(F.col("a").alias("id")).join(found, "id", "left_anti"), "left-lines")
    if not left.isEmpty():
        asking = _index(distinct.join(left, "id", "left_semi"), F.lit(1))
        tokens = _ids(asking.select("token").distinct(), "left-words")
        rest = _met(asking, _index(distinct, F.lit(0)).join(tokens, "token", "left_semi"), threshold).select("a", "b")
        gone = gone.unionByName(_verified(rest, distinct, rows, threshold))
    gone = _ids(gone.distinct(), "gone")

    # Equal lines: all but the first go; the first goes when another set matched it.
    narrow = distinct.select("id", "h", "first", "copies").join(gone.withColumn("goes", F.lit(True)), "id", "left")
    meant = _ids(narrow.filter("goes OR copies > 1").select("h", F.when(F.col("goes").isNull(), F.col("first")).alias("after")), "gone-lines")
    places = lines.select("h", "doc_id", "tie", "place").join(meant, "h")
    return places.filter(F.col("after").isNull() | (F.struct("doc_id", "tie", "place") > F.col("after"))).select("doc_id", "tie", "place")


def repeated_lines(docs: DataFrame, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, tie, place`` of every line that an earlier line matches.

    Earlier: smaller document id (null first), then smaller ``tie`` (a hash of
    the text), then smaller line number from 0.  Matches are judged on the
    input: a line matched only by a removed line goes too.  Lines without words
    are never matched; a null text has no lines.  Rows alike in id and text are
    one document.  Other columns are not read."""
    return _repeated(docs, threshold, doc_id, text).distinct()


def line_report(docs: DataFrame, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_removed, removed_lines`` (line numbers from 0,
    ascending, as text joined by commas), one row per document; a null text has
    no lines, an empty text one."""
    gone = _by_document(_repeated(docs, threshold, doc_id, text))
    own = F.col(f"`{text}`")
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(own).alias("tie"),
        F.coalesce(F.octet_length(own) - F.octet_length(F.replace(own, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines"),
    )
    joined = rows.alias("r").join(gone.alias("g"), F.expr("r.doc_id <=> g.gone_id AND r.tie = g.gone_tie"), "left")
    return joined.select(
        "r.doc_id", "n_lines", F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.col("places").cast("array<string>"), ","), F.lit("")).alias("removed_lines"),
    )


def _by_document(places: DataFrame) -> DataFrame:
    """Removed line numbers of each document; as many as it has lines at most."""
    return places.groupBy(F.col("doc_id").alias("gone_id"), F.col("tie").alias("gone_tie")).agg(F.array_sort(F.collect_set("place")).alias("places"))


def drop_repeated_lines(docs: DataFrame, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without their repeated lines, all columns kept, whatever their
    names.  A document that loses every line that has words is dropped; one that
    had none, or a null text, stays as it is."""
    gone = _by_document(_repeated(docs, threshold, doc_id, text))
    cut = fresh_name(docs.columns, "cut")
    own, places = F.col(f"d.`{text}`"), F.col("g.places")
    marked = docs.alias("d").join(gone.alias("g"), F.expr(f"cast(d.`{doc_id}` AS bigint) <=> g.gone_id AND xxhash64(d.`{text}`) = g.gone_tie"), "left")
    kept = F.array_join(F.filter(F.split(own, "\n", -1), lambda line, i: ~F.array_contains(places, i)), "\n")
    new = F.when(places.isNull(), own).otherwise(kept)
    out = marked.select(*[new.alias(c) if c == text else F.col(f"d.`{c}`") for c in docs.columns], places.isNotNull().alias(cut))
    return out.filter(~F.col(cut) | (F.trim(F.col(f"`{text}`"), F.lit(BLANKS)) != "")).drop(cut)
