"""SimHash near-duplicates by deletion variants.

Fingerprints within two bits of each other are cut into two segments; one of
them differs by at most one bit.  Each fingerprint is indexed under both
segments with each bit in turn made a wildcard, so such a pair meets under
some variant; the full distance is verified in the join.  Equal fingerprints
are folded first: copies cost one index entry together.

For texts of a given Jaccard similarity the distance is wider and there are
more segments, still with one wildcard; pairs are verified on their shingles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.shared import fresh_name
from colloquy.operators.components import connected_components
from colloquy.session import cut_lineage

SEED, MOST_BITS, SEGMENT_BITS = 42, 2, 32
#: Bits by which texts of similarity 0.8 on five words may differ: 9.7 expected, 2.9 standard deviation.
SIMILAR_BITS, SIMILARITY, LEAD_ROUNDS = 15, 0.8, 1
_SLICE = 1 << 13


def _shingles(text: str | None, shingle: int) -> np.ndarray:
    """Hash of each shingle in order; a text of fewer words is one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    parts = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(b" ".join(p), SEED) for p in parts), np.uint64)


def fingerprint_of(text: str | None, shingle: int) -> int:
    """Signed 64-bit form of the fingerprint."""
    return _folded(_shingles(text, shingle))


def _folded(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _SLICE):
        planes = np.unpackbits(hashes[at : at + _SLICE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += planes.sum(axis=0, dtype=np.uint16 if len(planes) < 1 << 16 else np.int64)
    bits = np.packbits(2 * counts > len(hashes)).tobytes()
    return int.from_bytes(bits, "big", signed=True)


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """64 bits as a long: bit set where over half of the shingle hashes set it.
    Null, empty and blank texts have fingerprint zero."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, shingle) for t in texts], dtype="int64")

    return of(text)


def _starts(segments: int) -> list[int]:
    return [64 * i // segments for i in range(segments + 1)]


def _variants(fp: Column, segments: int = 2) -> Column:
    """One long for each segment and wildcard: which bit, and the rest of the segment."""
    keys, starts = [], _starts(segments)
    for start, end in zip(starts, starts[1:]):
        every = (1 << (end - start)) - 1
        segment = F.shiftrightunsigned(fp, start).bitwiseAND(F.lit(every))
        for bit in range(end - start):
            rest = segment.bitwiseAND(F.lit(every ^ (1 << bit)))
            keys.append(rest.bitwiseOR(F.lit((start + bit) << SEGMENT_BITS)))
    return F.array(*keys)


def links(prints: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of distinct fingerprints (column ``fp``, each once)
    that differ by one or two bits, ``a < b`` as signed longs."""
    index = prints.select("fp", F.explode(_variants(F.col("fp"))).alias("variant"))
    left, right = index.select(F.col("fp").alias("a"), "variant"), index.select(F.col("fp").alias("b"), "variant")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_BITS
    return left.join(right, (left.variant == right.variant) & (F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def _marked(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """``doc_id, tie, fp`` of each row; ``tie`` is a hash of the text."""
    own = F.col(f"`{text}`")
    return cut_lineage(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(own).alias("tie"), fingerprint(own, shingle).alias("fp")))


def _members(marked: DataFrame) -> DataFrame:
    """``fp, component_id, first``: the smallest id of the fingerprint's
    component, and the first row of it as ``(no id, doc_id, tie)``."""
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie")
    prints = cut_lineage(marked.groupBy("fp").agg(F.min(row).alias("least")))
    roots = connected_components(links(prints))
    grouped = prints.join(roots, prints.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    firsts = cut_lineage(grouped.groupBy("root").agg(F.min("least").alias("first")))
    return cut_lineage(grouped.join(firsts, "root").select("fp", F.col("first.doc_id").alias("component_id"), "first"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``.

    ``fingerprint`` has 16 lowercase hex digits; ``component_id`` is the
    smallest id reachable over links, itself included.  Null and wordless texts
    have fingerprint zero, linked like any other.  Null ids come after all
    others (a component without an id has a null one).  Repeated rows are kept.
    Other columns of ``docs`` are not read."""
    marked = _marked(docs, doc_id, text, shingle)
    return marked.join(_members(marked), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """``docs`` with one row of each component: the smallest id, then the
    smallest hash of the text; all columns unchanged.  Of rows alike in id and
    text one stays."""
    return _keep_first(docs, _members(_marked(docs, doc_id, text, shingle)), doc_id, text)


def _keep_first(docs: DataFrame, members: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of ``docs`` that are ``first`` of a component, each once."""
    keys = [fresh_name(docs.columns, name) for name in ROW_KEYS]
    first = [F.col("first.no_id"), F.coalesce("first.doc_id", F.lit(0)), F.col("first.tie")]
    firsts = members.select("first").distinct().select(*[c.alias(k) for c, k in zip(first, keys)])
    own = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(*own, *[c.alias(k) for c, k in zip(_row_keys(doc_id, text), keys)])
    return keyed.join(firsts, keys, "left_semi").dropDuplicates(keys).select(*own)


ROW_KEYS = ("no_id", "id", "tie")


def _row_keys(doc_id: str, text: str) -> list[Column]:
    own = F.col(f"`{doc_id}`").cast("long")
    return [own.isNull(), F.coalesce(own, F.lit(0)), F.xxhash64(F.col(f"`{text}`"))]


def _sets(text: Column, shingle: int) -> Column:
    """``fp, node, n`` of the distinct shingles: fingerprint, digest and count."""

    @F.pandas_udf("fp long, node long, n int")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            own = np.unique(_shingles(text, shingle))
            node = xxhash.xxh64_intdigest(own.tobytes(), SEED) - (1 << 63)
            rows.append((_folded(own) if len(own) else 0, node, len(own)))
        return pd.DataFrame(rows, columns=["fp", "node", "n"]).astype({"fp": "int64", "node": "int64", "n": "int32"})

    return of(text)


def _distinct_shingles(text: Column, shingle: int) -> Column:
    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(_shingles(t, shingle)).view(np.int64) for t in texts])

    return of(text)


def _candidates(nodes: DataFrame, bits: int, similarity: float, lead_salt: int | None) -> DataFrame:
    """Pairs ``(a, b)`` of ``nodes`` (``node, fp, n, root``) of unlike root that
    differ by ``bits`` at most and whose sizes admit the similarity.  With
    ``lead_salt`` each node comes with one lead of the variant groups it is in."""
    segments = -(-(bits + 1) // 2)
    band = F.floor(F.log("n") / float(np.log(1 / similarity) * (1 + 1e-9))).cast("int")
    row = F.struct("node", "fp", "n", "root")
    rows = nodes.filter(F.col("n") >= int(np.floor(similarity / (1 - similarity)))).select(row.alias("r"), band.alias("band"), _variants(F.col("fp"), segments).alias("all"))
    left = rows.select(F.col("r").alias("x"), "band", F.explode("all").alias("variant"))
    spread = rows.select("r", "band", "all", F.explode(F.array("band", F.col("band") + 1)).alias("band_y"))
    right = spread.select(F.col("r").alias("y"), (F.col("band") != F.col("band_y")).alias("below"), "band_y", F.explode("all").alias("variant_y"))
    meet = (F.col("variant") == F.col("variant_y")) & (F.col("band") == F.col("band_y"))
    apart = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    near = (F.bit_count(apart) <= bits) & (F.least("x.n", "y.n") >= F.lit(similarity) * F.greatest("x.n", "y.n") - 1e-6) & (F.col("x.root") != F.col("y.root"))
    if lead_salt is not None:
        first = F.min(F.struct(F.xxhash64("x.node", F.lit(lead_salt)).alias("order"), "x")).alias("first")
        leads = cut_lineage(left.groupBy("variant", "band").agg(first).select("variant", "band", "first.order", "first.x"))
        met = leads.join(right, meet & near)
        return met.groupBy("y.node").agg(F.min(F.struct("order", F.col("x.node").alias("lead"))).alias("m")).select(F.col("node").alias("a"), F.col("m.lead").alias("b"))
    # A pair that agrees on a whole segment is taken there under the first wildcard only.
    bit = F.shiftrightunsigned("variant", SEGMENT_BITS).cast("int")
    once = (F.getbit(apart, bit) == 1) | bit.isin(_starts(segments)[:-1])
    met = left.join(right, meet & near & once & (F.col("below") | (F.col("x.node") < F.col("y.node"))))
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, doc_id: str, text: str, shingle: int, similarity: float) -> DataFrame:
    """The pairs whose distinct shingles have the similarity, by their number in both."""
    pairs = cut_lineage(pairs)
    asked = nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node").select(
        "node", F.col("least.no_id").alias("no_id"), F.coalesce("least.doc_id", F.lit(0)).alias("id"), F.col("least.tie").alias("tie"))
    own = [c.alias(k) for c, k in zip(_row_keys(doc_id, text), ROW_KEYS)]
    keyed = docs.select(*own, F.col(f"`{text}`").alias("text")).join(asked, list(ROW_KEYS)).dropDuplicates(["node"])
    sets = cut_lineage(keyed.select("node", _distinct_shingles(F.col("text"), shingle).alias("set")))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("s")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("t")), "b")
    both = both.select("a", "b", F.size("s").alias("m"), F.size("t").alias("n"), F.size(F.array_intersect("s", "t")).alias("common"))
    return both.filter(F.col("common") >= F.lit(similarity) * (F.col("m") + F.col("n") - F.col("common")) - 1e-6).select("a", "b")


def similar_members(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, bits: int = SIMILAR_BITS, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Rows ``doc_id, tie, node`` and nodes ``node, root, first``: each set of
    distinct shingles is a node, nodes of at least the Jaccard ``similarity``
    whose fingerprints differ by ``bits`` at most are linked, and ``first`` is
    the first row of the component.

    Each node is held against leads of its variant groups first; the pairs that
    are then still in unlike components are all listed and verified."""
    own = F.col(f"`{text}`")
    marked = cut_lineage(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(own).alias("tie"), _sets(own, shingle).alias("s")).select("doc_id", "tie", "s.*"))
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie")
    nodes = cut_lineage(marked.groupBy("node").agg(F.first("fp").alias("fp"), F.first("n").alias("n"), F.min(row).alias("least")))
    found, rooted = None, nodes.withColumn("root", F.col("node"))
    for salt in [*range(LEAD_ROUNDS), None]:
        links_now = cut_lineage(_verified(_candidates(rooted, bits, similarity, salt), nodes, docs, doc_id, text, shingle, similarity))
        if links_now.isEmpty():
            continue
        found = links_now if found is None else found.unionByName(links_now)
        roots = connected_components(found).select("node", F.col("root").alias("r"))
        rooted = cut_lineage(nodes.join(roots, "node", "left").select(*nodes.columns, F.coalesce("r", "node").alias("root")))
    firsts = cut_lineage(rooted.groupBy("root").agg(F.min("least").alias("first")))
    return marked.select("doc_id", "tie", "node"), rooted.join(firsts, "root").select("node", "root", "first")


def keep_dissimilar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, bits: int = SIMILAR_BITS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with the first row of each component of ``similar_members``, in
    the order of ``keep_representatives``; all columns unchanged."""
    _, members = similar_members(docs, doc_id, text, shingle, bits, similarity)
    return _keep_first(docs, members, doc_id, text)
