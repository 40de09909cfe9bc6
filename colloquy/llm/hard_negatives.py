"""Hard negatives by a multiway hyperplane tree with distance ranges.

Each node of the tree has several split points; a row goes to its nearest one
(the hyperplanes between them bound the subtrees).  For every pair of siblings
the node stores the range of distances from one's split point to the rows under
the other.  A query that looks for scores in a window looks, in distances, into
an annulus; a subtree is left out when its range from any sibling's split point
cannot meet the annulus by the triangle inequality.  Leaves are scored exactly.

Inner products become distances by one added coordinate that gives every row
the same length.  The upper tree is fitted on a bounded sample and its ranges
are taken over all rows; its leaves are cut into chunks of bounded size, each
with a lower tree of its own.  Queries travel to the chunks that the upper tree
leaves them, in blocks of bounded size, and each brings back its best few.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.shared import shared_folder
from colloquy.session import cut_lineage

#: Rows of a chunk and queries of a block; children of a node; rows of a lower leaf.
CHUNK_ROWS, BLOCK_ROWS = 8192, 2048
ARITY, LEAF_ROWS, MOST_DEPTH = 16, 256, 12
#: Rows that the upper tree is fitted on, at most about.
SAMPLE_ROWS = 32_768
NONE, ANY = -(1 << 62), 1 << 62
SEED = 11


def lifted(vectors: np.ndarray, square: float) -> np.ndarray:
    """One more coordinate, after which every vector has the squared length ``square``."""
    own = vectors.astype(np.float64)
    return np.column_stack([own, np.sqrt(np.maximum(square - (own**2).sum(axis=1), 0))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    apart = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(apart, 0))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; in floating point where that is exact."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Node:
    """Split points, their children and the ranges between them; or a leaf."""

    def __init__(self, number: int):
        self.number, self.rows, self.splits, self.children = number, None, None, []
        self.low = self.high = None

    def widen(self, near: np.ndarray, apart: np.ndarray) -> None:
        """Take rows into the ranges: ``low[i, j]`` is the least distance from
        split point ``i`` to a row under child ``j``."""
        m = len(self.splits)
        if self.low is None:
            self.low, self.high = np.full((m, m), np.inf), np.full((m, m), -np.inf)
        for j in range(m):
            under = apart[near == j]
            if len(under):
                self.low[:, j] = np.minimum(self.low[:, j], under.min(axis=0))
                self.high[:, j] = np.maximum(self.high[:, j], under.max(axis=0))

    def admits(self, child: int, apart: np.ndarray, inner: np.ndarray, outer: np.ndarray, margin: float) -> np.ndarray:
        """Which queries, ``apart`` from the split points, could have a row under
        ``child`` between ``inner`` and ``outer`` of themselves."""
        low, high = self.low[:, child], self.high[:, child]
        inner, outer = inner[:, None] - margin, outer[:, None] + margin
        return ((apart + high >= inner) & (low - apart <= outer) & (apart - high <= outer)).all(axis=1)


def _split_points(points: np.ndarray, rng) -> np.ndarray:
    """Rows far from each other, out of a few random ones."""
    some = points[rng.choice(len(points), min(len(points), 3 * ARITY), replace=False)]
    chosen, far = [0], distances(some, some[:1])[:, 0]
    tiny = 1e-6 * max(float(np.sqrt((some[0] ** 2).sum())), 1e-300)
    while len(chosen) < min(ARITY, len(some)) and far.max() > tiny:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distances(some, some[chosen[-1:]])[:, 0])
    return some[chosen]


def grow(points: np.ndarray, leaf_rows: int) -> list[Node]:
    """The tree of lifted ``points`` as its nodes, root first.  Leaves hold row
    numbers, ``leaf_rows`` of them at most unless the rows cannot be told apart."""
    rng, nodes = np.random.default_rng(SEED), []

    def below(rows: np.ndarray, depth: int) -> Node:
        node = Node(len(nodes))
        nodes.append(node)
        if len(rows) > leaf_rows and depth < MOST_DEPTH:
            splits = _split_points(points[rows], rng)
            apart = distances(points[rows], splits)
            near = apart.argmin(axis=1)
            if len(np.unique(near)) > 1:
                node.splits = splits
                node.widen(near, apart)
                node.children = [below(rows[near == j], depth + 1) for j in range(len(splits))]
                return node
        node.rows = rows
        return node

    below(np.arange(len(points)), 0)
    return nodes


def assign(root: Node, points: np.ndarray, seen=None) -> np.ndarray:
    """Leaf number of each point; ``seen(node, near, apart)`` is told each step."""
    out = np.zeros(len(points), np.int32)

    def down(node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if node.splits is None:
            out[rows] = node.number
            return
        apart = distances(points[rows], node.splits)
        near = apart.argmin(axis=1)
        if seen:
            seen(node, near, apart)
        for j, child in enumerate(node.children):
            down(child, rows[near == j])

    down(root, np.arange(len(points)))
    return out


class Queries:
    """Vectors with score windows ``lo`` to ``hi``, ready to walk a tree."""

    def __init__(self, vectors: np.ndarray, lo: np.ndarray, hi: np.ndarray, square: float):
        self.vectors, self.lo, self.hi = vectors, lo, hi
        self.points = np.column_stack([vectors.astype(np.float64), np.zeros(len(vectors))])
        self.reach = (self.points**2).sum(axis=1) + square
        self.margin = 1e-6 * float(np.sqrt(max(self.reach.max(initial=0), square, 1e-300)))
        self.inner = self._radius(hi)

    def _radius(self, score: np.ndarray, at=slice(None)) -> np.ndarray:
        return np.sqrt(np.maximum(self.reach[at] - 2.0 * score, 0))

    def walk(self, root: Node, at_leaf, least=None) -> None:
        """Call ``at_leaf(leaf, queries)`` wherever the window may be met;
        ``least`` (scores, changed on the way) narrows it from below."""

        def down(node: Node, asks: np.ndarray) -> None:
            if not len(asks):
                return
            if node.splits is None:
                at_leaf(node, asks)
                return
            apart = distances(self.points[asks], node.splits)
            for j, child in enumerate(node.children):
                lo = self.lo[asks] if least is None else np.maximum(self.lo[asks], least[asks])
                down(child, asks[node.admits(j, apart, self.inner[asks], self._radius(lo, asks), self.margin)])

        down(root, np.arange(len(self.vectors)))


class Best:
    """The ``k`` best of each query so far: higher score, then smaller id."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.full(queries, NONE)
        self.at = self.score = self.ids = np.zeros(0, np.int64)

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        at, score, ids = (np.concatenate(both) for both in ((self.at, at), (self.score, score), (self.ids, ids)))
        order = np.lexsort((ids, -score, at))
        at, score, ids = at[order], score[order], ids[order]
        first = np.searchsorted(at, at)
        rank = np.arange(len(at)) - first
        self.at, self.score, self.ids = at[rank < self.k], score[rank < self.k], ids[rank < self.k]
        full = rank == self.k - 1
        self.least[at[full]] = score[full]


def _matrix(column) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0), np.int32)


def _find(k: int, same: bool, square: float):
    """Search one chunk for one block of queries."""

    def find(base: pa.Table, queries: pa.Table) -> pa.Table:
        n, out = queries.num_rows, Best(queries.num_rows, k)
        if base.num_rows and n:
            ids, labels, vectors = base["vec_id"].to_numpy(), base["label"].to_numpy(), _matrix(base["vector"])
            own, label = queries["own"].to_numpy(), queries["label"].to_numpy()
            asks = Queries(_matrix(queries["vector"]), queries["lo"].to_numpy(), queries["hi"].to_numpy(), square)

            def at_leaf(leaf: Node, at: np.ndarray) -> None:
                rows = leaf.rows
                scores = products(asks.vectors[at], vectors[rows])
                lowest = np.maximum(asks.lo[at], out.least[at])[:, None]
                fits = (scores >= lowest) & (scores <= asks.hi[at][:, None]) & (ids[rows][None] != own[at][:, None])
                fits &= (labels[rows][None] == label[at][:, None]) == same
                a, r = np.nonzero(fits)
                if len(a):
                    out.add(at[a], scores[a, r], ids[rows[r]])

            asks.walk(grow(lifted(vectors, square), LEAF_ROWS)[0], at_leaf, out.least)
        at = pa.array(out.at)
        return pa.table({
            "anchor_id": queries["anchor_id"].combine_chunks().take(at), "positive_id": queries["positive_id"].combine_chunks().take(at),
            "vec_id": pa.array(out.ids), "score": pa.array(out.score),
        })

    return find


class Index:
    """All rows with their upper leaf, written to the shared folder once."""

    def __init__(self, rows: DataFrame):
        spark = rows.sparkSession
        n = rows.count()
        square = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x)
        self.square = float(rows.agg(F.max(square)).first()[0] or 0.0)
        share = min(1.0, SAMPLE_ROWS / max(n, 1))
        drawn = rows.filter(F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(1 << 20)) < int(np.ceil(share * (1 << 20))))
        by_size: dict[int, list] = {}
        for r in drawn.select("vector").toLocalIterator():  # about SAMPLE_ROWS
            by_size.setdefault(len(r.vector), []).append(r.vector)
        leaf_rows = max(4 * ARITY, int(CHUNK_ROWS * share))
        self.trees = {}
        for d, held in by_size.items():
            points = lifted(np.array(held, np.int64).reshape(len(held), d), self.square)
            self.trees[d] = grow(points, leaf_rows)
            for node in self.trees[d]:
                node.rows = node.low = node.high = None
        folder = shared_folder(spark, "hyperplane-index")
        rows.mapInArrow(self._assign(), "vec_id long, label long, vector array<int>, asks boolean, d int, leaf int").write.parquet(folder)
        self.rows = spark.read.schema("vec_id long, label long, vector array<int>, asks boolean, d int, leaf int").parquet(folder)
        self._take_ranges()
        self.leaves = cut_lineage(self.rows.groupBy("d", "leaf").agg(F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("chunks")))

    def _assign(self):
        trees, square = self.trees, self.square

        def run(batches):
            for batch in batches:
                table = pa.Table.from_batches([batch])
                size = np.diff(table["vector"].combine_chunks().offsets.to_numpy())
                for d in np.unique(size).tolist():
                    part = table.take(pa.array(np.flatnonzero(size == d)))
                    leaf = np.zeros(len(part), np.int32)
                    if d in trees:
                        leaf = assign(trees[d][0], lifted(_matrix(part["vector"]).reshape(len(part), d), square))
                    part = part.append_column("d", pa.array(np.full(len(part), d, np.int32))).append_column("leaf", pa.array(leaf))
                    yield from part.to_batches()

        return run

    def _take_ranges(self) -> None:
        """The least and greatest distance of every (split point, child) over all
        rows: partial in each task, few numbers a node, so bounded by the sample."""
        trees, square = self.trees, self.square

        def run(batches):
            held: dict[int, dict[int, Node]] = {}
            for batch in batches:
                size = batch.column("d").to_numpy()
                for d in np.unique(size).tolist():
                    if d not in trees:
                        continue
                    own = held.setdefault(d, {})
                    points = lifted(_matrix(batch.column("vector").take(pa.array(np.flatnonzero(size == d)))), square)

                    def seen(node, near, apart, own=own):
                        kept = own.setdefault(node.number, Node(node.number))
                        kept.splits = node.splits
                        kept.widen(near, apart)

                    assign(trees[d][0], points, seen)
            for d, nodes in held.items():
                for number, node in nodes.items():
                    i, j = np.nonzero(np.isfinite(node.low))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(i), v, np.int32)) for v in (d, number)]
                        + [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(node.low[i, j]), pa.array(node.high[i, j])],
                        ["d", "node", "i", "j", "low", "high"],
                    )

        kept = self.rows.select("vector", "d").mapInArrow(run, "d int, node int, i int, j int, low double, high double")
        for r in kept.groupBy("d", "node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
            node = self.trees[r.d][r.node]
            if node.low is None:
                m = len(node.splits)
                node.low, node.high = np.full((m, m), np.inf), np.full((m, m), -np.inf)
            node.low[r.i, r.j], node.high[r.i, r.j] = r.low, r.high

    def _route(self, home: bool):
        """To which upper leaves each query goes: its own, or all its window may meet."""
        trees, square = self.trees, self.square

        def run(batches):
            for batch in batches:
                table = pa.Table.from_batches([batch])
                size = np.diff(table["vector"].combine_chunks().offsets.to_numpy())
                for d in np.unique(size).tolist():
                    part = table.take(pa.array(np.flatnonzero(size == d)))
                    at, leaf = np.arange(len(part)), np.zeros(len(part), np.int32)
                    if d in trees:
                        vectors = _matrix(part["vector"]).reshape(len(part), d)
                        if home:
                            leaf = assign(trees[d][0], lifted(vectors, square))
                        else:
                            ends: list[tuple[np.ndarray, int]] = []
                            asks = Queries(vectors, part["lo"].to_numpy(), part["hi"].to_numpy(), square)
                            asks.walk(trees[d][0], lambda node, q: ends.append((q, node.number)))
                            at = np.concatenate([q for q, _ in ends] or [np.zeros(0, np.int64)])
                            leaf = np.concatenate([np.full(len(q), number, np.int32) for q, number in ends] or [np.zeros(0, np.int32)])
                    part = part.take(pa.array(at)).append_column("d", pa.array(np.full(len(at), d, np.int32))).append_column("leaf", pa.array(leaf))
                    yield from part.to_batches()

        return run

    def search(self, queries: DataFrame, k: int, same: bool, home: bool = False) -> DataFrame:
        """``anchor_id, positive_id, vec_id, score``: each chunk's best ``k`` for
        each query (``anchor_id, positive_id, own, label, vector, lo, hi``) among
        rows of its label (``same``) or of other labels, with scores in its
        window; only in one chunk of its own leaf, with ``home``."""
        columns = "anchor_id long, positive_id long, own long, label long, vector array<int>, lo long, hi long"
        routed = cut_lineage(queries.select(*[c.split()[0] for c in columns.split(", ")]).mapInArrow(self._route(home), columns + ", d int, leaf int"))
        # One small row a leaf of the upper tree, whose size the sample bounds.
        asked = routed.groupBy("d", "leaf").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
        plan = cut_lineage(self.leaves.join(F.broadcast(asked), ["d", "leaf"]))
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        deal = lambda c, by: F.pmod(F.xxhash64(c, F.lit(by)), F.col("chunks" if by else "blocks")).cast("int")
        keys = ["d", "leaf", "chunk", "block"]
        base = self.rows.join(F.broadcast(plan), ["d", "leaf"]).withColumn("chunk", deal("vec_id", 1)).withColumn("block", every("blocks"))
        asks = routed.join(F.broadcast(plan), ["d", "leaf"]).withColumn("block", F.pmod(F.xxhash64("anchor_id", "positive_id"), F.col("blocks")).cast("int"))
        asks = asks.withColumn("chunk", deal("own", 1) if home else every("chunks"))
        base, asks = base.select(*keys, "vec_id", "label", "vector"), asks.select(*keys, *[c.split()[0] for c in columns.split(", ")])
        return base.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(
            _find(k, same, self.square), "anchor_id long, positive_id long, vec_id long, score long"
        )


def quantized(vector: Column, scale: float) -> Column:
    """``floor(scale * x)`` of each component; null where a component is null, not
    finite, or so large that an inner product might not fit a long."""
    most = F.least(F.lit(float((1 << 31) - 2)), F.sqrt(F.lit(2.0**61) / F.greatest(F.size(vector), F.lit(1))))
    fits = F.forall(vector, lambda x: x.isNotNull() & (F.abs(F.lit(float(scale)) * x.cast("double")) < most))
    return F.when(F.coalesce(fits, F.lit(False)), F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("int")))


def _settled(rows: DataFrame) -> DataFrame:
    """One row an id: the least label, then the least vector.  Only ids are
    counted; vectors move for repeated ids alone."""
    again = cut_lineage(rows.groupBy("vec_id").agg(F.count("*").alias("n")).filter("n > 1").select("vec_id"))
    if again.isEmpty():
        return rows
    one = rows.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "vector", "asks")).alias("r"))
    return rows.join(again, "vec_id", "left_anti").unionByName(one.select("vec_id", "r.*"))


def _ranked(found: DataFrame, k: int, *keys: str) -> DataFrame:
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def mine(
    vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 5, least: int = 80, of: int = 100,
    scale: float = 256.0, vec_id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Scores are integer inner products of the quantized vectors, higher first,
    ties by smaller id.  Positives of an anchor are its best ``positives`` other
    rows of its label; for each, the best ``negatives`` rows of other labels with
    ``least * positive_score <= of * negative_score <= of * positive_score``.
    All, if fewer; a positive without any has no row.

    Rows with a null id, label or vector, or with a component that is null, not
    finite or too large for a long score (2^30.5 over the root of the
    dimension, quantized) take no part; vectors meet only those of their own
    dimension.  Of rows with one id the one of least label, then least vector,
    takes part.  Other columns are not read; an empty table gives no rows."""
    own = F.col(f"`{vector}`")
    rows = vectors.select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"), label.cast("long").alias("label"), quantized(own, scale).alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks"),
    ).filter("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    index = Index(_settled(rows))
    anchors = index.rows.filter("asks").select(F.col("vec_id").alias("anchor_id"), F.col("vec_id").alias("own"), "label", "vector")
    whole = anchors.withColumns({"positive_id": F.lit(0).cast("long"), "lo": F.lit(NONE), "hi": F.lit(ANY)})
    # The positives of its own leaf bound the radius in which an anchor looks elsewhere.
    near = index.search(whole, positives, same=True, home=True)
    bound = near.groupBy("anchor_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") >= positives)
    bound = cut_lineage(bound.select("anchor_id", F.col("least").alias("bound")))
    narrowed = whole.drop("lo").join(bound, "anchor_id", "left").withColumn("lo", F.coalesce("bound", F.lit(NONE)))
    found = cut_lineage(_ranked(index.search(narrowed, positives, same=True), positives, "anchor_id"))
    # Whole and rest of the quotient apart: no product leaves the long range.
    whole_part, rest = F.expr(f"(score - pmod(score, {of})) div {of}"), F.pmod("score", F.lit(of))
    windows = found.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("hi"), (whole_part * least + F.ceil(rest * least / of)).alias("lo"))
    asked = anchors.join(windows, "anchor_id").filter("lo <= hi")
    mined = _ranked(index.search(asked, negatives, same=False), negatives, "anchor_id", "positive_id")
    scores = windows.select("anchor_id", "positive_id", F.col("hi").alias("positive_score"))
    return mined.join(scores, ["anchor_id", "positive_id"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
