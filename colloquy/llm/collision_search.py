"""Nearest neighbours by collision counting with query-centred windows.

Each of many random projections keeps its vectors in one sorted array.  A
query opens a window around its own projection in every array and widens all
of them step by step (virtual rehashing: nothing is hashed again).  Vectors
that fall into the windows of enough projections are verified by the exact
inner product.  Largest inner product becomes least distance by one added
coordinate that gives every vector of a shard the same length.  A query stops
when a vector better than its k-th verified one would, at that radius, have
passed the collision threshold with the confidence asked for.  Shards of few
vectors (four times k) are verified whole.

Vectors are dealt to shards by norm band and queries to blocks, both of bounded
size; each (shard, block) pair is one group, and only each query's best of a
shard leaves it.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.session import cut_lineage

#: Rows of a shard, queries of a block, and of those how many share their windows' ends.
SHARD_ROWS, BLOCK_ROWS, SLICE = 16384, 8192, 256
PROJECTIONS, THRESHOLD = 64, 0.9
#: Chance that the k-th true neighbour is not verified (nearer ones are missed less); norm bands to a doubling.
MISSED, NORM_BANDS = 0.15, 4
FIRST_RADIUS, WIDENING = 0.5, 1.06
SEED = 7


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, and every component finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1).astype(np.float64)


def _reach(projections: int, need: int, missed: float) -> float:
    """Radius, in distances, at which a vector lies in under ``need`` windows
    with chance ``missed`` at most: projections of a difference are normal with
    its length as deviation, and the number of windows is binomial."""
    low, high = 0.0, 1.0
    for _ in range(50):
        p = (low + high) / 2
        short = sum(math.comb(projections, i) * p**i * (1 - p) ** (projections - i) for i in range(need))
        low, high = (p, high) if short > missed else (low, p)
    return NormalDist().inv_cdf(min((1 + high) / 2, 1 - 1e-15))


class Index:
    """Sorted projections of one shard.  Vectors are scaled by their largest
    component, so their lengths are finite whatever they hold."""

    def __init__(self, vectors: np.ndarray, projections: int):
        self.vectors = vectors
        self.unit = vectors / np.abs(vectors).max()
        square = (self.unit**2).sum(axis=1)
        self.length = float(np.sqrt(square.max()))
        rng = np.random.default_rng(SEED)
        self.axes = rng.standard_normal((projections, vectors.shape[1] + 1))
        rest = np.sqrt(np.maximum(self.length**2 - square, 0))
        values = (np.column_stack([self.unit, rest]) @ self.axes.T).T
        self.order = np.argsort(values, axis=1, kind="stable")
        self.sorted = np.take_along_axis(values, self.order, axis=1)
        self.start = 0

    def radius(self, level: int) -> float:
        return FIRST_RADIUS * WIDENING**level * self.length

    def windows(self, at: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the windows of many queries (columns of ``at``) in every array."""
        r = self.radius(level)
        low = [np.searchsorted(s, own - r) for s, own in zip(self.sorted, at)]
        high = [np.searchsorted(s, own + r, "right") for s, own in zip(self.sorted, at)]
        return np.array(low), np.array(high)

    def candidates(self, queries: np.ndarray, others: np.ndarray, k: int, need: int, reach: float):
        """For each query, the rows in the windows of at least ``need``
        projections when its radius is ``reach`` times the distance of the k-th
        best verified of its ``others`` (one row of flags a query), or all.

        A window takes most of an array before it holds the neighbours often
        enough to tell them apart, so what is counted are the projections whose
        window does *not* hold a row: ``len(axes) - need`` of them at most."""
        n, most = len(self.vectors), len(self.axes) - need
        if n <= 4 * k or not np.isfinite(reach):
            yield from (np.arange(n) for _ in queries)
            return
        direction = queries / np.abs(queries).max(axis=1, keepdims=True)
        direction /= np.sqrt((direction**2).sum(axis=1, keepdims=True))
        at = self.axes[:, :-1] @ (direction * self.length).T
        # One product for the rows that any of these queries may verify, which are nearly all.
        exact = direction @ self.unit.T
        exact[~others] = -np.inf
        ends: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        stopped: list[int] = []
        for q in range(len(queries)):
            # Later queries start near where earlier ones stopped.
            level = max(0, int(np.quantile(stopped, 0.2)) - 1) if stopped else self.start
            misses, old = None, None
            while True:
                if level not in ends:
                    ends[level] = self.windows(at, level)
                low, high = ends[level][0][:, q].tolist(), ends[level][1][:, q].tolist()
                if misses is None:
                    outside = [o[:a] for o, a in zip(self.order, low)] + [o[b:] for o, b in zip(self.order, high)]
                    misses = np.bincount(np.concatenate(outside), minlength=n)
                else:
                    newly = [o[a:b] for o, a, b in zip(self.order, low, old[0])] + [o[a:b] for o, a, b in zip(self.order, old[1], high)]
                    misses -= np.bincount(np.concatenate(newly), minlength=n)
                old = low, high
                found = np.flatnonzero(misses <= most)
                if len(found) == n:
                    break
                if len(found) >= k:
                    kth = np.partition(exact[q][found], len(found) - k)[len(found) - k]
                    if kth > -np.inf and self.radius(level) >= reach * np.sqrt(max(2 * self.length**2 - 2 * self.length * kth, 0)):
                        break
                level += 1
            stopped.append(level)
            self.start = level
            yield found


def _search(k: int, projections: int, threshold: float, missed: float):
    need = math.ceil(threshold * projections)

    def search(base: pa.Table, queries: pa.Table) -> pa.Table:
        out = ([], [], [])
        if base.num_rows and queries.num_rows:
            reach = _reach(projections, need, missed) if missed > 0 else np.inf
            ids, own = base["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
            index, asked = Index(_matrix(base["vector"]), projections), _matrix(queries["vector"])
            for s in range(0, len(own), SLICE):
                others = ids[None] != own[s : s + SLICE, None]
                for q, at in enumerate(index.candidates(asked[s : s + SLICE], others, k, need, reach), s):
                    at = at[ids[at] != own[q]]
                    with np.errstate(over="ignore", invalid="ignore"):
                        scores = index.vectors[at] @ asked[q]
                    best = np.lexsort((ids[at], np.where(np.isnan(scores), np.inf, -scores)))[:k]
                    for held, values in zip(out, (np.full(len(best), own[q]), ids[at][best], scores[best])):
                        held.append(values)
        return pa.table({
            "query_id": pa.array(np.concatenate(out[0] or [np.zeros(0, np.int64)])),
            "vec_id": pa.array(np.concatenate(out[1] or [np.zeros(0, np.int64)])),
            "score": pa.array(np.concatenate(out[2] or [np.zeros(0)])),
        })

    return search


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding",
    projections: int = PROJECTIONS, threshold: float = THRESHOLD, missed: float = MISSED,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of largest inner
    product found for each query row, ties to the smaller id; all, if fewer.

    Every usable row is indexed; queries are the rows of ``is_query``, searched
    against every row with another id.  Rows without an id, and vectors that are
    null, empty, zero or hold null or non-finite components, take no part; vectors
    meet only those of their own dimension.  Of rows with one id and one vector
    one is taken.  The k-th true neighbour is missed with chance ``missed`` at
    most; with zero every vector is verified.  Where an inner product overflows
    the score is infinite; one without a value (infinities that cancel) comes last."""
    rows = vectors.filter(usable(F.col(vector)) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.transform(vector, lambda x: x.cast("double")).alias("vector"), is_query.alias("asks")
    ).distinct()
    square = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x)
    band = F.coalesce(F.floor(F.least(F.log2(square), F.lit(1100.0)) * (NORM_BANDS / 2) + 0.5), F.lit(-9999)).cast("int")
    rows = rows.select("*", F.size("vector").alias("d"), band.alias("band"))
    sizes = cut_lineage(rows.groupBy("d", "band").agg(F.count("*").alias("n"), F.count_if("asks").alias("asked")))
    asked = sizes.agg(F.sum("asked")).first()[0] or 0
    blocks = max(1, -(-asked // BLOCK_ROWS))
    deal = lambda parts, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), parts).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), (parts - 1).cast("int")))
    shards = sizes.select("d", "band", F.ceil(F.col("n") / SHARD_ROWS).alias("shards"))
    keys = ["d", "band", "shard", "part"]
    anew = [F.col(c).alias(c) for c in (*keys, "vec_id", "vector")]
    base = rows.join(shards, ["d", "band"]).withColumn("shard", deal(F.col("shards"), 1)).withColumn("part", every(F.lit(blocks))).select(*anew)
    groups = shards.select(F.col("d").alias("of"), F.col("band").alias("in"), every(F.col("shards")).alias("shard"))
    queries = rows.filter("asks").select("d", deal(F.lit(blocks), 2).alias("part"), "vec_id", "vector").join(groups, F.col("d") == F.col("of")).withColumnRenamed("in", "band").select(*anew)
    found = base.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(
        _search(k, projections, threshold, missed), "query_id long, vec_id long, score double"
    )
    best = Window.partitionBy("query_id").orderBy(F.isnan("score"), F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
