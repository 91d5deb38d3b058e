"""Approximate nearest neighbours (operator 6): stable projections, a kd-tree and a chi-square stop.

A Gaussian (2-stable) projection to ``DIMENSIONS`` coordinates turns a distance
d into one whose square, divided by d squared, is chi-square distributed.
Unit vectors are indexed by their projections: the top of a kd-tree, fitted on
a bounded sample, deals all vectors to cells; each cell's task builds the rest
of the tree with the boxes of its leaves.  A query takes leaves in order of
their projected distance and verifies, on the original vectors, the points
whose projections lie near enough.  It stops when every unseen projection is
so far that a vector as near as the k-th found would with probability
``CONFIDENCE`` have shown up: chi2_cdf(unseen^2 / d_k^2) >= CONFIDENCE.

First each query searches its own cell; the k-th distance found there bounds
the projected ball, and the query visits only the other cells which that ball
meets.  A task holds one cell; queries stream past it.  Cells above
``2 * CELL_ROWS`` vectors (a direction that many share) are salted, and equal
vectors are one point with its k + 1 smallest ids, so no cell grows with a
vector's copies.

Defined results.  Vectors that are null, zero, or hold null or non-finite
components take no part, neither do null ids nor vectors of another length
than the commonest (the longer, if two are equally common).  Rows of one
vec_id are one candidate, with the smallest of their vectors.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwarn.llm.common import saved, ship_package

DIMENSIONS = 8
CONFIDENCE = 0.95
#: Bound on the sample that the top of the tree is fitted on.
SAMPLE_ROWS = 10_000
CELL_ROWS = 8192
MAX_CELLS = 4096
LEAF_ROWS = 256


def chi_square_cdf(x: float, degrees: int) -> float:
    """For an even number of degrees: 1 - exp(-x/2) * sum (x/2)^i / i!."""
    term, total = 1.0, 0.0
    for i in range(degrees // 2):
        total += term
        term *= x / 2 / (i + 1)
    return 1.0 - math.exp(-x / 2) * total


def chi_square_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1.0
    while chi_square_cdf(high, degrees) < p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, degrees) < p else (low, mid)
    return high


def projector(length: int, dimensions: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((length, dimensions))


def _unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True)  # neither overflow nor underflow
    y = x / top
    return y / np.sqrt((y * y).sum(axis=1, keepdims=True))


def kd_leaves(points: np.ndarray, rows: int) -> list[np.ndarray]:
    """Median splits on the widest coordinate down to ``rows`` points."""
    todo, out = [np.arange(len(points))], []
    while todo:
        part = todo.pop()
        if len(part) <= rows:
            out.append(part)
            continue
        widest = int(np.argmax(np.ptp(points[part], axis=0)))
        order = part[np.argsort(points[part, widest], kind="stable")]
        todo += [order[:len(order) // 2], order[len(order) // 2:]]
    return out


class Cells:
    """The top of the kd-tree: ``depth`` levels of splits, and the box of each cell."""

    def __init__(self, sample: np.ndarray, depth: int, dimensions: int):
        self.depth = depth
        self.axis, self.cut = np.zeros(1 << depth, np.int64), np.zeros(1 << depth)
        self.low, self.high = np.full((1 << depth, dimensions), -np.inf), np.full((1 << depth, dimensions), np.inf)
        self._split(sample, 1, 0, np.full(dimensions, -np.inf), np.full(dimensions, np.inf))

    def _split(self, points: np.ndarray, node: int, level: int, low: np.ndarray, high: np.ndarray) -> None:
        if level == self.depth:
            cell = node - (1 << self.depth)
            self.low[cell], self.high[cell] = low, high
            return
        axis = int(np.argmax(np.ptp(points, axis=0))) if len(points) else level % len(low)
        cut = float(np.median(points[:, axis])) if len(points) else 0.0
        self.axis[node], self.cut[node] = axis, cut
        below = points[:, axis] < cut
        left_high, right_low = high.copy(), low.copy()
        left_high[axis] = right_low[axis] = cut
        self._split(points[below], 2 * node, level + 1, low, left_high)
        self._split(points[~below], 2 * node + 1, level + 1, right_low, high)

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] >= self.cut[node])
        return node - (1 << self.depth)

    def within(self, point: np.ndarray, radius: float) -> np.ndarray:
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return np.flatnonzero((gap * gap).sum(axis=1) <= radius * radius)


class CellIndex:
    """The vectors of one cell with their leaves."""

    def __init__(self, vectors: np.ndarray, ids: list[list[int]], matrix: np.ndarray):
        self.vectors, self.ids, self.unit = vectors, ids, _unit(vectors)
        self.norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        self.projected = self.unit @ matrix
        self.leaves = kd_leaves(self.projected, LEAF_ROWS)
        self.low = np.array([self.projected[x].min(axis=0) for x in self.leaves])
        self.high = np.array([self.projected[x].max(axis=0) for x in self.leaves])

    def search(self, query_id: int, vector: np.ndarray, projected: np.ndarray, k: int, quantile: float,
               bound: float) -> list[tuple[float, int]]:
        """The k best (score, id) nearer than ``bound``, an upper bound on the k-th distance."""
        norm = math.sqrt(float(np.einsum("i,i->", vector, vector)))
        gap = np.maximum(np.maximum(self.low - projected, projected - self.high), 0)
        reach = (gap * gap).sum(axis=1)
        best: list[tuple[float, int]] = []  # smallest score first, larger id first among equals
        for at in np.argsort(reach, kind="stable").tolist():
            if reach[at] >= bound * bound * quantile:  # the chi-square stopping test
                break
            leaf = self.leaves[at]
            delta = self.projected[leaf] - projected
            near = leaf[(delta * delta).sum(axis=1) <= bound * bound * quantile]
            scores = np.einsum("ij,j->i", self.vectors[near], vector) / (self.norms[near] * norm)
            for i in np.argsort(-scores, kind="stable").tolist():
                if len(best) == k and scores[i] < best[0][0]:
                    break
                for other in self.ids[near[i]]:
                    if other == query_id:
                        continue
                    entry = (float(scores[i]), -other)
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
                    else:
                        break
            if len(best) == k:
                bound = min(bound, math.sqrt(max(2 - 2 * best[0][0], 0.0)) + 1e-9)
        return [(s, -i) for s, i in best]


def _usable(rows: DataFrame, id_name: str, vector: str) -> tuple[DataFrame, int]:
    table = rows.select(rows[id_name].alias("id"), rows[vector].cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    table = table.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(finite)
    table = table.filter(F.exists("v", lambda x: x != 0))
    commonest = table.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    length = commonest["n"] if commonest else 0
    return table.filter(F.size("v") == length).groupBy("id").agg(F.min("v").alias("v")), length


def nearest(rows: DataFrame, k: int = 5, every: int = 50, id_name: str = "vec_id", vector: str = "embedding",
            dimensions: int = DIMENSIONS, confidence: float = CONFIDENCE, cell_rows: int = CELL_ROWS,
            seed: int = 42) -> DataFrame:
    """query_id, rank, vec_id and score (cosine) of the k nearest found for each id divisible by ``every``."""
    ship_package(rows.sparkSession)
    usable, length = _usable(rows, id_name, vector)
    usable = saved(usable, "vectors")
    copies = Window.partitionBy("v").orderBy("id")
    first = usable.withColumn("n", F.row_number().over(copies)).filter(F.col("n") <= k + 1)
    points = saved(first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "points")
    sample = points.select("v").orderBy(F.xxhash64(F.lit(seed), "v"), "v").limit(SAMPLE_ROWS).toPandas()
    matrix = projector(length, dimensions, seed)
    quantile = chi_square_quantile(confidence, dimensions)
    n = points.count()
    depth = max(0, min(int(math.log2(MAX_CELLS)), math.ceil(math.log2(max(n, 1) / cell_rows))))
    taken = np.array(sample["v"].tolist(), float).reshape(-1, max(length, 1))
    cells = Cells(_unit(taken) @ matrix if len(taken) else np.zeros((0, dimensions)), depth, dimensions)

    def vectors(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = cells.of(_unit(vectors(batch.column("v"))) @ matrix)
                yield pa.RecordBatch.from_arrays([pa.array(at), *batch.columns], names=["cell", *batch.schema.names])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells other than its own that a query's ball meets."""
        for batch in batches:
            if not batch.num_rows:
                continue
            projected = _unit(vectors(batch.column("v"))) @ matrix
            home = cells.of(projected)
            owner, target = [], []
            for i, bound in enumerate(batch.column("bound").to_numpy()):
                for c in cells.within(projected[i], bound * math.sqrt(quantile)).tolist():
                    if c != home[i]:
                        owner.append(i)
                        target.append(c)
            taken = batch.take(pa.array(owner, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(target, pa.int64()), *taken.columns],
                                             names=["cell", *batch.schema.names])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by cell, a cell's vectors before its queries."""
        here, held, index = None, [], None
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                out: list[tuple[int, int, float]] = []
                data = vectors(batch.column("v"))
                projected = _unit(data) @ matrix
                columns = [batch.column(c).to_pylist() for c in ("cell", "part", "query", "ids", "bound")]
                for i, (cell, part, query, ids, bound) in enumerate(zip(*columns)):
                    if (cell, part) != here:
                        here, held, index = (cell, part), [], None
                    if not query:
                        held.append((data[i], ids))
                        continue
                    if index is None and held:
                        index, held = CellIndex(np.array([v for v, _ in held]), [x for _, x in held], matrix), []
                    if index is not None:
                        found = index.search(ids[0], data[i], projected[i], k, quantile, bound)
                        out += [(ids[0], other, score) for score, other in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                     pa.array([o[2] for o in out], pa.float64())], names=["query_id", "vec_id", "score"])

    placed = saved(points.mapInArrow(place, "cell long, v array<double>, ids array<long>"), "placed")
    # how many salted parts a cell has: at most MAX_CELLS rows
    parts = F.broadcast(placed.groupBy("cell").count().select(
        F.col("cell").alias("_cell"), F.ceil(F.col("count") / F.lit(2 * cell_rows)).cast("int").alias("parts")))
    salt = F.pmod(F.xxhash64("v"), F.col("parts").cast("long")).cast("int")
    indexed = placed.join(parts, F.col("cell") == F.col("_cell")).select(
        "cell", salt.alias("part"), F.lit(False).alias("query"), "ids", "v", F.lit(0.0).alias("bound"))

    def searched(queries: DataFrame) -> DataFrame:
        to_parts = queries.join(parts, F.col("cell") == F.col("_cell")).select(
            "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("query"),
            "ids", "v", "bound")
        together = indexed.unionByName(to_parts).repartition("cell", "part")
        ordered = together.sortWithinPartitions("cell", "part", "query")
        return saved(ordered.mapInArrow(search, "query_id long, vec_id long, score double"), "neighbours")

    asked = usable.filter(F.col("id") % every == 0).select("v", F.array("id").alias("ids"))
    asked = asked.withColumn("bound", F.lit(2.0 + 1e-9))
    at_home = searched(asked.mapInArrow(place, "cell long, v array<double>, ids array<long>, bound double"))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = at_home.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") == k)
    kth = kth.select("query_id", F.sqrt(F.greatest(2 - 2 * F.col("score"), F.lit(0.0))).alias("_bound"))
    bounded = asked.join(kth, F.col("ids")[0] == F.col("query_id"), "left").select(
        "v", "ids", F.coalesce(F.col("_bound") + 1e-9, "bound").alias("bound"))
    elsewhere = searched(bounded.mapInArrow(route, "cell long, v array<double>, ids array<long>, bound double"))
    best = at_home.unionByName(elsewhere).withColumn("rank", F.row_number().over(ranked))
    return best.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
