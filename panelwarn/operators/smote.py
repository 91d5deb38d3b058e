"""SMOTE oversampling (M4) with exact k-nearest neighbours by leaves and visits.

Neighbours without a cross join: a tree over a bounded sample splits the points
at quantiles of the coordinate that varies most in each node; its leaves, cut
further where they hold more than ``LEAF_ROWS`` points, are blocks.  (1) Inside
its block each point finds its k nearest (numpy, one block a task).  (2) A point
then visits every other block whose bounding box is no farther than its k-th
distance so far, and takes at most k closer points from each.  (3) The answers
are merged by distance.  A box is never farther than a point in it (also in
floating point: rounding is monotone and the sums have one order), so the
answer is exact k-NN, ties by id, at every size.  Visits are streamed past one
block at a time; how many there are depends on the data (few in clusters or few
dimensions, up to points x blocks in high dimensions without structure).
Collected: a sample of ``SAMPLE_ROWS`` points and a box for each block.

Synthetic rows: synthetic s picks base index, neighbour rank and gap from
md5('<s>-<seed>-<tag>'), so the output is reproducible (and equal to a SQL
formulation of the same rule).  x_new = x_base + gap * (x_nb - x_base).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwarn.operators.ordering import exact_row_number
from panelwarn.session import cut_lineage

K_NEIGHBOURS = 5   # the public default of the SMOTE paper / library
SEED = 42
LEAF_ROWS = 2048
#: Points that the tree is built from, and the least in a leaf of it.
SAMPLE_ROWS, SAMPLE_LEAF = 20_000, 8
#: Points whose distances to the boxes, or to a block, are held at once.
VISIT_ROWS = 1024


def hash_uniform(col, seed: int, tag: str) -> Column:
    h = F.md5(F.concat(col.cast("string"), F.lit(f"-{seed}-{tag}")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _tree(sample: np.ndarray, leaves: int) -> tuple | None:
    """(dimension, cut, lower part, upper part), or None for a leaf; at most ``leaves`` leaves."""
    if leaves < 2 or len(sample) < 2 * SAMPLE_LEAF:
        return None
    spread = sample.var(axis=0)
    dim = int(np.argmax(spread))
    if not spread[dim] > 0:
        return None
    along, low = np.sort(sample[:, dim]), leaves // 2
    cut = along[len(along) * low // leaves - 1]
    if cut == along[-1]:
        cut = along[np.searchsorted(along, cut) - 1]
    below = sample[:, dim] <= cut
    return dim, cut, _tree(sample[below], low), _tree(sample[~below], leaves - low)


def _blocks(pts: DataFrame, n: int, leaf_rows: int, seed: int) -> DataFrame:
    """``pts`` with ``_block``: near points share a block, and none has more than ``leaf_rows``."""
    kind = pts.schema["id"].dataType.simpleString()
    wanted = -(-4 * n // (3 * leaf_rows)) if n > leaf_rows else 1
    sample = pts.select("vec")
    if n > SAMPLE_ROWS:
        sample = sample.sample(fraction=SAMPLE_ROWS / n, seed=seed).limit(2 * SAMPLE_ROWS)
    tree = _tree(np.nan_to_num(np.array([r[0] for r in sample.collect()], float)), wanted) if wanted > 1 else None

    def leaf_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf number of each point, and its coordinate along the leaf's last split."""
        leaf, along = np.zeros(len(x), np.int64), np.zeros(len(x))
        pending, number = [(tree, np.arange(len(x)), 0)], 0
        while pending:
            node, at, dim = pending.pop()
            if node is None:
                leaf[at], along[at] = number, x[at, dim]
                number += 1
            else:
                below = x[at, node[0]] <= node[1]
                pending += [(node[2], at[below], node[0]), (node[3], at[~below], node[0])]
        return leaf, along

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                leaf, along = leaf_of(np.array(part["vec"].tolist(), float))
                yield part.assign(_leaf=leaf, _along=along)

    placed = pts.mapInPandas(place, f"id {kind}, vec array<double>, _leaf long, _along double")
    placed = exact_row_number(placed, ["_leaf"], ["_along", "id"], out="_pos")
    sizes = placed.groupBy("_leaf").agg(F.count(F.lit(1)).alias("_n"))
    parts = F.ceil(F.col("_n") / F.lit(leaf_rows))
    piece = F.floor((F.col("_pos") - 1) * parts / F.col("_n"))
    return placed.join(sizes, "_leaf").select("id", "vec", F.concat_ws("-", "_leaf", piece).alias("_block"))


def _searcher():
    """A local function, so that it travels to the tasks by value."""
    def nearest(ids: np.ndarray, x: np.ndarray, v: np.ndarray, k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and squared distances of the k points nearest to v; ids ascend, so ties go to the smaller."""
        d2 = ((x - v) ** 2).sum(axis=1)
        near = np.argsort(d2, kind="stable")[:k + 1]
        near = near[near != but][:k] if but >= 0 and but in near else near[:k]
        return near, d2[near]

    return nearest


def knn(pts: DataFrame, id_col: str = "id", vec_col: str = "vec", k: int = K_NEIGHBOURS,
        leaf_rows: int = LEAF_ROWS, seed: int = SEED) -> DataFrame:
    """The k nearest other points, exact, ties by id: (id, rank, nb_id, d2)."""
    pts = pts.select(F.col(id_col).alias("id"), F.transform(F.col(vec_col), lambda x: x.cast("double")).alias("vec"))
    pts = cut_lineage(pts)
    n = pts.count()
    kind = pts.schema["id"].dataType.simpleString()
    if n < 2:
        return pts.sparkSession.createDataFrame([], f"id {kind}, rank int, nb_id {kind}, d2 double")
    blocked = cut_lineage(_blocks(pts, n, leaf_rows, seed))
    nearest = _searcher()

    def inside(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", kind="stable")
        ids, x = part["id"].to_numpy(), np.array(part["vec"].tolist(), float)
        found = [nearest(ids, x, v, min(k, len(x) - 1), i) if len(x) > 1 else ([], []) for i, v in enumerate(x)]
        return pd.DataFrame({"id": ids, "vec": part["vec"].to_numpy(), "_block": part["_block"].to_numpy(),
                             "nbs": [list(ids[near]) if len(near) else [] for near, _ in found],
                             "d2s": [list(d2) for _, d2 in found]})

    own = blocked.groupBy("_block").applyInPandas(
        inside, f"id {kind}, vec array<double>, _block string, nbs array<{kind}>, d2s array<double>")
    own = cut_lineage(own)
    found = own.select("id", F.explode(F.arrays_zip("nbs", "d2s")).alias("f")).select(
        "id", F.col("f.nbs").alias("nb_id"), F.col("f.d2s").alias("d2"))
    if n > leaf_rows:
        found = found.unionByName(_visits(blocked, own, k, kind))
    # a point's own k, and at most k from each block it visits
    best = Window.partitionBy("id").orderBy("d2", "nb_id")
    return (found.withColumn("rank", F.row_number().over(best))
                 .filter(F.col("rank") <= k).select("id", "rank", "nb_id", "d2"))


def _visits(blocked: DataFrame, own: DataFrame, k: int, kind: str) -> DataFrame:
    """(id, nb_id, d2) of the points in other blocks that are as near as a point's k-th so far."""
    spark, nearest = blocked.sparkSession, _searcher()

    def box(part: pd.DataFrame) -> pd.DataFrame:
        x = np.array(part["vec"].tolist(), float)
        return pd.DataFrame({"_block": part["_block"].iloc[:1], "low": [x.min(axis=0)], "high": [x.max(axis=0)]})

    boxes = blocked.groupBy("_block").applyInPandas(box, "_block string, low array<double>, high array<double>").collect()
    shared = spark.sparkContext.broadcast([(r["_block"], np.array(r["low"]), np.array(r["high"])) for r in boxes])

    def leave(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in parts:
            for at in range(0, len(whole), VISIT_ROWS):
                part = whole.iloc[at:at + VISIT_ROWS]
                x, home = np.array(part["vec"].tolist(), float), part["_block"].to_numpy()
                reach = np.array([d[k - 1] if len(d) >= k else np.inf for d in part["d2s"]])
                for block, low, high in shared.value:
                    d2 = (np.maximum(np.maximum(low - x, x - high), 0) ** 2).sum(axis=1)
                    goes = ~(d2 > reach) & (home != block)  # also where something is NaN
                    if goes.any():
                        yield pd.DataFrame({"_block": block, "guest": True, "id": part["id"].to_numpy()[goes],
                                            "vec": part["vec"].to_numpy()[goes], "reach": reach[goes]})

    def meet(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held, x = None, [], None
        for part in parts:
            for (name, guest), rows in part.groupby(["_block", "guest"], sort=False):  # rows come in order
                if not guest:
                    held = [*held, rows] if name == block else [rows]
                    block, x = name, None
                    continue
                if x is None:
                    members = pd.concat(held).sort_values("id", kind="stable")
                    ids, x = members["id"].to_numpy(), np.array(members["vec"].tolist(), float)
                out = []
                for who, v, reach in zip(rows["id"], np.array(rows["vec"].tolist(), float), rows["reach"]):
                    near, d2 = nearest(ids, x, v, k)
                    out += [(who, ids[j], d) for j, d in zip(near, d2) if not d > reach]
                if out:
                    yield pd.DataFrame(out, columns=["id", "nb_id", "d2"])

    schema = f"_block string, guest boolean, id {kind}, vec array<double>, reach double"
    members = blocked.select("_block", F.lit(False).alias("guest"), "id", "vec", F.lit(0.0).alias("reach"))
    both = members.unionByName(own.select("id", "vec", "_block", "d2s").mapInPandas(leave, schema))
    dealt = both.repartition("_block").sortWithinPartitions("_block", "guest")
    return dealt.mapInPandas(meet, f"id {kind}, nb_id {kind}, d2 double")


def smote(df: DataFrame, label: str, id_col: str, vec_col: str, k: int = K_NEIGHBOURS, seed: int = SEED,
          **knn_kw) -> DataFrame:
    """M4: raise every smaller class to the size of the largest with synthetic rows.

    Output: original rows plus synthetic ones, with ``synthetic`` (bool) and
    ``synthetic_id`` columns; synthetic rows carry a NULL ``id_col``.  A class
    of one row is copied.  Class counts are one row a class; a label with more
    than 1,000 values is refused.
    """
    counts = {r[0]: r[1] for r in df.groupBy(label).count().limit(1001).collect()}
    if len(counts) > 1000:
        raise ValueError(f"{label} has more than 1000 values; is it a class?")
    out = df.select(id_col, F.transform(F.col(vec_col), lambda x: x.cast("double")).alias(vec_col), label) \
            .withColumn("synthetic", F.lit(False)).withColumn("synthetic_id", F.lit(None).cast("long"))
    most = max(counts.values(), default=0)
    for c in sorted((c for c in counts if c is not None and counts[c] < most), key=str):
        out = out.unionByName(_synthetic(df, label, c, counts[c], most - counts[c], id_col, vec_col, k, seed, knn_kw))
    return out


def _synthetic(df: DataFrame, label: str, minority, n_min: int, n_syn: int, id_col: str, vec_col: str, k: int,
               seed: int, knn_kw: dict) -> DataFrame:
    spark = df.sparkSession
    mins = df.filter(F.col(label) == F.lit(minority)).select(
        F.col(id_col).alias("id"), F.transform(F.col(vec_col), lambda x: x.cast("double")).alias("vec"))
    k_eff = min(k, n_min - 1)
    if k_eff:
        neighbours = knn(mins, "id", "vec", k, seed=seed, **knn_kw)
    else:
        neighbours = mins.select("id", F.lit(1).alias("rank"), F.col("id").alias("nb_id"), F.lit(0.0).alias("d2"))
    k_eff = max(k_eff, 1)
    idx = exact_row_number(mins, [], ["id"], out="_i").select((F.col("_i") - 1).alias("base_i"),
                                                               F.col("id").alias("base_id"),
                                                               F.col("vec").alias("base_vec"))
    s = F.col("synthetic_id")
    syn = spark.range(n_syn).select(F.col("id").alias("synthetic_id")).select(
        "synthetic_id",
        F.floor(hash_uniform(s, seed, "base") * F.lit(n_min)).cast("long").alias("base_i"),
        (F.floor(hash_uniform(s, seed, "nb") * F.lit(k_eff)) + 1).cast("int").alias("rank"),
        hash_uniform(s, seed, "gap").alias("gap"))
    syn = (syn.join(idx, "base_i")
              .join(neighbours.select(F.col("id").alias("base_id"), "rank", "nb_id"), ["base_id", "rank"])
              .join(mins.select(F.col("id").alias("nb_id"), F.col("vec").alias("nb_vec")), "nb_id"))
    new_vec = F.zip_with("base_vec", "nb_vec", lambda a, b: a + F.col("gap") * (b - a))
    return syn.select(F.lit(None).cast(df.schema[id_col].dataType).alias(id_col),
                      new_vec.alias(vec_col), F.lit(minority).cast(df.schema[label].dataType).alias(label),
                      F.lit(True).alias("synthetic"), "synthetic_id")
