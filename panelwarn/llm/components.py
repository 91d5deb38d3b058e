"""Connected components of an edge table by alternating stars.

The large star links every larger neighbour of a node to the node's smallest
one, the small star every smaller one; after a logarithmic number of rounds
each node points to the smallest node of its component.  Only minima are
aggregated (map-side first), no neighbour list is ever gathered, and each
round is written to the shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwarn.llm.common import discard, saved_at


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    below = edges.join(least, "a").filter(F.col("b") > F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return below.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(mixed), F.sum(F.shiftright(mixed, 20))).first())


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``node`` and ``root`` (the smallest node it is linked with) for every node of ``edges(a, b)``, a != b.

    An empty edge table gives no rows.
    """
    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current, path = saved_at(ordered, "edges")
    state = _state(current)
    for _ in range(rounds):
        following, new_path = saved_at(_small_star(_large_star(current)), "edges")
        discard(edges.sparkSession, path)
        current, path, before, state = following, new_path, state, _state(following)
        if state == before:
            break
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    roots = current.select("b").distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        roots.select(F.col("b").alias("node"), F.col("b").alias("root")))
