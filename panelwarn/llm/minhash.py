"""MinHash near-duplicates (operator 12) on HyperMinHash registers.

1. A document's shingle hashes fall into ``BUCKETS`` buckets; of each bucket's
   least hash a register keeps the number of leading zeros and ten mantissa
   bits.  An empty bucket borrows the register of the first filled one in a
   fixed random order.  Documents of equal sets are one node from here on.
2. Bands of four registers are the candidate keys.  Inside a bucket pairs are
   compared by registers: the share of equal ones, corrected for those that are
   equal by chance, estimates the Jaccard similarity.  Pairs that reach the
   threshold less five standard deviations, and whose sizes allow it, connect
   nodes to clusters; a bucket passes on a spanning forest only.  Buckets above
   ``BUCKET_ROWS`` are dealt into blocks that cover every pair.
3. Each cluster is verified on full sets.  A cluster of up to ``PART_ROWS``
   nodes is one block.  A larger one is dealt into parts; all its nodes are
   first compared with one pivot, and only those without a link to it (strays)
   are compared with all parts.  A block's intersections are exact, a product
   of incidence matrices in NumPy, and it passes on a spanning forest of links.

A link at the threshold misses all bands with probability (1 - 0.85^4)^24, two
in 10^8.  A cluster of n nodes, all linked with its pivot, costs n comparisons;
s strays cost s x n, without any cap.

Defined results.  A text without words (null, empty, blank) has the empty set:
n_shingles 0, linked with nothing, its component_id its own doc_id.  Fewer
words than a shingle are one shingle.  The component id is the smallest doc_id
reachable; null doc_ids count only where there is no other.  Repeated rows
share their component and are all ``kept`` if their doc_id is its smallest.
Whole texts count.  An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwarn.llm.common import documents, pair_blocks, saved, sorted_groups, text_bytes
from panelwarn.llm.components import components

SEED = 42
BUCKETS = 96
BAND = 4
MANTISSA = 10
#: Rows of a candidate bucket that are compared in one block.
BUCKET_ROWS = 4096
#: Nodes and shingles in a part of a cluster.
PART_ROWS = 256
PART_SHINGLES = 1_000_000
#: Columns of the incidence matrices that are multiplied at once.
MATRIX_COLUMNS = 8192


def shingle_set(raw: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends + 1 - sizes)[:len(words) - width + 1].tolist()
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1:].tolist())], np.uint64))


@lru_cache(maxsize=1)
def _donors() -> np.ndarray:
    """For each bucket the order in which it asks the others for a register."""
    rng = np.random.default_rng(7)
    return np.array([rng.permutation(BUCKETS) for _ in range(BUCKETS)])


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (leading zeros << MANTISSA | mantissa) of a sorted, not empty set of hashes."""
    # hash * BUCKETS in 128 bits: the upper 64 are the bucket, the lower 64 the place inside it
    half = np.uint64(32)
    upper = (hashes >> half) * np.uint64(BUCKETS) + ((hashes & np.uint64(0xFFFFFFFF)) * np.uint64(BUCKETS) >> half)
    bucket = (upper >> half).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    scaled = (hashes[first] * np.uint64(BUCKETS)) >> np.uint64(11)  # 53 bits, which a float holds
    zeros = 53 - np.frexp(scaled.astype(np.float64))[1]
    zeros[scaled == 0] = 53
    mantissa = ((scaled << zeros.astype(np.uint64)) >> np.uint64(52 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    value = (zeros.astype(np.uint64) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    out, filled = np.zeros(BUCKETS, np.uint16), np.zeros(BUCKETS, bool)
    out[bucket[first]], filled[bucket[first]] = value, True
    if not filled.all():
        donors = _donors()
        empty = np.flatnonzero(~filled)
        out[empty] = out[donors[empty, filled[donors[empty]].argmax(axis=1)]]
    return out


@lru_cache(maxsize=1)
def _by_chance() -> np.ndarray:
    """Probability that registers of different least hashes are equal, for sets of 2^i shingles."""
    zeros, mantissa = np.arange(54)[:, None], np.arange(1 << MANTISSA)[None, :]
    low = (0.5 ** (zeros + 1)) * (1 + mantissa / (1 << MANTISSA))
    high = low + 0.5 ** (zeros + 1) / (1 << MANTISSA)
    out = []
    for i in range(48):
        n = max(1.0, 2.0 ** i / BUCKETS)
        out.append(float((((1 - low) ** n - (1 - high) ** n) ** 2).sum()))
    return np.array(out)


def estimated(equal: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of equal registers, corrected for chance."""
    chance = _by_chance()[np.log2(np.maximum(size, 1)).astype(np.int64)]
    return (equal / BUCKETS - chance) / (1 - chance)


def least_estimate(size: np.ndarray, percent: int) -> np.ndarray:
    """Lowest estimate that a pair at the threshold is let through with: five standard deviations below it."""
    t = percent / 100
    return t - 5 * np.sqrt(t * (1 - t) / np.clip(size, 1, BUCKETS))


def _signatures(docs: DataFrame, width: int) -> DataFrame:
    """rid, doc_id, raw, n_shingles, the set's 128-bit digest and its registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, high, low, regs = [], [], [], []
            for raw in batch.column("raw").to_pylist():
                s = shingle_set(raw, width)
                d = xxhash.xxh3_128_digest(s.tobytes())
                n.append(len(s))
                high.append(int.from_bytes(d[:8], "big", signed=True))
                low.append(int.from_bytes(d[8:], "big", signed=True))
                regs.append(registers(s).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("doc_id"), batch.column("raw"), pa.array(n, pa.int64()),
                 pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(regs, pa.binary())],
                names=["rid", "doc_id", "raw", "n_shingles", "high", "low", "regs"])

    rows = documents(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("rid"), "doc_id",
                                                    text_bytes().alias("raw"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"rid long, doc_id {kind}, raw binary, n_shingles long, high long, low long, regs binary")


def _bands(nodes: DataFrame) -> DataFrame:
    """key and node of every band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint16).reshape(-1, BUCKETS)
            node = batch.column("node")
            for k in range(BUCKETS // BAND):
                part = np.ascontiguousarray(regs[:, k * BAND:(k + 1) * BAND]).view(np.uint64)[:, 0]
                key = part * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
                key = (key ^ key >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), node], names=["key", "node"])

    return nodes.select("node", "regs").mapInArrow(run, "key long, node long")


class _Forest:
    """Nodes that are connected so far; ``join`` says whether an edge was new."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def top(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        x, y = self.top(i), self.top(j)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
        return x != y

    def flatten(self) -> None:
        while True:
            upper = self.parent[self.parent]
            if (upper == self.parent).all():
                return
            self.parent[:] = upper


def _similar(group: np.ndarray, regs: np.ndarray, size: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Row pairs that connect, within each group, what pairs of sufficient estimate connect."""
    forest = _Forest(len(group))
    cut = least_estimate(size, percent)
    left = np.arange(len(group))
    for shift in range(1, len(group)):
        left = left[left + shift < len(group)]
        left = left[group[left] == group[left + shift]]
        if not len(left):
            return
        a = left[forest.parent[left] != forest.parent[left + shift]]
        b = a + shift
        less, more = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
        fits = 100 * less >= percent * more
        a, b, less = a[fits], b[fits], less[fits]
        close = estimated((regs[a] == regs[b]).sum(axis=1), less) >= np.minimum(cut[a], cut[b])
        for i, j in zip(a[close].tolist(), b[close].tolist()):
            if forest.join(i, j):
                yield i, j
        forest.flatten()


def _clusters(nodes: DataFrame, percent: int) -> DataFrame:
    """node and root of all nodes that some chain of estimated similarity connects."""
    bands = saved(_bands(nodes), "bands")
    shared = bands.groupBy("key").count().filter("count > 1").select("key")
    met = bands.join(shared, "key").join(nodes.select("node", "n_shingles", "regs"), "node")
    dealt = pair_blocks(saved(met.select("key", "node", "n_shingles", "regs"), "band-rows"), ["key"], ["node"], BUCKET_ROWS)
    sorted_ = dealt.repartition("key", "block").sortWithinPartitions("key", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, ["key", "block"], 20_000):
            key, block, node, size = (table.column(c).to_numpy() for c in ("key", "block", "node", "n_shingles"))
            regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint16).reshape(-1, BUCKETS)
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])])
            pairs = np.array(list(_similar(np.cumsum(new), regs, size, percent)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(node[pairs[:, 0]]), pa.array(node[pairs[:, 1]])], names=["a", "b"])

    found = sorted_.mapInArrow(run, "a long, b long").distinct()
    return components(found)


def exact_links(sets: list[np.ndarray], stray: np.ndarray, percent: int) -> np.ndarray:
    """Row pairs (stray, any other) whose sets reach the threshold."""
    sizes = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times > 1
    number = np.cumsum(often) - 1
    keep = often[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    strays = np.flatnonzero(stray)
    met = np.zeros((len(strays), len(sets)), np.float32)  # whole numbers far below 2^24 stay exact
    for at in range(0, int(often.sum()), MATRIX_COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + MATRIX_COLUMNS])
        part = np.zeros((len(sets), MATRIX_COLUMNS), np.float32)
        part[row[lo:hi], column[lo:hi] - at] = 1
        met += part[strays] @ part.T
    met = met.astype(np.int64)
    union = sizes[strays][:, None] + sizes[None, :] - met
    i, j = np.nonzero((100 * met >= percent * union) & (strays[:, None] != np.arange(len(sets))))
    return np.stack([strays[i], j], axis=1)


def _verified(rows: DataFrame, width: int, percent: int, pivot_only: bool) -> DataFrame:
    """Edges (a, b) that connect what exact links between strays and others connect, in each (root, part, block)."""
    dealt = rows.repartition("root", "part", "block").sortWithinPartitions("root", "part", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, ["root", "part", "block"], 512):
            keys = [table.column(c).to_numpy() for c in ("root", "part", "block")]
            change = np.zeros(len(table), bool)
            change[0] = True
            for k in keys:
                change[1:] |= k[1:] != k[:-1]
            cuts = [*np.flatnonzero(change).tolist(), len(table)]
            node, stray = table.column("node").to_numpy(), table.column("stray").to_numpy(zero_copy_only=False)
            raw = table.column("raw")
            a, b = [], []
            for lo, hi in zip(cuts, cuts[1:]):
                sets = [shingle_set(x.as_py(), width) for x in raw[lo:hi]]
                forest = _Forest(hi - lo)
                for i, j in exact_links(sets, stray[lo:hi], percent).tolist():
                    if node[lo + i] != node[lo + j] and (pivot_only or forest.join(i, j)):
                        a.append(int(node[lo + i]))
                        b.append(int(node[lo + j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.select("root", "part", "block", "node", "stray", "raw").mapInArrow(run, "a long, b long")


def _links(rows: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges whose components are those of all exact links."""
    clusters = saved(_clusters(nodes, percent), "clusters")
    sized = clusters.join(nodes.select("node", "n_shingles"), "node").groupBy("root").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / PART_ROWS), F.ceil(F.sum("n_shingles") / PART_SHINGLES)).cast("int").alias("parts"))
    part = F.when(F.col("parts") == 1, 0).otherwise(F.pmod(F.xxhash64("node"), F.col("parts"))).cast("int")
    dealt = clusters.join(sized, "root").withColumn("part", part)
    members = saved(rows.select(F.col("rid").alias("node"), "raw").join(dealt, "node"), "members")

    small = members.filter("parts = 1").select("root", "part", F.lit(0).alias("block"), "node", F.lit(True).alias("stray"), "raw")
    edges = _verified(small, width, percent, False)
    large = members.filter("parts > 1")
    if large.isEmpty():
        return edges

    # every node of a large cluster against its pivot, the root
    pivots = large.filter("node = root").select(
        "root", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("block"), "node",
        F.lit(True).alias("stray"), "raw")
    others = large.filter("node != root").select("root", "part", F.lit(0).alias("block"), "node", F.lit(False).alias("stray"), "raw")
    to_pivot = saved(_verified(pivots.unionByName(others), width, percent, True), "pivot-links")
    strays = saved(large.filter("node != root").select("root", "node").join(
        to_pivot.select(F.col("b").alias("node")), "node", "left_anti"), "strays")
    # strays against all: member part p meets stray block q
    blocks = strays.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("blocks"))
    flagged = large.join(blocks, "root").join(strays.select("node", F.lit(True).alias("lost")), "node", "left")
    as_member = flagged.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "root", "part", "block", "node", F.lit(False).alias("stray"), "raw")
    as_stray = (flagged.filter("lost").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
                .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
                .select("root", "part", "block", "node", F.lit(True).alias("stray"), "raw"))
    to_strays = _verified(as_member.unionByName(as_stray), width, percent, False)
    return edges.unionByName(to_pivot).unionByName(to_strays)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    rows = saved(_signatures(docs, shingle), "hyperminhash")
    nodes = saved(rows.filter("n_shingles > 0").groupBy("high", "low").agg(
        F.min("rid").alias("node"), F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n_shingles"),
        F.first("regs").alias("regs")), "nodes")
    roots = saved(components(_links(rows, nodes, shingle, percent)), "roots")
    named = nodes.select("high", "low", "node", "first_id").join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = named.join(least, "root").select("high", "low", "component_id")
    own = rows.select("doc_id", "n_shingles", "high", "low")
    found = own.filter("n_shingles > 0").join(named, ["high", "low"]).select("doc_id", "n_shingles", "component_id")
    alone = own.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
