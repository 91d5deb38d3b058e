"""SimHash near-duplicates (operator 7) by multi-index hashing.

A fingerprint is cut into segments.  Two fingerprints within ``max_distance``
bits differ in some segment by no more than that segment's radius, where the
radii plus one each sum to ``max_distance`` + 1.  So every distinct
fingerprint is entered once under each segment's value, and looks up the small
Hamming ball around that value; of a pair only the one that has the highest
differing bit set looks the other up.  All pairs that meet in a bucket are
verified on all 64 bits.  A bucket passes on the edges of a spanning forest
only, never all its pairs, and buckets above ``bucket_rows`` are dealt into
blocks that cover every pair.  Exact copies are one fingerprint throughout.

Defined results.  A null, empty or blank text has fingerprint zero, linked
like any other.  The component id is the smallest doc_id of the component;
null doc_ids count only where there is no other.  Repeated rows share it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwarn.llm.common import documents, pair_blocks, saved, sorted_groups, text_bytes
from panelwarn.llm.components import components

SEED = 42


def fingerprint(raw: bytes, shingle: int, seed: int = SEED) -> int:
    """SimHash of a text's word shingles: bit set if in over half of their XXH64 values."""
    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends + 1 - sizes)[:len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1:].tolist())], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at:at + 8192].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def segment_plan(max_distance: int, segments: int, bits: int = 64) -> list[tuple[int, int, int]]:
    """(first bit, width, radius) of each segment."""
    cuts = [round(i * bits / segments) for i in range(segments + 1)]
    base, more = divmod(max_distance + 1, segments)
    if not base:
        raise ValueError("more segments than max_distance + 1")
    return [(a, b - a, base - 1 + (i < more)) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def _entries(fp: np.ndarray, plan: list[tuple[int, int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows, bucket, looks up) of the segment values and of the balls around them."""
    for i, (first, width, radius) in enumerate(plan):
        value = (fp >> np.uint64(first)) & np.uint64((1 << width) - 1)
        tag = np.uint64(i << 48)
        yield np.arange(len(fp)), value | tag, False
        for flips in range(1, radius + 1):
            for bits in combinations(range(width), flips):
                mask = np.uint64(sum(1 << b for b in bits))
                rows = np.flatnonzero(value & np.uint64(1 << bits[-1]))
                yield rows, (value[rows] ^ mask) | tag, True


def _bucket_entries(fingerprints: DataFrame, plan: list[tuple[int, int, int]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = batch.column("fp").to_numpy()
            for rows, bucket, probe in _entries(signed.view(np.uint64), plan):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket.view(np.int64)), pa.array(signed[rows]), pa.array(np.full(len(rows), probe))],
                    names=["bucket", "fp", "probe"])

    return fingerprints.select("fp").mapInArrow(run, "bucket long, fp long, probe boolean")


def _forest(group: np.ndarray, fp: np.ndarray, probe: np.ndarray, max_distance: int) -> Iterator[tuple[int, int]]:
    """Edges (pairs of fingerprints) that connect, within each group, what links of at most ``max_distance`` bits connect."""
    order = np.lexsort((fp, group))
    group, fp, probe = group[order], fp[order], probe[order]
    parent = np.arange(len(fp))

    def top(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    left = np.arange(len(fp))
    for shift in range(1, len(fp)):
        left = left[left + shift < len(fp)]
        left = left[group[left] == group[left + shift]]
        if not len(left):
            return
        a, b = left, left + shift
        linked = (fp[a] != fp[b]) & ~(probe[a] & probe[b]) & (np.bitwise_count(fp[a] ^ fp[b]) <= max_distance)
        linked &= parent[a] != parent[b]
        if not linked.any():
            continue
        for i, j in zip(a[linked].tolist(), b[linked].tolist()):
            x, y = top(i), top(j)
            if x != y:
                parent[max(x, y)] = min(x, y)
                yield fp[i], fp[j]
        while True:
            upper = parent[parent]
            if (upper == parent).all():
                break
            parent[:] = upper


def link_fingerprints(fingerprints: DataFrame, max_distance: int, segments: int = 3,
                      bucket_rows: int = 8192) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs within ``max_distance`` bits.

    ``fingerprints`` has distinct values in column ``fp``.
    """
    entries = _bucket_entries(fingerprints, segment_plan(max_distance, segments))
    blocks = pair_blocks(entries, ["bucket"], ["fp"], bucket_rows)
    dealt = blocks.repartition("bucket", "block").sortWithinPartitions("bucket", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, ["bucket", "block"], 50_000):
            bucket, block = (table.column(c).to_numpy() for c in ("bucket", "block"))
            new = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1])])
            fp = table.column("fp").to_numpy().view(np.uint64)
            probe = table.column("probe").to_numpy(zero_copy_only=False)
            found = list(_forest(np.cumsum(new), fp, probe, max_distance))
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def fingerprints(docs: DataFrame, shingle: int, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns and ``fp`` (64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch.column("_raw").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], pa.array(fp.view(np.int64))],
                                             names=[*carry, "fp"])

    rows = documents(docs, *dict.fromkeys([*carry, "text"])).withColumn("_raw", text_bytes()).select(*carry, "_raw")
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(run, f"{kinds}, fp long")


def _roots(rows: DataFrame, max_distance: int) -> DataFrame:
    """fp and root of every distinct fingerprint that has a link."""
    distinct = saved(rows.select("fp").distinct(), "fingerprints")
    return components(link_fingerprints(distinct, max_distance))


def near_duplicates(docs: DataFrame, shingle: int = 4, max_distance: int = 4) -> DataFrame:
    """doc_id, fp and component_id of every row."""
    rows = saved(fingerprints(docs, shingle), "simhash")
    roots = saved(_roots(rows, max_distance), "roots")
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("_first"))
    whole = first.join(roots, first["fp"] == roots["node"], "left").select(
        "fp", "_first", F.coalesce("root", "fp").alias("_root"))
    least = whole.groupBy("_root").agg(F.min("_first").alias("component_id"))
    named = whole.join(least, "_root").select(F.col("fp").alias("_fp"), "component_id")
    return rows.join(named, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 4, max_distance: int = 4) -> DataFrame:
    """One row of ``docs`` for each component: the smallest doc_id (null last, then the first row written)."""
    columns = docs.columns
    inner = {c: f"c{i}" for i, c in enumerate(columns) if c != "text"}
    numbered = docs.withColumnsRenamed(inner).withColumn("rid", F.monotonically_increasing_id())
    rows = saved(fingerprints(numbered, shingle, (*[inner.get(c, c) for c in columns], "rid")), "simhash")
    roots = saved(_roots(rows, max_distance), "roots")
    choice = F.struct(F.col(inner["doc_id"]).isNull(), F.col(inner["doc_id"]), F.col("rid"))
    first = rows.groupBy("fp").agg(F.min(choice).alias("_first"))
    whole = first.join(roots, first["fp"] == roots["node"], "left").select(
        "_first", F.coalesce("root", "fp").alias("_root"))
    chosen = whole.groupBy("_root").agg(F.min("_first").alias("_first")).select(F.col("_first.rid").alias("rid"))
    kept = rows.join(chosen, "rid", "left_semi")
    return kept.select(*[F.col(inner.get(c, c)).alias(c) for c in columns])
