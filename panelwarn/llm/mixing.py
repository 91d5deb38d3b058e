"""Mixing sources to target weights (operator 4): Sainte-Laguë apportionment of equal blocks.

Each source's documents, in a seeded order, form one stream of words that is
cut into blocks of ``block_words`` words.  The mix's blocks go to the sources
by highest quotients target / (2 seats + 1), but a source whose target is the
most allowed is passed over whole; a source's seats beyond whole
passes over it go, by the same rule, to its shards (slices of its blocks).  In
a shard the seeded choice takes exactly its quota: block i is taken if
(a * i + c) mod n is below the quota, with a prime to n.  So a document is
taken once for each whole pass, plus its words in chosen blocks, and nothing
but one row for each source reaches the driver.

Targets: sources in code point order, null last, weigh ``WEIGHTS`` in turn and
share 150 % of all words; a target stops at twice its source's words, and the
excess is shared again by weight until none is above.

Defined results.  A null text has no words and is never taken; so is an empty
table.  Null is a source of its own.  Equal rows are interchangeable: the mix
takes as much of them in any run.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwarn.llm.common import documents, running, text_bytes

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
BLOCK_WORDS = 64
SHARDS = 16


def source_targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Share of the total for each source, in proportion to its weight, at most ``most`` times its size."""
    targets, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    rest = share * sum(sizes)
    while open_:
        per_weight = rest / sum(weights[i] for i in open_)
        above = [i for i in open_ if per_weight * weights[i] > most * sizes[i]]
        for i in above or open_:
            targets[i] = most * sizes[i] if above else per_weight * weights[i]
        if not above:
            break
        rest -= sum(targets[i] for i in above)
        open_ -= set(above)
    return targets


def apportion(votes: list[float], seats: int, limits: list[int]) -> list[int]:
    """Sainte-Laguë: ``seats`` by highest quotients votes / (2 k + 1), none beyond its limit, ties in order.

    The seats above a quotient q are counted in closed form, so the cost does
    not grow with the number of seats.
    """
    seats = min(seats, sum(n for n, v in zip(limits, votes) if v > 0))
    if seats <= 0:
        return [0] * len(votes)

    def at(q: float) -> list[int]:
        return [min(n, int(math.floor((v / q + 1) / 2))) if v > 0 else 0 for v, n in zip(votes, limits)]

    low, high = 0.0, 2 * max(votes)
    for _ in range(200):
        mid = (low + high) / 2
        if mid <= low or mid >= high:
            break
        if sum(at(mid)) >= seats:
            low = mid
        else:
            high = mid
    got = at(high)
    while sum(got) < seats:  # equal quotients at the threshold
        _, i = max((v / (2 * k + 1), -i) for i, (v, k, n) in enumerate(zip(votes, got, limits)) if k < n and v > 0)
        got[-i] += 1
    return got


def _permutation(n: int, seed: int) -> tuple[int, int]:
    """Multiplier prime to n and shift of a seeded bijection of 0..n-1."""
    if n <= 1:
        return 1, 0
    rng = np.random.default_rng([seed, n])
    a = int(rng.integers(1, n))
    while math.gcd(a, n) != 1:
        a = a % (n - 1) + 1
    return a, int(rng.integers(0, n))


def mix_plan(sources: list[tuple[str | None, int]], block_words: int, shards: int, seed: int) -> dict:
    """source -> size, target, first word of its stream, whole passes, and for each shard start, quota, a, c."""
    names = sorted(s for s, _ in sources if s is not None) + [None] * any(s is None for s, _ in sources)
    size = dict(sources)
    sizes = [int(size[s]) for s in names]
    weights = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(names))]
    targets = source_targets(sizes, weights)
    blocks = [-(-n // block_words) for n in sizes]
    full = [t >= MOST * n for t, n in zip(targets, sizes)]  # whole passes meet these targets to the word
    votes = [0.0 if f else t for f, t in zip(full, targets)]
    seats = apportion(votes, round(sum(votes) / block_words), [int(MOST) * b for b in blocks])
    quotas = [int(MOST) * b if f else q for f, q, b in zip(full, seats, blocks)]
    plan = {}
    for i, name in enumerate(names):
        n, whole = blocks[i], quotas[i] // blocks[i] if blocks[i] else 0
        starts = [-(-h * n // shards) for h in range(shards + 1)]
        lengths = [b - a for a, b in zip(starts, starts[1:])]
        chosen = apportion([float(x) for x in lengths], quotas[i] - whole * n, lengths)
        perms = [_permutation(x, seed * 1_000_003 + i * shards + h) for h, x in enumerate(lengths)]
        plan[name] = {"size": sizes[i], "target": targets[i], "blocks": n, "whole": whole,
                      "starts": starts, "chosen": chosen, "a": [p[0] for p in perms], "c": [p[1] for p in perms]}
    return plan


def _chosen_blocks(p: dict, block: np.ndarray, shards: int) -> np.ndarray:
    shard = np.minimum(block * shards // max(p["blocks"], 1), shards - 1)
    starts = np.array(p["starts"], np.int64)
    length = np.maximum(starts[shard + 1] - starts[shard], 1)
    turned = (np.array(p["a"], np.int64)[shard] * (block - starts[shard]) + np.array(p["c"], np.int64)[shard]) % length
    return turned < np.array(p["chosen"], np.int64)[shard]


def _expand(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and value of every integer of the ranges first..last, in order."""
    n = np.maximum(last - first + 1, 0)
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def word_ranges(plan: dict, source: str | None, begin: np.ndarray, size: np.ndarray, block_words: int,
                shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chosen parts of documents at words begin..begin+size of a source: owner, first and last+1 word."""
    p = plan[source]
    last = np.where(size > 0, (begin + size - 1) // block_words, begin // block_words - 1)
    owner, block = _expand(begin // block_words, last)
    keep = _chosen_blocks(p, block, shards)
    owner, block = owner[keep], block[keep]
    lo = np.maximum(block * block_words - begin[owner], 0)
    hi = np.minimum((block + 1) * block_words - begin[owner], size[owner])
    return owner, lo, hi


def _sized(docs: DataFrame, carry: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = [len(t.split()) for t in batch.column("_raw").to_pylist()]
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(size, pa.int64())], names=[*names, "size"])

    names = ["doc_id", "source", *carry]
    rows = documents(docs, *dict.fromkeys([*names, "text"])).withColumn("_raw", text_bytes())
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(run, f"{kinds}, size long")


def _ordered(docs: DataFrame, carry: list[str], block_words: int, shards: int, seed: int) -> tuple[DataFrame, dict]:
    sized = _sized(docs, carry).withColumn("_turn", F.xxhash64(F.lit(seed), "doc_id", "size"))
    ordered = running(sized, ["source", "_turn", "doc_id", "size"], ["size"], "mixing")
    # one row for each source
    sources = ordered.groupBy("source").agg(F.sum("size").alias("size"), F.min("size_before").alias("first")).collect()
    plan = mix_plan([(r["source"], r["size"] or 0) for r in sources], block_words, shards, seed)
    for r in sources:
        plan[r["source"]]["first"] = r["first"]
    return ordered, plan


def mix_sizes(docs: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = 42) -> DataFrame:
    """doc_id, size, source_size, target and the words taken of every document."""
    ordered, plan = _ordered(docs, [], block_words, shards, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("source").to_pylist()
            size, before = batch.column("size").to_numpy(), batch.column("size_before").to_numpy()
            taken = size * np.array([plan[s]["whole"] for s in names], np.int64)
            kinds = np.array([-1 if s is None else order[s] for s in names])
            for s in set(names):
                at = np.flatnonzero(kinds == (-1 if s is None else order[s]))
                owner, lo, hi = word_ranges(plan, s, before[at] - plan[s]["first"], size[at], block_words, shards)
                taken[at] += np.bincount(owner, hi - lo, len(at)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(size), pa.array([plan[s]["size"] for s in names], pa.int64()),
                pa.array([plan[s]["target"] for s in names], pa.float64()), pa.array(taken)],
                names=["doc_id", "size", "source_size", "target", "taken"])

    order = {s: i for i, s in enumerate(k for k in plan if k is not None)}
    kind = ordered.schema["doc_id"].dataType.simpleString()
    return ordered.mapInArrow(run, f"doc_id {kind}, size long, source_size long, target double, taken long")


def _cut(text: bytes, parts: list[tuple[int, int]]) -> list[bytes]:
    """The bytes from the first to the last word of each part (a range of word numbers)."""
    raw = np.frombuffer(text, np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate([[1], blank, [1]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return [text[starts[a]:ends[b - 1]] for a, b in parts]


def mix_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = 42) -> DataFrame:
    """The mix itself: a row for each whole pass over a document and for each run of chosen words.

    Columns as in ``docs``; ``text`` is cut to the chosen words and ``n_chars``,
    if there, counted anew.  The words of the result are those ``mix_sizes`` counts.
    """
    columns = docs.columns
    carry = [c for c in columns if c not in ("doc_id", "source")]
    clash = {c: f"_own_{i}" for i, c in enumerate(carry) if c not in ("text", "n_chars")}
    ordered, plan = _ordered(docs.withColumnsRenamed(clash), [clash.get(c, c) for c in carry],
                             block_words, shards, seed)
    inner = [clash.get(c, c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                yield one(whole.slice(start, 512))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = batch.column("source").to_pylist()
        size, before = batch.column("size").to_numpy(), batch.column("size_before").to_numpy()
        rows, texts = [], []
        for i, raw in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
            p, n = plan[names[i]], int(size[i])
            if not n:
                continue
            rows += [i] * p["whole"]
            texts += [raw] * p["whole"]
            _, lo, hi = word_ranges(plan, names[i], before[i:i + 1] - p["first"], size[i:i + 1], block_words, shards)
            parts: list[tuple[int, int]] = []
            for a, b in zip(lo.tolist(), hi.tolist()):
                if parts and parts[-1][1] == a:
                    parts[-1] = (parts[-1][0], b)
                else:
                    parts.append((a, b))
            found = [raw] if parts == [(0, n)] else _cut(raw, parts)
            rows += [i] * len(found)
            texts += found
        out = batch.select(inner).take(pa.array(rows, pa.int64()))
        text = pa.array(texts, pa.binary()).cast(pa.string())
        out = out.set_column(inner.index("text"), "text", text)
        if "n_chars" in inner:
            at = inner.index("n_chars")
            lengths = pa.array([len(t) for t in text.to_pylist()], pa.int64()).cast(out.schema.field(at).type)
            out = out.set_column(at, "n_chars", lengths)
        return out.rename_columns(columns)

    return ordered.mapInArrow(run, docs.schema)
