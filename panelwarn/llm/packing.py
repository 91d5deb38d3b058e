"""Best-fit packing (operator 3): large-item matching planned on the histogram of lengths.

A sequence holds at most ``capacity`` tokens, so there are at most that many
different lengths, however many documents there are.  The plan is made on
these counts: pieces above a third of the capacity go at most two to a
sequence, each largest one greedily matched with the largest other one that
still fits; then the smaller lengths, largest first, go to the tightest gap
that holds them, and to new sequences where none does.  The plan is a list of
runs: "the pieces of length l, ranks r to r + n * q, go q by q into the
sequences s to s + n, from offset o".  Each piece finds its run by its rank
among the pieces of its length, which one range shuffle gives.

Defined results.  A null text is empty; every document ends in token 0, so an
empty one is a piece of one token.  Longer documents are cut so that the first
piece takes the remainder and all others are full.  Repeated rows and null
doc_ids are packed like any other.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwarn.llm.common import documents, running, saved
from panelwarn.llm.tokens import TOKENIZER, tokenizer_path

CAPACITY = 2048
END_ID = 0
#: Texts above this many characters are encoded by the tokenizers library itself.
LONG_TEXT = 200_000


class Encoder:
    """Ids as the tokenizers library gives them, without added special tokens.

    Where the same vocabulary also lies there as ranks, tiktoken encodes
    (the same ids, three times as fast; tests compare the two).
    """

    def __init__(self, name: str):
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(tokenizer_path(name))
        self.fast = None
        if name == TOKENIZER:
            import public_tokenizers
            import tiktoken
            with open(tokenizer_path(name.replace(".json", ".tiktoken")), "rb") as f:
                ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
            special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
            self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN,
                                          mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and len(text) <= LONG_TEXT:
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4")
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    return Encoder(name)


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER,
                 with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian 32-bit) of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).ids
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                owner, piece, start, length, crc, kept = [], [], [], [], [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    ids = np.append(encode(text), np.uint32(END_ID)).astype("<u4")
                    n = len(ids)
                    first = n % capacity or capacity
                    for k, a in enumerate([0, *range(first, n, capacity)]):
                        part = ids[a:first if a == 0 else a + capacity].tobytes()
                        owner.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            kept.append(part)
                columns = [batch.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()),
                           *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(kept, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = documents(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
                           + ", ids binary" * with_ids)


def plan_runs(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, ...]], int]:
    """Runs (length, first rank, ranks, first sequence, pieces a sequence, offset) and the number of sequences."""
    left = {k: n for k, n in counts.items() if n}
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, ...]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> ranges of sequences that have it
    widths: list[int] = []
    sequences = 0

    def place(size: int, n: int, first: int, each: int, offset: int) -> None:
        runs.append((size, used[size], n, first, each, offset))
        used[size] += n
        left[size] -= n

    def free(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(widths, gap)
            gaps[gap].append((first, n))

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        x = large[-1]
        if not left[x]:
            large.pop()
            continue
        y = bisect_left(large, capacity - x + 1) - 1
        while y >= 0 and not left[large[y]]:
            del large[y]
            y -= 1
        if y < 0 or large[y] == x and left[x] == 1 and y == 0:
            n, partner = left[x], 0
        elif large[y] == x:
            n, partner = left[x] // 2, x
            if not n:  # one is left of it; the next smaller length may still join it
                y -= 1
                while y >= 0 and not left[large[y]]:
                    del large[y]
                    y -= 1
                n, partner = 1, large[y] if y >= 0 else 0
        else:
            partner = large[y]
            n = min(left[x], left[partner])
        if partner == x:
            place(x, 2 * n, sequences, 2, 0)
        else:
            place(x, n, sequences, 1, 0)
            if partner:
                place(partner, n, sequences, 1, x)
        free(capacity - x - partner, sequences, n)
        sequences += n

    for size in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[size]:
            w = bisect_left(widths, size)
            if w < len(widths):
                gap = widths[w]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], widths[w]
            else:
                gap, first, n = capacity, sequences, -(-left[size] // (capacity // size))
                sequences += n
            each = gap // size
            full = min(n, left[size] // each)
            if full:
                place(size, full * each, first, each, capacity - gap)
                free(gap - each * size, first, full)
            if full < n and left[size]:  # fewer pieces than one more sequence would take
                rest = left[size]
                place(size, rest, first + full, rest, capacity - gap)
                free(gap - rest * size, first + full, 1)
                full += 1
            free(gap, first + full, n - full)
    return runs, sequences


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset; the histogram has at most ``capacity`` rows."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, _ = plan_runs(counts, capacity)
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 6)
    lengths = sorted(counts)
    first_row = dict(zip(lengths, np.cumsum([0, *[counts[k] for k in lengths]])))
    # runs sorted by length and rank begin at these rows of the ordered pieces
    begins = np.array([first_row[r[0]] + r[1] for r in runs], np.int64)
    columns = pieces.columns
    keys = [c for c in ("length", "doc_id", "start", "piece", "ids_crc32") if c in columns]
    ordered = running(pieces, keys, name="packing")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row").to_numpy()
            at = np.searchsorted(begins, row, side="right") - 1
            size, _, _, first, each, offset = table[at].T
            k = row - begins[at]
            arrays = [batch.column(c) for c in columns]
            arrays += [pa.array(first + k // each), pa.array(offset + k % each * size)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ordered.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER,
                   with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place; texts are encoded once and the pieces written once."""
    return pack(saved(token_pieces(docs, capacity, tokenizer, with_ids), "pieces"), capacity)
