"""Phrase collocation mining (operator 11) with double-array tries.

1. Words are counted per language.  A bitmap over word hashes holds those that
   reach ``min_count``.
2. Level by level, every position whose two shorter phrases are marked in the
   bitmap before adds to a hash bucket; buckets that reach ``min_count`` make
   the next bitmap.  A phrase that is common enough is never lost (Apriori:
   its parts are at least as common, and a bucket counts at least its phrases).
3. The longest marked phrase of every position is kept, with the number of its
   positions: the phrases that begin one are the candidates, and each stands
   wherever it begins one.  The longest phrases are sorted and cut into shards
   of at most ``SHARD_BYTES``; the candidates of each shard become a
   double-array trie over UTF-8 bytes.  NumPy advances the states of all its
   longest phrases at once, byte by byte and word by word, and adds up their
   numbers at accepting states with ``bincount``; Spark sums the counts of all
   shards.  These counts are exact, whatever hashes collide.
4. Cuts, scores, containment and the ranking are joins and one ranked window on
   the counted phrases, in decimals where products may pass 64 bits.

Bitmaps, which are broadcast, have at most 2^``MAX_BUCKET_BITS`` bits and a trie
at most 24 bytes for each byte of its shard.  Tasks build the tries, each once,
and the texts are read as often however many shards there are.

Defined results.  A null text is empty, a null language ``und``.  Repeated rows
count as often as they stand there.  Ties rank by a, then by the phrase's
UTF-8 bytes; cuts of equal (floored) score take the shortest first part.
Whole texts count, however long, and phrases never cross documents or pieces.
An empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwarn.llm.common import documents, saved

#: Bytes of text worked on at once; one longer text is a block of its own.
BLOCK_BYTES = 1_000_000
#: Bytes of longest phrases whose candidates make one trie.
SHARD_BYTES = 1_000_000
#: A bitmap has at most 2^28 bits: 32 MB.
MAX_BUCKET_BITS = 28
#: Positions that a task gathers before it sends them on; of distinct phrases, an eighth.
GATHERED = 2_000_000
#: Rows that a task sends on at once.
SENT = 100_000
#: Buckets that one row of counts covers; their places in it are 16 bits wide.
RANGE_BUCKETS = 1 << 16
#: Random places that are tried for the branching nodes of a trie before the arrays grow.
TRIES = 64

_ODD = 0x9E3779B97F4A7C15
_CLASS = np.zeros(256, np.uint8)   # 0 word, 1 blank, 2 end of a piece
_CLASS[[0x20, 0x09]] = 1
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse."""
    both = []
    for base in (_ODD, pow(_ODD, -1, 1 << 64)):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        both.append(np.cumprod(p))
    return both[0], both[1]


class Block:
    """The words of some texts: where they start and end, their language, and which ones the next word follows in its piece."""

    def __init__(self, lang: pa.Array, text: pa.Array):
        langs = pc.dictionary_encode(lang)
        self.langs: list[bytes] = [x.encode() for x in langs.dictionary.to_pylist()]
        offsets = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, text.offset * 4).astype(np.int64)
        raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
        offsets -= offsets[0]
        self.low = _LOWER[raw]
        kind = _CLASS[raw]
        word, edge = kind == 0, np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        begins, stops = word.copy(), word.copy()
        begins[1:] &= ~word[:-1] | edge[1:-1]
        stops[:-1] &= ~word[1:] | edge[1:-1]
        self.start = np.flatnonzero(begins)
        self.size = np.flatnonzero(stops) + 1 - self.start
        piece = np.cumsum((kind == 2) | edge[:-1], dtype=np.int32)[self.start]
        self.follows = np.zeros(len(self.start), bool)
        self.follows[:-1] = piece[1:] == piece[:-1]
        row = np.searchsorted(offsets, self.start, "right") - 1
        self.lang = langs.indices.to_numpy(zero_copy_only=False)[row]

    def __len__(self) -> int:
        return len(self.start)

    def words(self) -> pa.BinaryArray:
        """All words, as one Arrow array."""
        ends = np.cumsum(self.size)
        at = np.arange(ends[-1] if len(self) else 0) + np.repeat(self.start - ends + self.size, self.size)
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(self), [None, pa.py_buffer(offsets), pa.py_buffer(self.low[at])])

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word and its language, from one running sum over the bytes."""
        n = len(self.low)
        size = max(BLOCK_BYTES, 1 << max(n, 1).bit_length() if n > BLOCK_BYTES else 0)
        power, inverse = _powers(size)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.low.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        salt = np.array([xxhash.xxh64_intdigest(x) for x in self.langs], np.uint64)
        own = (total[self.start + self.size] - total[self.start]) * inverse[self.start]
        return _mixed(own ^ salt[self.lang]) if len(self) else own

    def marked(self, bitmaps: list[np.ndarray], bits: int, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For k = 2 .. most: k, the positions whose two (k-1)-word phrases are marked, and the phrases' buckets.

        ``bitmaps[k - 1]`` marks the buckets of k-word phrases.
        """
        word = self.hashes()
        own = word
        at = np.flatnonzero(_marks(bitmaps[0], own >> np.uint64(64 - bits)))
        for k in range(2, most + 1):
            there = np.zeros(len(self) + 1, bool)
            there[at] = True
            at = at[self.follows[at + k - 2] & there[at + 1]]
            longer = np.zeros(len(self), np.uint64)
            longer[at] = _mixed(own[at] * np.uint64(_ODD) ^ word[at + k - 1])
            own = longer
            bucket = own[at] >> np.uint64(64 - bits)
            yield k, at, bucket.astype(np.int64)
            if k < most:
                at = at[_marks(bitmaps[k - 1], bucket)]

    def phrases(self, words: pa.BinaryArray, at: np.ndarray, k: int) -> pa.Array:
        """Keys (language, line feed, words joined by blanks) of the k-word phrases at some positions."""
        parts = [pc.take(words, pa.array(at + j)) for j in range(k)]
        joined = pc.binary_join_element_wise(*parts, b" ")
        lang = pc.take(pa.array(self.langs, pa.binary()), pa.array(self.lang[at]))
        return pc.binary_join_element_wise(lang, joined, b"\n")


def _marks(bitmap: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    bucket = bucket.astype(np.int64)
    return (bitmap[bucket >> 3] >> (bucket & 7).astype(np.uint8) & 1).astype(bool)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column("raw")).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            most = int(np.searchsorted(size, (size[at - 1] if at else 0) + BLOCK_BYTES, "right"))
            stop = min(max(most, at + 1), batch.num_rows)
            yield Block(batch.column("lang").slice(at, stop - at), batch.column("raw").slice(at, stop - at))
            at = stop


def _texts(docs: DataFrame) -> DataFrame:
    return documents(docs, "lang", "text").select(F.coalesce("lang", F.lit("und")).alias("lang"),
                                                  F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("raw"))


# ------------------------------------------------------------------ the trie


class Trie:
    """A double-array trie over bytes: from state s byte c leads to t = base[s] + c if check[t] = s."""

    def __init__(self, keys: list[bytes]):
        """``keys``: sorted, distinct, none empty."""
        sizes = np.array([len(k) for k in keys], np.int64)
        flat = np.frombuffer(b"".join(keys), np.uint8)
        first = np.cumsum(sizes) - sizes
        node, live, nodes = np.zeros(len(keys), np.int64), np.arange(len(keys)), 1
        parents, labels = [], []
        depth = 0
        while len(live):
            c, above = flat[first[live] + depth].astype(np.int64), node[live]
            new = np.ones(len(live), bool)
            new[1:] = (above[1:] != above[:-1]) | (c[1:] != c[:-1])
            parents.append(above[new])
            labels.append(c[new])
            node[live] = np.cumsum(new) - 1 + nodes
            nodes += int(new.sum())
            depth += 1
            live = live[sizes[live] > depth]
        parent, label = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (parents, labels))
        base, length = self._places(parent, label, nodes)
        slot = np.zeros(nodes, np.int64)
        slot[1:] = base[parent] + label  # edge e leads to node e + 1
        self.base = np.zeros(length, np.int32)
        self.check = np.full(length, -1, np.int32)
        self.accept = np.full(length, -1, np.int32)
        self.base[slot] = base
        self.check[slot[1:]] = slot[parent]
        self.accept[slot[node]] = np.arange(len(keys))

    @staticmethod
    def _places(parent: np.ndarray, label: np.ndarray, nodes: int) -> tuple[np.ndarray, int]:
        """A base for every node so that no two edges share a slot; nodes with many edges are placed first."""
        width = np.bincount(parent, minlength=nodes)
        first = np.cumsum(width) - width
        rng = np.random.default_rng(1)
        size = 2 * len(parent) + 512
        used = np.zeros(size + 256, bool)
        used[0] = True  # the root
        base = np.zeros(nodes, np.int64)
        for least, most in ((16, 256), (4, 15), (2, 3)):
            open_ = np.flatnonzero((width >= least) & (width <= most))
            turns = 0
            while len(open_):
                turns += 1
                if turns % TRIES == 0:
                    size += len(parent) + 512
                    used = np.concatenate([used, np.zeros(size + 256 - len(used), bool)])
                base[open_] = rng.integers(0, size, len(open_))
                owner = np.repeat(np.arange(len(open_)), width[open_])
                step = np.arange(len(owner)) - np.repeat(np.cumsum(width[open_]) - width[open_], width[open_])
                slots = base[open_][owner] + label[first[open_][owner] + step]
                claim = np.zeros(len(slots), bool)
                claim[np.unique(slots, return_index=True)[1]] = True
                fits = np.bincount(owner[~claim | used[slots]], minlength=len(open_)) == 0
                used[slots[fits[owner]]] = True
                open_ = open_[~fits]
        single = np.flatnonzero(width == 1)
        free = np.flatnonzero(~used[256:]) + 256
        if len(free) < len(single):
            more = np.arange(len(used), len(used) + len(single))
            free = np.concatenate([free, more])
        base[single] = free[:len(single)] - label[first[single]]
        return base, max(len(used), int(free[:len(single)].max(initial=0)) + 1) + 256

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after one byte, and which of them exist."""
        after = self.base[state] + byte
        return after, self.check[after] == state

    def begin(self, key: bytes) -> int:
        """The state after ``key`` from the root, or -1."""
        state = 0
        for c in key:
            after = int(self.base[state]) + c
            if self.check[after] != state:
                return -1
            state = after
        return state

    def counts(self, block: Block, most: int, weight: np.ndarray) -> np.ndarray:
        """The sum of the weights of the positions at which each key stands: all advance together, word by word."""
        total = np.zeros(int(self.accept.max(initial=-1)) + 1, np.int64)
        begins = np.array([self.begin(x + b"\n") for x in block.langs] or [-1], np.int32)
        state = begins[block.lang] if len(block) else np.zeros(0, np.int32)
        word = np.flatnonzero((state >= 0) & block.follows & (weight > 0))
        state = state[word]
        for k in range(1, most + 1):
            ended, held = [], []
            at, left = block.start[word], block.size[word]
            while len(word):
                state, there = self.step(state, block.low[at])
                state, word, at, left = state[there], word[there], at[there] + 1, left[there] - 1
                over = left == 0
                if over.any():
                    ended.append(state[over])
                    held.append(word[over])
                    going = ~over
                    state, word, at, left = state[going], word[going], at[going], left[going]
            state = np.concatenate([np.zeros(0, np.int32), *ended])
            word = np.concatenate([np.zeros(0, np.int64), *held])
            found = self.accept[state]
            own = weight[word[found >= 0] - (k - 1)]  # of the first word; sums below 2^53 are exact
            total += np.bincount(found[found >= 0], weights=own, minlength=len(total)).astype(np.int64)
            if k == most:
                break
            more = block.follows[word]
            state, there = self.step(state[more], np.uint8(0x20))
            state, word = state[there], word[more][there] + 1
        return total


# ------------------------------------------------------------------ Spark jobs


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, word and n over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def summed() -> Iterator[pa.RecordBatch]:
            table = pa.concat_tables(held).group_by(["lang", "word"], use_threads=False).aggregate([("n", "sum")])
            yield from table.select(["lang", "word", "n_sum"]).rename_columns(["lang", "word", "n"]).to_batches()

        for block in _blocks(batches):
            table = pa.table({"lang": pa.array(block.lang), "word": block.words()})
            part = table.group_by(["lang", "word"], use_threads=False).aggregate([([], "count_all")])
            lang = pc.take(pa.array(block.langs, pa.binary()), part["lang"].combine_chunks()).cast(pa.string())
            held.append(pa.table({"lang": lang, "word": part["word"].combine_chunks().cast(pa.string()),
                                  "n": part["count_all"]}))
            rows += len(lang)
            if rows > GATHERED // 4:
                yield from summed()
                held, rows = [], 0
        if rows:
            yield from summed()

    return texts.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _bitmap(buckets: DataFrame, bits: int) -> np.ndarray:
    """One bit for each bucket; at most 2^bits / 64 rows come to the driver."""
    packed = buckets.groupBy(F.shiftright("bucket", 6).alias("at")).agg(
        F.expr("bit_or(shiftleft(1L, cast(bucket & 63 as int)))").alias("marks")).toArrow()
    held = np.zeros(max(1, (1 << bits) // 64), "<u8")
    held[packed["at"].to_numpy()] = packed["marks"].to_numpy().view(np.uint64)
    return held.view(np.uint8)


def _word_bitmap(words: DataFrame, bits: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            bucket = block.hashes() >> np.uint64(64 - bits)
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int64))], names=["bucket"])

    rows = words.select("lang", F.col("word").cast("binary").alias("raw"))
    return _bitmap(rows.mapInArrow(run, "bucket long").distinct(), bits)


def _range_counts(bucket: np.ndarray, min_count: int) -> pa.RecordBatch:
    """One row for each range of buckets: the places filled in it and how often, as little-endian bytes.

    Counts stop at ``min_count``: whether a sum reaches it stays the same.
    """
    bucket, n = np.unique(bucket, return_counts=True)
    ranges, first = np.unique(bucket // RANGE_BUCKETS, return_index=True)
    offsets = np.append(first, len(bucket))

    def packed(values: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(ranges), [
            None, pa.py_buffer((offsets * values.itemsize).astype(np.int32)), pa.py_buffer(values)])

    places, counts = (bucket % RANGE_BUCKETS).astype("<u2"), np.minimum(n, min_count).astype(_width(min_count))
    return pa.RecordBatch.from_arrays([pa.array(ranges), packed(places), packed(counts)], names=["range", "places", "counts"])


def _width(min_count: int) -> np.dtype:
    """The narrowest unsigned integers that hold ``min_count``."""
    return np.min_scalar_type(min_count).newbyteorder("<")


def _range_marks(batches: Iterator[pa.RecordBatch], min_count: int) -> Iterator[pa.RecordBatch]:
    """range and marks (a bit for each bucket that reaches ``min_count``, deflated), from rows sorted by range."""
    last, total = None, np.zeros(RANGE_BUCKETS, np.int64)

    def marks() -> pa.RecordBatch:
        bits = zlib.compress(np.packbits(total >= min_count, bitorder="little").tobytes(), 1)
        return pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([bits], pa.binary())], names=["range", "marks"])

    for batch in batches:
        for at, places, counts in zip(batch.column("range").to_pylist(), batch.column("places"), batch.column("counts")):
            if at != last:
                if last is not None:
                    yield marks()
                last = at
                total[:] = 0
            total[np.frombuffer(places.as_buffer(), "<u2")] += np.frombuffer(counts.as_buffer(), _width(min_count))
    if last is not None:
        yield marks()


def _next_bitmap(texts: DataFrame, bitmaps: list[np.ndarray], bits: int, min_count: int) -> np.ndarray:
    """Marks of the buckets that phrases one word longer fill ``min_count`` times; at most 2^bits bits come to the driver.

    Counts travel packed, a row for each range of buckets: as rows of their own they fill the JVM's hash maps.
    """
    shared, level = texts.sparkSession.sparkContext.broadcast(bitmaps), len(bitmaps) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for block in _blocks(batches):
            for k, _, bucket in block.marked(shared.value, bits, level):
                if k == level:
                    held.append(bucket)
                    rows += len(bucket)
            if rows > GATHERED:
                yield _range_counts(np.concatenate(held), min_count)
                held, rows = [], 0
        if rows:
            yield _range_counts(np.concatenate(held), min_count)

    counts = texts.mapInArrow(run, "range long, places binary, counts binary")
    dealt = counts.repartition("range").sortWithinPartitions("range")
    found = dealt.mapInArrow(lambda batches: _range_marks(batches, min_count), "range long, marks binary").toArrow()
    held = np.zeros(max((1 << bits), RANGE_BUCKETS) // 8, np.uint8)
    for at, marks in zip(found["range"].to_pylist(), found["marks"]):
        begin = at * RANGE_BUCKETS // 8
        held[begin:begin + RANGE_BUCKETS // 8] = np.frombuffer(zlib.decompress(marks.as_py()), np.uint8)
    shared.unpersist()
    return held


def candidates(texts: DataFrame, words: DataFrame, min_count: int, most: int) -> DataFrame:
    """key (language, line feed, phrase) and n: the longest phrase of 2 to ``most`` words at each position that may reach
    ``min_count``, and at how many positions it is the longest.

    A phrase that may reach it begins such a key wherever it stands.
    """
    total = words.agg(F.sum("n")).first()[0] or 0
    bits = min(MAX_BUCKET_BITS, max(16, int(total // 2).bit_length()))
    bitmaps = [_word_bitmap(words.filter(F.col("n") >= min_count), bits)]
    for _ in range(2, most + 1):
        bitmaps.append(_next_bitmap(texts, bitmaps, bits, min_count))
    shared = texts.sparkSession.sparkContext.broadcast(bitmaps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = known = 0

        def summed() -> pa.Table:
            table = pa.concat_tables(held).group_by("key", use_threads=False).aggregate([("n", "sum")])
            return table.select(["key", "n_sum"]).rename_columns(["key", "n"])

        def sent(table: pa.Table) -> Iterator[pa.RecordBatch]:
            yield from table.cast(pa.schema([("key", pa.string()), ("n", pa.int64())])).to_batches(SENT)

        for block in _blocks(batches):
            words_, longest = block.words(), np.zeros(len(block), np.int64)
            for k, at, bucket in block.marked(shared.value, bits, most):
                longest[at[_marks(shared.value[k - 1], bucket)]] = k
            for k in range(2, most + 1):
                found = pc.value_counts(block.phrases(words_, np.flatnonzero(longest == k), k))
                held.append(pa.table({"key": found.field("values"), "n": found.field("counts")}))
                rows += len(found)
            if rows > known + GATHERED // 8:
                held = [summed()]
                rows = known = len(held[0])
                if known > GATHERED // 8:
                    yield from sent(held.pop())
                    rows = known = 0
                pa.default_memory_pool().release_unused()  # a worker may stay for long
        if rows:
            yield from sent(summed())

    # dealt by key first: a task has each key once or nearly so, and a hash map of them before the shuffle saves little
    return texts.mapInArrow(run, "key string, n long").repartition("key").groupBy("key").agg(F.sum("n").alias("n"))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Successive rows with at most ``SHARD_BYTES`` of keys; one longer key is a shard of its own."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("key")).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = int(np.searchsorted(ends, before + SHARD_BYTES - size, "right"))
            if stop <= at and held:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                continue
            stop = max(stop, at + 1)
            held.append(batch.slice(at, stop - at))
            size += int(ends[stop - 1] - before)
            at = stop
    if held:
        yield pa.Table.from_batches(held)


def _shard_counts(shard: pa.Table, min_count: int, most: int) -> pa.RecordBatch:
    """key and n of a shard's candidates, by their trie; ``shard`` is sorted by key.

    Left out are those that stay below ``min_count`` whatever other shards hold.  Keys that begin with the same bytes
    are neighbours, so only what the first or the last one begins with can begin a key of another shard too.
    """
    both = pc.split_pattern(shard["key"].combine_chunks(), "\n", max_splits=1, reverse=True).flatten()  # phrases have no line feed
    even = pa.array(np.arange(0, len(both), 2))
    block = Block(pc.take(both, even), pc.take(both, pc.add(even, 1)).cast(pa.binary()))
    first = np.ones(len(block), bool)
    first[1:] = ~block.follows[:-1]
    first, words = np.flatnonzero(first), block.words()
    size = np.diff(first, append=len(block))
    weight = np.zeros(len(block), np.int64)
    weight[first] = shard["n"].to_numpy()
    parts = [block.phrases(words, first[size >= k], k) for k in range(2, most + 1)]
    keys = pc.unique(pa.chunked_array(parts)).sort()
    listed = keys.to_pylist()
    total = Trie(listed).counts(block, most, weight)
    ends = [shard["key"][i].as_py().encode() for i in (0, -1)]
    kept = (total >= min_count) | np.array([ends[0].startswith(x) or ends[1].startswith(x) for x in listed])
    return pa.RecordBatch.from_arrays([keys.filter(pa.array(kept)).cast(pa.string()), pa.array(total[kept])], names=["key", "n"])


def phrase_counts(keys: DataFrame, min_count: int, most: int) -> DataFrame:
    """lang, phrase, k and a of the candidates that reach ``min_count``, counted by tries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            yield _shard_counts(shard, min_count, most)

    # no fixed number: adaptive execution joins small neighbouring ranges
    ordered = keys.repartitionByRange("key").sortWithinPartitions("key")
    counted = ordered.mapInArrow(run, "key string, n long").groupBy("key").agg(F.sum("n").alias("a"))
    phrase = F.substring_index("key", "\n", -1)
    lang = F.expr("substring(key, 1, length(key) - length(substring_index(key, '\n', -1)) - 1)")
    return counted.filter(F.col("a") >= min_count).select(
        lang.alias("lang"), phrase.alias("phrase"), F.size(F.split(phrase, " ")).alias("k"), "a")


def collocations(docs: DataFrame, min_count: int = 30, most: int = 4, top: int = 2000, share: int = 80) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: each language's ``top`` phrases."""
    texts = _texts(docs)
    words = saved(word_counts(texts), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = words.filter(F.col("n") >= min_count)
    phrases = saved(phrase_counts(saved(candidates(texts, words, min_count, most), "keys"), min_count, most), "phrases")

    parts = phrases.select("lang", "phrase", "a").unionByName(
        frequent.select("lang", F.col("word").alias("phrase"), F.col("n").alias("a")))
    split = F.split("phrase", " ")
    joined = lambda start, size: F.array_join(F.slice(split, start, size), " ")
    cuts = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select(
        "lang", "phrase", "a", "cut", joined(F.lit(1), F.col("cut")).alias("head"),
        joined(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("tail"))
    head = parts.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l"))
    tail = parts.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r"))
    wide = "decimal(38,0)"
    score = F.expr(f"cast((cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div cast(l + r as {wide}) as bigint)")
    scored = cuts.join(head, ["lang", "head"]).join(tail, ["lang", "tail"]).withColumn("score", score)
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))

    inside = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1),"
                    " s -> array_join(slice(split(phrase, ' '), s, m), ' '))))")
    longer = (phrases.filter("k > 2").select("lang", F.explode(inside).alias("phrase"), F.col("a").alias("b"))
                     .groupBy("lang", "phrase").agg(F.max("b").alias("b")))
    swallowed = F.expr(f"cast(b as decimal(20,0)) * 100 >= cast(a as decimal(20,0)) * {int(share)}")
    kept = best.join(longer, ["lang", "phrase"], "left").filter(F.col("b").isNull() | ~swallowed)
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("best.l").alias("l"),
        F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))
