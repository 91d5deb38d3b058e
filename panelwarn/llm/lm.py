"""LM scoring (operator 5): a hashed maximum-entropy model with class-factored softmax.

P(word | history) = P(class | history) P(bucket | class, history) (c + 1) / mass.
Classes are bands of word frequency with about equal mass, buckets split a
class by word hash, and ``mass`` is the sum of c + 1 over the words of that
leaf; one extra unit in the lowest leaf stands for any unknown word.  Both
softmaxes start at the leaves' own masses, so the untrained model is exactly
the add-one unigram base.  Their features are the previous word (n-gram), the
previous two (n-gram) and the word before the previous one (skip), hashed into
tables of a row for each distinct context of the training part, 2 **
``ROW_BITS`` at least and 2 ** ``MOST_ROW_BITS`` at most (beyond, contexts share
rows).

Steps.  (1) Each task numbers the words of a chunk of documents and counts
them.  (2) One shuffle by word gives every chunk the corpus counts of its own
words, so no task holds the whole vocabulary.  (3) Chunks meet their counts:
exact base scores, and each token becomes four bytes (hashed word, leaf).
(4) Each round, every training task takes AdaGrad steps from the shared
weights over all its training tokens; the tasks' weights are averaged, row by
row in proportion to use, by a shuffle on weight blocks.  (5) All documents
are scored in numpy batches.  Broadcast and collected: the weights, 34 MB at
``MOST_ROW_BITS``, one histogram of at most a few thousand cells, and the
``SKETCH`` least hashes that estimate the number of contexts.

Defined results.  A null or empty text is one token, the end.  A null doc_id
counts as the empty text in the split.  Without training documents every token
is unknown with probability 1.  Repeated rows are scored, and learnt, each.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwarn.llm.common import discard, documents, saved, saved_at, text_bytes

CLASSES, BUCKETS = 16, 16
#: Weight rows of a table are a power of two between these.
ROW_BITS, MOST_ROW_BITS = 16, 18
#: Hashes kept to estimate the number of distinct contexts (to about 3 percent).
SKETCH = 1024
#: Tokens of a chunk (a chunk ends with the document that reaches it).
CHUNK_TOKENS = 2_000_000
#: Tokens of a gradient step.
STEP_TOKENS = 65_536
#: Training tasks at most, and tokens that one learns at least; each sends its weights once a round.
TRAINERS, TRAINER_TOKENS = 512, 8_000_000
#: Logits are at least this, far below any mass: smaller ones give subnormal floats, which cost a hundredfold.
LEAST_LOGIT = -35.0
#: Weight rows of a block in the averaging shuffle.
BLOCK = 1024
_MIX = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint64)


def numbered_chunks(docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Rows of two kinds: documents as word numbers of their chunk, and the chunks' words with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, serial = TaskContext.get().partitionId() << 24, 0
        numbers: defaultdict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        held: list[tuple] = []
        tokens = 0
        for batch in batches:
            for doc_id, out, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held_out", "_raw"))):
                words = raw.lower().split()
                words.append(b"")  # the end
                ids = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
                held.append((doc_id, out, ids))
                tokens += len(ids)
                if tokens >= chunk_tokens:
                    yield from emit(base + serial, numbers, held, batch.schema.field("doc_id").type)
                    serial, tokens = serial + 1, 0
                    numbers.clear()
                    held.clear()
        if held:
            yield from emit(base + serial, numbers, held, batch.schema.field("doc_id").type)

    def emit(chunk: int, numbers: dict, held: list, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        train = [ids for _, out, ids in held if not out] or [np.zeros(0, np.int32)]
        counts = np.bincount(np.concatenate(train), minlength=len(numbers))
        n, v = len(held), len(numbers)
        docs = [pa.array([d for d, _, _ in held], kind), pa.array([o for _, o, _ in held], pa.bool_()),
                pa.array([ids.tobytes() for _, _, ids in held], pa.binary())]
        words = [pa.array(list(numbers), pa.binary()), pa.array(np.arange(v, dtype=np.int32)), pa.array(counts)]
        columns = [pa.array(np.full(n + v, chunk)), *[pa.concat_arrays([c, pa.nulls(v, c.type)]) for c in docs],
                   *[pa.concat_arrays([pa.nulls(n, c.type), c]) for c in words]]
        whole = pa.RecordBatch.from_arrays(columns, names=["chunk", "doc_id", "held_out", "tokens", "word", "number", "n"])
        for at in range(0, n + v, 20_000):
            yield whole.slice(at, 20_000)

    rows = documents(docs, "doc_id", "text").withColumn("_raw", text_bytes())
    split = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    rows = rows.select("doc_id", split.alias("held_out"), "_raw")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"chunk long, doc_id {kind}, held_out boolean, tokens binary, "
                                "word binary, number int, n long")


def _band(count: np.ndarray) -> np.ndarray:
    """Eighths of a power of two: at most a few hundred bands of word counts."""
    return np.floor(np.log2(np.asarray(count, float) + 1) * 8).astype(np.int64)


class Leaves:
    """Class of each frequency band and mass of each leaf, from the histogram of the corpus."""

    def __init__(self, histogram: list[tuple[int, int, int, int]]):
        """(band, bucket, words, tokens) of the known words."""
        bands = max((h[0] for h in histogram), default=0) + 1
        tokens = np.zeros(bands)
        for band, _, _, n in histogram:
            tokens[band] += n
        self.train_tokens = int(tokens.sum())
        self.vocabulary = sum(h[2] for h in histogram)
        before = np.cumsum(tokens) - tokens
        self.class_of = np.minimum(before * CLASSES // max(self.train_tokens, 1), CLASSES - 1).astype(np.int64)
        self.mass = np.zeros((CLASSES, BUCKETS))
        self.mass[self.class_of[0], 0] = 1.0  # any unknown word
        for band, bucket, words, n in histogram:
            self.mass[self.class_of[band], bucket] += n + words
        with np.errstate(divide="ignore", invalid="ignore"):
            first = np.log(self.mass.sum(axis=1) / self.mass.sum())
            second = np.log(self.mass / self.mass.sum(axis=1, keepdims=True))
        self.first = np.where(np.isfinite(first), first, -60.0).astype(np.float32)
        self.second = np.where(np.isfinite(second), second, -60.0).astype(np.float32)

    def leaf(self, count: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        known = count > 0
        band = np.where(known, _band(count), 0)
        return self.class_of[band] * BUCKETS + np.where(known, bucket, 0)


def corpus_counts(chunks: DataFrame) -> DataFrame:
    """chunk, number, the word's corpus count and hash, and whether this row stands for the word."""
    word = Window.partitionBy("word")
    return chunks.filter(F.col("word").isNotNull()).select(
        "chunk", "number", F.sum("n").over(word).alias("count"), F.xxhash64("word").alias("hash"),
        (F.col("chunk") == F.min("chunk").over(word)).alias("first"))


def _bucket(hashed: np.ndarray) -> np.ndarray:
    return hashed >> np.uint64(40) & np.uint64(BUCKETS - 1)


def histogram(counts: DataFrame) -> list[tuple[int, int, int, int]]:
    band = F.floor(F.log2(F.col("count") + 1) * 8)
    bucket = F.shiftrightunsigned("hash", 40).bitwiseAND(F.lit(BUCKETS - 1))
    known = counts.filter(F.col("first") & (F.col("count") > 0))
    rows = known.groupBy(band.alias("band"), bucket.alias("bucket")).agg(F.count(F.lit(1)), F.sum("count")).collect()
    return [tuple(map(int, r)) for r in rows]


def encoded(chunks: DataFrame, counts: DataFrame, leaves: Leaves) -> DataFrame:
    """Each document with its exact base figures and its tokens as hash and leaf (four bytes a token)."""
    floor = np.log10(leaves.train_tokens + leaves.vocabulary + 1)
    log_mass = np.log10(np.where(leaves.mass > 0, leaves.mass, 1).ravel())  # no token is in an empty leaf

    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        number = words.column("number").to_numpy()
        count, hashed = np.zeros(len(number), np.int64), np.zeros(len(number), np.uint64)
        count[number] = words.column("count").to_numpy()
        hashed[number] = words.column("hash").to_numpy().view(np.uint64)
        leaf = leaves.leaf(count, _bucket(hashed).astype(np.int64))
        context = np.where(count > 0, hashed & np.uint64(0xFFFFFF), 1)  # unknown words look alike
        code = (context.astype(np.uint64) << np.uint64(8) | leaf.astype(np.uint64)).astype("<u4")
        log_count = np.log10(count + 1.0)
        inside = log_count - log_mass[leaf]
        out = {k: [] for k in ("n_tokens", "n_known", "base_score", "inside", "codes")}
        for raw in docs.column("tokens").to_pylist():
            ids = np.frombuffer(raw, np.int32)
            out["n_tokens"].append(len(ids))
            out["n_known"].append(int((count[ids] > 0).sum()))
            out["base_score"].append(float(log_count[ids].sum() - len(ids) * floor))
            out["inside"].append(float(inside[ids].sum()))
            out["codes"].append(code[ids].tobytes())
        kinds = dict(n_tokens=pa.int64(), n_known=pa.int64(), base_score=pa.float64(), inside=pa.float64(), codes=pa.binary())
        return pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"),
                         **{k: pa.array(v, kinds[k]) for k, v in out.items()}})

    texts = chunks.filter(F.col("tokens").isNotNull()).select("chunk", "doc_id", "held_out", "tokens")
    words = counts.select("chunk", "number", "count", "hash")
    kind = chunks.schema["doc_id"].dataType.simpleString()
    return texts.groupBy("chunk").cogroup(words.groupBy("chunk")).applyInArrow(
        run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, "
             "inside double, codes binary")


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """``_features`` of documents gathered up to STEP_TOKENS tokens."""
    held: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for raw in batch.column("codes").to_pylist():
            held.append(np.frombuffer(raw, "<u4"))
            size += len(held[-1])
            if size >= STEP_TOKENS:
                yield from _features(held)
                held, size = [], 0
    if held:
        yield from _features(held)


def _features(docs: list[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    """Of each token: the owner's place, class, bucket and the three hashed contexts, STEP_TOKENS at most."""
    codes = np.concatenate(docs).astype(np.uint64)
    lengths = np.array([len(d) for d in docs])
    starts = np.cumsum(lengths) - lengths
    word, leaf = codes >> np.uint64(8), (codes & np.uint64(255)).astype(np.int64)
    one, two = np.zeros_like(word), np.zeros_like(word)
    one[1:], two[2:] = word[:-1], word[:-2]
    one[starts] = 0
    two[starts] = 0
    two[starts[lengths > 1] + 1] = 0
    owner = np.repeat(np.arange(len(docs)), lengths)
    contexts = np.stack([one * _MIX[0] + np.uint64(1), one * _MIX[1] + two * _MIX[2] + np.uint64(2),
                         two * _MIX[3] + np.uint64(3)])
    for a in range(0, len(codes), STEP_TOKENS):
        b = a + STEP_TOKENS
        yield owner[a:b], leaf[a:b] // BUCKETS, leaf[a:b] % BUCKETS, contexts[:, a:b]


def _hashed(contexts: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    x = (contexts + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + salt * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x


def _rows(contexts: np.ndarray, salt: np.ndarray | int, bits: int) -> np.ndarray:
    """Weight rows of the contexts."""
    return (_hashed(contexts, salt) >> np.uint64(64 - bits)).astype(np.intp)


def row_bits(training: DataFrame) -> int:
    """Bits of a table that has a row for each distinct context, within the bounds."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros(0, np.uint64)
        for *_, contexts in _steps(batches):
            x = _hashed(contexts, np.uint64(0)).ravel()
            if len(kept) == SKETCH:
                x = x[x < kept[-1]]
            kept = np.unique(np.concatenate([kept, x]))[:SKETCH]
        yield pa.RecordBatch.from_arrays([pa.array((kept >> np.uint64(1)).astype(np.int64))], names=["h"])

    first = training.mapInArrow(least, "h long").distinct().orderBy("h").limit(SKETCH).collect()
    contexts = len(first) if len(first) < SKETCH else (SKETCH - 1) / (first[-1]["h"] / 2**63)
    return int(np.clip(np.ceil(np.log2(max(contexts, 1))), ROW_BITS, MOST_ROW_BITS))


def _softmax(weights: np.ndarray, rows: np.ndarray, prior: np.ndarray) -> np.ndarray:
    z = weights.take(rows[0], axis=0)
    z += weights.take(rows[1], axis=0)
    z += weights.take(rows[2], axis=0)
    z += prior
    np.clip(z, LEAST_LOGIT, 80, out=z)
    np.exp(z, out=z)
    z *= (1 / np.maximum(z @ np.ones(z.shape[1], z.dtype), 1e-30))[:, None]
    return z


def _row_sums(rows: np.ndarray, values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, how often each is used, and the sum of its values (the same for each of the contexts)."""
    uses = np.bincount(rows.ravel(), minlength=size)
    touched = np.flatnonzero(uses)
    place = np.zeros(size, np.intp)
    place[touched] = np.arange(len(touched))
    places = place.take(rows).ravel()
    sums = np.empty((values.shape[1], len(touched)), np.float32)
    thrice = np.empty((len(rows), len(values)))
    for column, value in zip(sums, values.T):
        thrice[:] = value
        column[:] = np.bincount(places, thrice.ravel(), len(touched))
    return touched, uses[touched].astype(np.float32), np.ascontiguousarray(sums.T)


def _own(tables: np.ndarray) -> np.ndarray:
    """A fresh array of broadcast weights; one that came through pickle keeps numpy from its fast paths."""
    fresh = np.zeros(tables.shape, np.float32)
    fresh[...] = tables
    return fresh


def _both(leaves: Leaves, tables: np.ndarray, step: tuple) -> Iterator[tuple]:
    """Of the class and then the bucket: table number, rows, probabilities, and what was there."""
    _, cls, bucket, contexts = step
    bits = tables.shape[1].bit_length() - 1
    for k, prior, truth, salt in ((0, leaves.first, cls, np.uint64(0)),
                                  (1, leaves.second.take(cls, axis=0), bucket, (cls + 1).astype(np.uint64))):
        rows = _rows(contexts, salt, bits)
        yield k, rows, _softmax(tables[k], rows, prior), truth


def train(rows: DataFrame, leaves: Leaves, rounds: int = 1, rate: float = 0.2) -> np.ndarray:
    """Weights of both softmaxes, by rounds of distributed gradient steps and averaging."""
    spark = rows.sparkSession
    training = rows.filter(~F.col("held_out")).select("codes")
    trainers = min(TRAINERS, -(-leaves.train_tokens // TRAINER_TOKENS) or 1)
    if training.rdd.getNumPartitions() > trainers:
        training = training.coalesce(trainers)
    bits = row_bits(training) if rounds else ROW_BITS
    tables = np.zeros((2, 1 << bits, max(CLASSES, BUCKETS)), np.float32)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(tables)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights = _own(shared.value)
            squares = np.full_like(weights, 1e-2)
            used = np.zeros(weights.shape[:2], np.float32)
            width = weights.shape[2]
            for step in _steps(batches):
                for k, rows, p, truth in _both(leaves, weights, step):
                    p[np.arange(len(truth)), truth] -= 1
                    touched, uses, g = _row_sums(rows, p, weights.shape[1])
                    g /= np.sqrt(uses)[:, None]
                    used[k][touched] += uses
                    square = squares[k].take(touched, axis=0) + g * g
                    squares[k][touched] = square
                    g *= rate
                    g /= np.sqrt(square, out=square)
                    weights[k][touched] -= g
            weighted = (weights * used[:, :, None]).reshape(-1, BLOCK * width)
            for i, part in enumerate(weighted):
                n = used.reshape(-1, BLOCK)[i]
                if n.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i], pa.int32()), pa.array([part.tobytes()], pa.binary()),
                         pa.array([n.tobytes()], pa.binary())], names=["block", "weighted", "used"])

        def mean(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros((BLOCK, tables.shape[2])), np.zeros(BLOCK)
            for part in parts:
                for w, u in zip(part.column("weighted"), part.column("used")):
                    total += np.frombuffer(w.as_py(), np.float32).reshape(total.shape)
                    n += np.frombuffer(u.as_py(), np.float32)
            average = (total / np.maximum(n, 1)[:, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key[0].as_py()], pa.int32()), pa.array([average.tobytes()], pa.binary())],
                names=["block", "average"])

        sent = training.mapInArrow(run, "block int, weighted binary, used binary")
        averaged = sent.groupBy("block").applyInArrow(mean, "block int, average binary").collect()
        tables = np.zeros_like(tables)
        flat = tables.reshape(-1, BLOCK, tables.shape[2])
        for r in averaged:
            flat[r["block"]] = np.frombuffer(r["average"], np.float32).reshape(flat.shape[1:])
        shared.unpersist()
    return tables


def score_documents(docs: DataFrame, rounds: int = 1, rate: float = 0.2,
                    chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and the model's score of every text."""
    chunks, chunks_at = saved_at(numbered_chunks(docs, chunk_tokens), "lm-chunks")
    counts, counts_at = saved_at(corpus_counts(chunks), "lm-counts")
    leaves = Leaves(histogram(counts))
    rows = saved(encoded(chunks, counts, leaves), "lm-encoded")
    discard(docs.sparkSession, chunks_at, counts_at)
    shared = docs.sparkSession.sparkContext.broadcast(train(rows, leaves, rounds, rate))
    total = leaves.train_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _own(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known")],
                     pa.array(np.full(batch.num_rows, total)), batch.column("base_score"),
                     pa.array(outer(batch, tables) + batch.column("inside").to_numpy())],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def outer(batch: pa.RecordBatch, tables: np.ndarray) -> np.ndarray:
        out = np.zeros(batch.num_rows)
        held = [np.frombuffer(r, "<u4") for r in batch.column("codes").to_pylist()]
        for step in _features(held):
            for _, _, p, truth in _both(leaves, tables, step):
                chosen = np.maximum(p[np.arange(len(truth)), truth], 1e-30)
                out += np.bincount(step[0], np.log10(chosen.astype(float)), len(out))
        return out

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, "
                                "train_tokens long, base_score double, score double")
