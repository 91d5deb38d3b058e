"""Quality rules (operator 10): boosted trees over document statistics.

``fit_quality`` joins a bounded sample of the labelled documents to their
statistics and boosts shallow trees on quantile histograms.  Chosen features
are monotone: more symbols, repeated lines, repeated words, capitals or
exclamation marks can never raise a document's score.  The trees are flattened
to node arrays (feature, threshold, left, right, value), and every Spark task
scores its Arrow batches with them, all rows and trees at once.

Defined results.  A null text is empty.  A document without words has all
counts 0 and fails the base rule.  No usable labels (none, one class only, or
an empty table) gives a model without trees, whose verdict is "keep", so that
only the base rule rejects.  Labels of one document that disagree count as the
lowest.  Rows with a null doc_id or repeated doc_ids are scored like any other.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwarn.llm.common import documents, ship_package, text_bytes

#: Bound on the labelled sample the trees are fitted on (taken by hash of doc_id).
MAX_TRAIN_ROWS = 40_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Feature -> monotone direction of P(good): -1 never rises with it, 0 free.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1,
    "capital_share": -1, "shout_share": -1, "digit_share": 0, "stop_share": 0, "comma_share": 0,
    "distinct_share": 0, "short_share": 0, "long_word": 0, "words_per_line": 0, "non_ascii_share": 0,
}
_SYMBOLS = b"#*$%&|<>"
_CAPITALS = bytes(range(65, 91))
_DIGITS = b"0123456789"
_CONTINUATION = bytes(range(0x80, 0xC0))
_HIGH = bytes(range(0x80, 0x100))


def _repeat_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that the text has twice or more."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    total, covered = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + 3 - max(i, covered)
            covered = i + 3
    return total


def statistics(raw: bytes) -> tuple[list[int], list[float]]:
    """The five base counts and the model's features of one text."""
    words = raw.split()
    n, size = len(words), len(raw)
    blanks = size - sum(map(len, words))
    chars = len(raw.translate(None, _CONTINUATION)) - blanks
    symbols = size - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    dup_lines = len(lines) - len(set(lines))
    repeat = _repeat_words(words)
    c, w = max(chars, 1), max(n, 1)
    feats = [
        float(np.log1p(n)), chars / w, symbols / c, dup_lines / max(len(lines), 1), repeat / w,
        (size - len(raw.translate(None, _CAPITALS))) / c, raw.count(b"!") / w,
        (size - len(raw.translate(None, _DIGITS))) / c, raw.count(b".") / w, raw.count(b",") / w,
        len(set(words)) / w, sum(len(x) <= 3 for x in words) / w, float(max(map(len, words), default=0)),
        n / max(len(lines), 1), (size - len(raw.translate(None, _HIGH))) / c,
    ]
    return [n, chars, symbols, dup_lines, repeat], feats


def base_failed(counts: np.ndarray) -> np.ndarray:
    n, repeat = counts[:, 0], counts[:, 4]
    return (n < 50) | (100 * repeat > 50 * n)


@dataclass
class Trees:
    """Flattened boosted trees; row t of each array is tree t, leaves point to themselves."""

    prior: float = 0.0
    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.int64))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))
    left: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.int64))
    right: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.int64))
    value: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))
    depth: int = 0

    def margin(self, x: np.ndarray) -> np.ndarray:
        n_trees = len(self.feature)
        if not n_trees:
            return np.full(len(x), self.prior)
        trees, rows = np.arange(n_trees)[None, :], np.arange(len(x))[:, None]
        node = np.zeros((len(x), n_trees), np.int64)
        for _ in range(self.depth):
            below = x[rows, self.feature[trees, node]] <= self.threshold[trees, node]
            node = np.where(below, self.left[trees, node], self.right[trees, node])
        return self.prior + self.value[trees, node].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))


def boost(x: np.ndarray, y: np.ndarray, monotone: list[int], n_trees: int = 60, depth: int = 3,
          rate: float = 0.2, bins: int = 48, l2: float = 1.0, min_leaf: int = 10) -> Trees:
    """Second-order logistic boosting on quantile bins with monotone constraints.

    A split on a constrained feature must order its children's values, and
    their midpoint bounds every value below on either side, which keeps whole
    trees monotone.
    """
    if not len(x) or y.min() == y.max():
        return Trees(prior=50.0)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    prior = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    width = 2 ** (depth + 1) - 1
    out = Trees(prior, *[np.zeros((n_trees, width), t) for t in (np.int64, float, np.int64, np.int64, float)], depth)
    out.left[:], out.right[:] = np.arange(width), np.arange(width)
    margin = np.full(len(x), prior)
    for t in range(n_trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        live = [(0, np.arange(len(x)), -np.inf, np.inf)]
        for level in range(depth + 1):
            following = []
            for node, rows, low, high in live:
                sg, sh = g[rows].sum(), h[rows].sum()
                best = _best_split(binned, edges, rows, g, h, monotone, l2, min_leaf, low, high) \
                    if level < depth and len(rows) >= 2 * min_leaf else None
                if best is None:
                    out.value[t, node] = rate * float(np.clip(-sg / (sh + l2), low, high))
                    margin[rows] += out.value[t, node]
                    continue
                j, cut, left_value, right_value = best
                a, b = 2 * node + 1, 2 * node + 2
                out.feature[t, node], out.threshold[t, node] = j, edges[j][cut]
                out.left[t, node], out.right[t, node] = a, b
                goes = binned[rows, j] <= cut
                mid = (left_value + right_value) / 2
                bounds = {-1: ((mid, high), (low, mid)), 0: ((low, high),) * 2, 1: ((low, mid), (mid, high))}
                (l_lo, l_hi), (r_lo, r_hi) = bounds[monotone[j]]
                following += [(a, rows[goes], l_lo, l_hi), (b, rows[~goes], r_lo, r_hi)]
            live = following
    return out


def _best_split(binned, edges, rows, g, h, monotone, l2, min_leaf, low, high):
    best, best_gain = None, 1e-6
    sg, sh = g[rows].sum(), h[rows].sum()
    for j, e in enumerate(edges):
        if not len(e):
            continue
        b = binned[rows, j]
        gl = np.cumsum(np.bincount(b, g[rows], len(e) + 1))[:-1]
        hl = np.cumsum(np.bincount(b, h[rows], len(e) + 1))[:-1]
        nl = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
        lv, rv = np.clip(-gl / (hl + l2), low, high), np.clip(-(sg - gl) / (sh - hl + l2), low, high)
        gain = gl**2 / (hl + l2) + (sg - gl) ** 2 / (sh - hl + l2) - sg**2 / (sh + l2)
        allowed = (nl >= min_leaf) & (len(rows) - nl >= min_leaf) & ((rv - lv) * monotone[j] >= 0)
        gain = np.where(allowed, gain, -np.inf)
        k = int(np.argmax(gain))
        if gain[k] > best_gain:
            best, best_gain = (j, k, float(lv[k]), float(rv[k])), gain[k]
    return best


def _score_batches(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [statistics(t) for t in batch.column("_raw").to_pylist()]
            counts = np.array([c for c, _ in both], np.int64).reshape(-1, len(COUNTS))
            feats = np.array([f for _, f in both], float).reshape(-1, len(FEATURES))
            arrays = [batch.column(c) for c in columns]
            arrays += [pa.array(counts[:, i]) for i in range(len(COUNTS))]
            arrays += [pa.array(list(feats), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, *COUNTS, "features"])
    return run


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts and the feature vector of every whole text."""
    raw = documents(docs, "doc_id", "text").select("doc_id", text_bytes().alias("_raw"))
    counts = ", ".join(f"{c} long" for c in COUNTS)
    kind = raw.schema["doc_id"].dataType.simpleString()
    return raw.mapInArrow(_score_batches(["doc_id"]), f"doc_id {kind}, {counts}, features array<double>")


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, seed: int = 7, **params) -> Trees:
    """Fit the trees on at most ``max_rows`` labelled documents, chosen by a seeded hash."""
    key = F.xxhash64(F.lit(seed), F.col("doc_id"))
    sample = (labels.select(labels["doc_id"], labels["quality"]).dropna()
                    .groupBy("doc_id").agg(F.min("quality").alias("_y"))
                    .orderBy(key, "doc_id").limit(max_rows))
    # bounded by max_rows rows of two numbers
    chosen = documents(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id")
    # statistics first, so that the final cut (for repeated doc_ids) moves numbers, not texts
    stats = document_statistics(chosen.select("doc_id", "text")).select("doc_id", "features")
    rows = (stats.join(F.broadcast(sample), "doc_id").select("doc_id", "features", "_y")
                 .orderBy(key, "doc_id", "features").limit(max_rows).toPandas())
    rows = rows.sort_values("doc_id", kind="stable")
    x = np.array(rows["features"].tolist(), float).reshape(-1, len(FEATURES))
    # an order of the values themselves keeps reruns equal
    order = np.lexsort(x.T)
    return boost(x[order], (rows["_y"].to_numpy(float) > 0).astype(float)[order], list(FEATURES.values()), **params)


def quality_verdicts(docs: DataFrame, model: Trees, threshold: float = 0.5) -> DataFrame:
    """doc_id, base counts, base_failed, the model's probability and ``kept``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, failed, prob = _judge(batch.column("_raw"), model)
            arrays = [batch.column("doc_id"), *[pa.array(counts[:, i]) for i in range(len(COUNTS))],
                      pa.array(failed), pa.array(~failed & (prob >= threshold)), pa.array(prob)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *COUNTS, "base_failed", "kept", "probability"])

    raw = documents(docs, "doc_id", "text").select("doc_id", text_bytes().alias("_raw"))
    counts = ", ".join(f"{c} long" for c in COUNTS)
    kind = raw.schema["doc_id"].dataType.simpleString()
    return raw.mapInArrow(run, f"doc_id {kind}, {counts}, base_failed boolean, kept boolean, probability double")


def _judge(texts: pa.Array, model: Trees) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    both = [statistics(t or b"") for t in texts.to_pylist()]
    counts = np.array([c for c, _ in both], np.int64).reshape(-1, len(COUNTS))
    feats = np.array([f for _, f in both], float).reshape(-1, len(FEATURES))
    return counts, base_failed(counts), model.probability(feats)


def keep_documents(docs: DataFrame, model: Trees, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that pass, all their columns unchanged."""
    ship_package(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, failed, prob = _judge(batch.column(at).cast(pa.binary()), model)
            yield batch.filter(pa.array(~failed & (prob >= threshold)))

    return docs.mapInArrow(run, docs.schema)
