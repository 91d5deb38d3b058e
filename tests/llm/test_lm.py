import math
import re
import zlib
from collections import Counter

import numpy as np

from conftest_llm import rows
from panelwarn.llm import lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + [None]


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def brute(docs):
    data = [(r["doc_id"], tokens(r["text"])) for r in docs.collect()]
    c = Counter(t for d, ts in data if not held_out(d) for t in ts)
    n, v = sum(c.values()), len(c)
    return [(d, held_out(d), len(ts), sum(t in c for t in ts), n,
             round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts), 6)) for d, ts in data]


def sorted_like(data):
    return sorted(data, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens"]


def check(docs, **options):
    out = lm.score_documents(docs, **options).collect()
    got = [(*[r[c] for c in COLUMNS], round(r["base_score"], 6)) for r in out]
    assert [x[:5] for x in sorted_like(got)] == [x[:5] for x in sorted_like(brute(docs))]
    assert np.allclose(sorted(x[5] for x in got), sorted(x[5] for x in brute(docs)))
    return out


def test_base_and_gain_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = check(docs)
    for part in (True, False):
        chosen = [r for r in out if r["held_out"] == part]
        assert sum(r["score"] for r in chosen) > sum(r["base_score"] for r in chosen)


def test_untrained_is_the_base(small_docs):
    for r in lm.score_documents(small_docs, rounds=0).collect():
        assert abs(r["score"] - r["base_score"]) < 1e-3 * max(1, abs(r["base_score"]))


def test_sums_to_one():
    """Over the known words and one unknown word, the model's probabilities sum to one after any history."""
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 400, 300)
    hashes = rng.integers(0, 2**63, 300).astype(np.uint64)
    bucket = lm._bucket(hashes).astype(np.int64)
    cells = Counter()
    for c, b in zip(counts, bucket):
        cells[int(lm._band(c)), int(b)] += np.array([1, c])
    leaves = lm.Leaves([(band, b, int(x[0]), int(x[1])) for (band, b), x in cells.items()])
    weights = rng.standard_normal((2, 1 << lm.ROW_BITS, 16)).astype(np.float32)
    all_counts, all_buckets = np.append(counts, 0), np.append(bucket, 0)
    leaf = leaves.leaf(all_counts, all_buckets)
    contexts = np.repeat(rng.integers(0, 2**60, (3, 1)).astype(np.uint64), 301, axis=1)
    step = (None, leaf // lm.BUCKETS, leaf % lm.BUCKETS, contexts)
    p = (all_counts + 1) / leaves.mass.ravel()[leaf]
    for _, _, q, truth in lm._both(leaves, weights, step):
        p = p * q[np.arange(301), truth]
    assert abs(p.sum() - 1) < 1e-4


def test_odd(odd_docs, clashing_docs, empty_docs, spark):
    check(odd_docs)
    check(clashing_docs)
    assert lm.score_documents(empty_docs).count() == 0
    unknown = next(i for i in range(100) if held_out(i))
    only = spark.createDataFrame([(unknown, "a b c")], "doc_id long, text string")
    (r,) = lm.score_documents(only).collect()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (4, 0, 0, 0.0)
    assert abs(r["score"]) < 1e-3


def test_small_chunks(small_docs):
    """Many chunks give the same figures as one."""
    check(small_docs, chunk_tokens=500)


def _doc_contexts(words, leaves):
    codes = np.array([w << 8 | leaf for w, leaf in zip(words, leaves)], "<u4")
    ((_, _, _, contexts),) = lm._features([codes])
    return contexts[:, -1]


def test_two_previous_words_are_a_context():
    """Histories of other words, but of the same classes, have contexts of their own; order counts."""
    leaves = [35, 35, 35]
    a, b, c = (_doc_contexts(w, leaves)[1] for w in ([5, 6, 9], [7, 6, 9], [6, 5, 9]))
    assert len({int(a), int(b), int(c)}) == 3


def test_pair_of_words_is_learnt(spark):
    """The third word follows from the exact pair before it, and from neither word alone."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(700):
        bits = rng.integers(0, 2, (60, 2))
        rows.append((i, " ".join(f"x{a} y{b} z{a ^ b}" for a, b in bits)))
    out = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), rounds=8).collect()
    held = [r for r in out if r["held_out"]]
    gain = sum(r["score"] - r["base_score"] for r in held) / sum(r["n_tokens"] for r in held)
    # known letter: a gain of log10(3); the third word besides: a third of log10(2)
    assert gain > math.log10(3) + 0.6 * math.log10(2) / 3


def test_rows_grow_with_the_contexts(spark):
    assert lm.STEP_TOKENS <= 65_536
    rng = np.random.default_rng(4)
    few = [(bytearray((rng.integers(1, 50, 1000) << 8).astype("<u4").tobytes()),)]
    many = [(bytearray((rng.integers(1, 1 << 23, 30_000) << 8).astype("<u4").tobytes()),) for _ in range(4)]
    bits = [lm.row_bits(spark.createDataFrame(r, "codes binary")) for r in (few, many)]
    assert bits == [16, 18] and lm.ROW_BITS == 16
