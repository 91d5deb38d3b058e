import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from conftest_llm import rows
from panelwarn.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines, earlier, dup = text.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in earlier
            earlier.add(x)
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


BASE = [*quality.COUNTS, "base_failed"]


def test_base_counts(small_docs):
    got = {r["doc_id"]: tuple(r[c] for c in BASE) for r in quality.quality_verdicts(small_docs, quality.Trees()).collect()}
    assert got == {r["doc_id"]: brute(r["text"]) for r in small_docs.collect()}


def test_verdicts_on_labels_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit_quality(docs, labels.filter("doc_id % 2 = 0"), min_leaf=3)
    judged = quality.quality_verdicts(docs, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("not base_failed")
    right, n = judged.agg(F.sum((F.col("kept") == (F.col("quality") == 1)).cast("int")), F.count(F.lit(1))).first()
    assert n > 100 and right / n >= 0.97


def test_monotone():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.2 * rng.standard_normal(3000)) < 0.6).astype(float)
    for direction in (-1, 0):
        model = quality.boost(x, y, [direction, 0, 0], n_trees=30, depth=3)
        grid = np.repeat(rng.random((50, 3))[:, None, :], 40, axis=1)
        grid[:, :, 0] = np.linspace(0, 1, 40)
        p = model.probability(grid.reshape(-1, 3)).reshape(50, 40)
        if direction:
            assert (np.diff(p, axis=1) <= 1e-12).all()
    assert ((quality.boost(x, y, [0, 0, 0]).probability(x) > 0.5) == (y > 0)).mean() > 0.85


def test_flat_nodes_match_recursion():
    rng = np.random.default_rng(3)
    x = rng.random((500, 4))
    model = quality.boost(x, (x[:, 2] > 0.4).astype(float), [0] * 4, n_trees=5, depth=3)

    def walk(t, row, node=0):
        if model.left[t, node] == node:
            return model.value[t, node]
        return walk(t, row, model.left[t, node] if row[model.feature[t, node]] <= model.threshold[t, node]
                    else model.right[t, node])
    want = [model.prior + sum(walk(t, r) for t in range(5)) for r in x]
    assert np.allclose(model.margin(x), want)


def test_odd(spark, odd_docs, clashing_docs, empty_docs):
    want = sorted(brute(r["text"] or "") for r in odd_docs.collect())
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    one_class = spark.createDataFrame([(1, 1), (2, 1), (None, 0), (3, None)], "doc_id long, quality int")
    for docs, labels in ((odd_docs, no_labels), (clashing_docs, one_class)):
        model = quality.fit_quality(docs, labels)
        out = quality.quality_verdicts(docs, model)
        assert rows(out, *BASE) == want
        assert out.filter(F.col("kept") == F.col("base_failed")).count() == 0
        kept = quality.keep_documents(docs, model)
        assert kept.schema == docs.schema and kept.count() == sum(not w[-1] for w in want)
    assert quality.quality_verdicts(empty_docs, quality.Trees()).count() == 0
    assert quality.fit_quality(empty_docs, one_class).margin(np.zeros((2, len(quality.FEATURES)))).shape == (2,)
