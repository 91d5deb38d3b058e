import random
import re

import numpy as np
import pytest

from conftest_llm import key, rows
from panelwarn.llm import minhash

COLUMNS = ["doc_id", "n_shingles", "component_id", "kept"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def brute(data, percent=85):
    sets = [shingles(t) for _, t in data]
    parent = list(range(len(data)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(data)):
        for j in range(i):
            small, large = sorted((len(sets[i]), len(sets[j])))
            if not small or 100 * small < percent * large:
                continue
            met = len(sets[i] & sets[j])
            if 100 * met >= percent * (len(sets[i]) + len(sets[j]) - met):
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(data):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(((d, len(sets[i]), least.get(top(i)), d == least.get(top(i))) for i, (d, _) in enumerate(data)), key=key)


def check(docs, percent=85):
    want = brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], percent)
    assert rows(minhash.near_duplicates(docs, percent=percent), *COLUMNS) == want
    return want


def family(rng, n, words, most):
    """Copies of one text, each with up to ``most`` words replaced."""
    base = [f"w{rng.randint(0, 10_000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(words)] = f"x{rng.randint(0, 10_000)}"
        out.append(" ".join(w))
    return out


def test_whole_documents(small_docs):
    assert any(not r[3] for r in check(small_docs))


def test_odd_rows(odd_docs):
    check(odd_docs)


@pytest.mark.parametrize("part", [4, 256])
def test_families_near_the_threshold(spark, odd_docs, monkeypatch, part):
    monkeypatch.setattr(minhash, "PART_ROWS", part)
    monkeypatch.setattr(minhash, "BUCKET_ROWS", 16)
    rng = random.Random(3)
    texts = family(rng, 40, 120, 3) + family(rng, 30, 30, 1) + family(rng, 25, 7, 1) + family(rng, 30, 500, 12) + ["a b", "b a", "a b"]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], odd_docs.schema)
    found = check(docs)
    assert 3 < sum(r[3] for r in found) < len(texts) - 20


def test_clashing_columns_and_empty_table(clashing_docs, odd_docs, empty_docs):
    assert rows(minhash.near_duplicates(clashing_docs), *COLUMNS) == rows(minhash.near_duplicates(odd_docs), *COLUMNS)
    assert minhash.near_duplicates(empty_docs).count() == 0


def test_estimate_is_unbiased():
    rng = np.random.default_rng(1)
    for share, n in ((0.85, 400), (0.5, 60), (0.0, 5000)):
        got = []
        for _ in range(200):
            h = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64) * np.uint64(2)
            met = round(2 * n * share / (1 + share))
            a, b = np.sort(h[:n]), np.sort(h[n - met:2 * n - met])
            equal = (minhash.registers(a) == minhash.registers(b)).sum()
            got.append(minhash.estimated(np.array([equal]), np.array([n]))[0])
        assert abs(np.mean(got) - met / (2 * n - met)) < 0.02


def test_links_are_exact():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 40, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[:rng.integers(45, 61)], rng.integers(0, 1 << 40, rng.integers(0, 6)).astype(np.uint64)]))
            for _ in range(50)]
    stray = np.arange(50) % 3 == 0
    want = {(i, j) for i in range(50) if stray[i] for j in range(50)
            if i != j and 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
    assert set(map(tuple, minhash.exact_links(sets, stray, 85).tolist())) == want
