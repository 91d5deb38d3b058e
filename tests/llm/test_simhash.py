import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from conftest_llm import rows
from panelwarn.llm import simhash
from panelwarn.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text, k=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = WORD.findall(lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(max(len(words) - k + 1, 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(values, distance):
    parent = {v: v for v in values}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v
    for v in parent:
        for w in parent:
            if v < w and bin(v ^ w).count("1") <= distance and top(v) != top(w):
                parent[max(top(v), top(w))] = min(top(v), top(w))
    return {v: top(v) for v in parent}


def check(docs, k=4, distance=4):
    data = [(r["doc_id"], brute_fingerprint(r["text"] or "", k)) for r in docs.collect()]
    top = brute_components({f for _, f in data}, distance)
    least = {}
    for d, f in data:
        if d is not None:
            least[top[f]] = min(d, least.get(top[f], d))
    want = [(d, f - (1 << 64) if f >> 63 else f, least.get(top[f])) for d, f in data]
    got = simhash.near_duplicates(docs, k, distance)
    assert rows(got, "doc_id", "fp", "component_id") == sorted(
        want, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))
    kept = simhash.one_of_each(docs, k, distance)
    assert kept.dtypes == docs.dtypes
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(top.values()))
    assert sorted(d for d in ids if d is not None) == sorted(least.values())


def test_whole_documents(small_docs):
    check(small_docs)


def test_odd(odd_docs, clashing_docs, empty_docs):
    check(odd_docs)
    check(clashing_docs)
    assert simhash.near_duplicates(empty_docs).count() == 0
    assert simhash.one_of_each(empty_docs).count() == 0


def near_values(n, rng):
    centres = [rng.getrandbits(64) for _ in range(6)]
    out = {rng.getrandbits(64) for _ in range(n)}
    while len(out) < 3 * n:
        v = rng.choice(centres)
        for _ in range(rng.randint(0, 7)):
            v ^= 1 << rng.randrange(64)
        out.add(v)
    return sorted(out)


def test_links_match_brute_force(spark):
    rng = random.Random(4)
    for distance, segments, limit in ((4, 3, 8192), (4, 3, 40), (3, 2, 64), (6, 3, 50), (4, 4, 8192)):
        values = near_values(150, rng)
        signed = np.array(values, np.uint64).view(np.int64).tolist()
        df = spark.createDataFrame([(v,) for v in signed], "fp long")
        edges = simhash.link_fingerprints(df, distance, segments, limit)
        for r in edges.collect():
            assert bin((r["a"] ^ r["b"]) & (2**64 - 1)).count("1") <= distance
        got = {r["node"]: r["root"] for r in components(edges).collect()}
        groups = {}
        for v, s in zip(values, signed):
            groups.setdefault(brute_components_cache(values, distance)[v], set()).add(got.get(s, s))
        assert all(len(g) == 1 for g in groups.values())
        assert len({next(iter(g)) for g in groups.values()}) == len(groups)


_CACHE = {}


def brute_components_cache(values, distance):
    key = (tuple(values), distance)
    if key not in _CACHE:
        _CACHE[key] = brute_components(values, distance)
    return _CACHE[key]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 5000), (-5, 6000)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 5000: 0, **{1000 + i: 1000 for i in range(300)}, -5: -5, 6000: -5}


def test_native_hash_is_the_same(spark):
    text = "über straße 日本 four"
    native = spark.range(1).select(F.xxhash64(F.lit(text))).first()[0]
    assert native & (2**64 - 1) == xxhash.xxh64_intdigest(text.encode(), 42)
