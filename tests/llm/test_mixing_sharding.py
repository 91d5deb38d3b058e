import zlib
from collections import Counter, defaultdict

from conftest_llm import rows
from panelwarn.llm import mixing, sharding


def highest_quotients(votes, seats, limits):
    got = [0] * len(votes)
    for _ in range(min(seats, sum(n for n, v in zip(limits, votes) if v > 0))):
        _, i = max((v / (2 * k + 1), -i) for i, (v, k, n) in enumerate(zip(votes, got, limits)) if k < n and v > 0)
        got[-i] += 1
    return got


def test_apportion():
    import random
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 7)
        votes = [float(rng.choice([0, 1, 1, 2, 5, 10, 33, 100])) for _ in range(n)]
        limits = [rng.randint(0, 30) for _ in range(n)]
        seats = rng.randint(0, 90)
        assert mixing.apportion(votes, seats, limits) == highest_quotients(votes, seats, limits)


def test_targets():
    t = mixing.source_targets([100, 10, 50, 0], [5, 2, 1, 5])
    assert abs(sum(t) - 240) < 1e-9 and t[1] == 20 and t[3] == 0
    assert all(a <= 2 * s + 1e-9 for a, s in zip(t, [100, 10, 50, 0]))


def check(docs, near):
    out = mixing.mix_sizes(docs).collect()
    texts = {(r["doc_id"], len((r["text"] or "").encode().split())): r["source"] for r in docs.collect()}
    per, size, target = Counter(), {}, {}
    for r in out:
        s = texts[r["doc_id"], r["size"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        per[s] += r["taken"]
        size[s], target[s] = r["source_size"], r["target"]
    total = sum(len((r["text"] or "").encode().split()) for r in docs.collect())
    assert sum(size.values()) == total
    for s in size:
        assert abs(per[s] - target[s]) <= near, s
    again = mixing.mix_sizes(docs)
    assert rows(again, "doc_id", "size", "taken") == sorted(
        ((r["doc_id"], r["size"], r["taken"]) for r in out), key=lambda r: tuple((x is None, str(type(x)), x or 0) for x in r))
    mixed = mixing.mix_documents(docs)
    assert mixed.schema == docs.schema
    words = Counter()
    for r in mixed.collect():
        words[r["doc_id"]] += len(r["text"].encode().split())
        assert r["n_chars"] == len(r["text"])
    taken = Counter()
    for r in out:
        taken[r["doc_id"]] += r["taken"]
    assert +words == +taken
    return out


def test_mix_documents(small_docs):
    check(small_docs, 130)


def test_mix_odd(odd_docs, clashing_docs, empty_docs):
    check(odd_docs, 130)
    assert rows(mixing.mix_sizes(clashing_docs), "size", "taken") == rows(mixing.mix_sizes(odd_docs), "size", "taken")
    assert mixing.mix_documents(clashing_docs).columns == clashing_docs.columns
    assert mixing.mix_documents(clashing_docs).count() == mixing.mix_documents(odd_docs).count()
    assert mixing.mix_sizes(empty_docs).count() == 0
    assert mixing.mix_documents(empty_docs).count() == 0


def check_shards(docs, n):
    got = sharding.shard_documents(docs, n).collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode()))
                   for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots, mixture = defaultdict(set), defaultdict(Counter)
    for r in got:
        slots[r["shard"]].add(r["slot"])
        mixture[r["source"]][r["shard"]] += 1
    sizes = [len(slots[s]) for s in range(n)]
    assert sum(sizes) == len(got) and max(sizes) - min(sizes) <= 1
    assert all(x == set(range(len(x))) for x in slots.values())
    for c in mixture.values():
        per = [c[s] for s in range(n)]
        assert max(per) - min(per) <= 2  # floor or ceiling of the even share, seen from either end


def test_shards(small_docs, odd_docs, clashing_docs, empty_docs):
    check_shards(small_docs, 24)
    check_shards(odd_docs, 3)
    assert rows(sharding.shard_documents(clashing_docs, 3), "size", "shard", "slot") == \
        rows(sharding.shard_documents(odd_docs, 3), "size", "shard", "slot")
    assert sharding.shard_documents(empty_docs, 24).count() == 0


def test_full_sources_meet_their_targets_to_the_word():
    """A source whose target is twice its size is taken twice, whatever its last block holds."""
    sources = [("a", 28), ("b", 369), ("c", 100_000), ("d", 17), (None, 5)]
    plan = mixing.mix_plan(sources, 16, 4, 1)
    for name, size in sources:
        p = plan[name]
        if p["target"] == 2 * size:
            assert p["whole"] == 2 and not any(p["chosen"])
        else:
            assert abs(p["whole"] * size + 16 * sum(p["chosen"]) - p["target"]) <= 16
    assert sum(p["target"] == 2 * p["size"] for p in plan.values()) == 4
