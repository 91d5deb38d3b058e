import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from conftest_llm import rows
from panelwarn.llm import packing
from panelwarn.llm.tokens import TOKENIZER, tokenizer_path


def unroll(counts, capacity):
    """Every piece's place from the plan's runs, checked for overlap and gaps."""
    runs, n = packing.plan_runs(counts, capacity)
    bins = defaultdict(list)
    ranks = defaultdict(set)
    for size, rank0, k, first, each, offset in runs:
        for r in range(k):
            bins[first + r // each].append((offset + r % each * size, size))
            ranks[size].add(rank0 + r)
    assert {s: len(x) for s, x in ranks.items()} == {s: c for s, c in counts.items() if c}
    assert all(x == set(range(len(x))) for x in ranks.values())
    for b in bins.values():
        at = 0
        for offset, size in sorted(b):
            assert offset == at
            at += size
        assert at <= capacity
    assert sorted(bins) == list(range(n))
    assert all(sum(3 * s > capacity for _, s in b) <= 2 for b in bins.values())
    return n


def item_by_item(counts, capacity):
    """The same rule on single pieces."""
    items = sorted((k for k, n in counts.items() for _ in range(n)), reverse=True)
    large, gaps = [k for k in items if 3 * k > capacity], []
    while large:
        x = large.pop(0)
        partner = next((y for y in large if x + y <= capacity), 0)
        if partner:
            large.remove(partner)
        gaps.append(capacity - x - partner)
    for k in items:
        if 3 * k <= capacity:
            fit = min((g for g in gaps if g >= k), default=None)
            if fit is None:
                gaps.append(fit := capacity)
            gaps.remove(fit)
            gaps.append(fit - k)
    return len(gaps)


def test_plans():
    rng = random.Random(3)
    for _ in range(300):
        capacity = rng.randint(4, 60)
        counts = {rng.randint(1, capacity): rng.randint(0, 30) for _ in range(rng.randint(1, 15))}
        assert unroll(counts, capacity) == item_by_item(counts, capacity)
    assert packing.plan_runs({}, 8) == ([], 0)
    assert unroll({8: 3}, 8) == 3
    assert unroll({5: 3, 3: 3}, 8) == 3
    assert unroll({4: 5}, 8) == 3


def check(docs, capacity=2048):
    library = Tokenizer.from_file(tokenizer_path(TOKENIZER))
    want = defaultdict(list)
    for r in docs.collect():
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        want[r["doc_id"]].append(ids)
    got = [r.asDict() for r in packing.pack_documents(docs, capacity).collect()]
    sequences, seen = defaultdict(list), defaultdict(int)
    for r in got:
        assert any(zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
                   for ids in want[r["doc_id"]])
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        seen[r["doc_id"]] += r["length"]
        assert r["piece"] == 0 or r["length"] == capacity
    assert dict(seen) == {d: sum(map(len, x)) for d, x in want.items()}
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(seen.values())


def test_whole_documents(small_docs):
    n, total = check(small_docs)
    assert n <= -(-total // 2048) * 1.02 + 1


def test_odd(odd_docs, clashing_docs, empty_docs):
    check(odd_docs)
    check(odd_docs, capacity=16)
    docs = clashing_docs
    assert rows(packing.pack_documents(docs), "length", "ids_crc32") == \
        rows(packing.pack_documents(odd_docs), "length", "ids_crc32")
    assert packing.pack_documents(empty_docs).count() == 0


def test_encoders_agree_on_every_character():
    e = packing.Encoder(TOKENIZER)
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(chars), 60_000):
        for pattern in ("a{}b", "1{} ", " {}!"):
            text = "".join(pattern.format(c) for c in chars[i:i + 20_000])
            assert e.ids(text).tolist() == e.library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", "a <|endoftext|> b", "\n" * 5000, "x" * 20000, " " * 3000 + "y"])
def test_encoders_agree(text):
    e = packing.Encoder(TOKENIZER)
    assert e.ids(text).tolist() == e.library.encode(text, add_special_tokens=False).ids
