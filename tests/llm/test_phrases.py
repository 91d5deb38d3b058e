import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from conftest_llm import rows
from panelwarn.llm import phrases

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text))]


def brute(data, min_count, top):
    f, n = Counter(), Counter()
    for lang, text in data:
        for words in pieces(text):
            n[lang or "und"] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang or "und", tuple(words[i:i + k])] += 1
    n = {x: c for x, c in n.items() if c}
    found = {p: a for p, a in f.items() if a >= min_count and len(p[1]) > 1}
    swallowed = set()
    for (lang, p), b in found.items():
        for m in range(2, len(p)):
            for s in range(len(p) - m + 1):
                if 100 * b >= 80 * f[lang, p[s:s + m]]:
                    swallowed.add((lang, p[s:s + m]))
    out = []
    for lang in n:
        scored = []
        for (x, p), a in found.items():
            if x != lang or (x, p) in swallowed:
                continue
            score, _, left, right = min((2_000_000 * a // (f[x, p[:c]] + f[x, p[c:]]), c, f[x, p[:c]], f[x, p[c:]])
                                        for c in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        for i, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, i, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def check(docs, min_count, top=2000):
    data = [(r["lang"], r["text"]) for r in docs.select("lang", "text").collect()]
    want = brute(data, min_count, top)
    assert rows(phrases.collocations(docs, min_count, top=top), *COLUMNS) == want
    return want


def test_whole_documents(small_docs):
    assert len(check(small_docs, 30)) > 30


def test_odd_rows_and_a_short_list(odd_docs):
    assert len(check(odd_docs, 2, top=3)) > 3


def test_many_shards_and_blocks(small_docs, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_BYTES", 60_000)
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 5_000)
    monkeypatch.setattr(phrases, "GATHERED", 4_000)
    check(small_docs, 30, top=50)


def test_texts_are_read_as_often_with_many_shards(small_docs, monkeypatch, tmp_path):
    plain = phrases._texts

    def noted(docs):
        out = str(tmp_path / "read")

        def run(batches):
            for batch in batches:
                with open(out, "ab") as f:
                    f.write(b"." * batch.num_rows)
                yield batch

        return plain(docs).mapInArrow(run, "lang string, raw binary")

    monkeypatch.setattr(phrases, "_texts", noted)
    read = []
    for shard_bytes in (4_000_000, 10_000):
        monkeypatch.setattr(phrases, "SHARD_BYTES", shard_bytes)
        check(small_docs, 4, top=50)
        read.append((tmp_path / "read").stat().st_size - sum(read))
    assert read[0] == read[1] > 0


def test_shards_between_phrases_that_begin_alike(spark, monkeypatch):
    # in byte order "of the\x01 z" stands between "of the" and "of the cat"
    texts = ["of the", "of the\x01 z", "of the cat sat", "of thea x", "of the cat", "of", "the cat sat up of the", "über of the"]
    docs = spark.createDataFrame([(t, lang) for lang in ("en", "e n", "a\nb", None) for i, t in enumerate(texts * 2)
                                  for _ in range(i % 3 + 1)], "text string, lang string")
    for shard_bytes, min_count in ((1, 2), (1, 7), (40, 5)):
        monkeypatch.setattr(phrases, "SHARD_BYTES", shard_bytes)
        assert len(check(docs, min_count)) > 8


def test_shards_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_BYTES", 50)
    keys = sorted(f"en\n{'x' * (i % 90)} {i}" for i in range(300))
    table = pa.table({"key": keys, "n": range(300)})
    shards = list(phrases._shards(iter(table.to_batches(max_chunksize=7))))
    assert pa.concat_tables(shards).to_pydict() == table.to_pydict()
    assert all(s.num_rows == 1 or sum(map(len, s["key"].to_pylist())) <= 50 for s in shards)
    assert len(shards) < 290


def test_clashing_columns_and_empty_table(clashing_docs, odd_docs, empty_docs):
    assert rows(phrases.collocations(clashing_docs, 2), *COLUMNS) == rows(phrases.collocations(odd_docs, 2), *COLUMNS)
    assert phrases.collocations(empty_docs).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_trie_holds_its_keys_and_no_others(seed):
    rng = random.Random(seed)
    made = {bytes(rng.choice(b"ab\xc3\xff c") for _ in range(rng.randint(1, 9))) for _ in range(400)}
    made |= {b"z" * 300, bytes(range(255, 0, -1))} | {bytes([i]) for i in range(1, 256)}
    keys = sorted(made)
    trie = phrases.Trie(keys)
    for i, key in enumerate(keys):
        assert trie.accept[trie.begin(key)] == i
        other = key + bytes([rng.randint(1, 255)])
        state = trie.begin(other)
        assert (state >= 0 and trie.accept[state] >= 0) == (other in made)


def test_words_and_hashes_of_a_block():
    texts = ["One, two\tthree  four\nfive", "", "five", None, "É x! y z", "\n", "two  Three"]
    block = phrases.Block(pa.array(["a", "a", "b", "a", "b", "a", "a"]), pa.array([(t or "").encode() for t in texts], pa.binary()))
    assert [w.as_py().decode() for w in block.words()] == [w for t in texts for p in pieces(t) for w in p]
    want = [i + 1 < len(p) for t in texts for p in pieces(t) for i in range(len(p))]
    assert block.follows.tolist() == want
    h = block.hashes()
    words = [w.as_py() for w in block.words()]
    same = {(w, block.langs[x]) for w, x in zip(words, block.lang)}
    assert len(set(h.tolist())) == len(same)
    assert np.array_equal(block.size, [len(w) for w in words])


def test_bucket_counts_travel_packed():
    rng = np.random.default_rng(4)
    for min_count in (1, 30, 300, 70_000):
        drawn = [np.concatenate([rng.integers(0, 300_000, 4_000), np.full(200, 65_535), np.full(200, 65_536)]) for _ in range(3)]
        packed = [phrases._range_counts(b, min_count) for b in drawn]
        assert max(b.num_rows for b in packed) <= 300_000 // phrases.RANGE_BUCKETS + 1
        table = pa.Table.from_batches(packed).sort_by("range")
        marks = np.zeros(5 * phrases.RANGE_BUCKETS // 8, np.uint8)
        for part in phrases._range_marks(iter(table.to_batches(max_chunksize=2)), min_count):
            begin = part["range"][0].as_py() * phrases.RANGE_BUCKETS // 8
            marks[begin:begin + phrases.RANGE_BUCKETS // 8] = np.frombuffer(zlib.decompress(part["marks"][0].as_py()), np.uint8)
        want = Counter(np.concatenate(drawn).tolist())
        got = np.flatnonzero(np.unpackbits(marks, bitorder="little")).tolist()
        assert got == sorted(b for b, n in want.items() if n >= min_count)
