import hashlib
import random
from collections import Counter

import numpy as np

from conftest_llm import rows
from panelwarn.llm import suffix


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text, windows counted one by one."""
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


COLUMNS = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]


def check(docs, length=400, **options):
    got = suffix.remove_repeats(docs, length=length, **options)
    want = brute([(r["text"] or "").encode() for r in docs.collect()], length)
    assert rows(got, *COLUMNS) == sorted(want)


def test_whole_documents(small_docs):
    check(small_docs)


def made(spark, seed, n=60):
    """Texts over few letters with shared passages, runs and periods."""
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice("abé ") for _ in range(k))
    passages = [word(rng.randint(20, 90)) for _ in range(6)] + ["x" * 150, "ab" * 90, "abc " * 50]
    texts = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 3)
            parts.append(rng.choice([word(rng.randint(0, 40)), p, p[a:], p[:len(p) - a]]))
        texts.append((rng.choice([i, None, 5]), "".join(parts) if rng.random() < 0.95 else None))
    return spark.createDataFrame(texts + texts[:3], "doc_id long, text string").repartition(4).cache()


def test_made_texts(spark):
    for seed, options in ((1, {}), (2, {"batches": 7}), (3, {"group_rows": 5, "batches": 1})):
        check(made(spark, seed), length=30, gram=12, **options)


def test_levels_stay_logarithmic(spark):
    family = suffix.SuffixFamily()
    found = []
    for i in range(6):
        df = spark.createDataFrame([(k,) for k in (i, i, 100 + i // 2, 7)], "key long")
        found.append(sorted(r["key"] for r in family.add(df).collect()))
        assert [n for n, _, _ in family.levels] == [1 << b for b in range(5, -1, -1) if i + 1 >> b & 1]
    assert found == [[0], [1, 7, 100], [2, 7], [3, 7, 101], [4, 7], [5, 7, 102]]


def test_equal_windows_share_a_sample():
    rng = random.Random(9)
    for _ in range(60):
        shared = bytes(rng.choice(b"ab") for _ in range(50))
        texts = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 70))) + shared + b"zz" * rng.randint(0, 20)
                 for _ in range(2)]
        marks = []
        for t in texts:
            keys, places = suffix.sampled_suffixes(t, 50, 16)
            p = t.index(shared)
            marks.append({(k, a - p) for k, a in zip(keys.tolist(), places.tolist()) if p <= a <= p + 34})
        assert marks[0] & marks[1]


def test_odd(odd_docs, clashing_docs, empty_docs):
    check(odd_docs)
    assert rows(suffix.remove_repeats(clashing_docs), *COLUMNS) == rows(suffix.remove_repeats(odd_docs), *COLUMNS)
    assert suffix.remove_repeats(empty_docs).count() == 0


def check_passages(docs, words, **options):
    got = suffix.remove_repeats(docs, words=words, **options)
    split = [(r["doc_id"], (r["text"] or "").encode().split()) for r in docs.collect()]
    windows = [{tuple(w[i:i + words]) for i in range(len(w) - words + 1)} for _, w in split]
    seen = Counter(x for s in windows for x in s)
    want = [(str(d), any(seen[x] > 1 for x in s)) for (d, _), s in zip(split, windows)]
    assert sorted((str(r["doc_id"]), r["repeats_passage"]) for r in got.collect()) == sorted(want)
    return [flag for _, flag in want]


def test_passages_below_the_length(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 6)))
    prose = lambda n: [word() for _ in range(n)]
    shared, short = prose(51), prose(50)
    texts = [prose(30) + shared + prose(40), prose(3) + shared, prose(70) + short + prose(9), short + prose(20), prose(200),
             prose(10) * 12]
    docs = spark.createDataFrame([*((i, " ".join(t)) for i, t in enumerate(texts)), (9, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in suffix.remove_repeats(docs).collect()}
    assert len(" ".join(shared).encode()) < 400 and got[0]["n_removed"] == got[1]["n_removed"] == 0
    assert {i for i in got if got[i]["repeats_passage"]} == {0, 1}


def test_passages_of_made_texts(spark):
    for seed, words, gram in ((5, 7, 2), (6, 12, 4), (7, 5, 5)):
        rng = random.Random(seed)
        prose = lambda n: [rng.choice(["a", "bé", "cc", "d", "e,"]) + str(rng.randint(0, 9)) for _ in range(n)]
        passages = [prose(rng.randint(words - 1, 3 * words)) for _ in range(8)]
        texts = []
        for i in range(80):
            parts = [rng.choice([prose(rng.randint(0, 20)), rng.choice(passages)[rng.randint(0, 2):], ["x"] * rng.randint(0, 9)])
                     for _ in range(rng.randint(0, 3))]
            texts.append((rng.choice([i, None, 5]), rng.choice([" ", "\n ", "\t"]).join(x for p in parts for x in p)))
        texts += [(100, None), (101, " \n"), (102, "y " * 5 * words), (103, "z " * 400), (104, "z " * 300), *texts[:2]]
        flags = check_passages(spark.createDataFrame(texts, "doc_id long, text string").repartition(3).cache(), words, word_gram=gram)
        assert 10 < sum(flags) < len(flags) - 10


def test_words_above_a_piece(monkeypatch):
    rng = random.Random(8)
    text = b" ".join(bytes(rng.choice(b"abc") for _ in range(rng.choice([1, 3, 9, 60]))) for _ in range(500))
    whole = suffix._word_hashes(text)
    split = text.split()
    assert len(whole) == len(split) and len(set(whole.tolist())) == len(set(split))
    monkeypatch.setattr(suffix, "_PIECE", 40)
    pieces = suffix._word_hashes(text)
    assert len(set(pieces.tolist())) == len(set(split))
    assert all(a == b for a, b, w in zip(whole, pieces, split) if len(w) <= 40)
    monkeypatch.undo()
    parted = b"\n\x0b" + text.replace(b" ", b" \r\n") + b"\t"
    assert (suffix._word_hashes(parted) == whole).all()
