import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from conftest_llm import rows
from panelwarn.llm import tokens


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.tokenizer_path(tokens.TOKENIZER))


@pytest.fixture(scope="module")
def table():
    return tokens.prefix_table(tokens.tokenizer_path(tokens.TOKENIZER))


def brute(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def random_text(rng):
    parts = ["the", " and", "'re", "'ll", "'", " ", "  ", "\n", "\t", "　", "\xa0", "12", "é", "ß", "日本", "😀", "!", "...",
             "<|endoftext|>", "<|end", "aaaaaaaa", " Atouou", "ing", "A", "é", "​", "'s", "x'd", "_"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))


def test_every_prefix_exact(library, table):
    rng = random.Random(5)
    for _ in range(250):
        text = random_text(rng)
        got = np.cumsum(table.text_steps(text)).tolist()
        assert got == [brute(library, text[:k]) for k in range(1, len(text) + 1)], repr(text)


def test_whole_documents(library, small_docs):
    got = dict(rows(tokens.token_counts(small_docs), "doc_id", "n_tokens"))
    assert got == {r["doc_id"]: brute(library, r["text"] or "") for r in small_docs.collect()}


def test_limit_answers(library, small_docs):
    texts = {r["doc_id"]: r["text"] for r in small_docs.limit(40).collect()}
    for r in tokens.token_counts(small_docs.limit(40), limit=64).collect():
        text, k = texts[r["doc_id"]], r["limit_chars"]
        assert brute(library, text[:k]) <= 64
        assert all(brute(library, text[:j]) > 64 for j in range(k + 1, min(k + 6, len(text)) + 1))
        assert r["over_limit"] == (brute(library, text) > 64)


def test_memo_starts_anew(library, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_PIECES", 3)
    t = tokens.PrefixTable(tokens.tokenizer_path(tokens.TOKENIZER))
    text = "one two three four five six seven one two"
    assert t.text_steps(text).sum() == brute(library, text)
    assert len(t) <= 3


def test_odd(library, odd_docs, clashing_docs, empty_docs):
    want = sorted((len((r["text"] or "").encode()), brute(library, r["text"] or "")) for r in odd_docs.collect())
    for docs in (odd_docs, clashing_docs):
        assert rows(tokens.token_counts(docs), "n_bytes", "n_tokens") == want
    assert tokens.token_counts(empty_docs).count() == 0
