import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from conftest_llm import rows
from panelwarn.llm import alignment
from panelwarn.llm.tokens import _byte_alphabet, tokenizer_path

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def encoders():
    a = Tokenizer.from_file(tokenizer_path(alignment.TOKENIZER))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(alignment.PIECES))


def brute(texts, encoders):
    """Rows by plain loops over the tokens."""
    a_enc, b_enc = encoders
    alphabet = _byte_alphabet()

    def b_raw(i):
        piece = b_enc.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_enc.is_byte(i) else piece.replace("▁", " ").encode()

    docs, held = [], Counter()
    for text in texts:
        groups = []
        if text:
            raw = b" " + text.encode()
            a = a_enc.encode(" " + text, add_special_tokens=False).ids
            b = b_enc.encode(text)
            a_tok = [bytes(alphabet[c] for c in a_enc.id_to_token(i)) for i in a]
            b_tok = [b_raw(i) for i in b]
            if b"".join(a_tok) == raw and b"".join(b_tok) == raw:
                a_end, b_end = np.cumsum([len(x) for x in a_tok]), np.cumsum([len(x) for x in b_tok])
                cuts = sorted(set(a_end.tolist()) & set(b_end.tolist()))
                groups = [([], []) for _ in cuts]
                for ids, ends, side in ((a, a_end, 0), (b, b_end, 1)):
                    for i, e in zip(ids, ends.tolist()):
                        groups[bisect_left(cuts, e)][side].append(i)
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        held.update(links.keys())
        docs.append((groups, links))
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for groups, links in docs:
        said = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(links.values()),
                    sum(m for p, m in links.items() if held[p] == top[p[0]]), sum(m * held[p] for p, m in links.items()),
                    hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return out


def check(docs, encoders):
    data = docs.select("doc_id", "text").collect()
    want = [(r["doc_id"], *b) for r, b in zip(data, brute([r["text"] or "" for r in data], encoders))]
    got = rows(alignment.alignments(docs), *COLUMNS)
    assert got == sorted(want, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def test_odd_rows(odd_docs, encoders):
    check(odd_docs, encoders)


def test_rare_pairs_by_a_join(odd_docs, encoders, monkeypatch):
    monkeypatch.setattr(alignment, "HOT_PAIRS", 5)
    monkeypatch.setattr(alignment, "LINK_ROWS", 7)
    monkeypatch.setattr(alignment, "PARTIAL_PAIRS", 3)
    check(odd_docs, encoders)


def test_whole_documents(small_docs, encoders):
    check(small_docs, encoders)


def test_clashing_columns_and_empty_table(clashing_docs, odd_docs, empty_docs):
    assert rows(alignment.alignments(clashing_docs), *COLUMNS) == rows(alignment.alignments(odd_docs), *COLUMNS)
    assert alignment.alignments(empty_docs).count() == 0


def test_special_strings_and_text_without_blanks(encoders):
    kit = alignment.tokenizers(alignment.TOKENIZER, alignment.PIECES)
    texts = ["<|endoftext|> <s> </s> <0x41>", "1234567890" * 3000, "日本語" * 500, "\x00\x7f", "▁ ▁a", " ", "a  b", "é́",
             "word " * 50_000]
    made = alignment.align_block(texts, kit)
    want = brute(texts, encoders)
    for i, w in enumerate(want):
        got = tuple(int(np.asarray(made[c])[i]) for c in ("n_a", "n_b", "n_groups", "n_links")) + (made["groups_sha256"][i],)
        assert got == (*w[:4], w[6]), repr(texts[i][:20])
    assert isinstance(made["pairs"], pa.ListArray)
