"""Token counts (operator 2): a prefix dynamic program over byte-level BPE.

A byte-pair encoding of a string is the only sequence of tokens in which every
two neighbours stay apart when the two are encoded together.  So the encoding
of every prefix follows from shorter ones: prefix i ends in the one token t
whose predecessor, the last token of prefix i - len(t), stays apart from t,
and count(i) = count(i - len(t)) + 1.  One pass over a piece of text gives the
exact count at all its prefixes.

The tokenizer first cuts a text into pieces (words with their leading blank,
numbers, punctuation, white space).  Pieces repeat, so each Python worker
memoises the table of a piece; a text's table is the concatenation of its
pieces' tables.  Three cuts change the pieces of a truncated text and are
corrected: after a run of white space, inside a contraction, and inside a
special token.  ``prefix_steps`` stores, for every character, by how much the
count changes (two bytes each), so any truncation or budget question is a
cumulative sum over stored numbers, without encoding again.

Defined results.  A null text is empty: no tokens, no steps.  Special strings
in a text count as one token, as in the library's default.  Repeated rows and
null doc_ids give a row each.
"""

from __future__ import annotations

import json
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import sub

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwarn.llm.common import documents

#: Memoised pieces a worker holds at most; the memo starts anew beyond.
MEMO_PIECES = 1_000_000
#: Beginnings of this many bytes are memoised too.
HEAD_BYTES = 6
#: Longer pieces are computed each time.
MEMO_CHARS = 48
TOKENIZER = "byte_bpe_50k.json"
_CONTRACTIONS = ("'re", "'ve", "'ll")


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _byte_alphabet() -> dict[str, int]:
    """Character of a byte-level vocabulary -> byte: visible Latin-1 as is, the others from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PrefixTable(dict):
    """piece -> int16 steps (as bytes) of the token count at each of its characters."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if (model["type"], pre["type"], spec["normalizer"]) != ("BPE", "ByteLevel", None) \
                or not pre.get("use_regex", True) or pre["add_prefix_space"]:
            raise ValueError(f"{path}: not a plain byte-level BPE tokenizer")
        import public_tokenizers
        alphabet = _byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.token = [b"", *(raw(t) for t in model["vocab"] if t not in set(self.specials))]
        self.number = {t: i for i, t in enumerate(self.token) if i}
        self.longest = max(map(len, self.token))
        self.rank = {}
        for i, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[raw(left), raw(right)] = i
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        self.blanks = regex.compile(r"\s{2,}(?=\S)").finditer
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.apart: dict[int, bool] = {}
        self.heads: dict[bytes, tuple[list[int], list[int]]] = {}

    def merge(self, raw: bytes) -> list[bytes]:
        """Plain encoding of a short string: the earliest merge first."""
        parts = [raw[i:i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            ranks = [self.rank.get(p, len(self.rank)) for p in zip(parts, parts[1:])]
            best = min(ranks)
            if best == len(self.rank):
                break
            k = ranks.index(best)
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether two tokens (0: none) remain these two when encoded together; remembered."""
        if len(self.apart) > 2_000_000:
            self.apart.clear()
        pair = [self.token[left], self.token[right]] if left else [self.token[right]]
        known = self.apart[left << 20 | right] = self.merge(b"".join(pair)) == pair
        return known

    def counts(self, raw: bytes) -> list[int]:
        """Token count at every byte prefix of a piece, by the dynamic program."""
        return self._program(raw)[1]

    def _program(self, raw: bytes) -> tuple[list[int], list[int]]:
        """Last token and token count of every prefix; many pieces begin alike, so beginnings are remembered."""
        last, count = [0], [0]
        if len(raw) > HEAD_BYTES:
            head = raw[:HEAD_BYTES]
            known = self.heads.get(head)
            if known is None:
                if len(self.heads) > MEMO_PIECES // 4:
                    self.heads.clear()
                known = self.heads[head] = self._program(head)
            last, count = known[0][:], known[1][:]
        number, apart, longest = self.number.get, self.apart.get, self.longest
        for i in range(len(count), len(raw) + 1):
            for j in range(i - 1, i - longest - 1 if i > longest else -1, -1):
                token = number(raw[j:i])
                if token is not None:
                    known = apart(last[j] << 20 | token)
                    if known or known is None and self.stay_apart(last[j], token):
                        last.append(token)
                        count.append(count[j] + 1)
                        break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return last, count

    def steps(self, piece: str) -> bytes:
        raw = piece.encode()
        count = self.counts(raw)
        if len(raw) > len(piece):
            count = [0] + [c for i, c in enumerate(count[1:], 1) if i == len(raw) or raw[i] & 0xC0 != 0x80]
        if piece in _CONTRACTIONS:  # cut after two characters it is an apostrophe and a letter
            count[2] = 2
        found = array("h", map(sub, count[1:], count))
        if sys.byteorder == "big":
            found.byteswap()
        return found.tobytes()

    def __missing__(self, piece: str) -> bytes:
        found = self.steps(piece)
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = found
        return found

    def total(self, piece: str) -> int:
        return int(np.frombuffer(self[piece], "<i2").sum())

    def _plain(self, text: str) -> np.ndarray:
        steps = np.frombuffer(b"".join(map(self.__getitem__, self.pieces(text))), "<i2").astype(np.int32)
        for m in self.blanks(text):
            a, b = m.span()  # the last blank joins the next piece, but not where the text ends there
            change = self.total(text[a:b]) - self.total(text[a:b - 1]) - self.total(text[b - 1])
            steps[b - 1] += change
            steps[b] -= change
        return steps

    def text_steps(self, text: str) -> np.ndarray:
        """By how much the exact token count changes at every character of a text."""
        found = list(self.special.finditer(text)) if self.special and "<" in text else []
        if not found:
            return self._plain(text)
        parts, at = [], 0
        for m in found:
            plain = text[at:m.start()]
            parts.append(self._plain(plain))
            tail = (self.pieces(plain) or [""])[-1]
            before = self.total(tail) if tail else 0
            inside = [sum(map(self.total, self.pieces(tail + m[0][:k]))) - before for k in range(1, len(m[0]))]
            parts.append(np.diff(np.array([0, *inside, 1])))
            at = m.end()
        return np.concatenate([*parts, self._plain(text[at:])])


@lru_cache(maxsize=2)
def prefix_table(path: str) -> PrefixTable:
    return PrefixTable(path)


def longest_within(steps: np.ndarray, limit: int) -> int:
    """Characters of the longest prefix that has at most ``limit`` tokens."""
    counts = np.cumsum(steps)
    fits = np.flatnonzero(counts <= limit)
    return int(fits[-1]) + 1 if len(fits) else 0


def token_counts(docs: DataFrame, limit: int = 512, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, limit_chars and prefix_steps of every whole text.

    ``prefix_steps`` holds two little-endian bytes a character; their running
    sum is the exact count at every prefix.  ``limit_chars`` is the length of
    the longest prefix within ``limit`` tokens.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefix_table(tokenizer_path(tokenizer))
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                rows = [(len(t.encode()), table.text_steps(t)) for t in batch.column("text").to_pylist()]
                totals = [int(s.sum()) for _, s in rows]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), pa.array([n for n, _ in rows], pa.int64()), pa.array(totals, pa.int64()),
                    pa.array([t > limit for t in totals], pa.bool_()),
                    pa.array([longest_within(s, limit) for _, s in rows], pa.int64()),
                    pa.array([s.astype("<i2").tobytes() for _, s in rows], pa.binary()),
                ], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "limit_chars", "prefix_steps"])

    rows = documents(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, "
                                "limit_chars long, prefix_steps binary")
