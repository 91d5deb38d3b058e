"""Cross-tokenizer alignment (operator 13): Arrow columns from the ids to the links.

Both tokenizers encode the same bytes (blank + text).  In a block of documents
the two lists of ids are flattened with their parent indices, token lengths
are summed cumulatively within each document, and an Acero hash join on
(document, end) finds the byte offsets where tokens of both sides end.  A
cumulative sum over these marks numbers the groups alike on both sides, and a
second Acero join on the group gives the links, counted by
``Table.group_by`` per document and id pair.

The corpus-wide count of an id pair is the number of documents that hold it:
each task adds up its blocks' pairs with ``Table.group_by`` and Spark merges
these partial counts.  The ``HOT_PAIRS`` commonest pairs, nearly all
occurrences, go back to the documents as a broadcast of bounded size; the rarer
ones by a shuffle join, where no key is hot.  A pair's highest count by A id
has one row for each entry of A's vocabulary.

Defined results.  Null and empty texts, and texts whose joined token bytes on
either side are not blank + text, have no tokens: zeros and ''.  Repeated rows
and null doc_ids are documents of their own, each with its row.  Ties for an A
id's highest count all count as best.  Long texts are encoded whole; links are
made in runs of at most ``LINK_ROWS`` rows, whatever a group holds.  An empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwarn.llm.common import documents, saved
from panelwarn.llm.tokens import TOKENIZER, _byte_alphabet, tokenizer_path

PIECES = "piece_bpe_32k.model"
#: Texts above this many characters are encoded by the tokenizers library itself (the same ids).
LONG_TEXT = 200_000
#: Documents and characters of a block; one longer text is a block of its own.
BLOCK_DOCS = 512
BLOCK_CHARS = 2_000_000
#: Links made at once.
LINK_ROWS = 2_000_000
#: Commonest pairs that are broadcast: 17 bytes each, 18 MB.
HOT_PAIRS = 1 << 20
#: Distinct pairs a task adds up before it sends them on.
PARTIAL_PAIRS = 1 << 20


class Tokenizers:
    """The two encoders, the bytes of their tokens and the decimal spelling of their ids."""

    def __init__(self, a_name: str, b_name: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(tokenizer_path(a_name))
        self.library.encode_special_tokens = True
        self.fast = None
        if a_name == TOKENIZER:
            with open(tokenizer_path(a_name.replace(".json", ".tiktoken")), "rb") as f:
                ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN,
                                          mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(b_name))
        with open(tokenizer_path(a_name), encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        entries = {i: t for t, i in spec["model"]["vocab"].items()}
        entries |= {t["id"]: t["content"] for t in spec["added_tokens"]}
        raw = [bytes(alphabet[c] for c in entries.get(i, "")) for i in range(max(entries) + 1)]
        self.a_bytes = pa.array(raw, pa.large_binary())
        p = self.pieces
        self.b_bytes = pa.array([bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i)
                                 else p.id_to_piece(i).replace("▁", " ").encode()
                                 for i in range(p.vocab_size())], pa.large_binary())
        self.b_size = len(self.b_bytes)
        most = max(len(raw), self.b_size)
        #: "id," "id|" "id;" at 3 * id + 0, 1, 2
        self.spelt = pa.array([f"{i}{s}" for i in range(most) for s in ",|;"], pa.large_string())

    def encode_a(self, text: str) -> np.ndarray:
        if self.fast is not None and len(text) <= LONG_TEXT:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)


@lru_cache(maxsize=2)
def tokenizers(a_name: str, b_name: str) -> Tokenizers:
    return Tokenizers(a_name, b_name)


def _lists(ids: list[np.ndarray]) -> pa.LargeListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))


def _spells(ids: pa.LargeListArray, token: pa.Array, raw: list[bytes]) -> list[bool]:
    """Whether each list's joined token bytes are the document's."""
    joined = pc.take(token, pc.list_flatten(ids))
    ends = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1, joined.offset * 8)
    data = memoryview(joined.buffers()[2] or b"").cast("B")
    cuts = ends[ids.offsets.to_numpy()].tolist()
    return [data[a:b] == r for a, b, r in zip(cuts, cuts[1:], raw)]


def _ends(ids: pa.LargeListArray, token: pa.Array) -> pa.Table:
    """doc and end (byte offset after the token, within its document) of every token, in order."""
    flat, doc = pc.list_flatten(ids), pc.list_parent_indices(ids)
    length = pc.cast(pc.take(pc.binary_length(token), flat), pa.int64())
    total = pc.cumulative_sum(length)
    before = pc.subtract(total, length)
    begin = pc.take(before, pc.take(ids.offsets, doc))  # a document with tokens: the sum before its first
    return pa.table({"doc": doc, "end": pc.subtract(total, begin),
                     "at": pa.array(np.arange(len(flat), dtype=np.int64))})


def _groups(common: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Mark of the tokens that end a group, and the group of every token."""
    mark = np.zeros(n, np.int64)
    mark[common] = 1
    total = pc.cumulative_sum(pa.array(mark)).to_numpy()
    return mark, total - mark


def _links(doc: np.ndarray, a_group: np.ndarray, a_id: np.ndarray, b_group: np.ndarray, b_id: np.ndarray,
           b_count: np.ndarray, b_size: int) -> pa.Table:
    """doc, pair and links (occurrences) of every id pair that shares a group, by document."""
    done = np.cumsum(b_count[a_group])
    parts, at = [], 0
    while at < len(a_group):
        stop = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + LINK_ROWS, "right")))
        lo, hi = np.searchsorted(b_group, [a_group[at], a_group[stop - 1] + 1])
        left = pa.table({"group": a_group[at:stop], "doc": doc[at:stop], "a": a_id[at:stop]})
        right = pa.table({"group": b_group[lo:hi], "b": b_id[lo:hi]})
        met = left.join(right, "group", join_type="inner", use_threads=False)
        pair = pc.add(pc.multiply(pc.cast(met["a"], pa.int64()), b_size), pc.cast(met["b"], pa.int64()))
        parts.append(pa.table({"doc": met["doc"], "pair": pair}).group_by(["doc", "pair"], use_threads=False)
                     .aggregate([([], "count_all")]))
        at = stop
    if not parts:
        return pa.table({"doc": pa.array([], pa.int64()), "pair": pa.array([], pa.int64()),
                         "links": pa.array([], pa.int64())})
    found = pa.concat_tables(parts)
    if len(parts) > 1:
        found = found.group_by(["doc", "pair"], use_threads=False).aggregate([("count_all", "sum")])
    return found.rename_columns(["doc", "pair", "links"])


def align_block(texts: list[str], kit: Tokenizers) -> dict[str, object]:
    """Per-document columns of a block: n_a, n_b, n_groups, n_links, groups_sha256, pairs and links."""
    n = len(texts)
    raw = [b" " + t.encode() for t in texts]
    a_ids = [kit.encode_a(" " + t) if t else np.zeros(0, np.int32) for t in texts]
    b_ids = [np.array(x, np.int32) for x in kit.pieces.encode(texts, num_threads=1)]
    a_lists, b_lists = _lists(a_ids), _lists(b_ids)
    good = [bool(t) and x and y for t, x, y in
            zip(texts, _spells(a_lists, kit.a_bytes, raw), _spells(b_lists, kit.b_bytes, raw))]
    if not all(good):
        none = np.zeros(0, np.int32)
        a_lists = _lists([x if g else none for x, g in zip(a_ids, good)])
        b_lists = _lists([x if g else none for x, g in zip(b_ids, good)])
    a, b = _ends(a_lists, kit.a_bytes), _ends(b_lists, kit.b_bytes)
    a_id, b_id = (pc.list_flatten(x).to_numpy() for x in (a_lists, b_lists))
    common = a.join(b, ["doc", "end"], join_type="inner", right_suffix="_b", use_threads=False)
    a_mark, a_group = _groups(common["at"].to_numpy(), len(a))
    b_mark, b_group = _groups(common["at_b"].to_numpy(), len(b))
    groups = len(common)
    a_doc = a["doc"].to_numpy()
    a_count, b_count = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
    group_doc = a_doc[a_mark == 1]
    found = _links(a_doc, a_group, a_id, b_group, b_id, b_count, kit.b_size).sort_by([("doc", "ascending"), ("pair", "ascending")])

    # spelling: the A ids of a group, then its B ids; where each token stands follows from the groups' sizes
    a_at = np.arange(len(a)) + (np.cumsum(b_count) - b_count)[a_group]
    b_at = np.arange(len(b)) + np.cumsum(a_count)[b_group]
    code = np.zeros(len(a) + len(b), np.int64)
    code[a_at] = 3 * a_id.astype(np.int64) + a_mark
    code[b_at] = 3 * b_id.astype(np.int64) + 2 * b_mark
    spelt = pc.take(kit.spelt, pa.array(code))
    starts = np.frombuffer(spelt.buffers()[1], np.int64, len(spelt) + 1, spelt.offset * 8)
    data = memoryview(spelt.buffers()[2] or b"")
    cuts = starts[a_lists.offsets.to_numpy() + b_lists.offsets.to_numpy()].tolist()
    sha = [hashlib.sha256(data[x:y - 1]).hexdigest() if y > x else "" for x, y in zip(cuts, cuts[1:])]
    edges = np.searchsorted(found["doc"].to_numpy(), np.arange(n + 1)).astype(np.int32)
    return {
        "n_a": np.diff(a_lists.offsets.to_numpy()), "n_b": np.diff(b_lists.offsets.to_numpy()),
        "n_groups": np.bincount(group_doc, minlength=n).astype(np.int64),
        "n_links": np.bincount(group_doc, weights=a_count * b_count, minlength=n).astype(np.int64),
        "groups_sha256": sha,
        "pairs": pa.ListArray.from_arrays(pa.array(edges), found["pair"].combine_chunks()),
        "links": pa.ListArray.from_arrays(pa.array(edges), found["links"].combine_chunks()),
    }


_COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = np.cumsum(pc.utf8_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            most = int(np.searchsorted(size, (size[at - 1] if at else 0) + BLOCK_CHARS, "right"))
            stop = min(max(most, at + 1), at + BLOCK_DOCS, batch.num_rows)
            yield batch.slice(at, stop - at)
            at = stop


def aligned(docs: DataFrame, a_name: str = TOKENIZER, b_name: str = PIECES) -> DataFrame:
    """rid, doc_id, the block columns, and per document the sorted id pairs with their links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kit = tokenizers(a_name, b_name)
        for block in _blocks(batches):
            made = align_block(block.column("text").to_pylist(), kit)
            yield pa.RecordBatch.from_arrays(
                [block.column("rid"), block.column("doc_id"),
                 *[x if isinstance(x, pa.Array) else pa.array(x) for x in (made[c] for c in _COLUMNS)]],
                names=["rid", "doc_id", *_COLUMNS])

    rows = documents(docs, "doc_id", "text").select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"rid long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, "
                                "groups_sha256 string, pairs array<long>, links array<long>")


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair and n (documents that hold it) over all rows: partial counts by block and task, merged by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            return (pa.concat_tables(held).group_by("pair", use_threads=False)
                    .aggregate([("n", "sum")]).rename_columns(["pair", "n"]))

        fresh = 0
        for batch in batches:
            pairs = pc.list_flatten(batch.column("pairs"))
            part = pa.table({"pair": pairs}).group_by("pair", use_threads=False).aggregate([([], "count_all")])
            held.append(part.rename_columns(["pair", "n"]))
            fresh += len(part)
            if fresh > 2 * PARTIAL_PAIRS:
                held = [merged()]
                fresh = len(held[0])
                if fresh > PARTIAL_PAIRS:
                    yield from held[0].to_batches()
                    held, fresh = [], 0
        if held:
            yield from merged().to_batches()

    return rows.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def alignments(docs: DataFrame, a_name: str = TOKENIZER, b_name: str = PIECES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    spark = docs.sparkSession
    rows = saved(aligned(docs, a_name, b_name), "aligned")
    size = tokenizers(a_name, b_name).b_size
    counts = saved(pair_counts(rows), "pair-counts")
    best = counts.groupBy(F.floor(F.col("pair") / size).alias("a")).agg(F.max("n").alias("top"))
    # as many rows as A's vocabulary at most
    flagged = saved(counts.join(F.broadcast(best), F.floor(F.col("pair") / size) == F.col("a")).select(
        "pair", "n", (F.col("n") == F.col("top")).alias("is_best")), "pair-flags")
    hot = flagged.orderBy(F.desc("n"), "pair").limit(HOT_PAIRS).toArrow().sort_by("pair")
    shared = spark.sparkContext.broadcast({"pair": hot["pair"].to_numpy(), "n": hot["n"].to_numpy(),
                                           "best": hot["is_best"].to_numpy().astype(np.int64)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            pairs, links = batch.column("pairs"), batch.column("links")
            doc = pc.list_parent_indices(pairs).to_numpy(zero_copy_only=False)
            pair, link = pc.list_flatten(pairs).to_numpy(), pc.list_flatten(links).to_numpy()
            at = np.minimum(np.searchsorted(known["pair"], pair), max(len(known["pair"]) - 1, 0))
            is_hot = known["pair"][at] == pair if len(known["pair"]) else np.zeros(len(pair), bool)
            held, at, times = doc[is_hot], at[is_hot], link[is_hot]
            totals = []
            for value in (known["best"][at] * times, known["n"][at] * times):
                total = np.zeros(batch.num_rows, np.int64)  # whole numbers throughout
                np.add.at(total, held, value)
                totals.append(pa.array(total))
            edges = pa.array(np.searchsorted(doc[~is_hot], np.arange(batch.num_rows + 1)).astype(np.int32))
            rest = [pa.ListArray.from_arrays(edges, pa.array(x[~is_hot])) for x in (pair, link)]
            keep = [batch.column(c) for c in ("rid", "doc_id", *_COLUMNS[:5])]
            yield pa.RecordBatch.from_arrays([*keep, *totals, *rest], names=[
                "rid", "doc_id", *_COLUMNS[:5], "hot_best", "hot_sum", "rest_pairs", "rest_links"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    summed = saved(rows.mapInArrow(run, f"rid long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, "
                                        "groups_sha256 string, hot_best long, hot_sum long, rest_pairs array<long>, "
                                        "rest_links array<long>"), "aligned-sums")
    rest = summed.select("rid", F.explode(F.arrays_zip("rest_pairs", "rest_links")).alias("x")).select(
        "rid", F.col("x.rest_pairs").alias("pair"), F.col("x.rest_links").alias("times"))
    rest = rest.join(flagged, "pair").groupBy("rid").agg(
        F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("rest_best"),
        F.sum(F.col("n") * F.col("times")).alias("rest_sum"))
    return summed.join(rest, "rid", "left").select(
        "doc_id", *_COLUMNS[:4], (F.col("hot_best") + F.coalesce("rest_best", F.lit(0))).alias("n_best"),
        (F.col("hot_sum") + F.coalesce("rest_sum", F.lit(0))).alias("count_sum"), "groups_sha256")
