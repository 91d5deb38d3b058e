"""Passage dedup (operator 8): a logarithmic family of sampled gram hashes, in place of suffix arrays.

Every string of ``LENGTH`` bytes is represented by one of the suffixes that
start in it: the one whose first ``GRAM`` bytes hash lowest.  Equal strings
choose the same place in themselves, so two copies of a long passage always
share a sampled suffix, and about one suffix in 170 bytes is kept.  No suffix
array is built: a level is the sorted set of the distinct keys of the sampled
suffixes (the hash of their first ``GRAM`` bytes), without suffixes, places or
alphabetic order.

Batches (``BATCHES`` hash slices of the one input) enter one after the other: a
batch gets its own level, a semi-join with the existing levels finds equal keys,
and levels of equal size are merged, so that there are never more than
log(batches) of them.  Suffixes with a match then meet with their surroundings, one group a key, and
for each the first and last ``LENGTH``-byte window is found that also starts
elsewhere; rolling hashes find the windows and their bytes are compared.
Groups above ``GROUP_ROWS`` are dealt into blocks that cover every pair.

Passages of ``WORDS`` words may be shorter than ``LENGTH`` bytes.  The words of a
text are sampled in the same way, and ``repeats_passage`` tells whether any
``WORDS`` words of a row stand one after the other in another row too.  A first
pass compares one window an occurrence, the one that starts at the sampled
place; texts that it leaves open, and those that share a key with them, then
compare all windows that hold the place, by 128-bit digests.

Only one row of exact copies takes part, so a text that a third of all rows
share costs what one row costs; its copies are removed whole if they have
``LENGTH`` bytes at all.  Inside one text, suffixes whose whole surroundings
repeat (long runs) are settled at once and two of them kept.

Defined results.  A null text is empty.  Texts under ``LENGTH`` bytes lose
nothing, texts under ``WORDS`` words repeat no passage.  Repeated rows are copies
of each other.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwarn.llm.common import discard, documents, pair_blocks, saved, saved_at, sorted_groups, text_bytes

LENGTH = 400
GRAM = 64
#: Passages of so many words are marked, whatever their bytes; sampled by grams of ``WORD_GRAM`` words.
WORDS = 51
WORD_GRAM = 8
BATCHES = 4
#: Occurrences of one suffix beginning that a task compares at a time.
GROUP_ROWS = 16_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 1 << 19


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    both = []
    for base in (_BASE, inverse):
        p = np.full(n, base)
        p[0] = 1
        both.append(np.multiply.accumulate(p))
    return both[0], both[1]


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    n = len(data)
    up, down = _powers(1 << max(n, 2).bit_length())
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n])])
    h = (sums[gram:] - sums[:-gram]) * down[:n - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(values)] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def _sampled(values: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and places of the sampled suffixes of a sequence of bytes or of hashed words."""
    if len(values) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = length - gram + 1
    keys, places = [], []
    for a in range(0, len(values) - length + 1, _PIECE):
        h = _gram_hashes(values[a:a + _PIECE + length - 1], gram)
        low = np.uint64((1 << 20) - 1)
        at = np.arange(len(h), dtype=np.uint64)
        chosen = np.unique(_window_minima(h & ~low | at, width) & low).astype(np.int64)
        keys.append(h[chosen].view(np.int64))
        places.append(chosen + a)
    places_, first = np.unique(np.concatenate(places), return_index=True)
    return np.concatenate(keys)[first], places_


def sampled_suffixes(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Keys and places of a text's sampled suffixes."""
    return _sampled(np.frombuffer(raw, np.uint8), length, gram)


def _word_hashes(raw: bytes) -> np.ndarray:
    """A hash of each word ``[^\\x20\\x09-\\x0D]+``."""
    data = np.frombuffer(raw, np.uint8)
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        lo = int(starts[a])
        b = int(np.searchsorted(ends, lo + _PIECE, "right"))
        if b <= a:  # one word longer than a piece
            out[a] = int.from_bytes(hashlib.blake2b(raw[lo:ends[a]], digest_size=8).digest(), "little")
            a += 1
            continue
        n = int(ends[b - 1]) - lo
        up, down = _powers(1 << max(n, 2).bit_length())
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data[lo:lo + n].astype(np.uint64) + np.uint64(1)) * up[:n])])
        out[a:b] = (sums[ends[a:b] - lo] - sums[starts[a:b] - lo]) * down[starts[a:b] - lo]
        a = b
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


def sampled_words(raw: bytes, words: int = WORDS, gram: int = WORD_GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The same of its words; of occurrences with the same ``words`` on both sides only the first is kept."""
    keys, places = _sampled(_word_hashes(raw), words, gram)
    if len(np.unique(keys)) == len(keys):
        return keys, places
    split, back = raw.split(), words - gram
    keep, seen = np.ones(len(keys), bool), set()
    _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
    for i in np.flatnonzero(count[inverse] > 2).tolist():
        p = int(places[i])
        if p >= back and p + words <= len(split):
            mark = _digest(split[p - back:p + words])
            keep[i] = mark not in seen
            seen.add(mark)
    return keys[keep], places[keep]


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _settle_runs(raw: bytes, keys: np.ndarray, places: np.ndarray, length: int, gram: int):
    """Keep two of the suffixes whose whole surroundings repeat inside the text, and what these cover."""
    back = length - gram
    if len(np.unique(keys)) == len(keys):
        return keys, places, []
    alike: defaultdict[bytes, list[int]] = defaultdict(list)
    _, inverse, count = np.unique(keys, return_inverse=True, return_counts=True)
    for i in np.flatnonzero(count[inverse] > 2).tolist():
        p = int(places[i])
        if p >= back and p + length <= len(raw):
            alike[hashlib.blake2b(raw[p - back:p + length], digest_size=16).digest()].append(i)
    gone, own = [], []
    for members in alike.values():
        if len(members) > 2 and all(raw[places[i] - back:places[i] + length]
                                    == raw[places[members[0]] - back:places[members[0]] + length] for i in members):
            gone += members[2:]
            own += [(int(places[i]) - back, int(places[i]) + length) for i in members]
    keep = np.ones(len(keys), bool)
    keep[gone] = False
    return keys[keep], places[keep], merged(own)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans as maximal disjoint ones."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class SuffixFamily:
    """Levels of sorted tables of distinct keys; each covers a power of two of batches."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame, str]] = []

    def add(self, suffixes: DataFrame) -> DataFrame:
        """Enter a batch (column ``key``); the keys that it has twice or shares with a level."""
        counted = suffixes.groupBy("key").agg((F.count(F.lit(1)) > 1).alias("again"))
        level, path = saved_at(counted.repartitionByRange("key").sortWithinPartitions("key"), "suffixes")
        found = level.filter("again").select("key")
        for _, older, _ in self.levels:
            found = found.unionByName(level.join(older, "key", "left_semi").select("key"))
        matches = saved(found.distinct(), "matches")
        batches = 1
        while self.levels and self.levels[-1][0] == batches:
            _, older, old_path = self.levels.pop()
            both = level.select("key").unionByName(older.select("key")).distinct()
            level, new_path = saved_at(both.repartitionByRange("key").sortWithinPartitions("key"), "suffixes")
            discard(suffixes.sparkSession, old_path, path)
            batches, path = 2 * batches, new_path
        self.levels.append((batches, level, path))
        return matches


def _surroundings(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    back = length - gram
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            out = {k: [] for k in ("key", "tid", "place", "before", "bytes")}
            for tid, raw, keys, places in zip(*(batch.column(c).to_pylist() for c in ("tid", "_raw", "keys", "places"))):
                for key, p in zip(keys, places):
                    a = max(p - back, 0)
                    for name, v in zip(out, (key, tid, p, p - a, raw[a:p + length])):
                        out[name].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["key"], pa.int64()), pa.array(out["tid"], pa.int64()), pa.array(out["place"], pa.int64()),
                 pa.array(out["before"], pa.int32()), pa.array(out["bytes"], pa.binary())], names=list(out))


def repeated_windows(group: np.ndarray, before: np.ndarray, around: list[bytes], length: int,
                     gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each occurrence, the least and the most bytes before it at which a repeated window starts (-1: none).

    A window that starts o bytes before an occurrence is repeated if another
    occurrence of its group has the same bytes around it.
    """
    back, n = length - gram, len(around)
    field = np.zeros((n, back + length), np.uint8)
    after = np.zeros(n, np.int64)
    for i, (b, raw) in enumerate(zip(before.tolist(), around)):
        field[i, back - b:back - b + len(raw)] = np.frombuffer(raw, np.uint8)
        after[i] = len(raw) - b
    up = _powers(1024 if length < 1024 else 1 << length.bit_length())[0]
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    salt = group.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)

    def search(offsets: range, active: np.ndarray) -> np.ndarray:
        found = np.full(n, -1, np.int64)
        start = back - offsets[0]
        rolling = ((field[active, start:start + length].astype(np.uint64) + np.uint64(1)) * up[:length]).sum(axis=1)
        for o in offsets:
            if o != offsets[0]:  # roll one byte
                start = back - o
                if offsets.step > 0:
                    rolling = rolling * _BASE + field[active, start] + np.uint64(1) \
                        - (field[active, start + length] + np.uint64(1)) * up[length]
                else:
                    rolling = (rolling - field[active, start - 1] - np.uint64(1)) * inverse \
                        + (field[active, start + length - 1] + np.uint64(1)) * up[length - 1]
            fits = np.flatnonzero((before[active] >= o) & (after[active] >= length - o))
            if len(fits) > 1:
                value = rolling[fits] ^ salt[active[fits]]
                order = np.argsort(value, kind="stable")
                same = np.flatnonzero(np.diff(value[order]) == 0)
                if len(same):
                    rows = active[fits[order]]
                    hit = np.unique(np.concatenate([same, same + 1]))
                    partner = np.where(np.isin(hit, same), hit + 1, hit - 1)
                    i, j = rows[hit], rows[partner]
                    new = found[i] < 0
                    i, j = i[new], j[new]
                    span = slice(back - o, back - o + length)
                    equal = np.array([group[a] == group[b] and bool((field[a, span] == field[b, span]).all())
                                      for a, b in zip(i.tolist(), j.tolist())], bool)
                    found[i[equal]] = o
                    if not equal.all():  # equal hashes of different bytes: look at the bytes themselves
                        _exact(found, i[~equal], group, field, before, after, o, back, length)
                    open_ = np.unique(group[active][found[active] < 0])
                    keep = np.isin(group[active], open_)
                    if not keep.all():
                        active, rolling = active[keep], rolling[keep]
                        if not len(active):
                            break
        return found

    least = search(range(0, back + 1), np.arange(n))
    some = np.flatnonzero(np.isin(group, group[least >= 0]))
    most = search(range(back, -1, -1), some) if len(some) else np.full(n, -1, np.int64)
    return least, most


def _exact(found: np.ndarray, rows: np.ndarray, group: np.ndarray, field: np.ndarray, before: np.ndarray,
           after: np.ndarray, o: int, back: int, length: int) -> None:
    """Set ``found`` of the given occurrences by comparing bytes with their whole group."""
    span = slice(back - o, back - o + length)
    for i in rows.tolist():
        others = np.flatnonzero((group == group[i]) & (before >= o) & (after >= length - o))
        others = others[others != i]
        if len(others) and (field[others, span] == field[i, span]).all(axis=1).any():
            found[i] = o


def _passage_marks(parts: Iterator[pa.RecordBatch], words: int, gram: int, every: bool) -> Iterator[pa.RecordBatch]:
    """Digests of the windows of ``words`` words that start at a sampled place, or of every one that holds it."""
    for whole in parts:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            tids, marks = [], []
            for tid, raw, places in zip(*(batch.column(c).to_pylist() for c in ("tid", "_raw", "words"))):
                split = raw.split() if places else []
                last = len(split) - words
                if every:
                    starts = {i for p in places for i in range(max(p - words + gram, 0), min(p, last) + 1)}
                else:
                    starts = {p for p in places if p <= last}
                found = {_digest(split[i:i + words]) for i in starts}
                tids += [tid] * len(found)
                marks += found
            yield pa.RecordBatch.from_arrays([pa.array(tids, pa.int64()), pa.array(marks, pa.binary())], names=["tid", "mark"])


def _sharing(marks: DataFrame) -> DataFrame:
    """Texts with a mark that another text has too (the marks are stored, so that a frequent one's join can be split)."""
    both = marks.groupBy("mark").agg(F.min("tid").alias("_lo"), F.max("tid").alias("_hi")).filter("_lo < _hi").select("mark")
    return marks.join(saved(both, "shared-marks"), "mark", "left_semi").select("tid").distinct()


def repeated_passages(held: DataFrame, matched: DataFrame, words: int = WORDS, gram: int = WORD_GRAM) -> DataFrame:
    """The texts (tid) of which ``words`` words in a row stand in another text; ``matched`` holds sampled places."""
    def marks(texts: DataFrame, every: bool) -> DataFrame:
        return saved(texts.select("tid", "_raw", "words").mapInArrow(
            lambda parts: _passage_marks(parts, words, gram, every), "tid long, mark binary"), "marks")

    hit = saved(_sharing(marks(held, False)), "passages")
    open_keys = saved(matched.join(hit, "tid", "left_anti").select("key").distinct(), "open-keys")
    rest = matched.join(open_keys, "key", "left_semi").groupBy("tid").agg(F.collect_list("place").alias("words"))
    return hit.unionByName(_sharing(marks(held.select("tid", "_raw").join(rest, "tid"), True))).distinct()


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES,
                   group_rows: int = GROUP_ROWS, words: int = WORDS,
                   word_gram: int = WORD_GRAM) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows with their digest, the distinct texts, those with matches, spans (tid, start, end) repeated
    elsewhere, and the texts (tid) that repeat a passage of another one."""
    hashed = documents(docs, "doc_id", "text").withColumn("_raw", text_bytes()).select(
        "doc_id", F.unhex(F.sha2("_raw", 256)).alias("sha"), "_raw")

    lists = ["keys", "places", "own", "word_keys", "word_places"]

    def sample(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            sizes, keys, places, own, word_keys, word_places = [], [], [], [], [], []
            for raw in batch.column("_raw").to_pylist():
                k, p = sampled_suffixes(raw, length, gram)
                k, p, o = _settle_runs(raw, k, p, length, gram)
                sizes.append(len(raw))
                keys.append(k)
                places.append(p)
                own.append([x for span in o for x in span])
                k, p = sampled_words(raw, words, word_gram)
                word_keys.append(k)
                word_places.append(p)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("sha"), pa.array(sizes, pa.int64()),
                 *[pa.array(x, pa.list_(pa.int64())) for x in (keys, places, own, word_keys, word_places)]],
                names=["doc_id", "sha", "n_bytes", *lists])

    kind = hashed.schema["doc_id"].dataType.simpleString()
    rows = saved(hashed.mapInArrow(sample, f"doc_id {kind}, sha binary, n_bytes long, "
                                   + ", ".join(f"{c} array<long>" for c in lists)), "sampled")
    once = rows.groupBy("sha").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("keeper"),
                                   *[F.first(c).alias(c) for c in ("n_bytes", *lists)])
    texts = saved(once.withColumn("tid", F.monotonically_increasing_id()), "texts")

    family, found = SuffixFamily(), None
    for i in range(batches):
        part = texts.filter(F.pmod(F.xxhash64("sha"), F.lit(batches)) == i)
        matches = family.add(part.select(F.explode("keys").alias("key")))
        found = matches if found is None else found.unionByName(matches)
    repeated = found.distinct()
    pairs = texts.select("tid", F.explode(F.arrays_zip("keys", "places")).alias("s")).select(
        "tid", F.col("s.keys").alias("key"), F.col("s.places").alias("place"))
    matched = saved(pairs.join(repeated, "key", "left_semi"), "matched")

    twice = texts.select(F.explode(F.array_distinct("word_keys")).alias("key")).groupBy("key").count().filter("count > 1")
    word_pairs = texts.select("tid", F.explode(F.arrays_zip("word_keys", "word_places")).alias("s")).select(
        "tid", F.col("s.word_keys").alias("key"), F.col("s.word_places").alias("place"))
    matched_words = saved(word_pairs.join(saved(twice.select("key"), "word-keys"), "key", "left_semi"), "matched-words")

    both = matched.select("tid", F.struct("key", "place").alias("s"), F.lit(None).cast("long").alias("word")).unionByName(
        matched_words.select("tid", F.col("place").alias("word")), allowMissingColumns=True)
    listed = both.groupBy("tid").agg(F.collect_list("s").alias("s"), F.collect_list("word").alias("words")).select(
        F.col("tid").alias("_tid"), F.col("s.key").alias("keys"), F.col("s.place").alias("places"), "words")
    wanted = texts.select("tid", F.col("sha").alias("_sha"), "keeper", "copies").join(listed, F.col("tid") == F.col("_tid"))
    held = hashed.join(wanted, (F.col("sha") == F.col("_sha")) & F.col("doc_id").eqNullSafe(F.col("keeper")))
    held = saved(held.select("tid", "copies", "_raw", "keys", "places", "words"), "matched-texts")
    around = held.select("tid", "_raw", "keys", "places").mapInArrow(
        lambda parts: _surroundings(parts, length, gram), "key long, tid long, place long, before int, bytes binary")
    dealt = pair_blocks(around, ["key"], ["tid", "place"], group_rows, counted=matched)
    dealt = dealt.repartition("key", "block").sortWithinPartitions("key", "block")

    def resolve(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(parts, ["key", "block"], 4_000):
            key, block, tid, place, before = (table.column(c).to_numpy() for c in ("key", "block", "tid", "place", "before"))
            group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (block[1:] != block[:-1])]))
            least, most = repeated_windows(group, before.astype(np.int64), table.column("bytes").to_pylist(), length, gram)
            hit = np.flatnonzero(least >= 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tid[hit]), pa.array(place[hit] - most[hit]), pa.array(place[hit] - least[hit] + length)],
                names=["tid", "start", "end"])

    spans = dealt.mapInArrow(resolve, "tid long, start long, end long")
    return rows, texts, held, spans, repeated_passages(held, matched_words, words, word_gram)


def _cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text, by its digest, and how much went."""
    for batch in parts:
        removed, runs, digests = [], [], []
        for raw, found, own in zip(*(batch.column(c).to_pylist() for c in ("_raw", "spans", "own"))):
            spans = merged([(s["start"], s["end"]) for s in found or []] + list(zip(own[::2], own[1::2])))
            kept, at = hashlib.sha256(), 0
            for a, b in spans:
                kept.update(raw[at:a])
                at = b
            kept.update(raw[at:])
            removed.append(sum(b - a for a, b in spans))
            runs.append(len(spans))
            digests.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("tid"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()),
                                          pa.array(digests, pa.string())], names=["tid", "n_removed", "n_spans", "kept"])


def _lower_hex(c: str) -> Column:
    return F.lower(F.hex(c))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES,
                   group_rows: int = GROUP_ROWS, words: int = WORDS, word_gram: int = WORD_GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and repeats_passage of every row."""
    rows, texts, held, spans, passages = repeated_spans(docs, length, gram, batches, group_rows, words, word_gram)
    spans = spans.groupBy(F.col("tid").alias("_tid")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    own = texts.select(F.col("tid").alias("_own_tid"), "own")
    once = held.filter("copies = 1").select("tid", "_raw").join(spans, F.col("tid") == F.col("_tid"))
    cut = once.join(own, F.col("tid") == F.col("_own_tid")).select("tid", "_raw", "spans", "own").mapInArrow(
        _cut, "tid long, n_removed long, n_spans long, kept string").withColumnRenamed("tid", "_cut_tid")
    result = texts.join(cut, F.col("tid") == F.col("_cut_tid"), "left").join(
        passages.select(F.col("tid").alias("_passage_tid")), F.col("tid") == F.col("_passage_tid"), "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    result = result.select(
        F.col("sha").alias("_sha"),
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", _lower_hex("sha")))
        .alias("kept_sha256"),
        (F.col("_passage_tid").isNotNull() | ((F.col("copies") > 1) & (F.size("word_keys") > 0))).alias("repeats_passage"))
    return rows.select("doc_id", "sha", "n_bytes").join(result, F.col("sha") == F.col("_sha")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "repeats_passage")
