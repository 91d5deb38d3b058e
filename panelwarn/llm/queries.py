"""The registered queries of the training-data operators, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwarn.llm import alignment, ann, lm, minhash, mixing, packing, phrases, pii, quality, sharding, simhash, suffix, tokens
from panelwarn.llm.common import read


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and digest, and all spans of personal data, of every document."""
    return pii.personal_data(read(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact token count of every document, and how much of it fits 512 tokens."""
    counted = tokens.token_counts(read(spark, sf_dir, "documents"), limit=512)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit", "limit_chars")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    return packing.pack_documents(read(spark, sf_dir, "documents"), capacity=2048)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix_sizes(read(spark, sf_dir, "documents"), block_words=16)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base and maximum-entropy score of every document."""
    return lm.score_documents(read(spark, sf_dir, "documents"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors found for every vec_id divisible by 50."""
    return ann.nearest(read(spark, sf_dir, "embeddings"), k=5, every=50)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=4, max_distance=4)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", hexed.alias("fingerprint"), "component_id")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that lie in a 400-byte string starting elsewhere too, and whether 51 words in a row do."""
    return suffix.remove_repeats(read(spark, sf_dir, "documents"), length=400)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under the law ``rows``."""
    placed = sharding.shard_documents(read(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), "source")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, base verdict and the trees' verdict for all documents."""
    docs = read(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, read(spark, sf_dir, "labels"))
    return quality.quality_verdicts(docs, model)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of every language."""
    return phrases.collocations(read(spark, sf_dir, "documents"), min_count=30, most=4, top=2000)


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document on five-word shingles, Jaccard similarity 0.85 or more."""
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=5, percent=85)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned groups and links of two tokenizers on every document, weighed by corpus-wide pair counts."""
    return alignment.alignments(read(spark, sf_dir, "documents"))


REGISTRY = {
    "op1_personal_data": op1_personal_data,
    "op2_token_counts": op2_token_counts,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_source_mixing": op4_source_mixing,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_simhash": op7_simhash,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_sharding": op9_sharding,
    "op10_quality_rules": op10_quality_rules,
    "op11_collocations": op11_collocations,
    "op12_minhash": op12_minhash,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}
_LOWERED = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op12_minhash": f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all({_LOWERED.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s
  FROM worded),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reached AS (
  SELECT doc_id, doc_id AS seen FROM sets
  UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.seen)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.seen) AS component_id, s.doc_id = min(r.seen) AS kept
FROM sets s JOIN reached r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.s
""",
    "op11_collocations": f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array({_LOWERED.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
worded AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces),
placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded WHERE len(w) > 0),
counted AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f
  FROM placed, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE k = 1 GROUP BY lang),
parts AS MATERIALIZED (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM counted WHERE f >= 30),
found AS (SELECT * FROM parts WHERE k > 1),
split AS (
  SELECT lang, phrase, f, cut, array_to_string(w[1 : cut], ' ') AS head, array_to_string(w[cut + 1 : k], ' ') AS tail
  FROM found, (SELECT unnest([1, 2, 3]) AS cut) WHERE cut < k),
cuts AS (
  SELECT s.*, h.f AS l, t.f AS r, CAST((2000000::HUGEINT * s.f) // (h.f + t.f) AS BIGINT) AS score
  FROM split s JOIN parts h ON h.lang = s.lang AND h.phrase = s.head JOIN parts t ON t.lang = s.lang AND t.phrase = s.tail),
best AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS choice FROM cuts),
pieces_of AS (
  SELECT lang, array_to_string(w[s : s + m - 1], ' ') AS phrase, f
  FROM found, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS s) WHERE m < k AND s + m - 1 <= k),
inside AS (SELECT lang, phrase, max(f) AS b FROM pieces_of GROUP BY ALL),
kept AS (
  SELECT b.lang, b.phrase, b.f AS a, b.l, b.r, b.score
  FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE b.choice = 1 AND (i.b IS NULL OR 100 * i.b < 80 * b.f)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, n, score
FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE rank <= 2000
""",
}
