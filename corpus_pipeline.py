"""A training corpus from raw documents: filter, deduplicate, mask, mix, pack.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before kept; its output is written as Parquet and read again as the next
one's ``docs``.  All but the last return the columns of ``documents``.

A stage deletes nothing: its result may be read at any time, beside other
stages and runs.  ``run`` deletes what its own stages no longer need.

1. quality rules: drop documents that the base rules or the trees reject;
2. SimHash near-dedup: keep one document of each near-duplicate component;
3. personal data: replace every span by its kind, e.g. ``[EMAIL]``;
4. source mixing: repeat or cut documents so that sources meet their targets;
5. best-fit packing: place the pieces of all documents in sequences.

SQL can express none of the trained or hashed stages, so there is no oracle;
tests compare each stage with a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelwarn.llm import common, mixing, packing, pii, quality, simhash

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit_quality(docs, common.read(spark, sf_dir, "labels"))
    return quality.keep_documents(docs, model)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs, shingle=4, max_distance=4)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask_documents(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, capacity=2048)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("personal_data", personal_data),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again, from ``documents``.

    A stage's own tables and its input go once its output is written; those of
    the last one stay, for the returned frame reads them.
    """
    docs = common.read(spark, sf_dir, "documents")
    before: list[str] = []
    for name, stage in STAGES[:-1]:
        with common.noted() as written:
            docs, path = common.saved_at(stage(spark, docs, sf_dir), f"stage-{name}")
        common.discard(spark, *before, *[p for p in written if p != path])
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
