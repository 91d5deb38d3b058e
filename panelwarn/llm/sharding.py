"""Sharding (operator 9): proportional stratified interleaving.

Rows are ranked in a seeded order within their source; sorting all rows by
fractional rank (rank + 1/2) / rows of the source spreads every source evenly
over the whole order, and cutting that order into equal runs gives shards
whose sizes differ by one row at most and whose mixture is the corpus's.
Both orders come from one range shuffle each, so a source with a third of all
rows is no hot spot, and only the small key columns are shuffled.

Defined results.  A null text has size 8 and checksum 0.  Null is a source of
its own.  Equal rows are interchangeable.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwarn.llm.common import documents, running, text_bytes

SHARDS = 24


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = 42) -> DataFrame:
    """doc_id, source, size, text_crc32, shard and slot of every row."""
    rows = documents(docs, "doc_id", "source", "text").select(
        "doc_id", "source", (F.octet_length(text_bytes()) + 8).cast("long").alias("size"),
        F.crc32(text_bytes()).alias("text_crc32"))
    rows = rows.withColumn("_turn", F.xxhash64(F.lit(seed), "doc_id", "text_crc32"))
    ranked = running(rows, ["source", "_turn", "doc_id", "text_crc32", "size"], name="sharding")
    sources = ranked.groupBy("source").agg(F.min("row").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    sources = sources.withColumnRenamed("source", "_source")
    placed = ranked.join(sources, F.col("source").eqNullSafe(F.col("_source")))
    share = (F.col("row") - F.col("_first") + F.lit(0.5)) / F.col("_rows")
    placed = placed.select("doc_id", "source", "size", "text_crc32", "_turn", share.alias("_share"))
    ordered = running(placed, ["_share", "source", "_turn", "doc_id", "text_crc32", "size"], name="sharding")
    n = ordered.count()
    cut = ordered.withColumn("shard", F.expr(f"cast(row * {shards} div {max(n, 1)} as int)"))
    first = F.expr(f"(cast(shard as bigint) * {n} + {shards - 1}) div {shards}")
    return cut.select("doc_id", "source", "size", "text_crc32", "shard", (F.col("row") - first).alias("slot"))
