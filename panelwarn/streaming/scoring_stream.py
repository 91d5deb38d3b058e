"""C4: score feature-map events as they land, and keep a prediction history (T5).

The reference scores one request at a time; here requests are files landing in
a folder, read with ``readStream`` and scored by the same batch code path
(stateless, so no watermark is needed).  The sink is a parquet table with a
checkpoint in the reliable checkpoint folder, so a restarted query resumes
exactly where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwarn.schemas import REQUEST


def request_stream(spark: SparkSession, folder: str, schema=REQUEST, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(folder)


def start_scoring(spark: SparkSession, scorer, source_folder: str, sink_folder: str, checkpoint: str,
                  keep=("request_id",), available_now: bool = True, schema=None):
    """Start the stream; returns the StreamingQuery (call awaitTermination / stop)."""
    from pyspark.sql.types import LongType, StructField, StructType
    sch = schema or StructType([StructField("request_id", LongType()), *REQUEST.fields])
    stream = request_stream(spark, source_folder, sch)
    scored = scorer.score_maps(stream, "features", keep=list(keep)) \
        .withColumn("scored_at", F.current_timestamp())
    writer = (scored.writeStream.format("parquet").option("path", sink_folder)
                    .option("checkpointLocation", checkpoint).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def latest_history(history: DataFrame, k: int = 10, by=(), ts: str = "scored_at",
                   tiebreak: str = "request_id") -> DataFrame:
    """T5: newest k predictions (per key in ``by`` if given)."""
    from panelwarn.operators.profile import top_k_per_group
    if by:
        return top_k_per_group(history, list(by), [F.desc(ts), F.desc(tiebreak)], k)
    return history.orderBy(F.desc(ts), F.desc(tiebreak)).limit(k)
