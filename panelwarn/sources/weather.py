"""Weather covariates: landed JSON documents (S4) and a partitioned parquet store.

A document holds ``properties.parameter.<PARAM>.<YYYYMM> -> value`` for one
entity.  Parsing is a column expression pipeline (explode of a MAP column), so
any number of documents is processed in parallel.

``load_weather`` reuses what is stored: a coverage table (entity, year) is
anti-joined with what is asked, only documents of entities with a missing year
are read, one parse gives rows and errors, and only missing years are appended.
A document in error covers nothing, so the next call tries it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructField, StructType, DoubleType

from panelwarn.functions.numeric import split_yyyymm
from panelwarn.session import cut_lineage

# Fixed values of the reference's weather source: parameter names and the
# precipitation fallback order.
TEMPERATURE_PARAM = "T2M"
PRECIP_PARAMS = ("PRECTOTCORR", "PRECTOT")

#: Errors of a document, in the order in which they are looked for.
DAMAGED, NO_TEMPERATURE, NO_RECORDS = "Document cannot be read.", "Missing T2M", "No valid weather records extracted."

DOC_SCHEMA = StructType([
    StructField("ISO_A0", StringType()),
    StructField("properties", StructType([
        StructField("parameter", MapType(StringType(), MapType(StringType(), DoubleType()))),
    ])),
])


def read_weather_documents(spark: SparkSession, path: str, entity: str = "ISO_A0",
                           file_pattern: str = r"([A-Z]{3})[^/]*$") -> DataFrame:
    """Read whole JSON documents; the entity comes from the document or the file name."""
    docs = spark.read.schema(DOC_SCHEMA).option("multiLine", True).json(path)
    from_name = F.regexp_extract(F.input_file_name(), file_pattern, 1)
    return docs.withColumn(entity, F.coalesce(F.col("ISO_A0"), F.nullif(from_name, F.lit(""))))


def parse_documents(docs: DataFrame, entity: str = "ISO_A0", months_only: bool = True,
                    missing_sentinel: float | None = None) -> DataFrame:
    """One frame of weather rows and error rows, from one pass over the documents.

    A good row has (entity, year, month, temperature_c, precipitation_mm) for a
    'YYYYMM' key of T2M with a precipitation value (PRECTOTCORR, else PRECTOT
    for the whole document) and a null ``error``.  A document that is damaged
    (column ``_corrupt_record``), has no T2M or yields no row gives one row
    with its ``error`` and nulls.  Months without precipitation are skipped.
    """
    params = F.col("properties.parameter")
    temp = F.try_element_at(params, F.lit(TEMPERATURE_PARAM))
    precip = F.coalesce(*[F.try_element_at(params, F.lit(p)) for p in PRECIP_PARAMS])
    damaged = F.col("_corrupt_record").isNotNull() if "_corrupt_record" in docs.columns else F.lit(False)
    months = F.transform(F.map_entries("_pw_t"), lambda e: F.struct(
        e["key"].alias("key"), e["value"].alias("temperature_c"), F.try_element_at("_pw_p", e["key"]).alias("precipitation_mm")))
    valid, year, month = split_yyyymm("_pw_r.key")
    docs = docs.select(entity, damaged.alias("_pw_damaged"), temp.alias("_pw_t"), precip.alias("_pw_p"))
    usable = F.filter(months, lambda m: m["precipitation_mm"].isNotNull() & m["key"].rlike(r"^[0-9]{6}$"))
    docs = docs.withColumn("_pw_rows", usable).withColumn("error", F.when(F.col("_pw_damaged"), DAMAGED)
        .when(F.col("_pw_t").isNull(), NO_TEMPERATURE)
        .when(F.size("_pw_rows") == 0, NO_RECORDS))
    rows = docs.select(entity, "error", F.explode_outer(F.when(F.col("error").isNull(), F.col("_pw_rows"))).alias("_pw_r"))
    rows = rows.select(entity, year.alias("year"), month.alias("month"), "_pw_r.temperature_c", "_pw_r.precipitation_mm",
                       "error", valid.alias("_pw_valid"))
    good = F.col("_pw_valid") & F.col("month").between(1, 12) if months_only else F.col("_pw_valid")
    rows = rows.filter(F.col("error").isNotNull() | good).drop("_pw_valid")
    if missing_sentinel is not None:
        for c in ("temperature_c", "precipitation_mm"):
            rows = rows.withColumn(c, F.when(F.col(c) != F.lit(missing_sentinel), F.col(c)))
    return rows


def documents_to_rows(docs: DataFrame, entity: str = "ISO_A0", months_only: bool = True,
                      missing_sentinel: float | None = None) -> tuple[DataFrame, DataFrame]:
    """S4 as two frames: (weather rows, per-entity errors)."""
    parsed = parse_documents(docs, entity, months_only, missing_sentinel)
    return parsed.filter("error is null").drop("error"), parsed.filter("error is not null").select(entity, "error")


def load_weather(spark: SparkSession, asked: DataFrame, documents: str, store: str, entity: str = "ISO_A0",
                 **parsing) -> DataFrame:
    """S5 with reuse: the stored weather of the asked (entity, year) pairs, after parsing what is missing.

    ``documents``: folder of JSON lines, partitioned by ``entity``.  ``store``
    holds ``data`` (partitioned by entity), ``coverage`` and ``errors``.
    """
    known = _stored(spark, f"{store}/coverage", f"{entity} string, year int")
    missing = cut_lineage(asked.select(entity, F.col("year").cast("int").alias("year")).distinct()
                               .join(known, [entity, "year"], "left_anti"))
    if not missing.isEmpty():
        wanted = missing.select(entity).distinct()
        schema = StructType([*[f for f in DOC_SCHEMA.fields if f.name != entity],
                             StructField(entity, StringType()), StructField("_corrupt_record", StringType())])
        docs = spark.read.schema(schema).json(documents).join(wanted, entity, "left_semi")
        parsed = cut_lineage(parse_documents(docs, entity, **parsing))  # once, for rows and errors
        errors = parsed.filter("error is not null").select(entity, "error")
        rows = parsed.filter("error is null").drop("error").join(missing, [entity, "year"], "left_semi")
        rows.write.mode("append").partitionBy(entity).parquet(f"{store}/data")
        errors.withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{store}/errors")
        seen = parsed.filter("error is null").select(entity).distinct()
        missing.join(seen, entity, "left_semi").write.mode("append").parquet(f"{store}/coverage")
    kinds = f"{entity} string, year int, month int, temperature_c double, precipitation_mm double"
    return _stored(spark, f"{store}/data", kinds).join(
        asked.select(entity, F.col("year").cast("int").alias("year")).distinct(), [entity, "year"], "left_semi")


def weather_errors(spark: SparkSession, store: str, entity: str = "ISO_A0") -> DataFrame:
    """(entity, error) of the latest try of every entity that has never been covered."""
    tries = _stored(spark, f"{store}/errors", f"{entity} string, error string, at timestamp")
    covered = _stored(spark, f"{store}/coverage", f"{entity} string, year int")
    return (tries.groupBy(entity).agg(F.max_by("error", "at").alias("error"))
                 .join(covered, entity, "left_anti"))


def _stored(spark: SparkSession, path: str, kinds: str) -> DataFrame:
    """A stored table, or an empty one where nothing is written yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], kinds)
    return spark.read.schema(kinds).parquet(path)


def write_weather_store(df: DataFrame, path: str, entity: str = "ISO_A0") -> None:
    """Parquet store partitioned by entity; only the entities present are replaced."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(entity).parquet(path))


def read_weather_store(spark: SparkSession, path: str, entities=None, first_year: int | None = None,
                       entity: str = "ISO_A0") -> DataFrame:
    """S5 read with partition pruning on entity and a pushed-down year filter."""
    df = spark.read.parquet(path)
    if entities is not None:
        df = df.filter(F.col(entity).isin(list(entities)))
    if first_year is not None:
        df = df.filter(F.col("year") >= F.lit(first_year))
    return df
