"""Small helpers shared by the training-data operators.

* ``saved`` writes an intermediate table once, as Parquet, below the shared
  folder named by ``spark.checkpoint.dir`` and reads it back.  It cuts lineage
  like ``checkpoint()`` but is compressed and column-pruned, and it survives
  the loss of any executor.
* ``sorted_groups`` walks an Arrow stream that Spark has partitioned and sorted
  by a key, in whole groups, holding one block of groups at a time.
* ``pair_blocks`` splits the rows of over-large groups so that every pair of
  rows still meets in some block and no block exceeds a fixed size.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwarn.session import checkpoint_dir

#: A word, everywhere: a maximal run of bytes that are neither blank nor \x09-\x0D.
#: ``bytes.split()`` splits at exactly those six bytes.
WORD = r"[^\x20\x09-\x0D]+"


#: The list that ``saved_at`` notes its paths in, where a caller has asked for one (see ``noted``).
_NOTED: ContextVar[list[str] | None] = ContextVar("panelwarn_noted", default=None)


@contextmanager
def noted() -> Iterator[list[str]]:
    """The paths that ``saved_at`` writes inside this block (of this thread or task), oldest first.

    The caller owns them: it deletes them with ``discard`` once their readers are done.
    """
    paths: list[str] = []
    token = _NOTED.set(paths)
    try:
        yield paths
    finally:
        _NOTED.reset(token)


def scratch_root(spark: SparkSession) -> str:
    """This application's folder below the shared checkpoint folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or checkpoint_dir(spark)
    return f"{configured.rstrip('/')}/panelwarn-{spark.sparkContext.applicationId}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it read back."""
    return saved_at(df, name)[0]


def saved_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if (paths := _NOTED.get()) is not None:
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables written by ``saved_at`` whose readers are done."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, as ``--py-files`` would; once an application."""
    sc = spark.sparkContext
    if getattr(sc, "_panelwarn_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="panelwarn-py-")) / "panelwarn_pkg.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    sc._panelwarn_shipped = True


def documents(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns of a documents table only, so that extra columns never clash."""
    ship_package(docs.sparkSession)
    return docs.select(*[docs[c] for c in columns])


def text_bytes(name: str = "text") -> Column:
    """The UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b"").cast("binary"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def running(df: DataFrame, order: Sequence[str], sums: Sequence[str] = (), name: str = "order") -> DataFrame:
    """``df`` with ``row`` (global 0-based position in ``order``) and ``<c>_before`` (sum of the rows before).

    One range shuffle, however hot a key is.  Positions inside a partition are
    counted while the sorted partition is written once; the partitions' totals
    (one row for each range partition) give the offsets.  Column names of
    ``df`` must not be ``row``, ``_pid`` or ``<c>_before``.
    """
    spark = df.sparkSession
    # no fixed number: adaptive execution joins small neighbouring ranges
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    before = [f"{c}_before" for c in sums]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, at, totals = TaskContext.get().partitionId(), 0, [0] * len(sums)
        for batch in batches:
            k = batch.num_rows
            more = [pa.array(np.full(k, pid, np.int32)), pa.array(np.arange(at, at + k, dtype=np.int64))]
            for i, c in enumerate(sums):
                values = batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                more.append(pa.array(np.cumsum(values) - values + totals[i]))
                totals[i] += int(values.sum())
            at += k
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "_pid", "row", *before])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    kinds += ["_pid int", "row long", *[f"`{b}` long" for b in before]]
    numbered = saved(ordered.mapInArrow(number, ", ".join(kinds)), name)
    totals = (numbered.groupBy("_pid").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s_{c}") for c in sums])
                      .orderBy("_pid").collect())
    starts, at = [], [0] * (1 + len(sums))
    for t in totals:
        starts.append((t["_pid"], *at))
        at = [a + int(b or 0) for a, b in zip(at, t[1:])]
    # as many rows as range partitions
    kinds = ["_pid int", "_row0 long", *[f"`_{b}0` long" for b in before]]
    offsets = F.broadcast(spark.createDataFrame(starts, ", ".join(kinds)))
    joined = numbered.join(offsets, "_pid")
    moved = {"row": F.col("row") + F.col("_row0")} | {b: F.col(b) + F.col(f"_{b}0") for b in before}
    return joined.withColumns(moved).drop("_pid", "_row0", *[f"_{b}0" for b in before])


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str],
                  target: int = 20_000) -> Iterator[pa.Table]:
    """Blocks of about ``target`` rows, cut only between different keys.

    The stream must be sorted by ``keys``; the bound on a group's size is the
    caller's (see ``pair_blocks``).
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < target:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cols = [np.asarray(table.column(k).to_numpy(zero_copy_only=False)) for k in keys]
        change = np.zeros(rows - 1, dtype=bool) if rows > 1 else np.zeros(0, dtype=bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        cuts = np.flatnonzero(change)
        if len(cuts):
            cut = int(cuts[-1]) + 1
            yield table.slice(0, cut)
            rest = table.slice(cut)
            held, rows = rest.to_batches(), rest.num_rows
        else:
            held = table.to_batches()
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def pair_blocks(df: DataFrame, keys: Sequence[str], unit: Sequence[str], limit: int,
                counted: DataFrame | None = None) -> DataFrame:
    """Add ``block`` so that (keys, block) holds at most about ``limit`` rows.

    A group of n rows is dealt by a hash of ``unit`` into b = ceil(2n / limit)
    parts; each pair of parts is one block, so every pair of rows meets at
    least once and each row is copied b times.  Groups within the limit are
    one block.  The list of large groups holds at most rows / limit entries
    and is left to the planner to broadcast or shuffle.  ``counted`` may give
    the same rows' keys at less cost.
    """
    large = ((df if counted is None else counted).groupBy(*keys).count().filter(F.col("count") > limit)
               .select(*[F.col(k).alias(f"_pb_{k}") for k in keys],
                       F.ceil(F.col("count") * 2 / F.lit(limit)).cast("int").alias("_pb_parts")))
    cond = None
    for k in keys:
        c = df[k].eqNullSafe(large[f"_pb_{k}"])
        cond = c if cond is None else cond & c
    joined = df.join(large, cond, "left")
    own = F.pmod(F.xxhash64(*[F.col(u) for u in unit]), F.col("_pb_parts").cast("long")).cast("int")
    other = F.sequence(F.lit(0), F.col("_pb_parts") - 1)
    blocks = F.transform(other, lambda o: F.least(own, o) * F.lit(100_003) + F.greatest(own, o))
    return (joined.withColumn("block", F.explode(F.when(F.col("_pb_parts").isNull(), F.array(F.lit(0)))
                                                  .otherwise(blocks)))
                  .drop("_pb_parts", *[f"_pb_{k}" for k in keys]))
