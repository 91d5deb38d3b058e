"""T5 on arriving requests: the newest k predictions of every key, kept across restarts.

A micro-batch leaves one run in the history folder: its own newest k rows of a
key, however many rows the key has (the rank limit is planned below the shuffle
too).  ``fanout`` runs of one level merge into a run of the next, so a row is
rewritten a logarithmic number of times and a reader joins few runs; no batch
rewrites the whole history.  A run names the batches that it covers and counts
once its ``_SUCCESS`` is there, so a replayed batch and a merge cut short by a
crash change nothing.  Superseded runs go with the next batch: a frame that was
read before a merge stays readable until then.

One stream writes a folder.  Rows with a null key are a key of their own; ties
in time are broken by ``tiebreak``; without a run there is nothing to read.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwarn.operators.profile import top_k_per_group

_RUN = re.compile(r"^run-(\d+)-(\d+)-(\d+)$")


class PredictionHistory:
    """The newest ``k`` rows of each key in ``by``, in runs below ``folder``."""

    def __init__(self, folder: str, by: Sequence[str], k: int = 10, ts: str = "scored_at",
                 tiebreak: str = "request_id", fanout: int = 8):
        self.folder, self.by, self.k, self.fanout = folder.rstrip("/"), list(by), k, fanout
        self.order = [F.desc(ts), F.desc(tiebreak)]

    def _files(self, spark: SparkSession, path: str):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(spark._jsc.hadoopConfiguration()), target

    def runs(self, spark: SparkSession) -> list[tuple[int, int, int]]:
        """(first batch, last batch, level) of every finished run."""
        fs, folder = self._files(spark, self.folder)
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        found = [tuple(map(int, m.groups())) for m in map(_RUN.match, names) if m]
        return [r for r in found if fs.exists(self._files(spark, f"{self._path(r)}/_SUCCESS")[1])]

    @staticmethod
    def cover(runs: Sequence[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """The widest runs, in order, that hold every batch once."""
        kept: list[tuple[int, int, int]] = []
        for run in sorted(runs, key=lambda r: (r[0], -r[1], -r[2])):
            if not kept or run[0] > kept[-1][1]:
                kept.append(run)
        return kept

    def _path(self, run: tuple[int, int, int]) -> str:
        return f"{self.folder}/run-{run[0]}-{run[1]}-{run[2]}"

    def _newest(self, rows: DataFrame) -> DataFrame:
        return top_k_per_group(rows, self.by, self.order, self.k)

    def _union(self, spark: SparkSession, runs: Sequence[tuple[int, int, int]]) -> DataFrame:
        return spark.read.parquet(*[self._path(r) for r in runs])

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Enter a micro-batch (the function for ``foreachBatch``)."""
        spark = rows.sparkSession
        runs = self.runs(spark)
        cover = self.cover(runs)
        for run in set(runs) - set(cover):
            fs, path = self._files(spark, self._path(run))
            fs.delete(path, True)
        if not cover or cover[-1][1] < batch_id:  # else replayed after a restart
            cover.append((batch_id, batch_id, 0))
            self._newest(rows).drop("rank").write.mode("overwrite").parquet(self._path(cover[-1]))
        while len(cover) >= self.fanout and len({r[2] for r in cover[-self.fanout:]}) == 1:
            last = cover[-self.fanout:]
            merged = (last[0][0], last[-1][1], last[0][2] + 1)
            self._newest(self._union(spark, last)).drop("rank").write.mode("overwrite").parquet(self._path(merged))
            cover[-self.fanout:] = [merged]

    def read(self, spark: SparkSession) -> DataFrame:
        """The newest k rows of every key, with their ``rank``."""
        cover = self.cover(self.runs(spark))
        if not cover:
            raise ValueError(f"no history in {self.folder}")
        return self._newest(self._union(spark, cover))


def keep_history(stream: DataFrame, history: PredictionHistory, checkpoint: str, available_now: bool = True):
    """Start keeping the history of a stream of predictions; a restart goes on from ``checkpoint``."""
    writer = stream.writeStream.foreachBatch(history.add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()
