"""Prediction history as requests arrive (T5): equal to brute force after every batch, replay and crash."""

import os
import random
import tempfile

import pytest

from panelwarn.streaming.history import PredictionHistory


def newest(rows, k):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    return sorted((g[0] is None, g) for rows_ in groups.values()
                  for g in sorted(rows_, key=lambda r: (r[1], r[2]), reverse=True)[:k])


def stored(spark, history):
    return sorted((r["user"] is None, (r["user"], r["ts"], r["id"])) for r in history.read(spark).collect())


def key(found):
    return [(missing, tuple(-1 if v is None else v for v in row)) for missing, row in found]


def test_batches_replays_and_crashes(spark):
    rng = random.Random(4)
    history = PredictionHistory(tempfile.mkdtemp(prefix="pw-hist-") + "/h", ["user"], k=3, ts="ts", tiebreak="id", fanout=2)
    seen, serial = [], 0
    for batch in range(7):
        rows = []
        for _ in range(rng.choice([0, 5, 30])):  # one key takes a third, times tie
            rows.append((rng.choice([1, 1, None, 2, 3]), rng.randint(0, 6), serial))
            serial += 1
        seen += rows
        df = spark.createDataFrame(rows, "user long, ts long, id long")
        history.add(df, batch)
        if batch == 3:  # the merge of all four was cut short, its parts are still there
            os.remove(f"{history.folder}/run-0-3-2/_SUCCESS")
            assert key(stored(spark, history)) == key(newest(seen, 3))
        history.add(df, batch)  # replayed
        assert key(stored(spark, history)) == key(newest(seen, 3))
        levels = [r[2] for r in history.cover(history.runs(spark))]
        assert len(set(levels)) == len(levels)  # never two runs of one level with fanout 2


def test_cover():
    runs = [(0, 0, 0), (0, 3, 2), (2, 3, 1), (4, 4, 0), (4, 5, 1), (6, 6, 0)]
    assert PredictionHistory.cover(runs) == [(0, 3, 2), (4, 5, 1), (6, 6, 0)]


def test_nothing_kept(spark):
    with pytest.raises(ValueError, match="no history"):
        PredictionHistory(tempfile.mkdtemp() + "/none", ["user"]).read(spark)
