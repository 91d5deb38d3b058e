import itertools
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from panelwarn.llm import common


def test_running_positions_and_sums(spark):
    """Positions are 0..n-1 in order, sums are of the rows before; one value holds most rows."""
    df = spark.range(5000).select((F.col("id") % 7).alias("w"), F.when(F.col("id") % 10 < 8, "hot").otherwise(
        F.col("id").cast("string")).alias("k"), F.xxhash64("id").alias("t"), "id").repartition(9)
    rows = common.running(df, ["k", "t", "id"], ["w"]).collect()
    rows.sort(key=lambda r: r["row"])
    assert [r["row"] for r in rows] == list(range(5000))
    assert [(r["k"], r["t"]) for r in rows] == sorted((r["k"], r["t"]) for r in rows)
    assert [r["w_before"] for r in rows] == list(itertools.accumulate([r["w"] for r in rows], initial=0))[:-1]
    assert common.running(df.limit(0), ["k"]).count() == 0


def test_pair_blocks_cover_every_pair(spark):
    df = spark.createDataFrame([(k, i) for k, n in (("hot", 120), ("small", 9), (None, 60)) for i in range(n)], "k string, i long")
    blocks = defaultdict(set)
    for r in common.pair_blocks(df, ["k"], ["i"], 20).collect():
        assert r["i"] not in blocks[r["k"], r["block"]]
        blocks[r["k"], r["block"]].add(r["i"])
    for k, n in (("hot", 120), ("small", 9), (None, 60)):
        met = {p for (key, _), m in blocks.items() if key == k for p in itertools.combinations(sorted(m), 2)}
        assert met == set(itertools.combinations(range(n), 2))
    assert max(len(m) for m in blocks.values()) < 60  # about 20; parts are dealt by hash


def test_sorted_groups_are_whole():
    keys = [1] * 5 + [2] * 40 + [3, 4, 5] * 1 + [6] * 2
    batches = [pa.RecordBatch.from_pydict({"k": keys[i:i + 7], "v": list(range(i, min(i + 7, len(keys))))})
               for i in range(0, len(keys), 7)]
    batches.insert(2, batches[0].slice(0, 0))
    tables = list(common.sorted_groups(iter(batches), ["k"], 10))
    assert [v for t in tables for v in t.column("v").to_pylist()] == list(range(len(keys)))
    seen = [set(t.column("k").to_pylist()) for t in tables]
    assert all(not a & b for a, b in itertools.combinations(seen, 2)) and len(tables) > 1


def exists(spark, path):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def test_saved_and_discard(spark):
    with common.noted() as paths:
        table, path = common.saved_at(spark.range(5), "test")
        with common.noted() as inner:
            _, other = common.saved_at(spark.range(2), "test")
    assert table.count() == 5 and paths == [path] and inner == [other]
    _, third = common.saved_at(spark.range(2), "test")
    assert paths == [path]
    common.discard(spark, path)
    assert not exists(spark, path) and exists(spark, other) and exists(spark, third)
