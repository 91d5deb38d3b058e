"""Order-dependent primitives that stay distributed when one group is huge.

``row_number() over (partition by g order by o)`` puts a whole group into one
task, and ``Window.partitionBy()`` with no key puts the whole table there.  The
helpers here get the same exact answers with a range shuffle instead:

1. ``repartitionByRange`` on (group, order) splits every group, however hot,
   across range partitions of similar size, and each partition is sorted.
2. ``monotonically_increasing_id`` then follows that total order.
3. A per-(group, partition) count table (at most #groups + #partitions rows)
   gives each piece its offset inside the group.  It is joined back without a
   broadcast hint: AQE broadcasts it at run time when it is small and keeps a
   shuffle join (keys bounded by one range partition, so no skew) otherwise.

The range bounds come from a sample seeded by the RDD id, so two evaluations
of the same ``repartitionByRange`` may cut differently.  The numbered frame is
therefore written once to the reliable checkpoint folder and both consumers
(piece counts and the join back) read that single materialisation; this also
keeps the numbering stable when an executor is lost and tasks are retried.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwarn.session import cut_lineage

_PID, _MID, _M0, _OFF = "_pw_pid", "_pw_mid", "_pw_m0", "_pw_off"


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def _ranged(df: DataFrame, by: Sequence[str], order: Sequence, num_partitions: int | None):
    keys = _cols(by) + _cols(order)
    # without a number, adaptive execution sizes the ranges by the data
    parts = [num_partitions] if num_partitions else []
    ranged = df.repartitionByRange(*parts, *keys).sortWithinPartitions(*keys)
    ranged = ranged.withColumn(_PID, F.spark_partition_id()).withColumn(_MID, F.monotonically_increasing_id())
    return cut_lineage(ranged)


def _piece_offsets(ranged: DataFrame, by: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """One row per (group, range partition): first id, rows and sums before it in the group."""
    aggs = [F.min(_MID).alias(_M0), F.count(F.lit(1)).alias("_pw_n")]
    aggs += [F.sum(c).alias(f"_pw_s_{c}") for c in sums]
    stats = ranged.groupBy(*by, _PID).agg(*aggs)
    before = Window.partitionBy(*by).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    out = stats.withColumn(_OFF, F.coalesce(F.sum("_pw_n").over(before), F.lit(0)))
    for c in sums:
        out = out.withColumn(f"_pw_b_{c}", F.coalesce(F.sum(f"_pw_s_{c}").over(before), F.lit(0)))
    renamed = {b: f"_pw_k_{i}" for i, b in enumerate(by)}
    for b, r in renamed.items():
        out = out.withColumnRenamed(b, r)
    return out.drop("_pw_n", *[f"_pw_s_{c}" for c in sums]), renamed


def _join_offsets(ranged: DataFrame, stats: DataFrame, renamed: dict[str, str]) -> DataFrame:
    cond = ranged[_PID] == stats[_PID]
    for b, r in renamed.items():
        cond = cond & ranged[b].eqNullSafe(stats[r])
    return ranged.join(stats, cond).drop(stats[_PID]).drop(*renamed.values())


def exact_row_number(df: DataFrame, by: Sequence[str], order: Sequence, out: str = "row_number",
                     num_partitions: int | None = None) -> DataFrame:
    """Exact 1-based ``row_number() over (partition by by order by order)``.

    ``order`` must make rows unique inside a group for a reproducible answer.
    """
    ranged = _ranged(df, by, order, num_partitions)
    stats, renamed = _piece_offsets(ranged, by)
    joined = _join_offsets(ranged, stats, renamed)
    return joined.withColumn(out, (F.col(_OFF) + F.col(_MID) - F.col(_M0) + 1).cast("long")) \
                 .drop(_PID, _MID, _M0, _OFF)


def prefix_sums(df: DataFrame, by: Sequence[str], order: Sequence, cols: Sequence[str],
                inclusive: bool = True, num_partitions: int | None = None,
                suffix: str = "_cum") -> DataFrame:
    """Running sums of ``cols`` within each group in ``order`` (exact, distributed).

    Within a range partition the running sum is a window over (group, partition),
    whose size is bounded by one range partition; earlier partitions contribute a
    carried offset from the small piece table.
    """
    ranged = _ranged(df, by, order, num_partitions)
    stats, renamed = _piece_offsets(ranged, by, sums=cols)
    joined = _join_offsets(ranged, stats, renamed)
    frame = (Window.unboundedPreceding, 0) if inclusive else (Window.unboundedPreceding, -1)
    local = Window.partitionBy(*by, _PID).orderBy(_MID).rowsBetween(*frame)
    out = joined.withColumns({
        f"{c}{suffix}": F.col(f"_pw_b_{c}") + F.coalesce(F.sum(c).over(local), F.lit(0)) for c in cols
    })
    return out.drop(_PID, _MID, _M0, _OFF, *[f"_pw_b_{c}" for c in cols])


#: Accuracy of the rank sketch: its error is below rows / ACCURACY.
ACCURACY = 2_000
#: Brackets of at most so many groups are broadcast (some ten megabytes); beyond, they are joined by shuffle.
BROADCAST_GROUPS = 50_000


def exact_quantiles(long_df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float],
                    num_partitions: int | None = None) -> DataFrame:
    """Linear-interpolated quantiles (pandas / ``quantile_cont``) per group, exact.

    ``long_df`` holds one value per row (unpivot wide tables first).  A mergeable
    rank sketch brackets every wanted rank between two values; one pass counts
    the rows below each bracket and, map-side first, the rows of each value in
    it, so equal values are one row before any shuffle.  Running counts over the
    few distinct values inside a bracket then give the value at the exact rank.
    Output: ``by`` + ``prob`` + ``quantile``; missing values are left out.
    """
    if not by:  # one group, by a constant key
        whole = long_df.select(F.lit(1).alias("_pw_all"), F.col(value).alias("value"))
        return exact_quantiles(whole, ["_pw_all"], "value", probs, num_partitions).drop("_pw_all")
    vals = long_df.select(*by, F.col(value).cast("double").alias("_pw_v"))
    vals = vals.filter(F.col("_pw_v").isNotNull() & ~F.isnan("_pw_v"))
    probs = [float(p) for p in probs]
    edge = 3.0 / ACCURACY  # covers the sketch's error and two more ranks once a group has ACCURACY rows
    asked = [x for p in probs for x in (max(p - edge, 0.0), min(p + edge, 1.0))]
    sketch = vals.groupBy(*by).agg(F.count(F.lit(1)).alias("_pw_cnt"),
                                   F.percentile_approx("_pw_v", asked, ACCURACY).alias("_pw_a"),
                                   F.min("_pw_v").alias("_pw_min"), F.max("_pw_v").alias("_pw_max"))
    brackets = []
    for i, p in enumerate(probs):
        small = F.col("_pw_cnt") <= ACCURACY  # its whole range is a short bracket
        low = F.col("_pw_min") if p - edge <= 0 else F.when(small, F.col("_pw_min")).otherwise(F.col("_pw_a")[2 * i])
        high = F.col("_pw_max") if p + edge >= 1 else F.when(small, F.col("_pw_max")).otherwise(F.col("_pw_a")[2 * i + 1])
        brackets += [low.alias(f"_pw_lo{i}"), high.alias(f"_pw_hi{i}")]
    per = cut_lineage(sketch.select(*by, "_pw_cnt", *brackets))
    side = per.select(*[F.col(b).alias(f"_pw_g_{i}") for i, b in enumerate(by)],
                      *[c for c in per.columns if c.startswith(("_pw_lo", "_pw_hi"))])
    if per.count() <= BROADCAST_GROUPS:
        side = F.broadcast(side)
    cond = None
    for i, b in enumerate(by):
        c = vals[b].eqNullSafe(side[f"_pw_g_{i}"])
        cond = c if cond is None else cond & c
    v = F.col("_pw_v")
    within = [v.between(F.col(f"_pw_lo{i}"), F.col(f"_pw_hi{i}")) for i in range(len(probs))]
    any_within = within[0]
    for w in within[1:]:
        any_within = any_within | w
    # one row a value inside some bracket, and one for all values outside
    counted = vals.join(side, cond).groupBy(*by, F.when(any_within, v).alias("_pw_w")).agg(
        F.count(F.lit(1)).alias("_pw_n"),
        *[F.sum((v < F.col(f"_pw_lo{i}")).cast("long")).alias(f"_pw_b{i}") for i in range(len(probs))])
    counted = cut_lineage(counted)
    below = counted.groupBy(*by).agg(*[F.sum(f"_pw_b{i}").alias(f"_pw_b{i}") for i in range(len(probs))])
    targets = _null_safe_left(per, below, by, [f"_pw_b{i}" for i in range(len(probs))])
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("_pw_i"), F.lit(p).alias("prob"), F.col(f"_pw_lo{i}").alias("_pw_low"),
                                        F.col(f"_pw_hi{i}").alias("_pw_high"), F.col(f"_pw_b{i}").alias("_pw_below"))
                               for i, p in enumerate(probs)])).alias("_pw_s")
    targets = cut_lineage(targets.select(*by, "_pw_cnt", each).select(*by, "_pw_cnt", "_pw_s.*"))
    inside = _null_safe_left(counted.filter(F.col("_pw_w").isNotNull()).select(*by, F.col("_pw_w").alias("_pw_v"), "_pw_n"),
                             targets, by, ["_pw_i", "_pw_low", "_pw_high"])
    inside = inside.filter(F.col("_pw_v").between(F.col("_pw_low"), F.col("_pw_high"))).select(*by, "_pw_i", "_pw_v", "_pw_n")
    cum = prefix_sums(inside, [*by, "_pw_i"], ["_pw_v"], ["_pw_n"], num_partitions=num_partitions, suffix="_to")
    pos = (F.col("_pw_cnt") - 1) * F.col("prob")
    targets = targets.select(*by, "_pw_i", "prob", (F.floor(pos) + 1).alias("_pw_lo"), (F.ceil(pos) + 1).alias("_pw_hi"),
                             (pos - F.floor(pos)).alias("_pw_frac"), F.coalesce("_pw_below", F.lit(0)).alias("_pw_below"))
    both = _null_safe_left(targets, cum.select(*by, "_pw_i", "_pw_v", "_pw_n", "_pw_n_to"), [*by, "_pw_i"],
                           ["_pw_v", "_pw_n", "_pw_n_to"])
    first, last = F.col("_pw_below") + F.col("_pw_n_to") - F.col("_pw_n") + 1, F.col("_pw_below") + F.col("_pw_n_to")
    holds = lambda rank: F.max(F.when((first <= F.col(rank)) & (F.col(rank) <= last), F.col("_pw_v")))
    res = both.groupBy(*by, "prob", "_pw_frac").agg(holds("_pw_lo").alias("_pw_x"), holds("_pw_hi").alias("_pw_y"))
    q = F.col("_pw_x") + (F.col("_pw_y") - F.col("_pw_x")) * F.col("_pw_frac")
    return res.select(*by, "prob", q.alias("quantile"))


#: Values of one column inside a bracket that are brought to the driver.
BRACKET_VALUES = 20_000


def wide_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                   extra: dict[str, Column] | None = None) -> tuple[dict[tuple[str, float], float], dict]:
    """({(column, prob): quantile}, one-row aggregates) of numeric columns whose missing values are NULL.

    The first pass over the table gives counts, bounds, the rank sketch of all
    columns together and the ``extra`` aggregates.  Each further pass counts,
    for every open rank, the values below, at the ends of and inside its
    bracket; the values inside one of at most ``BRACKET_VALUES`` rows come to
    the driver (counted, so that equal ones are one row), a larger one is
    narrowed by a sketch of its own.  A pass is one map-side aggregate, without unpivoting, sorting or
    writing the table, and narrows a bracket by ACCURACY / 6.  A column without
    values has no quantiles.
    """
    probs = [float(p) for p in probs]
    edge = 3.0 / ACCURACY
    cut = lambda x: max(0.0, min(1.0, x))
    asked = [cut(x) for p in probs for x in (p - edge, p + edge)]
    first = []
    for i, c in enumerate(cols):
        first += [F.count(c).alias(f"_n{i}"), F.min(c).alias(f"_min{i}"), F.max(c).alias(f"_max{i}"),
                  F.percentile_approx(c, asked, ACCURACY).alias(f"_a{i}")]
    row = df.agg(*first, *[e.alias(k) for k, e in (extra or {}).items()]).first().asDict()

    open_, ranks, value = {}, {}, {}
    for i, c in enumerate(cols):
        n = row[f"_n{i}"]
        for j, p in enumerate(probs if n else ()):
            whole = n <= ACCURACY
            low = row[f"_min{i}"] if whole or p - edge <= 0 else row[f"_a{i}"][2 * j]
            high = row[f"_max{i}"] if whole or p + edge >= 1 else row[f"_a{i}"][2 * j + 1]
            at = (n - 1) * p
            ranks[c, p] = (int(at) + 1, min(int(at) + 2, n), at - int(at))
            for r in set(ranks[c, p][:2]):
                open_[c, r] = (low, high)
    while open_:
        # ranks of one column that share a bracket are counted once; its ends are counted apart, so that it
        # shrinks in every pass, however often they occur
        brackets = sorted({(c, *b) for (c, _), b in open_.items()})
        counted = []
        for i, (c, low, high) in enumerate(brackets):
            x, between = F.col(c), (F.col(c) > low) & (F.col(c) < high)
            sums = {"below": x < low, "low": x == low, "inner": between}
            counted += [F.coalesce(F.sum(e.cast("long")), F.lit(0)).alias(f"{k}{i}") for k, e in sums.items()]
            counted += [F.min(F.when(between, x)).alias(f"first{i}"), F.max(F.when(between, x)).alias(f"last{i}")]
        got = df.agg(*counted).first()
        inner: dict = {}  # bracket -> (ranks inside it, rows before, rows in it)
        for (c, r), (low, high) in list(open_.items()):
            i = brackets.index((c, low, high))
            before = got[f"below{i}"] + got[f"low{i}"]
            if r <= before or r > before + got[f"inner{i}"]:
                value[c, r] = float(low if r <= before else high)
                del open_[c, r]
            else:
                inner.setdefault((c, got[f"first{i}"], got[f"last{i}"]), ([], before, got[f"inner{i}"]))[0].append(r)
        within = {b: F.col(b[0]).between(F.lit(b[1]), F.lit(b[2])) for b in inner}
        gather = [b for b in inner if inner[b][2] <= BRACKET_VALUES]
        if gather:
            hits = F.filter(F.array(*[F.when(within[b], F.struct(F.lit(i).alias("i"), F.col(b[0]).cast("double").alias("v")))
                                      for i, b in enumerate(gather)]), lambda x: x.isNotNull())
            found = df.select(F.explode(hits).alias("x")).groupBy("x.i", "x.v").count().collect()
            for i, b in enumerate(gather):
                ranks_in, reached, _ = inner.pop(b)
                for v, k in sorted((r["v"], r["count"]) for r in found if r["i"] == i):
                    for r in [r for r in ranks_in if reached < r <= reached + k]:
                        value[b[0], r] = v
                        del open_[b[0], r]
                    reached += k
        if inner:
            narrow = list(inner.items())
            shares = [[cut((r - before) / n + d) for r in mine for d in (-edge, edge)] for _, (mine, before, n) in narrow]
            got = df.agg(*[F.percentile_approx(F.when(within[b], F.col(b[0])), x, ACCURACY).alias(f"s{i}")
                           for i, ((b, _), x) in enumerate(zip(narrow, shares))]).first()
            for i, (b, (mine, _, _)) in enumerate(narrow):
                for j, r in enumerate(mine):
                    low, high = got[f"s{i}"][2 * j], got[f"s{i}"][2 * j + 1]
                    # a share of 0 or 1 means the bracket's own end
                    open_[b[0], r] = (b[1] if shares[i][2 * j] == 0 else low, b[2] if shares[i][2 * j + 1] == 1 else high)
    done = {(c, p): value[c, lo] + (value[c, hi] - value[c, lo]) * part for (c, p), (lo, hi, part) in ranks.items()}
    return done, row


def _null_safe_left(left: DataFrame, right: DataFrame, keys: Sequence[str], take: Sequence[str]) -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"_pw_r_{i}") for i, k in enumerate(keys)], *take)
    cond = None
    for i, k in enumerate(keys):
        c = left[k].eqNullSafe(renamed[f"_pw_r_{i}"])
        cond = c if cond is None else cond & c
    return left.join(renamed, cond, "left").drop(*[f"_pw_r_{i}" for i in range(len(keys))])
