"""Sequences, splits and resampling."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwarn.operators.windows import PanelSpec, apply_panel_window


def lookback_sequences(df: DataFrame, spec: PanelSpec, features: Sequence[str], target: str,
                       lookback: int = 12, out: str = "seq", **window_kw) -> DataFrame:
    """For row i the ``lookback`` previous rows' feature vectors, target at i.

    Entities with at most ``lookback`` rows yield no sequence.  The frame is
    bounded, so hot entities can go through the blocked window path: pass
    ``block_rows`` (see ``apply_panel_window``); without it, one task has an entity.
    """
    vec = F.array(*[F.col(c).cast("double") for c in features])

    def build(w, idx):
        return {out: F.collect_list(vec).over(w.rowsBetween(-lookback, -1)), "_pw_i": idx}

    seq = apply_panel_window(df, spec, build, lookback=lookback, **window_kw)
    return (seq.filter(F.col("_pw_i") > lookback)
               .select(spec.entity, *spec.order, out, target))


def standardize_within(df: DataFrame, by: Sequence[str], cols: Sequence[str], suffix: str = "",
                       ddof: int = 0, fit_on: DataFrame | None = None) -> DataFrame:
    """(x - mean) / std per group over its full history; std 0 -> 1.

    ``fit_on`` (e.g. the training rows) gives the statistics instead, so that
    nothing of the other rows leaks; a group it lacks takes its overall ones.

    Group statistics come from a partial aggregate (safe for hot groups) and
    are joined back; the statistics table has one row per group.
    """
    std = F.stddev_pop if ddof == 0 else F.stddev_samp
    aggs = [*[F.avg(c).alias(f"_pw_m_{c}") for c in cols], *[std(c).alias(f"_pw_s_{c}") for c in cols]]
    j = df.join((df if fit_on is None else fit_on).groupBy(*by).agg(*aggs), list(by), "left")
    whole = fit_on.agg(*aggs).first().asDict() if fit_on is not None else {}
    outs = {}
    for c in cols:
        m, s = F.col(f"_pw_m_{c}"), F.col(f"_pw_s_{c}")
        if whole:
            s = F.when(m.isNull(), F.lit(whole[f"_pw_s_{c}"])).otherwise(s)
            m = F.coalesce(m, F.lit(whole[f"_pw_m_{c}"]))
        div = F.when(s.isNull() | (s == 0), F.lit(1.0)).otherwise(s)
        outs[f"{c}{suffix}"] = (F.col(c) - m) / div
    return j.withColumns(outs).drop(*[f"_pw_m_{c}" for c in cols], *[f"_pw_s_{c}" for c in cols])


def flatten_sequences(seq_col: str = "seq") -> F.Column:
    """M5: ARRAY<ARRAY<DOUBLE>> [L, F] -> ARRAY<DOUBLE> [L*F]."""
    return F.flatten(F.col(seq_col))


def reshape_sequences(flat_col: str, steps: int, width: int) -> F.Column:
    """M5: ARRAY<DOUBLE> [L*F] -> ARRAY<ARRAY<DOUBLE>> [L, F]."""
    return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)),
                       lambda i: F.slice(F.col(flat_col), i * width + 1, width))


# ------------------------------------------------------------------- splits
SPLIT_SEED = 42
TEST_SIZE = 0.2
VAL_SIZE = 0.2


def hash_order_key(id_col: str, seed: int = SPLIT_SEED):
    """Deterministic pseudo-random sort key md5('<id>-<seed>') (same text in DuckDB)."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"-{seed}")))


def uniform_from_hash(id_col: str, seed: int = SPLIT_SEED, salt: str = ""):
    """A number in [0, 1) from the first 8 hex digits of md5('<id>-<seed><salt>')."""
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f"-{seed}{salt}")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def stratified_quotas(counts: dict, fraction: float) -> dict:
    """Per-class sample sizes summing to ceil(fraction * n), by largest remainder.

    Ties of the remainder go to the smaller class label (deterministic).
    """
    import math
    n = sum(counts.values())
    total = math.ceil(fraction * n)
    base = {c: (total * k) // n for c, k in counts.items()}
    rem = {c: (total * k) % n for c, k in counts.items()}
    left = total - sum(base.values())
    for c in sorted(counts, key=lambda c: (-rem[c], c is None, c))[:left]:
        base[c] += 1
    return base


#: Hash values that a bracket may hold when it is brought to the driver.
BRACKET_ROWS = 1000


def _bracketed(rows: DataFrame, targets: dict, digits: int) -> dict:
    """{(class, rank): the rank-th smallest ``_pw_h`` of that class}, by counting ever longer prefixes.

    Each round counts, for every target, the rows below each prefix of its
    bracket and keeps the one prefix that holds the rank; a bracket of at most
    ``BRACKET_ROWS`` rows is brought to the driver and its value picked.  Every
    round is one scan with a map-side count; no row is moved or written.
    """
    found, at = {}, {t: ("", t[1]) for t in targets}  # bracket prefix, rank inside it
    sizes = dict(targets)
    while at:
        small = {t for t in at if sizes[t] <= BRACKET_ROWS}
        inside = lambda ts: reduce(or_, [F.col("_pw_c").eqNullSafe(F.lit(c)) & F.col("_pw_h").startswith(p)
                                         for c, p in sorted({(t[0], at[t][0]) for t in ts}, key=str)])
        if small:
            values: dict = {}
            for r in rows.filter(inside(small)).select("_pw_c", "_pw_h").collect():
                values.setdefault(r["_pw_c"], []).append(r["_pw_h"])
            for t in small:
                prefix, rank = at.pop(t)
                found[t] = sorted(h for h in values[t[0]] if h.startswith(prefix))[rank - 1]
        if at:
            counts: dict = {}
            width = max(len(p) for p, _ in at.values()) + digits
            for r in rows.filter(inside(at)).groupBy("_pw_c", F.substring("_pw_h", 1, width).alias("p")).count().collect():
                counts.setdefault(r["_pw_c"], []).append((r["p"], r["count"]))
            for t, (prefix, rank) in list(at.items()):
                for p, n in sorted(x for x in counts[t[0]] if x[0].startswith(prefix)):
                    if rank <= n:
                        at[t], sizes[t] = (p, rank), n
                        break
                    rank -= n
                if len(at[t][0]) < width or at[t][0] == prefix:  # nothing longer: equal values to the end
                    found[t] = at.pop(t)[0]
            digits = 3
    return found


def stratified_split(df: DataFrame, label: str, id_col: str, test_size: float = TEST_SIZE,
                     val_size: float = VAL_SIZE, seed: int = SPLIT_SEED, out: str = "split") -> DataFrame:
    """M1: exact stratified test / val / train assignment (test first, val from the rest).

    Inside a class rows are ordered by md5(id, seed); the first quota rows go to
    test, the next to val.  The two bounding hash values of each class are found
    by counting (``_bracketed``), so the split itself is a comparison: no row is
    numbered, sorted or written.  Rows of one repeated id stay together, on the
    side of its first row; a null id comes first.
    """
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    q_test = stratified_quotas(counts, test_size)
    rest = {c: counts[c] - q_test[c] for c in counts}
    q_val = stratified_quotas(rest, val_size) if val_size else {c: 0 for c in counts}
    key = F.coalesce(hash_order_key(id_col, seed), F.lit(""))
    bounds = {c: (q_test[c], q_test[c] + q_val[c]) for c in counts}
    targets = {(c, rank): counts[c] for c, ranks in bounds.items() for rank in ranks if rank}
    # enough digits that a bracket is expected to be small after the first round
    digits = min(4, max(1, len(f"{max(counts.values(), default=0) * 4 // BRACKET_ROWS:x}")))
    values = _bracketed(df.select(F.col(label).alias("_pw_c"), key.alias("_pw_h")), targets, digits)
    split = F.lit("train")
    for position, part in ((1, "val"), (0, "test")):
        for c, ranks in bounds.items():
            if ranks[position]:
                inside = F.col(label).eqNullSafe(F.lit(c)) & (key <= F.lit(values[c, ranks[position]]))
                split = F.when(inside, F.lit(part)).otherwise(split)
    return df.withColumn(out, split)


def positional_split(df: DataFrame, order: Sequence[str], train: float = 0.8, val: float = 0.9,
                     out: str = "split") -> DataFrame:
    """M2 'positional': global 0-based position in ``order``; cut at int(0.8n), int(0.9n)."""
    from panelwarn.operators.ordering import exact_row_number
    n = df.count()
    a, b = int(train * n), int(val * n)
    pos = exact_row_number(df, [], list(order), out="_pw_pos")
    p0 = F.col("_pw_pos") - 1
    return pos.withColumn(out, F.when(p0 < a, "train").when(p0 < b, "val").otherwise("test")).drop("_pw_pos")


def temporal_split(df: DataFrame, time_col: str, train: float = 0.8, val: float = 0.9,
                   out: str = "split") -> DataFrame:
    """M2 'temporal': cut on time quantiles so every entity contributes to each part."""
    from panelwarn.operators.ordering import exact_quantiles
    q = exact_quantiles(df.select(F.col(time_col).cast("timestamp").cast("double").alias("_t")),
                        [], "_t", [train, val]).orderBy("prob").collect()
    t1, t2 = q[0]["quantile"], q[1]["quantile"]
    t = F.col(time_col).cast("timestamp").cast("double")
    return df.withColumn(out, F.when(t < t1, "train").when(t < t2, "val").otherwise("test"))
