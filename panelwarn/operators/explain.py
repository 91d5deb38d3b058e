"""Feature attribution (E6): permutation importance and sampled Shapley values as distributed jobs.

Both are meant for held-out rows.

Permutation importance.  For every feature f the scored rows are copied once
with f's column replaced by a permutation of itself (rank by row id, numbered
once, matched to rank by md5(row, f), an exact distributed row number), the
copies are re-scored together, and
the metric drop per feature is one grouped aggregate.  The copy count is the
feature count, not the number of row pairs.

Sampled Shapley values.  Each row walks ``background`` seeded permutations of
the features.  A walk starts at a background row and takes over the row's own
values one feature after the other; the walk's steps are rows of one exploded
frame, scored in one pass, and the change at a step belongs to the feature
taken over there.  A scored step adds its value to the feature before it and
subtracts it from the feature after it, so the average change is one grouped
sum without a window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwarn.operators.ordering import exact_row_number
from panelwarn.operators.profile import to_long


def permuted_copies(df: DataFrame, id_col: str, features: Sequence[str], seed: int = 42) -> DataFrame:
    """Rows x features copies with column ``permuted_feature`` shuffled in each copy."""
    long = to_long(df, features, ids=[id_col]).withColumnRenamed("column", "feature")
    by_id = exact_row_number(df.select(id_col), [], [id_col], out="_pw_ra")
    shuffled = long.withColumn("_pw_h", F.md5(F.concat_ws("-", F.col(id_col).cast("string"), F.col("feature"),
                                                           F.lit(str(seed)))))
    by_hash = exact_row_number(shuffled, ["feature"], ["_pw_h", id_col], out="_pw_rb") \
        .select("feature", F.col("_pw_rb").alias("_pw_ra"), F.col("value").alias("_pw_pv"))
    perm = by_id.join(by_hash, "_pw_ra").select(id_col, F.col("feature").alias("permuted_feature"),
                                                             "_pw_pv")
    base = df.join(perm, id_col)
    return base.withColumns({c: F.when(F.col("permuted_feature") == c, F.col("_pw_pv")).otherwise(F.col(c).cast("double"))
                             for c in features}).drop("_pw_pv")


def permutation_importance(df: DataFrame, id_col: str, label: str, features: Sequence[str],
                           score: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame:
    """Drop in macro F1 (at ``threshold``) when each feature is permuted.

    ``score(df) -> df`` must add a ``proba`` column and keep ``label`` and
    ``permuted_feature``.
    """
    from panelwarn.operators.metrics import _f1
    base = score(df.withColumn("permuted_feature", F.lit("<none>")))
    copies = score(permuted_copies(df, id_col, features))
    both = base.unionByName(copies, allowMissingColumns=True)
    pred = (F.col("proba") >= F.lit(threshold))
    y = F.col(label) == 1
    g = both.groupBy("permuted_feature").agg(
        F.sum((y & pred).cast("long")).alias("tp"), F.sum((~y & pred).cast("long")).alias("fp"),
        F.sum((y & ~pred).cast("long")).alias("fn"), F.sum((~y & ~pred).cast("long")).alias("tn"))
    g = g.withColumn("macro_f1", (_f1(F.col("tp"), F.col("fp"), F.col("fn"))
                                  + _f1(F.col("tn"), F.col("fn"), F.col("fp"))) / 2)
    g = g.persist()  # at most len(features) + 1 rows
    base_f1 = g.filter(F.col("permuted_feature") == "<none>").first()["macro_f1"]
    return (g.filter(F.col("permuted_feature") != "<none>")
             .select(F.col("permuted_feature").alias("feature"),
                     (F.lit(base_f1) - F.col("macro_f1")).alias("importance"))
             .orderBy(F.desc("importance"), "feature"))


def background_rows(df: DataFrame, id_col: str, features: Sequence[str], rows: int, seed: int = 42) -> DataFrame:
    """``rows`` rows of ``df`` in a seeded order: their number ``_pw_walk`` (from 0) and feature array ``_pw_z``."""
    order = F.md5(F.concat_ws("-", F.col(id_col).cast("string"), F.lit(str(seed))))
    values = F.array(*[F.col(c).cast("double") for c in features])
    first = df.select(order.alias("_pw_h"), F.col(id_col).alias("_pw_id"), values.alias("_pw_z")).orderBy("_pw_h", "_pw_id").limit(rows)
    # at most ``rows`` rows: their number is their place in one sorted array
    return first.agg(F.array_sort(F.collect_list(F.struct("_pw_h", "_pw_id", "_pw_z"))).alias("all")).select(
        F.posexplode("all").alias("_pw_walk", "_pw_row")).select("_pw_walk", "_pw_row._pw_z")


def shapley_values(df: DataFrame, train: DataFrame, id_col: str, features: Sequence[str],
                   score: Callable[[DataFrame], DataFrame], value_col: str, background: int = 50,
                   seed: int = 42) -> DataFrame:
    """``id_col``, ``feature`` and ``shapley`` for every row of ``df`` and every feature.

    ``score(df) -> df`` must add ``value_col`` (a probability or log-odds) and
    keep the columns that begin with ``_pw_``.  ``background`` rows of ``train``
    give as many walks a row; they are broadcast, ``background`` x features
    values.  A row without an id or an empty ``train`` gives no values.
    """
    d = len(features)
    walks = df.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("_pw_id"), F.array(*[F.col(c).cast("double") for c in features]).alias("_pw_x"),
        F.explode(F.sequence(F.lit(0), F.lit(background - 1))).alias("_pw_walk"))
    walks = walks.join(F.broadcast(background_rows(train, id_col, features, background, seed)), "_pw_walk")
    drawn = F.array(*[F.struct(F.xxhash64("_pw_id", "_pw_walk", F.lit(i), F.lit(seed)).alias("h"), F.lit(i).alias("i"))
                      for i in range(d)])
    walks = walks.withColumn("_pw_order", F.transform(F.array_sort(drawn), lambda s: s["i"]))
    # _pw_turn[i]: the step at which feature i is taken over
    walks = walks.withColumn("_pw_turn", F.transform(F.sequence(F.lit(0), F.lit(d - 1)),
                                                     lambda i: F.array_position("_pw_order", i)))
    steps = walks.withColumn("_pw_step", F.explode(F.sequence(F.lit(0), F.lit(d))))
    taken = {c: F.when(F.col("_pw_turn")[i] <= F.col("_pw_step"), F.col("_pw_x")[i]).otherwise(F.col("_pw_z")[i])
             for i, c in enumerate(features)}
    scored = score(steps.select("_pw_id", "_pw_step", "_pw_order", *[e.alias(c) for c, e in taken.items()]))
    value, step = F.col(value_col), F.col("_pw_step")
    signed = lambda at, v: F.struct(F.get("_pw_order", at).alias("i"), v.alias("v"))
    changes = scored.select("_pw_id", F.explode(F.array(signed(step - 1, value), signed(step, -value))).alias("c"))
    total = changes.filter(F.col("c.i").isNotNull()).groupBy("_pw_id", F.col("c.i").alias("i")).agg(F.sum("c.v").alias("v"))
    names = F.array(*[F.lit(c) for c in features])
    walked = F.least(F.lit(background), F.lit(train.select(id_col).limit(background).count()))
    return total.select(F.col("_pw_id").alias(id_col), names[F.col("i")].alias("feature"),
                        (F.col("v") / walked).alias("shapley"))


def shapley_importance(values: DataFrame) -> DataFrame:
    """feature, mean_abs_shapley and mean_shapley over all rows of ``shapley_values``."""
    return values.groupBy("feature").agg(F.avg(F.abs("shapley")).alias("mean_abs_shapley"),
                                         F.avg("shapley").alias("mean_shapley"))
