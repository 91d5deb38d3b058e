"""Per-entity ordered windows with bounded frames, safe for hot entities.

Every feature of the reference (lags, leakage-free rolling statistics, running
index) is a positional window over one entity's rows in time order
(SURVEY 2.5).  A plain ``Window.partitionBy(entity)`` is one shuffle and is the
best plan while every entity fits one task.  When an entity holds a large share
of all rows, its rows are numbered with a range shuffle
(:func:`exact_row_number`), cut into blocks of ``block_rows`` consecutive rows,
and each block receives a copy of the last ``lookback`` rows of the block before
it (a halo).  The same window expressions then run per (entity, block) and give
exactly the answers of the single-partition window.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwarn.operators.ordering import exact_row_number

# build(window, position) -> {name: column}; position is the 1-based row index
Builder = Callable[[object, Column], dict[str, Column]]

@dataclass(frozen=True)
class PanelSpec:
    """Names of the panel's key columns; defaults are the reference's names."""
    entity: str = "ISO_A0"
    time: str = "calendar_start_date"
    tiebreak: tuple[str, ...] = field(default_factory=tuple)
    target: str = "dengue_total"

    @property
    def order(self) -> list[str]:
        return [self.time, *self.tiebreak]

    def window(self):
        return Window.partitionBy(self.entity).orderBy(*self.order)


def apply_panel_window(df: DataFrame, spec: PanelSpec, build: Builder, lookback: int,
                       block_rows: int | None = None) -> DataFrame:
    """Add the columns of ``build`` computed over ``spec``'s ordered entity window.

    ``lookback`` is the largest number of preceding rows any expression reads.
    Expressions may only look backwards (lag / rowsBetween(-k, 0 or -1)).

    ``block_rows`` chooses the plan.  None is one window, one shuffle by entity:
    right while each entity's rows fit one task.  With a number, entities are
    cut into blocks of so many consecutive rows (see above): for panels where
    one entity may hold a large share of all rows.  Both give the same columns.
    """
    if block_rows is None:
        return _plain(df, spec, build)
    return _blocked(df, spec, build, lookback, block_rows)


def _plain(df: DataFrame, spec: PanelSpec, build: Builder) -> DataFrame:
    w = spec.window()
    return df.withColumns(build(w, F.row_number().over(w).cast("long")))


def _blocked(df: DataFrame, spec: PanelSpec, build: Builder, lookback: int, block_rows: int) -> DataFrame:
    if block_rows <= lookback:
        raise ValueError("block_rows must exceed lookback")
    pos = "_pw_pos"
    numbered = exact_row_number(df, [spec.entity], spec.order, out=pos)
    blk = F.floor((F.col(pos) - 1) / F.lit(block_rows))
    own = numbered.withColumn("_pw_blk", blk).withColumn("_pw_halo", F.lit(False))
    halo = (numbered.filter(((F.col(pos) - 1) % F.lit(block_rows)) >= F.lit(block_rows - lookback))
                    .withColumn("_pw_blk", blk + 1).withColumn("_pw_halo", F.lit(True)))
    both = own.unionByName(halo)
    w = Window.partitionBy(spec.entity, "_pw_blk").orderBy(pos)
    out = both.withColumns(build(w, F.col(pos)))
    return out.filter(~F.col("_pw_halo")).drop(pos, "_pw_blk", "_pw_halo")
