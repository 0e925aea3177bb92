"""Irregular readings onto an even grid of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4_096


def regular_grid(df: DataFrame, keys: list[str], time: str, value: str, cell_s: float, gap_limit_s: float) -> DataFrame:
    """One row for each cell of ``cell_s`` seconds from the first to the last reading of each series.

    A reading is a row whose ``time`` and ``value`` are neither null nor NaN; equal rows count once. Columns: ``keys``,
    ``cell``, ``n_readings``, ``grid_value`` and ``status``: "read" (the mean of the cell's readings), "filled" (no
    reading; value at the cell's middle by time-weighted linear interpolation between the last reading before and the
    first reading after it) or "gap" (no value: those neighbours are more than ``gap_limit_s`` apart). An empty table
    gives an empty grid; infinite times are no readings; of readings at one time, the lower value comes first.

    As-of merge of grid and readings: readings are first reduced to their cells, a sort of the cells per series brings
    each cell its next neighbour, and the empty cells between are generated from that pair in blocks, so a stretch of
    any length is never held as one array.
    """
    t, v = F.col(time), F.col(value)
    real = t.isNotNull() & v.isNotNull() & ~F.isnan(t) & ~F.isnan(v) & (F.abs(t) < F.lit(float("inf")))
    reads = df.where(real).select(*keys, t.cast("double").alias("__t"), v.cast("double").alias("__v"))
    spot = F.struct("__t", "__v")
    # Equal rows fall together in the cell's first aggregation, before its mean is taken.
    cells = (
        reads.withColumn("cell", F.floor(F.col("__t") / F.lit(float(cell_s))))
        .groupBy(*keys, "cell", "__t", "__v")
        .agg(F.lit(1).alias("__one"))
        .groupBy(*keys, "cell")
        .agg(F.count("__one").alias("n_readings"), F.avg("__v").alias("grid_value"), F.min(spot).alias("__first"), F.max(spot).alias("__last"))
    )
    order = Window.partitionBy(*keys).orderBy("cell")
    linked = cells.withColumn("__next_cell", F.lead("cell").over(order)).withColumn("__next", F.lead("__first").over(order))
    read = linked.select(*keys, "cell", "n_readings", "grid_value", F.lit("read").alias("status"))
    span = F.col("__next_cell") - F.col("cell") - 1
    blocks = linked.where(span > 0).withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((span - 1) / BLOCK))))
    first = F.col("cell") + 1 + F.col("__block") * BLOCK
    stop = F.least(first + (BLOCK - 1), F.col("__next_cell") - 1)
    empty = blocks.withColumn("__cell", F.explode(F.sequence(first, stop)))
    t0, v0, t1, v1 = (F.col(c) for c in ("__last.__t", "__last.__v", "__next.__t", "__next.__v"))
    middle = (F.col("__cell") + 0.5) * float(cell_s)
    close = (t1 - t0) <= float(gap_limit_s)
    filled = empty.select(
        *keys,
        F.col("__cell").alias("cell"),
        F.lit(0).cast("long").alias("n_readings"),
        F.when(close, v0 + (v1 - v0) * (middle - t0) / (t1 - t0)).alias("grid_value"),
        F.when(close, F.lit("filled")).otherwise(F.lit("gap")).alias("status"),
    )
    return read.unionByName(filled)
