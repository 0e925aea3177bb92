"""Pulses from anchors, and their fiducial points with sub-sample times.

``signal`` has ``keys``, ``i``, ``x``, ``fs``; ``anchors`` has ``keys`` and ``idx`` (peaks). Searches are equi-joins on
the sample number: each anchor names the samples it looks at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POINTS = ("peak", "foot", "mid_upslope", "max_slope")


def vertex(before: Column, at: Column, after: Column, i: Column) -> Column:
    """Vertex of the parabola through three samples; the middle one at an end, without curvature, or more than one sample off."""
    low = before - 2.0 * at + after
    shift = F.when(low != 0, 0.5 * (before - after) / low)
    return F.when(shift.isNotNull() & (F.abs(shift) <= 1.0), i + shift).otherwise(i.cast("double"))


def pulses(signal: DataFrame, anchors: DataFrame, keys: list[str], span_s: float = 0.40) -> DataFrame:
    """Onset of each peak: the first least sample in the 0.40 s before it, not before the peak before; ``onset``, ``peak``."""
    w = Window.partitionBy(*keys).orderBy("idx")
    fs = signal.groupBy(*keys).agg(F.first("fs").alias("fs"))
    p = anchors.select(*keys, F.col("idx").alias("peak"), F.coalesce(F.lag("idx").over(w), F.lit(0).cast("long")).alias("prev")).join(fs, keys)
    lo = F.greatest(F.col("prev"), F.col("peak") - F.bround(F.col("fs") * span_s).cast("long"), F.lit(0).cast("long"))
    looks = p.where(F.col("peak") > lo).select(*keys, "peak", "fs", F.explode(F.sequence(lo, F.col("peak"))).alias("i"))
    least = looks.join(signal.select(*keys, "i", "x"), [*keys, "i"]).groupBy(*keys, "peak", "fs").agg(F.min(F.struct("x", "i")).alias("m"))
    return least.select(*keys, "peak", "fs", F.col("m.i").alias("onset")).where(F.col("onset") < F.col("peak"))


def pulses_from_onsets(signal: DataFrame, anchors: DataFrame, keys: list[str], span_s: float = 0.40) -> DataFrame:
    """Peak of each onset: the first greatest sample up to 0.40 s after it and before the next onset; ``onset``, ``peak``.

    Onsets with less than two samples to look at, or that are their own peak, have no pulse.
    """
    w = Window.partitionBy(*keys).orderBy("idx")
    ends = signal.groupBy(*keys).agg(F.first("fs").alias("fs"), (F.max("i") + 1).alias("__n"))
    o = anchors.select(*keys, F.col("idx").alias("onset"), F.lead("idx").over(w).alias("__next")).join(ends, keys)
    stop = F.least(F.col("__n"), F.col("onset") + F.bround(F.col("fs") * span_s).cast("long") + 1, F.coalesce("__next", F.col("__n")))
    looks = o.where(stop - F.col("onset") > 1).select(*keys, "onset", "fs", F.explode(F.sequence(F.col("onset"), stop - 1)).alias("i"))
    top = looks.join(signal.select(*keys, "i", "x"), [*keys, "i"]).groupBy(*keys, "onset", "fs").agg(F.max(F.struct("x", (-F.col("i")).alias("n"))).alias("m"))
    return top.select(*keys, "fs", "onset", (-F.col("m.n")).alias("peak")).where(F.col("peak") > F.col("onset"))


def locate(signal: DataFrame, pulse: DataFrame, keys: list[str], kind: str, sub_sample: bool = True) -> DataFrame:
    """Time of the fiducial ``kind`` of each pulse: ``keys``, ``peak``, ``onset``, ``t`` (s).

    peak, foot: vertex at the peak or onset. mid_upslope: where the rise crosses half its height, interpolated.
    max_slope: vertex of the slope at its first greatest sample. Without ``sub_sample`` times are put on the grid.
    """
    if kind not in POINTS:
        raise ValueError(f"no such fiducial: {kind}")
    w = Window.partitionBy(*keys).orderBy("i")
    before, after = F.lag("x").over(w), F.lead("x").over(w)
    slope = F.when(before.isNull(), after - F.col("x")).when(after.isNull(), F.col("x") - before).otherwise((after - before) / 2.0)
    near = signal.select(*keys, "i", "x", before.alias("b"), after.alias("a"), slope.alias("g"))
    if kind in ("peak", "foot"):
        at = "peak" if kind == "peak" else "onset"
        spot = pulse.withColumn("i", F.col(at)).join(near, [*keys, "i"])
        pos = F.coalesce(vertex(F.col("b"), F.col("x"), F.col("a"), F.col("i")), F.col("i").cast("double"))
        found = spot.select(*keys, "peak", "onset", "fs", pos.alias("pos"))
    else:
        inside = pulse.withColumn("i", F.explode(F.sequence("onset", "peak"))).join(near, [*keys, "i"])
        group = [*keys, "peak", "onset", "fs"]
        if kind == "mid_upslope":
            whole = Window.partitionBy(*keys, "peak")
            foot, top = F.max(F.when(F.col("i") == F.col("onset"), F.col("x"))).over(whole), F.max(F.when(F.col("i") == F.col("peak"), F.col("x"))).over(whole)
            half = inside.withColumn("target", 0.5 * (foot + top)).where(F.col("x") >= F.col("target"))
            first = half.groupBy(*group).agg(F.min(F.struct("i", "x", "b", "target")).alias("m"))
            rise = F.col("m.x") - F.col("m.b")
            pos = F.when((F.col("m.i") > F.col("onset")) & (rise > 0), F.col("m.i") - 1 + (F.col("m.target") - F.col("m.b")) / rise).otherwise(F.col("m.i").cast("double"))
        else:
            steep = near.select(*keys, "i", "g", F.lag("g").over(w).alias("gb"), F.lead("g").over(w).alias("ga"))
            first = pulse.withColumn("i", F.explode(F.sequence("onset", "peak"))).join(steep, [*keys, "i"]).groupBy(*group).agg(F.max(F.struct(F.col("g"), (-F.col("i")).alias("n"), F.col("gb"), F.col("ga"))).alias("m"))
            i = -F.col("m.n")
            pos = F.coalesce(vertex(F.col("m.gb"), F.col("m.g"), F.col("m.ga"), i), i.cast("double"))
        found = first.select(*group, pos.alias("pos"))
    t = F.col("pos") / F.col("fs")
    if not sub_sample:
        t = F.bround(t * F.col("fs")) / F.col("fs")
    return found.select(*keys, "peak", "onset", t.alias("t"))
