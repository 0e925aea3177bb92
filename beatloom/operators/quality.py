"""Signal quality by tumbling windows, and the coverage gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beatloom.functions.numbers import half_even


def windows(df: DataFrame, keys: list[str], seconds: float) -> DataFrame:
    """Adds ``w`` for samples in whole windows of ``seconds``; the partial one at the end is left out."""
    size = half_even(F.col("fs") * seconds).cast("long")
    many = F.max("i").over(Window.partitionBy(*keys)) + 1
    w = F.floor(F.col("i") / size)
    return df.withColumn("w", w).withColumn("__full", (w + 1) * size <= many).where("__full").drop("__full")


def scores(df: DataFrame, keys: list[str], seconds: float) -> DataFrame:
    """Per window: ``score`` (population skewness; minus infinity where there is none) and ``perfusion``.

    Perfusion is (95th - 5th percentile) / mean |x|, 0 where the mean is 0.
    """
    g = windows(df, keys, seconds).groupBy(*keys, "w")
    p = F.percentile("x", F.array(F.lit(0.05), F.lit(0.95)))
    out = g.agg(F.skewness("x").alias("skew"), p.alias("p"), F.avg(F.abs("x")).alias("level"))
    score = F.coalesce(F.when(~F.isnan("skew"), F.col("skew")), F.lit(float("-inf")))
    return out.select(*keys, "w", score.alias("score"), F.when(F.col("level") > 0, (F.col("p")[1] - F.col("p")[0]) / F.col("level")).otherwise(F.lit(0.0)).alias("perfusion"))


def coverage_gate(df: DataFrame, keys: list[str], fraction: float) -> DataFrame:
    """Windows kept at a coverage: the best ``max(1, round(fraction x n))`` by score, with ties."""
    share = min(1.0, max(0.0, fraction))
    n = F.count("*").over(Window.partitionBy(*keys))
    least: Column = F.greatest(F.lit(1), half_even(n * F.lit(share)).cast("int"))
    rank = F.rank().over(Window.partitionBy(*keys).orderBy(F.col("score").desc()))
    return df.withColumn("kept", F.lit(True) if share >= 1 else rank <= least)


def spans(gated: DataFrame, keys: list[str], seconds: float) -> DataFrame:
    return gated.where("kept").select(*keys, "w", (F.col("w") * seconds).alias("t0"), ((F.col("w") + 1) * seconds).alias("t1"))


def beats_in_spans(beats: DataFrame, kept: DataFrame, keys: list[str], time: str, seconds: float) -> DataFrame:
    """Beats inside any span [t0, t1): a semi-join on the window number, not a range comparison."""
    numbered = beats.withColumn("w", F.floor(F.col(time) / seconds))
    return numbered.join(kept.select(*keys, "w"), [*keys, "w"], "left_semi").drop("w")
