"""Costs of timed detector runs, for summaries and leaderboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatloom.functions.numbers import real
from beatloom.sources.tables import table

#: Order in which detectors are reported.
ORDER = ["MSPTD", "MSPTDfast v2", "TERMA", "qppg (slope-sum)", "HeartPy", "find_peaks baseline", "MSPTD (NeuroKit2 reference loops)"]


def costs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs once each, label in its registered spelling, real costs of at least 0."""
    c = table(spark, folder, "detector_cost", "run_id", "record", "detector", "detector_label", "run_day", "best_s_per_min", "median_s_per_min").distinct()
    own = F.lower(F.trim("detector_label"))
    label = F.lit(None).cast("string")
    for name in ORDER:
        label = F.when(own == name.lower(), F.lit(name)).otherwise(label)
    return c.withColumn("label", label).withColumn("cost", real(F.col("best_s_per_min"))).where("cost >= 0")


_LABELS = ", ".join(f"('{n}', {i})" for i, n in enumerate(ORDER))
COST_SQL = f"""WITH lb(label, place) AS (VALUES {_LABELS}), c0 AS (SELECT DISTINCT run_id, record, detector, detector_label, run_day, best_s_per_min, median_s_per_min FROM detector_cost WHERE isfinite(best_s_per_min) AND best_s_per_min >= 0),
c AS (SELECT c0.*, lb.label, lb.place, best_s_per_min AS cost, split_part(record, '_', -1) AS activity FROM c0 LEFT JOIN lb ON lower(trim(detector_label)) = lower(lb.label))"""
