"""Clean series from the raw tables: each reading once, without nulls and NaN, in order, one shuffle each.

Repeated rows stand side by side once a series is sorted, so they are dropped in the sort that orders it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from beatloom.sources.tables import table

SESSION = ["record", "session_id"]
RUN = [*SESSION, "detector"]
#: Fixed value: top of the recorder's 18-bit range.
TOP = 262143


def _once(df: DataFrame, keys: list[str], order: list[str], same: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    repeated: Column = F.lit(True)
    for c in same:
        repeated = repeated & F.coalesce(F.lag(c).over(w) == F.col(c), F.lit(False))
    return df.withColumn("__again", repeated).where(~F.col("__again")).drop("__again")


def number(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Position of each row in its series, from 0."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def signal(spark: SparkSession, folder: str) -> DataFrame:
    """Samples on their recorded grid: ``record, session_id, fs, i, x``, dense in ``i`` from 0, so ``i / fs`` is the time.

    Samples that are lost, null or out of range are filled by linear interpolation between their neighbours, and before
    the first one with its value; nothing is added after the last one.
    """
    t = table(spark, folder, "ppg_samples", *SESSION, "fs", "i", "x").where((F.col("x") > 0) & (F.col("x") < TOP) & (F.col("i") >= 0))
    w = Window.partitionBy(*SESSION).orderBy("i")
    ahead = _once(t, SESSION, ["i"], ["i"]).select(*SESSION, "fs", "i", "x", F.lag("i").over(w).alias("__b"), F.lead("i").over(w).alias("__a"), F.lead("x").over(w).alias("__ax"))
    first = F.when(F.col("__b").isNull(), F.lit(0).cast("long")).otherwise(F.col("i"))
    filled = ahead.withColumn("__j", F.explode(F.sequence(first, F.coalesce(F.col("__a") - 1, F.col("i")))))
    between = F.col("x") + (F.col("__ax") - F.col("x")) * (F.col("__j") - F.col("i")) / (F.col("__a") - F.col("i"))
    return filled.select(*SESSION, "fs", F.col("__j").alias("i"), F.when(F.col("__j") <= F.col("i"), F.col("x")).otherwise(between).alias("x"))


def _timed(t: Column) -> Column:
    return (t >= 0) & ~F.isnan(t) & (t < F.lit(float("inf")))


def reference_beats(spark: SparkSession, folder: str) -> DataFrame:
    """Reference beats: ``record, session_id, ref_idx, t, k``; ``k`` is the place in time."""
    t = table(spark, folder, "ref_beats", *SESSION, "ref_idx", "t").where(F.col("ref_idx").isNotNull() & _timed(F.col("t")))
    return number(_once(t, SESSION, ["t", "ref_idx"], ["t", "ref_idx"]), SESSION, ["t", "ref_idx"], "k")


def detected_beats(spark: SparkSession, folder: str) -> DataFrame:
    """Detected beats: ``record, session_id, detector, test_idx, t, lag_s, k``."""
    t = table(spark, folder, "det_beats", *RUN, "test_idx", "t", "lag_s").where(F.col("test_idx").isNotNull() & _timed(F.col("t")))
    return number(_once(t, RUN, ["t", "test_idx"], ["t", "test_idx"]), RUN, ["t", "test_idx"], "k")


def intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Intervals of the tachogram: ``record, session_id, detector, correction, k, t, ibi_s``."""
    t = table(spark, folder, "tachogram", *RUN, "correction", "k", "t", "ibi_s").where(F.col("ibi_s").isNotNull() & ~F.isnan("ibi_s"))
    return _once(t, RUN, ["k"], ["k"])


def screened(spark: SparkSession, folder: str) -> DataFrame:
    """Intervals a heart can have (0.30 to 2.00 s), numbered without holes in ``n``."""
    kept = intervals(spark, folder).where(F.col("ibi_s").between(0.30, 2.00))
    return number(kept, RUN, ["k"], "n")


SQL = {
    "signal": """sg0 AS (SELECT *, lag(i) OVER w AS b, lead(i) OVER w AS a, lead(x) OVER w AS ax FROM (SELECT DISTINCT record, session_id, fs, i, x FROM ppg_samples WHERE x > 0 AND x < 262143 AND i >= 0) WINDOW w AS (PARTITION BY record, session_id ORDER BY i)),
    sg1 AS (SELECT *, unnest(range(CASE WHEN b IS NULL THEN 0 ELSE i END, coalesce(a, i + 1))) AS j FROM sg0),
    signal AS (SELECT record, session_id, fs, j AS i, CASE WHEN j <= i THEN x ELSE x + (ax - x) * (j - i) / (a - i) END AS x FROM sg1)""",
    "ref": """ref AS (SELECT *, row_number() OVER (PARTITION BY record, session_id ORDER BY t, ref_idx) - 1 AS k
    FROM (SELECT DISTINCT record, session_id, ref_idx, t FROM ref_beats WHERE ref_idx IS NOT NULL AND t >= 0 AND isfinite(t)))""",
    "det": """det AS (SELECT *, row_number() OVER (PARTITION BY record, session_id, detector ORDER BY t, test_idx) - 1 AS k
    FROM (SELECT DISTINCT record, session_id, detector, test_idx, t, lag_s FROM det_beats WHERE test_idx IS NOT NULL AND t >= 0 AND isfinite(t)))""",
    "tach": """tach AS (SELECT DISTINCT record, session_id, detector, correction, k, t, ibi_s FROM tachogram WHERE ibi_s IS NOT NULL AND NOT isnan(ibi_s))""",
    "scr": """tach AS (SELECT DISTINCT record, session_id, detector, correction, k, t, ibi_s FROM tachogram WHERE ibi_s IS NOT NULL AND NOT isnan(ibi_s)),
    scr AS (SELECT *, row_number() OVER (PARTITION BY record, session_id, detector ORDER BY k) - 1 AS n FROM tach WHERE ibi_s BETWEEN 0.30 AND 2.00)""",
}
