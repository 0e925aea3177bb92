"""Queries of the general data problems: copies that differ (p3), implausible readings (p4), even grids (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatloom.operators.diff import Field, latest, table_diff
from beatloom.operators.gridding import regular_grid
from beatloom.operators.spikes import INTERVALS, SAMPLES, faulty_beats, faulty_levels
from beatloom.sources.tables import table

FLOOR_KEYS = ["record", "session_id", "coverage_pct"]
FLOOR_FIELDS = [Field(c, 1e-6) for c in ("floor_rmse", "floor_mae", "n_intervals", "n_detectors")]
SERIES = ["record", "session_id", "detector"]


def floor_rows(df: DataFrame) -> DataFrame:
    """Floor rows under their common key, the version loaded last."""
    share = F.when(~F.isnan("coverage_target"), F.col("coverage_target"))
    keyed = df.select(
        F.lower(F.trim("record")).alias("record"),
        "session_id",
        F.coalesce(F.round(share * 100).cast("long"), F.lit(-1).cast("long")).alias("coverage_pct"),
        *[f.name for f in FLOOR_FIELDS],
        "loaded_at",
    )
    return latest(keyed, FLOOR_KEYS, "loaded_at", [f.name for f in FLOOR_FIELDS])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    a, b = (table(spark, folder, f"prv_floor_{side}") for side in "ab")
    rows = max(a.count(), b.count())  # from the files' footers
    return table_diff(floor_rows(a), floor_rows(b), FLOOR_KEYS, FLOOR_FIELDS, rows)


def p3_summary(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows and fields differ, by kind, field and coverage."""
    return p3_found(spark, folder).groupBy("kind", "field_name", "coverage_pct").agg(F.count("*").alias("n_cases"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    intervals, beats, samples = p4_intervals(spark, folder), p4_beats(spark, folder), p4_samples(spark, folder)

    def cases(df: DataFrame, field: str, detector: object, idx: str) -> DataFrame:
        return df.select(F.lit(field).alias("field_name"), "record", "session_id", detector, F.col(idx).alias("idx"))

    none = F.lit("").alias("detector")
    return cases(intervals, "ibi_s", F.col("detector"), "k").unionByName(cases(beats, "t", none, "ref_idx")).unionByName(cases(samples, "x", none, "i"))


def p4_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """The faulty intervals alone."""
    return faulty_levels(table(spark, folder, "tachogram", *SERIES, "k", "ibi_s"), SERIES, "k", "ibi_s", INTERVALS)


def p4_beats(spark: SparkSession, folder: str) -> DataFrame:
    """The faulty beat times alone."""
    return faulty_beats(table(spark, folder, "ref_beats", "record", "session_id", "ref_idx", "t"), ["record", "session_id"], "ref_idx", "t")


def p4_samples(spark: SparkSession, folder: str) -> DataFrame:
    """The faulty samples alone."""
    return faulty_levels(table(spark, folder, "ppg_samples", "record", "session_id", "i", "x"), ["record", "session_id"], "i", "x", SAMPLES)


def p4_by_record(spark: SparkSession, folder: str) -> DataFrame:
    """Faulty readings per record and field."""
    return p4_found(spark, folder).groupBy("record", "field_name").agg(F.count("*").alias("n_faulty"))


def p5_grid(spark: SparkSession, folder: str) -> DataFrame:
    """The tachogram on a 5 s grid, stretches of up to 20 s without readings filled."""
    grid = regular_grid(table(spark, folder, "tachogram", *SERIES, "t", "ibi_s"), SERIES, "t", "ibi_s", cell_s=5.0, gap_limit_s=20.0)
    return grid.withColumn("grid_value", F.round("grid_value", 9))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_grid(spark, folder).where(F.col("n_readings") == 0).select(*SERIES, "cell")


QUERIES = {"p3_found": p3_found, "p3_summary": p3_summary, "p4_found": p4_found, "p4_intervals": p4_intervals, "p4_beats": p4_beats, "p4_samples": p4_samples, "p4_by_record": p4_by_record, "p5_found": p5_found, "p5_grid": p5_grid}

_P3 = """
WITH ka AS (SELECT lower(trim(record)) AS record, session_id, coalesce(CASE WHEN isnan(coverage_target) THEN NULL ELSE CAST(round(coverage_target * 100) AS BIGINT) END, -1) AS coverage_pct,
    CASE WHEN NOT isnan(floor_rmse) THEN floor_rmse END AS floor_rmse, CASE WHEN NOT isnan(floor_mae) THEN floor_mae END AS floor_mae, n_intervals, n_detectors,
    row_number() OVER (PARTITION BY lower(trim(record)), session_id, coalesce(CAST(round(coverage_target * 100) AS BIGINT), -1) ORDER BY loaded_at DESC NULLS LAST) AS rn FROM prv_floor_a),
kb AS (SELECT lower(trim(record)) AS record, session_id, coalesce(CASE WHEN isnan(coverage_target) THEN NULL ELSE CAST(round(coverage_target * 100) AS BIGINT) END, -1) AS coverage_pct,
    CASE WHEN NOT isnan(floor_rmse) THEN floor_rmse END AS floor_rmse, CASE WHEN NOT isnan(floor_mae) THEN floor_mae END AS floor_mae, n_intervals, n_detectors,
    row_number() OVER (PARTITION BY lower(trim(record)), session_id, coalesce(CAST(round(coverage_target * 100) AS BIGINT), -1) ORDER BY loaded_at DESC NULLS LAST) AS rn FROM prv_floor_b),
a AS (SELECT * FROM ka WHERE rn = 1), b AS (SELECT * FROM kb WHERE rn = 1),
j AS (SELECT a.*, b.floor_rmse AS b1, b.floor_mae AS b2, b.n_intervals AS b3, b.n_detectors AS b4 FROM a JOIN b USING (record, session_id, coverage_pct)),
cases AS (
SELECT record, session_id, coverage_pct, 'only_a' AS kind, '' AS field_name FROM a ANTI JOIN b USING (record, session_id, coverage_pct)
UNION ALL SELECT record, session_id, coverage_pct, 'only_b', '' FROM b ANTI JOIN a USING (record, session_id, coverage_pct)
UNION ALL SELECT record, session_id, coverage_pct, 'differs', 'floor_rmse' FROM j WHERE abs(floor_rmse - b1) > 1e-6 OR (floor_rmse IS NULL) <> (b1 IS NULL)
UNION ALL SELECT record, session_id, coverage_pct, 'differs', 'floor_mae' FROM j WHERE abs(floor_mae - b2) > 1e-6 OR (floor_mae IS NULL) <> (b2 IS NULL)
UNION ALL SELECT record, session_id, coverage_pct, 'differs', 'n_intervals' FROM j WHERE abs(n_intervals - b3) > 1e-6 OR (n_intervals IS NULL) <> (b3 IS NULL)
UNION ALL SELECT record, session_id, coverage_pct, 'differs', 'n_detectors' FROM j WHERE abs(n_detectors - b4) > 1e-6 OR (n_detectors IS NULL) <> (b4 IS NULL))
"""

_P5 = """
WITH r AS (SELECT DISTINCT record, session_id, detector, t, ibi_s FROM tachogram WHERE t IS NOT NULL AND ibi_s IS NOT NULL AND NOT isnan(t) AND NOT isnan(ibi_s)),
c AS (SELECT record, session_id, detector, CAST(floor(t / 5) AS BIGINT) AS cell, count(*) AS n_readings, avg(ibi_s) AS grid_value,
    min(struct_pack(t := t, v := ibi_s)) AS f, max(struct_pack(t := t, v := ibi_s)) AS l FROM r GROUP BY ALL),
n AS (SELECT *, lead(cell) OVER w AS next_cell, lead(f) OVER w AS nf FROM c WINDOW w AS (PARTITION BY record, session_id, detector ORDER BY cell)),
e AS (SELECT * EXCLUDE (cell), unnest(range(cell + 1, next_cell)) AS cell FROM n WHERE next_cell > cell + 1),
g AS (SELECT record, session_id, detector, cell, n_readings, grid_value, 'read' AS status FROM c
UNION ALL SELECT record, session_id, detector, cell, 0, CASE WHEN nf.t - l.t <= 20 THEN l.v + (nf.v - l.v) * ((cell + 0.5) * 5 - l.t) / (nf.t - l.t) END, CASE WHEN nf.t - l.t <= 20 THEN 'filled' ELSE 'gap' END FROM e)
"""



def _level_sql(keys: str, order: str, value: str, table_name: str, impossible: str, stuck: int, half: int, spread: str, floor: float, limit: float) -> str:
    """Level rule in SQL: impossible readings and stuck runs first, the rolling median over the rest."""
    return f"""WITH d AS (SELECT DISTINCT {keys}, {order} AS k, {value} AS x FROM {table_name} WHERE {order} IS NOT NULL AND {value} IS NOT NULL AND NOT isnan({value})),
e AS (SELECT *, CAST(x IS DISTINCT FROM lag(x) OVER (PARTITION BY {keys} ORDER BY k) AS INT) AS new, min(x) OVER (PARTITION BY {keys}) < max(x) OVER (PARTITION BY {keys}) AS varies FROM d),
r AS (SELECT *, sum(new) OVER (PARTITION BY {keys} ORDER BY k) AS run FROM e),
b AS (SELECT *, ({impossible}) OR (varies AND count(*) OVER (PARTITION BY {keys}, run) >= {stuck}) AS bad FROM r),
g AS (SELECT *, abs(x - median(x) OVER (PARTITION BY {keys} ORDER BY k ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)) AS away, abs(x - lag(x) OVER (PARTITION BY {keys} ORDER BY k)) AS step FROM b WHERE NOT bad),
s AS (SELECT {keys}, greatest(1.4826 * median({spread}), {floor}) AS scale FROM g GROUP BY ALL)
SELECT {keys}, k AS {order} FROM b WHERE bad UNION ALL SELECT {keys}, k FROM g JOIN s USING ({keys}) WHERE away > {limit} * scale"""


_SER = "PARTITION BY record, session_id ORDER BY"
#: Beats: the Hampel filter on the intervals as window frames, the cheapest chain of each suspect stretch as a recursion over its beats.
_BEATS = f"""WITH RECURSIVE d AS (SELECT DISTINCT record, session_id, ref_idx AS k, t FROM ref_beats WHERE ref_idx IS NOT NULL AND t IS NOT NULL AND NOT isnan(t)),
e AS (SELECT *, CAST(t IS DISTINCT FROM lag(t) OVER ({_SER} k) AS INT) AS new, min(t) OVER (PARTITION BY record, session_id) < max(t) OVER (PARTITION BY record, session_id) AS varies FROM d),
r AS (SELECT *, sum(new) OVER ({_SER} k) AS run FROM e),
b AS (SELECT *, t < 0 OR (varies AND count(*) OVER (PARTITION BY record, session_id, run) >= 3) AS bad FROM r),
g AS (SELECT record, session_id, k, t, row_number() OVER ({_SER} k) AS n, t - lag(t) OVER ({_SER} k) AS step FROM b WHERE NOT bad),
u AS (SELECT record, session_id, k, step, median(step) OVER ({_SER} k ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS m FROM g WHERE step > 0.2 AND step < 3.0),
v AS (SELECT record, session_id, k, m, 1.4826 * median(abs(step - m)) OVER ({_SER} k ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS s FROM u),
l AS (SELECT g.*, coalesce(last_value(m IGNORE NULLS) OVER before, first_value(m IGNORE NULLS) OVER after, 0.8) AS m, coalesce(last_value(s IGNORE NULLS) OVER before, first_value(s IGNORE NULLS) OVER after, 0.0) AS s FROM g LEFT JOIN v USING (record, session_id, k)
    WINDOW before AS ({_SER} n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), after AS ({_SER} n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
o AS (SELECT *, coalesce(step <= 0.2 OR step >= 3.0 OR abs(step - m) > 3.0 * greatest(s, 0.004) OR abs(step - m) > 0.2 * m, false) AS odd FROM l),
q AS (SELECT *, odd OR coalesce(lead(odd) OVER ({_SER} n), false) AS suspect FROM o),
w AS (SELECT * FROM (SELECT *, bool_or(suspect) OVER ({_SER} n ROWS BETWEEN 14 PRECEDING AND 14 FOLLOWING) AS near FROM q) WHERE near),
i AS (SELECT *, n - row_number() OVER ({_SER} n) AS island FROM w),
seg AS (SELECT record, session_id, k, t, m, suspect, dense_rank() OVER (ORDER BY record, session_id, island) AS s, row_number() OVER (PARTITION BY record, session_id, island ORDER BY n) - 1 AS j, count(*) OVER (PARTITION BY record, session_id, island) AS size FROM i),
dp(s, j, link, cost, win) AS (
    SELECT s, j, CAST(-1 AS BIGINT), 0e0, [struct_pack(t := t, c := 0e0, j := j)] FROM seg WHERE j = 0
    UNION ALL
    SELECT s, j, link, cost, list_append(win, struct_pack(t := t, c := cost, j := j))[-12:] FROM (
        SELECT *, CASE WHEN list_min(costs) < j THEN win[list_position(costs, list_min(costs))].j ELSE -1 END AS link, least(list_min(costs), CAST(j AS DOUBLE)) AS cost FROM (
            SELECT seg.s, seg.j, seg.t, dp.win, list_transform(dp.win, lambda p: p.c + (CASE WHEN seg.t - p.t <= 0 OR seg.t - p.t > 600 THEN 4e0
                WHEN abs((seg.t - p.t) / seg.m - greatest(round_even((seg.t - p.t) / seg.m, 0), 1)) <= 0.2 * sqrt(least(greatest(round_even((seg.t - p.t) / seg.m, 0), 1), 2))
                    THEN CASE WHEN greatest(round_even((seg.t - p.t) / seg.m, 0), 1) = 1 THEN abs((seg.t - p.t) / seg.m - 1) ELSE 0.3e0 END
                WHEN (seg.t - p.t) / seg.m > 1.6 THEN 0.7e0 ELSE 4e0 END) + (seg.j - p.j - 1)) AS costs FROM dp JOIN seg ON seg.s = dp.s AND seg.j = dp.j + 1))),
best AS (SELECT dp.s, dp.j FROM dp JOIN (SELECT DISTINCT s, size FROM seg) z USING (s) QUALIFY row_number() OVER (PARTITION BY dp.s ORDER BY cost + (size - 1 - dp.j), dp.j) = 1),
kept(s, j) AS (SELECT s, j FROM best UNION ALL SELECT dp.s, dp.link FROM kept JOIN dp USING (s, j) WHERE dp.link >= 0)
SELECT record, session_id, k AS ref_idx FROM b WHERE bad UNION ALL SELECT record, session_id, k FROM seg ANTI JOIN kept USING (s, j) WHERE suspect"""
_INTERVALS = _level_sql("record, session_id, detector", "k", "ibi_s", "tachogram", "x < 0.30 OR x > 2.00", 10, 8, "away", 0.001, 6.5)
_SAMPLES = _level_sql("record, session_id", "i", "x", "ppg_samples", "x <= 0 OR x >= 262143", 25, 3, "step", 0.5, 18.0)
_P4 = f"""SELECT 'ibi_s' AS field_name, record, session_id, detector, k AS idx FROM ({_INTERVALS})
UNION ALL SELECT 't', record, session_id, '', ref_idx FROM ({_BEATS}) UNION ALL SELECT 'x', record, session_id, '', i FROM ({_SAMPLES})"""


ORACLES = {
    "p4_found": _P4,
    "p4_by_record": f"SELECT record, field_name, count(*) AS n_faulty FROM ({_P4}) GROUP BY ALL",
    "p4_beats": _BEATS,
    "p4_intervals": _INTERVALS,
    "p4_samples": _SAMPLES,
    "p3_found": _P3 + "SELECT * FROM cases",
    "p3_summary": _P3 + "SELECT kind, field_name, coverage_pct, count(*) AS n_cases FROM cases GROUP BY ALL",
    "p5_found": _P5 + "SELECT record, session_id, detector, cell FROM g WHERE n_readings = 0",
    "p5_grid": _P5 + "SELECT record, session_id, detector, cell, n_readings, round(grid_value, 9) AS grid_value, status FROM g",
}
