"""Queries of the problems of training-data pipelines, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatloom.llm import language, leakage, nearest, packing, percentiles, tokens
from beatloom.session import written
from beatloom.sources.tables import table

ENTITY, RUN = ["record", "session_id"], ["detector"]
TOLERANCE_S = 0.150
SHARES = [0.1, 0.5, 0.9, 0.99]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    left = table(spark, folder, "det_beats", *ENTITY, *RUN, "test_idx", "t", "lag_s")
    right = table(spark, folder, "ref_beats", *ENTITY, "ref_idx", "t")
    return nearest.match_runs(left, right, ENTITY, RUN, "test_idx", "ref_idx", "t", "t", "lag_s", TOLERANCE_S).select(*ENTITY, *RUN, "ref_idx", "test_idx")


def p1_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """For each detected beat with a stated delay the nearest reference beat within the tolerance, not one to one."""
    left = table(spark, folder, "det_beats", *ENTITY, *RUN, "test_idx", "t", "lag_s").where("lag_s is not null and test_idx is not null and not isnan(lag_s)")
    right = table(spark, folder, "ref_beats", *ENTITY, "ref_idx", "t").where("ref_idx is not null")
    near = nearest.nearest_pairs(left.withColumn("at", F.col("t") - F.col("lag_s")), right, ENTITY, [*RUN, "test_idx"], "ref_idx", "at", "t", TOLERANCE_S)
    return near.withColumn("distance", F.round("distance", 6))


def p1_nearest_every_run(spark: SparkSession, folder: str) -> DataFrame:
    """As p1_nearest, which its SQL holds to runs with a stated delay, but of every run; an unstated delay is estimated, 0 without any pair."""
    left = table(spark, folder, "det_beats", *ENTITY, *RUN, "test_idx", "t", "lag_s").where("test_idx is not null")
    right = table(spark, folder, "ref_beats", *ENTITY, "ref_idx", "t").where("ref_idx is not null")
    stated = F.when(~F.isnan("lag_s"), F.col("lag_s"))
    delays = nearest.run_delays(left.where(stated.isNull()), right, ENTITY, RUN, "test_idx", "ref_idx", "t", "t")
    placed = left.join(delays, [*ENTITY, *RUN], "left").withColumn("at", F.col("t") - F.coalesce(stated, "delay", F.lit(0.0)))
    near = nearest.nearest_pairs(placed, right, ENTITY, [*RUN, "test_idx"], "ref_idx", "at", "t", TOLERANCE_S)
    return near.withColumn("distance", F.round("distance", 6))


def cost_values(spark: SparkSession, folder: str) -> DataFrame:
    """Valid costs per minute of each run once: label in one spelling, a value in milliseconds turned to seconds.

    A value's unit shows in its ratio to the run's median cost, which is in seconds in both columns.
    """
    t = table(spark, folder, "detector_cost", "run_id", "record", "detector_label", "run_day", "best_s", "median_s", "best_s_per_min", "median_s_per_min").distinct()
    expected = F.try_divide(F.col("best_s") * F.col("median_s_per_min"), F.col("median_s"))
    milli = F.coalesce(F.abs(F.try_divide(F.col("best_s_per_min"), expected)) > 100, F.lit(False))
    value = percentiles.finite(F.when(milli, F.col("best_s_per_min") / 1000).otherwise(F.col("best_s_per_min")))
    activity = F.element_at(F.split("record", "_"), -1)
    return t.select(F.lower(F.trim("detector_label")).alias("label"), F.col("run_day").cast("string").alias("day"), activity.alias("activity"), value.alias("value")).where(F.col("value") >= 0)


def motion_values(spark: SparkSession, folder: str) -> DataFrame:
    """Valid gyro values of each segment once; zero is a resting wrist, negative and beyond 2000 deg/s is no reading."""
    t = table(spark, folder, "e4_motion", "record", "session_id", "seg", "gyro_rms_median", "loaded_at").distinct()
    value = percentiles.finite(F.col("gyro_rms_median"))
    activity = F.element_at(F.split("record", "_"), -1)
    return t.select(F.lit(None).cast("string").alias("label"), F.to_date("loaded_at").cast("string").alias("day"), activity.alias("activity"), value.alias("value")).where(F.col("value").between(0, 2000))


def _dimensions(values: DataFrame, metric: str) -> DataFrame:
    of = lambda name: F.struct(F.lit(name).alias("dimension"), F.col(name).alias("member"))
    stacked = values.withColumn("d", F.explode(F.array(of("day"), of("activity"))))
    return stacked.select(F.lit(metric).alias("metric"), "label", "d.dimension", "d.member", "value")


def p2_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of the cost per label and day or activity, and of the motion per day or activity; the rank error is 0."""
    values = _dimensions(cost_values(spark, folder), "best_s_per_min").unionByName(_dimensions(motion_values(spark, folder), "gyro_rms_median"))
    found = percentiles.multi_select(values, ["metric", "label", "dimension", "member"], "value", SHARES)
    return found.withColumn("value", F.round("value", 9)).withColumn("rank_error", F.lit(0.0))


def p2_combined(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles of the cost per label over all days, put together from one summary per label and month."""
    values = cost_values(spark, folder).withColumn("month", F.substring("day", 1, 7))
    parts = percentiles.summaries(values, ["label"], "month", "value", points=50)
    return percentiles.combine(parts, ["label"], SHARES, points=50).withColumn("value", F.round("value", 9))


def _packed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    sizes = written(tokens.token_counts(table(spark, folder, "documents", "doc_id", "text"), ["doc_id"], "text"), "sizes")
    kinds = table(spark, folder, "pack_sizes", "pack_id", "capacity_tokens")
    return packing.pack(sizes, ["doc_id"], "n_tokens", kinds, "pack_id", "capacity_tokens"), kinds


def p6_packing(spark: SparkSession, folder: str) -> DataFrame:
    """The container of each document, or of each piece of a longer one, for each capacity."""
    return _packed(spark, folder)[0]


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers of each capacity are."""
    packed, kinds = _packed(spark, folder)
    return packing.fill_report(packed, kinds, "pack_id", "capacity_tokens")


def _leaked(spark: SparkSession, folder: str) -> DataFrame:
    pages, items = table(spark, folder, "documents", "doc_id", "text", "line_boxes"), table(spark, folder, "eval_items", "item_id", "passage")
    return leakage.leaked_items(pages, "doc_id", "text", "line_boxes", items, "item_id", "passage")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaked(spark, folder).select("doc_id", "item_id")


def p7_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Each page's leaked items with the most words in a row it holds of each."""
    return _leaked(spark, folder).select("doc_id", "item_id", "n_words")


def p7_spans(spark: SparkSession, folder: str) -> DataFrame:
    """The stretches of each page's text that hold leaked passages, merged over the items, as characters."""
    return leakage.removal_spans(_leaked(spark, folder), "doc_id")


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    """Which evaluation items leaked, and onto how many pages."""
    return _leaked(spark, folder).groupBy("item_id").agg(F.count("*").alias("n_pages"), F.max("n_words").alias("most_words"))


def p8_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Each page's stretches of one language, in reading order, with confidence."""
    pages = table(spark, folder, "documents", "doc_id", "text", "lang", "line_boxes")
    model = language.fit(pages, "doc_id", "text", "lang")
    return language.language_segments(pages, ["doc_id"], "text", "line_boxes", model)


def p8_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The languages of each page with their words and confidence."""
    return language.page_languages(p8_segments(spark, folder), ["doc_id"])


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return language.label_cases(p8_documents(spark, folder), table(spark, folder, "documents", "doc_id", "lang"), ["doc_id"], "lang")


QUERIES = {
    "p1_found": p1_found,
    "p1_nearest": p1_nearest,
    "p1_nearest_every_run": p1_nearest_every_run,
    "p2_percentiles": p2_percentiles,
    "p2_combined": p2_combined,
    "p6_packing": p6_packing,
    "p6_fill": p6_fill,
    "p7_found": p7_found,
    "p7_matches": p7_matches,
    "p7_spans": p7_spans,
    "p7_items": p7_items,
    "p8_found": p8_found,
    "p8_documents": p8_documents,
    "p8_segments": p8_segments,
}

_COST = """
WITH c AS (SELECT DISTINCT run_id, record, detector_label, run_day, best_s, median_s, best_s_per_min, median_s_per_min FROM detector_cost),
u AS (SELECT lower(trim(detector_label)) AS label, CAST(run_day AS VARCHAR) AS day, split_part(record, '_', -1) AS activity,
    CASE WHEN coalesce(abs(best_s_per_min / (best_s * median_s_per_min / median_s)) > 100, false) THEN best_s_per_min / 1000 ELSE best_s_per_min END AS value FROM c),
cost AS (SELECT * FROM u WHERE isfinite(value) AND value >= 0),
m AS (SELECT DISTINCT record, session_id, seg, gyro_rms_median, loaded_at FROM e4_motion),
motion AS (SELECT CAST(NULL AS VARCHAR) AS label, CAST(CAST(loaded_at AS DATE) AS VARCHAR) AS day, split_part(record, '_', -1) AS activity, gyro_rms_median AS value FROM m WHERE isfinite(gyro_rms_median) AND gyro_rms_median BETWEEN 0 AND 2000),
a AS (SELECT 'best_s_per_min' AS metric, label, 'day' AS dimension, day AS member, value FROM cost UNION ALL SELECT 'best_s_per_min', label, 'activity', activity, value FROM cost
    UNION ALL SELECT 'gyro_rms_median', label, 'day', day, value FROM motion UNION ALL SELECT 'gyro_rms_median', label, 'activity', activity, value FROM motion)
"""


def _rounds(n: int) -> str:
    """Closest first, each beat once, as rounds: pairs that come first both for their reference and for their detection are taken."""
    out = ""
    for i in range(n):
        out += f""", b{i} AS (SELECT *, row_number() OVER (PARTITION BY record, session_id, detector, ref_idx ORDER BY d, ref_idx, test_idx) AS x, row_number() OVER (PARTITION BY record, session_id, detector, test_idx ORDER BY d, ref_idx, test_idx) AS y FROM c{i}),
t{i} AS (SELECT record, session_id, detector, ref_idx, test_idx FROM b{i} WHERE x = 1 AND y = 1),
c{i + 1} AS (SELECT * FROM c{i} ANTI JOIN t{i} USING (record, session_id, detector, ref_idx) ANTI JOIN t{i} z USING (record, session_id, detector, test_idx))"""
    return out + " " + " UNION ALL ".join(f"SELECT * FROM t{i}" for i in range(n))


_P1 = """
WITH l AS (SELECT DISTINCT record, session_id, detector, test_idx, CAST(round(t * 1e6) AS BIGINT) AS l, CAST(round(lag_s * 1e6) AS BIGINT) AS delay FROM det_beats WHERE t IS NOT NULL AND test_idx IS NOT NULL),
r AS (SELECT DISTINCT record, session_id, ref_idx, CAST(round(t * 1e6) AS BIGINT) AS r FROM ref_beats WHERE t IS NOT NULL AND ref_idx IS NOT NULL),
p AS (SELECT l.record, l.session_id, l.detector, l.l - r.r AS d FROM l JOIN r ON l.record = r.record AND l.session_id = r.session_id AND l.l - r.r BETWEEN -50000 AND 650000 WHERE delay IS NULL),
n AS (SELECT record, session_id, detector, CAST(floor(d / 5000) AS BIGINT) AS bin, count(*) AS n FROM p GROUP BY ALL),
s AS (SELECT *, sum(n) OVER (PARTITION BY record, session_id, detector ORDER BY bin RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS many FROM n),
m0 AS (SELECT record, session_id, detector, (bin + 0.5) * 5000 AS m FROM s WHERE (bin + 0.5) * 5000 BETWEEN 0 AND 605000 QUALIFY row_number() OVER (PARTITION BY record, session_id, detector ORDER BY many DESC, bin) = 1),
m1 AS (SELECT record, session_id, detector, avg(d) AS m FROM p JOIN m0 USING (record, session_id, detector) WHERE abs(d - m) <= 50000 GROUP BY ALL),
m2 AS (SELECT record, session_id, detector, avg(d) AS m FROM p JOIN m1 USING (record, session_id, detector) WHERE abs(d - m) <= 40000 GROUP BY ALL),
m3 AS (SELECT record, session_id, detector, CAST(round(avg(d)) AS BIGINT) AS m FROM p JOIN m2 USING (record, session_id, detector) WHERE abs(d - m) <= 40000 GROUP BY ALL)"""

ORACLES = {
    "p1_found": _P1
    + """,
a AS (SELECT record, session_id, detector, test_idx, l - coalesce(delay, m) AS at FROM l LEFT JOIN m3 USING (record, session_id, detector)),
c0 AS (SELECT a.record, a.session_id, a.detector, r.ref_idx, a.test_idx, abs(a.at - r.r) AS d FROM a JOIN r ON a.record = r.record AND a.session_id = r.session_id AND a.at - r.r BETWEEN -150000 AND 150000)"""
    + _rounds(6),
    "p2_combined": _COST
    + """, q AS (SELECT label, substr(day, 1, 7) AS month, value, row_number() OVER (PARTITION BY label, substr(day, 1, 7) ORDER BY value) AS rank, count(*) OVER (PARTITION BY label, substr(day, 1, 7)) AS n FROM cost),
k AS (SELECT label, value, n / 50 AS w FROM q JOIN (SELECT unnest(range(1, 51)) AS i) i ON rank = greatest(1, CAST(ceil(round(i / 50 * n, 9)) AS BIGINT))),
s AS (SELECT label, value, sum(sum(w)) OVER (PARTITION BY label ORDER BY value) AS upto FROM k GROUP BY label, value),
t AS (SELECT label, count(*) AS n FROM cost GROUP BY ALL), h AS (SELECT *, unnest([0.1e0, 0.5e0, 0.9e0, 0.99e0]) AS share FROM t)
SELECT h.label, h.n, h.share, round(min(s.value), 9) AS value, 0.02e0 AS rank_error FROM h JOIN s ON h.label IS NOT DISTINCT FROM s.label AND s.upto >= h.share * h.n - 1e-6 GROUP BY ALL""",
    "p1_nearest_every_run": _P1
    + """,
q AS (SELECT DISTINCT d.record, d.session_id, d.detector, d.test_idx, t - coalesce(CASE WHEN NOT isnan(lag_s) THEN lag_s END, m3.m / 1e6, 0) AS at FROM det_beats d LEFT JOIN m3 USING (record, session_id, detector) WHERE t IS NOT NULL AND d.test_idx IS NOT NULL),
k AS (SELECT DISTINCT record, session_id, ref_idx, t FROM ref_beats WHERE ref_idx IS NOT NULL AND t IS NOT NULL),
j AS (SELECT q.record, q.session_id, q.detector, q.test_idx, k.ref_idx, round(abs(q.at - k.t), 9) AS d FROM q JOIN k ON q.record = k.record AND q.session_id = k.session_id AND k.t BETWEEN q.at - 0.150000001 AND q.at + 0.150000001)
SELECT record, session_id, detector, test_idx, ref_idx, round(d, 6) AS distance FROM j QUALIFY row_number() OVER (PARTITION BY record, session_id, detector, test_idx ORDER BY d, ref_idx) = 1""",
    "p1_nearest": """
WITH l AS (SELECT DISTINCT record, session_id, detector, test_idx, t - lag_s AS at FROM det_beats WHERE lag_s IS NOT NULL AND t IS NOT NULL AND test_idx IS NOT NULL),
r AS (SELECT DISTINCT record, session_id, ref_idx, t FROM ref_beats WHERE ref_idx IS NOT NULL AND t IS NOT NULL),
j AS (SELECT l.record, l.session_id, l.detector, l.test_idx, r.ref_idx, round(abs(l.at - r.t), 9) AS d FROM l JOIN r ON l.record = r.record AND l.session_id = r.session_id AND r.t BETWEEN l.at - 0.150000001 AND l.at + 0.150000001)
SELECT record, session_id, detector, test_idx, ref_idx, round(d, 6) AS distance FROM j QUALIFY row_number() OVER (PARTITION BY record, session_id, detector, test_idx ORDER BY d, ref_idx) = 1""",
    "p2_percentiles": _COST
    + """, q AS (SELECT *, row_number() OVER w AS rank, count(*) OVER (PARTITION BY metric, label, dimension, member) AS n FROM a WINDOW w AS (PARTITION BY metric, label, dimension, member ORDER BY value)),
s AS (SELECT unnest([0.1e0, 0.5e0, 0.9e0, 0.99e0]) AS share)
SELECT metric, label, dimension, member, n, share, rank, round(value, 9) AS value, 0.0e0 AS rank_error FROM q JOIN s ON rank = greatest(1, CAST(ceil(round(share * n, 9)) AS BIGINT))""",
}
