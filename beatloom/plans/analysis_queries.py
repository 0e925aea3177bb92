"""Sources and sinks, sweeps, summaries and comparisons of results, and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from beatloom.functions.numbers import ratio, real, six
from beatloom.operators import conditioning as co
from beatloom.operators import detectors as de
from beatloom.operators import fiducial as fi
from beatloom.operators import matching as ma
from beatloom.operators import quality as qu
from beatloom.plans.costs import COST_SQL, ORDER, costs
from beatloom.session import ensure_checkpoint_dir
from beatloom.sources import files
from beatloom.sources.adapters import RUN, SESSION, SQL, intervals, reference_beats, signal
from beatloom.sources.tables import table
from beatloom.streaming import windows as st


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[six(df[c], c) if kind == "double" else c for c, kind in df.dtypes])


def _fine(df: DataFrame) -> DataFrame:
    """Nine decimals, for costs, which have seven."""
    return df.select(*[F.round(df[c], 9).alias(c) if kind == "double" else c for c, kind in df.dtypes])


def _floors(spark: SparkSession, folder: str, side: str = "a") -> DataFrame:
    t = table(spark, folder, f"prv_floor_{side}").distinct()
    return t.select(F.lower(F.trim("record")).alias("record"), "session_id", F.round("coverage_target", 2).alias("coverage_target"), *[real(F.col(c).cast("double")).alias(c) for c in ("floor_rmse", "floor_mae", "n_intervals", "n_detectors")])


def _motion(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "e4_motion", "record", "session_id", "seg", "gyro_rms_median", "gyro_rms_p90", "f1", "ibi_rmse", "rmssd_abserr", "sdnn_abserr").distinct()
    return t.select("record", "session_id", "seg", *[real(F.col(c)).alias(c) for c in ("gyro_rms_median", "gyro_rms_p90", "f1", "ibi_rmse", "rmssd_abserr", "sdnn_abserr")])


def s2_page_heads(spark: SparkSession, folder: str) -> DataFrame:
    """Head of each page as fields: the title, the number and the page, where they can be read."""
    head = F.substring_index("text", "\n", 1)
    d = table(spark, folder, "documents", "doc_id", "text").where("text is not null")
    numbers = F.regexp_extract_all(head, F.lit(r"([0-9]+)"), F.lit(1))
    return d.select("doc_id", F.regexp_extract(head, r"^([^.]*)\.", 1).alias("title"), F.get(numbers, F.lit(0)).alias("number"), F.get(numbers, F.size(numbers) - 1).alias("page"))


def s6_csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The motion table written as CSV and read back with its schema."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    rows = _motion(spark, folder)
    files.write_csv(rows, path)
    return _rounded(files.read_csv(spark, path, rows.schema.simpleString()[7:-1].replace(":", " ")))


def s8_json_fields(spark: SparkSession, folder: str) -> DataFrame:
    """The k of each event's JSON properties, 0 where there is none."""
    e = table(spark, folder, "events", "event_id", "props")
    return e.select("event_id", F.coalesce(F.from_json("props", "k long")["k"], F.lit(0)).alias("k"))


def x1_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Detectors x coverages on the raw excerpts against the session's reference beats: counts and F1."""
    ensure_checkpoint_dir(spark)
    raw = signal(spark, folder)
    prepared = co.prepare(raw, SESSION).checkpoint()  # read by the numpy detectors and by TERMA
    anchors = de.detect(prepared, SESSION)
    fs = raw.groupBy(*SESSION).agg(F.first("fs").alias("fs"), F.count("*").alias("n"))
    beats = anchors.join(fs, SESSION).select(*RUN, F.col("idx").alias("test_idx"), (F.col("idx") / F.col("fs")).alias("t"))
    inside = reference_beats(spark, folder).join(fs, SESSION).where(F.col("t") < F.col("n") / F.col("fs")).select(*SESSION, "ref_idx", "t")
    # All coverages at once, as one more key of the windows, not one plan after the other.
    targets = F.explode(F.array(*map(F.lit, (1.0, 0.9, 0.75, 0.5))))
    scored = qu.scores(raw, SESSION, 2.0).withColumn("coverage_target", targets)
    entity = [*SESSION, "coverage_target"]
    w = Window.partitionBy(*entity)
    least = F.greatest(F.lit(1), F.bround(F.count("*").over(w) * F.col("coverage_target")).cast("int"))
    kept = scored.withColumn("kept", F.rank().over(w.orderBy(F.col("score").desc())) <= least).where("kept").select(*entity, "w").checkpoint()
    within = lambda df: df.withColumn("w", F.floor(F.col("t") / 2.0)).join(kept, [*SESSION, "w"]).drop("w")
    ref = within(inside).select(*entity, "ref_idx", F.col("t").alias("rt")).checkpoint()
    test = within(beats).select(*entity, "detector", "test_idx", F.col("t").alias("tt")).checkpoint()
    delay = ma.grid_delay(ref, test, entity, ["detector"])
    shifted = test.join(delay, [*entity, "detector"]).select(*entity, "detector", "test_idx", (F.col("tt") - F.col("delay")).alias("tt")).checkpoint()
    return _rounded(ma.detection_counts(ma.match(ref, shifted, entity, ["detector"], 0.150), ref, shifted, entity, ["detector"]))


def x2_fiducials(spark: SparkSession, folder: str) -> DataFrame:
    """The four fiducial points of one detector's pulses: spread of their pulse intervals per session."""
    ensure_checkpoint_dir(spark)
    raw = co.prepare(signal(spark, folder), SESSION).checkpoint()  # read by every fiducial
    pulse = fi.pulses(raw, de.detect(raw, SESSION, ["msptdfast"]).drop("detector"), SESSION).checkpoint()
    w = Window.partitionBy(*SESSION).orderBy("peak")
    out = None
    for kind in fi.POINTS:
        at = fi.locate(raw, pulse, SESSION, kind)
        d = at.withColumn("d", (F.col("t") - F.lag("t").over(w)) * 1000.0)
        g = d.groupBy(*SESSION).agg(F.count("d").alias("n"), F.stddev_samp("d").alias("sd_ms")).withColumn("fiducial", F.lit(kind))
        out = g if out is None else out.unionByName(g)
    return _rounded(out)


def x5_motion(spark: SparkSession, folder: str) -> DataFrame:
    """Motion against error per activity: medians and 90th percentiles."""
    m = _motion(spark, folder).withColumn("activity", F.element_at(F.split("record", "_"), -1))
    g = m.groupBy("activity").agg(F.count("*").alias("n"), F.median("gyro_rms_median").alias("gyro_median"), F.percentile("gyro_rms_p90", F.lit(0.9)).alias("gyro_p90"), F.median("ibi_rmse").alias("ibi_rmse"), F.median("rmssd_abserr").alias("rmssd_abserr"))
    return _rounded(g)


def x10_count_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """Detected per reference beats of each run, and whether it lies in 0.90 to 1.10."""
    d = table(spark, folder, "det_beats", *RUN, "test_idx").distinct().groupBy(*RUN).agg(F.count("*").alias("n_test"))
    r = table(spark, folder, "ref_beats", *SESSION, "ref_idx").where("ref_idx is not null").distinct().groupBy(*SESSION).agg(F.count("*").alias("n_ref"))
    q = d.join(r, SESSION).withColumn("ratio", F.col("n_test") / F.col("n_ref"))
    return _rounded(q.withColumn("good", F.col("ratio").between(0.90, 1.10)).select(*RUN, "ratio", "good"))


def a1_run_summary(spark: SparkSession, folder: str) -> DataFrame:
    c = costs(spark, folder)
    return _fine(c.groupBy("label").agg(F.count("*").alias("n_runs"), F.median("cost").alias("cost"), F.max("cost").alias("worst")))


def a2_leaderboard(spark: SparkSession, folder: str) -> DataFrame:
    """Per label in reporting order: records, median cost, and its place by cost."""
    place = F.lit(None).cast("int")
    for i, name in enumerate(ORDER):
        place = F.when(F.col("label") == name, F.lit(i)).otherwise(place)
    g = costs(spark, folder).where("label is not null").groupBy("label").agg(F.countDistinct("record").alias("n_records"), F.median("cost").alias("cost"))
    ranked = g.withColumn("by_cost", F.rank().over(Window.orderBy(F.round("cost", 9))))  # seven labels
    return _fine(ranked.withColumn("place", place).orderBy("place"))


def a3_correlation(spark: SparkSession, folder: str) -> DataFrame:
    """Pearson correlations of F1 with the errors over rows without a missing value, per activity."""
    m = _motion(spark, folder).dropna(subset=["f1", "ibi_rmse", "rmssd_abserr"]).withColumn("activity", F.element_at(F.split("record", "_"), -1))
    g = m.groupBy("activity").agg(F.count("*").alias("n"), F.corr("f1", "ibi_rmse").alias("r_ibi_rmse"), F.corr("f1", "rmssd_abserr").alias("r_rmssd"))
    return _rounded(g)


def a4_coverage_curve(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_floors(spark, folder).groupBy("coverage_target").agg(F.count("floor_rmse").alias("n"), F.median("floor_rmse").alias("floor_rmse"), F.median("floor_mae").alias("floor_mae")))


def a5_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """Median cost per activity, one column for each detector."""
    keys = list(de.REGISTRY)
    c = costs(spark, folder).withColumn("activity", F.element_at(F.split("record", "_"), -1))
    return _fine(c.groupBy("activity").pivot("detector", keys).agg(F.median("cost")))


def a6_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Both copies of the floor table side by side per coverage: columns ``metric__side``."""
    both = _floors(spark, folder, "a").withColumn("side", F.lit("a")).unionByName(_floors(spark, folder, "b").withColumn("side", F.lit("b")))
    wide = both.groupBy("coverage_target").pivot("side", ["a", "b"]).agg(F.median("floor_rmse").alias("rmse"), F.median("floor_mae").alias("mae"))
    return _rounded(wide.select("coverage_target", *[F.col(f"{s}_{m}").alias(f"{m}__{s}") for m in ("rmse", "mae") for s in "ab"]))


def a7_discrimination(spark: SparkSession, folder: str) -> DataFrame:
    """How far a metric tells records apart: best, worst, worst / best and 100 SD / mean of the records' medians."""
    names = ["ibi_rmse", "rmssd_abserr", "sdnn_abserr"]
    m = _motion(spark, folder).groupBy("record").agg(*[F.median(n).alias(n) for n in names])
    rows = m.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("v")) for n in names])).alias("e")).select("e.*").where("v is not null")
    g = rows.groupBy("metric").agg(F.min("v").alias("best"), F.max("v").alias("worst"), F.stddev_samp("v").alias("sd"), F.avg("v").alias("mean"))
    return _rounded(g.select("metric", "best", "worst", ratio(F.col("worst"), F.col("best")).alias("spread"), (100 * F.col("sd") / F.col("mean")).alias("cv_pct")))


def a8_quantisation(spark: SparkSession, folder: str) -> DataFrame:
    """Expected error of interval times on a grid: sqrt((T / sqrt 12 x sqrt 2)^2 + floor^2) by sampling rate, floor by data."""
    rates = table(spark, folder, "ppg_samples", "fs").distinct()
    floor = _floors(spark, folder).where("coverage_target = 1").agg(F.median("floor_rmse").alias("floor_ms"))
    step = F.lit(1000.0) / F.col("fs")
    return _rounded(rates.crossJoin(F.broadcast(floor)).select("fs", "floor_ms", F.sqrt(step * step / 6.0 + F.col("floor_ms") * F.col("floor_ms")).alias("expected_ms")))


def a9_floor_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Each record's floor at coverage 1 and its excess over the median of all."""
    f = _floors(spark, folder).where("coverage_target = 1").groupBy("record").agg(F.median("floor_rmse").alias("floor_rmse"))
    mid = f.agg(F.median("floor_rmse").alias("middle"))
    return _rounded(f.crossJoin(F.broadcast(mid)).select("record", "floor_rmse", (F.col("floor_rmse") - F.col("middle")).alias("excess")))


def a10_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Agreement of the two copies' floors per coverage (bias and limits)."""
    key = ["record", "session_id", "coverage_target"]
    a, b = (_floors(spark, folder, s).where("coverage_target is not null").groupBy(*key).agg(F.max("floor_rmse").alias(f"v{s}")) for s in "ab")
    return _rounded(ma.bland_altman(a.join(b, key).where("va is not null and vb is not null"), ["coverage_target"], "va", "vb"))


def a11_verify(spark: SparkSession, folder: str) -> DataFrame:
    """Column by column comparison of the two copies: rows of one side only, missing on one side, greatest difference, rows beyond 1e-6."""
    key = ["record", "session_id", "coverage_target"]
    names = ["floor_rmse", "floor_mae", "n_intervals", "n_detectors"]
    a, b = (_floors(spark, folder, s).groupBy(*key).agg(*[F.max(n).alias(f"{n}_{s}") for n in names], F.lit(1).alias(f"in_{s}")) for s in "ab")
    both = a.alias("a").join(b.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key], "full_outer")
    rows = both.select("in_a", "in_b", F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"{n}_a").alias("va"), F.col(f"{n}_b").alias("vb")) for n in names])).alias("e")).select("in_a", "in_b", "e.*")
    d, shared = F.abs(F.col("va") - F.col("vb")), F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    many = lambda c, name: F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(name)
    return _rounded(rows.groupBy("column").agg(many(F.col("in_a").isNotNull(), "n_a"), many(F.col("in_b").isNotNull(), "n_b"), many(F.col("in_b").isNull(), "n_only_a"), many(F.col("in_a").isNull(), "n_only_b"), many(shared & (F.col("va").isNull() != F.col("vb").isNull()), "n_missing"), F.max(d).alias("greatest"), many(d > 1e-6, "n_beyond")))


def o3_best_run(spark: SparkSession, folder: str) -> DataFrame:
    """The cheapest run of each record; ties go to the lower run."""
    c = costs(spark, folder)
    return c.groupBy("record").agg(F.min(F.struct("cost", "run_id")).alias("m")).select("record", "m.run_id", "m.cost")


def o4_top_records(spark: SparkSession, folder: str) -> DataFrame:
    """The ten records with most intervals."""
    g = intervals(spark, folder).groupBy("record").agg(F.count("*").alias("n"))
    return g.orderBy(F.col("n").desc(), "record").limit(10)


def o7_set_operations(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions by the tables they are in: both, intervals only, reference only."""
    t, r = intervals(spark, folder).select(*SESSION), reference_beats(spark, folder).select(*SESSION)
    both, a, b = t.intersect(r), t.subtract(r), r.subtract(t)
    tag = lambda df, name: df.withColumn("where", F.lit(name))
    return tag(both, "both").unionByName(tag(a, "intervals")).unionByName(tag(b, "reference"))


def g1_distinct_counts(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "tachogram", *RUN, "correction")
    return t.groupBy("correction").agg(F.countDistinct("record").alias("n_records"), F.countDistinct("session_id", "detector").alias("n_series"))


def _events(spark: SparkSession, folder: str) -> DataFrame:
    e = st.stream_of(spark, f"{folder}/events.parquet")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


def st_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    """Daily windows of the event stream by type."""
    return _rounded(st.drain(st.tumbling(_events(spark, folder), ["event_type"], "ts", "value", "1 day"), "tumbling", "complete"))


def st_sliding(spark: SparkSession, folder: str) -> DataFrame:
    """Six-hour windows every five hours, by type."""
    return _rounded(st.drain(st.sliding(_events(spark, folder), ["event_type"], "ts", "value", "6 hours", "5 hours"), "sliding", "complete"))


def st_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of each user with pauses of up to six hours."""
    return st.drain(st.sessions(_events(spark, folder), ["user_id"], "ts", "6 hours"), "sessions", "complete")


def st_band_join(spark: SparkSession, folder: str) -> DataFrame:
    """Clicks and later purchases of a user within an hour, from two streams."""
    e = _events(spark, folder)
    kinds = spark.read.parquet(f"{folder}/events.parquet").select("event_type").distinct().orderBy("event_type").limit(2).collect()
    a = e.where(F.col("event_type") == kinds[0][0]).select("user_id", F.col("ts").alias("lt"), F.col("event_id").alias("left_id"))
    b = _events(spark, folder).where(F.col("event_type") == kinds[1][0]).select("user_id", F.col("ts").alias("rt"), F.col("event_id").alias("right_id"))
    return st.drain(st.band_join(a, b, "user_id", "lt", "rt", 3600, late="400 days").select("left_id", "right_id"), "band")


def st_adaptive_level(spark: SparkSession, folder: str) -> DataFrame:
    """Onsets over an adaptive level per user, with state kept between triggers."""
    return _rounded(st.drain(st.adaptive_level(_events(spark, folder), "user_id", "ts", "value"), "level"))


QUERIES = {f.__name__: f for f in (s2_page_heads, s6_csv_round_trip, s8_json_fields, x1_sweep, x2_fiducials, x5_motion, x10_count_ratio, a1_run_summary, a2_leaderboard, a3_correlation, a4_coverage_curve, a5_pivot, a6_comparison, a7_discrimination, a8_quantisation, a9_floor_summary, a10_agreement, a11_verify, o3_best_run, o4_top_records, o7_set_operations, g1_distinct_counts, st_tumbling, st_sliding, st_sessions, st_band_join, st_adaptive_level)}

_C = COST_SQL


def _f(side: str) -> str:
    cols = ", ".join(f"CASE WHEN isfinite(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) END AS {c}" for c in ("floor_rmse", "floor_mae", "n_intervals", "n_detectors"))
    return f"f{side} AS (SELECT lower(trim(record)) AS record, session_id, round(coverage_target, 2) AS coverage_target, {cols} FROM (SELECT DISTINCT * FROM prv_floor_{side}))"


_MO = "WITH m AS (SELECT record, split_part(record, '_', -1) AS activity, session_id, seg, " + ", ".join(f"CASE WHEN isfinite({c}) THEN {c} END AS {c}" for c in ("gyro_rms_median", "gyro_rms_p90", "f1", "ibi_rmse", "rmssd_abserr", "sdnn_abserr")) + " FROM (SELECT DISTINCT record, session_id, seg, gyro_rms_median, gyro_rms_p90, f1, ibi_rmse, rmssd_abserr, sdnn_abserr FROM e4_motion))"
_UN = " UNION ALL ".join(f"SELECT '{n}' AS metric, median({n}) AS v FROM m GROUP BY record" for n in ("ibi_rmse", "rmssd_abserr", "sdnn_abserr"))
_VF = " UNION ALL ".join(f"SELECT '{n}' AS \"column\", a.one AS in_a, b.one AS in_b, a.{n} AS va, b.{n} AS vb FROM ka a FULL JOIN kb b ON a.record IS NOT DISTINCT FROM b.record AND a.session_id IS NOT DISTINCT FROM b.session_id AND a.coverage_target IS NOT DISTINCT FROM b.coverage_target" for n in ("floor_rmse", "floor_mae", "n_intervals", "n_detectors"))
_MAX = ", ".join(f"max({n}) AS {n}" for n in ("floor_rmse", "floor_mae", "n_intervals", "n_detectors"))

ORACLES = {
    "s2_page_heads": r"WITH h AS (SELECT doc_id, split_part(text, chr(10), 1) AS h FROM documents WHERE text IS NOT NULL) SELECT doc_id, regexp_extract(h, '^([^.]*)\.', 1) AS title, regexp_extract_all(h, '[0-9]+')[1] AS number, regexp_extract_all(h, '[0-9]+')[-1] AS page FROM h",
    "s6_csv_round_trip": _MO + " SELECT record, session_id, seg, round(gyro_rms_median, 6) + 0e0 AS gyro_rms_median, round(gyro_rms_p90, 6) + 0e0 AS gyro_rms_p90, round(f1, 6) AS f1, round(ibi_rmse, 6) AS ibi_rmse, round(rmssd_abserr, 6) AS rmssd_abserr, round(sdnn_abserr, 6) AS sdnn_abserr FROM m",
    "s8_json_fields": "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events",
    "x5_motion": _MO + " SELECT activity, count(*) AS n, round(median(gyro_rms_median), 6) AS gyro_median, round(quantile_cont(gyro_rms_p90, 0.9), 6) AS gyro_p90, round(median(ibi_rmse), 6) AS ibi_rmse, round(median(rmssd_abserr), 6) AS rmssd_abserr FROM m GROUP BY ALL",
    "x10_count_ratio": "WITH d AS (SELECT record, session_id, detector, count(*) AS n_test FROM (SELECT DISTINCT record, session_id, detector, test_idx FROM det_beats) GROUP BY ALL), r AS (SELECT record, session_id, count(*) AS n_ref FROM (SELECT DISTINCT record, session_id, ref_idx FROM ref_beats WHERE ref_idx IS NOT NULL) GROUP BY ALL) SELECT record, session_id, detector, round(n_test / n_ref, 6) AS ratio, n_test / n_ref BETWEEN 0.90 AND 1.10 AS good FROM d JOIN r USING (record, session_id)",
    "a1_run_summary": _C + " SELECT label, count(*) AS n_runs, round(median(cost), 9) AS cost, round(max(cost), 9) AS worst FROM c GROUP BY ALL",
    "a2_leaderboard": _C + ", g AS (SELECT label, place, count(DISTINCT record) AS n_records, median(cost) AS cost FROM c WHERE label IS NOT NULL GROUP BY ALL) SELECT label, n_records, round(cost, 9) AS cost, rank() OVER (ORDER BY round(cost, 9)) AS by_cost, place FROM g",
    "a3_correlation": _MO + " SELECT activity, count(*) AS n, round(corr(f1, ibi_rmse), 6) AS r_ibi_rmse, round(corr(f1, rmssd_abserr), 6) AS r_rmssd FROM m WHERE f1 IS NOT NULL AND ibi_rmse IS NOT NULL AND rmssd_abserr IS NOT NULL GROUP BY ALL",
    "a4_coverage_curve": f"WITH {_f('a')} SELECT coverage_target, count(floor_rmse) AS n, round(median(floor_rmse), 6) AS floor_rmse, round(median(floor_mae), 6) AS floor_mae FROM fa GROUP BY ALL",
    "a5_pivot": _C + " SELECT activity, " + ", ".join(f"round(median(cost) FILTER (detector = '{k}'), 9) AS {k}" for k in de.REGISTRY) + " FROM c GROUP BY ALL",
    "a6_comparison": f"WITH {_f('a')}, {_f('b')}, u AS (SELECT *, 'a' AS side FROM fa UNION ALL SELECT *, 'b' FROM fb) SELECT coverage_target, " + ", ".join(f"round(median(floor_{m}) FILTER (side = '{s}'), 6) AS {m}__{s}" for m in ("rmse", "mae") for s in "ab") + " FROM u GROUP BY ALL",
    "a7_discrimination": f"{_MO}, u AS ({_UN}) SELECT metric, round(min(v), 6) AS best, round(max(v), 6) AS worst, CASE WHEN min(v) <> 0 THEN round(max(v) / min(v), 6) END AS spread, round(100 * stddev_samp(v) / avg(v), 6) AS cv_pct FROM u WHERE v IS NOT NULL GROUP BY ALL",
    "a8_quantisation": f"WITH {_f('a')}, fl AS (SELECT median(floor_rmse) AS floor_ms FROM fa WHERE coverage_target = 1) SELECT fs, round(floor_ms, 6) AS floor_ms, round(sqrt((1000 / fs / sqrt(12) * sqrt(2)) ** 2 + floor_ms ** 2), 6) AS expected_ms FROM (SELECT DISTINCT fs FROM ppg_samples), fl",
    "a9_floor_summary": f"WITH {_f('a')}, g AS (SELECT record, median(floor_rmse) AS v FROM fa WHERE coverage_target = 1 GROUP BY ALL) SELECT record, round(v, 6) AS floor_rmse, round(v - (SELECT median(v) FROM g), 6) + 0e0 AS excess FROM g",
    "a10_agreement": f"WITH {_f('a')}, {_f('b')}, ka AS (SELECT record, session_id, coverage_target, max(floor_rmse) AS va FROM fa WHERE coverage_target IS NOT NULL GROUP BY ALL), kb AS (SELECT record, session_id, coverage_target, max(floor_rmse) AS vb FROM fb WHERE coverage_target IS NOT NULL GROUP BY ALL), g AS (SELECT coverage_target, count(*) AS n, avg(vb - va) AS m, stddev_samp(vb - va) AS s FROM ka JOIN kb USING (record, session_id, coverage_target) WHERE va IS NOT NULL AND vb IS NOT NULL GROUP BY ALL) SELECT coverage_target, n, CASE WHEN n >= 3 THEN round(m, 6) + 0e0 END AS bias, CASE WHEN n >= 3 THEN round(m - 1.96 * s, 6) + 0e0 END AS lower, CASE WHEN n >= 3 THEN round(m + 1.96 * s, 6) + 0e0 END AS upper FROM g",
    "a11_verify": f"WITH {_f('a')}, {_f('b')}, ka AS (SELECT record, session_id, coverage_target, 1 AS one, {_MAX} FROM fa GROUP BY ALL), kb AS (SELECT record, session_id, coverage_target, 1 AS one, {_MAX} FROM fb GROUP BY ALL), u AS ({_VF}) SELECT \"column\", count(in_a) AS n_a, count(in_b) AS n_b, count(*) FILTER (in_b IS NULL) AS n_only_a, count(*) FILTER (in_a IS NULL) AS n_only_b, count(*) FILTER (in_a = 1 AND in_b = 1 AND (va IS NULL) <> (vb IS NULL)) AS n_missing, round(max(abs(va - vb)), 6) AS greatest, count(*) FILTER (abs(va - vb) > 1e-6) AS n_beyond FROM u GROUP BY ALL",
    "o3_best_run": _C + " SELECT record, run_id, cost FROM c QUALIFY row_number() OVER (PARTITION BY record ORDER BY cost, run_id) = 1",
    "o4_top_records": f"WITH {SQL['tach']} SELECT record, count(*) AS n FROM tach GROUP BY ALL ORDER BY n DESC, record LIMIT 10",
    "o7_set_operations": f"WITH {SQL['tach']}, {SQL['ref']}, t AS (SELECT DISTINCT record, session_id FROM tach), r AS (SELECT DISTINCT record, session_id FROM ref) SELECT *, 'both' AS \"where\" FROM (SELECT * FROM t INTERSECT SELECT * FROM r) UNION ALL SELECT *, 'intervals' FROM (SELECT * FROM t EXCEPT SELECT * FROM r) UNION ALL SELECT *, 'reference' FROM (SELECT * FROM r EXCEPT SELECT * FROM t)",
    "g1_distinct_counts": "SELECT correction, count(DISTINCT record) AS n_records, count(DISTINCT (session_id, detector)) AS n_series FROM tachogram GROUP BY ALL",
    "st_tumbling": "SELECT event_type, date_trunc('day', ts) AS start, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL",
    "st_sliding": "SELECT event_type, make_timestamp(s * 1000000) AS start, count(*) AS n, round(max(value), 6) AS top FROM (SELECT event_type, value, (CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) // 18000 - k) * 18000 AS s, epoch_us(ts) / 1e6 AS t FROM events, (VALUES (0), (1)) v(k)) WHERE t < s + 21600 GROUP BY ALL",
    "st_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS stop, count(*) AS n FROM s GROUP BY user_id, s",
    "st_band_join": "WITH k AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS n FROM (SELECT DISTINCT event_type FROM events)) SELECT a.event_id AS left_id, b.event_id AS right_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 3600 SECONDS AND a.ts + INTERVAL 3600 SECONDS WHERE a.event_type = (SELECT event_type FROM k WHERE n = 1) AND b.event_type = (SELECT event_type FROM k WHERE n = 2)",
}
