"""Matching of detected with reference beats, corrections of intervals, and accuracy metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from beatloom.functions.numbers import six
from beatloom.operators import correction as cr
from beatloom.operators import hrv
from beatloom.operators import matching as ma
from beatloom.operators.detectors import REGISTRY
from beatloom.plans.costs import COST_SQL, costs
from beatloom.session import written
from beatloom.sources.adapters import RUN, SESSION, SQL, detected_beats, intervals, number, reference_beats, screened
from beatloom.sources.tables import table

RUN_ONLY = ["detector"]
TOLERANCE_S = 0.150


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[six(df[c], c) if kind == "double" else c for c, kind in df.dtypes])


def _sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """References and the detections of every run, the delay taken off: the stated one, or the one that the beats show."""
    ref = reference_beats(spark, folder).select(*SESSION, "ref_idx", F.col("t").alias("rt"), F.col("k").alias("rk"))
    test = ma.with_delay(ref, detected_beats(spark, folder), SESSION, RUN_ONLY, "lag_s")
    return ref, test.select(*RUN, "test_idx", F.round(F.col("t") - F.col("lag_s"), 9).alias("tt"), F.col("k").alias("tk"))


def _matches(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    ref, test = _sides(spark, folder)
    return ma.match(ref.drop("rk"), test.drop("tk"), SESSION, RUN_ONLY, TOLERANCE_S), ref, test


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    return ma.paired_intervals(*_matches(spark, folder), SESSION, RUN_ONLY)


def j1_band_join(spark: SparkSession, folder: str) -> DataFrame:
    ref, test = _sides(spark, folder)
    pairs = ma.band_join(ref, test, SESSION, -TOLERANCE_S, TOLERANCE_S)
    return _rounded(pairs.select(*RUN, "ref_idx", "test_idx", (F.col("tt") - F.col("rt")).alias("apart")))


def j3_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest detection of each run to each reference beat of its session, however far."""
    ref, test = _sides(spark, folder)
    asked = ref.join(test.select(*RUN).distinct(), SESSION)
    return _rounded(ma.nearest(asked, test, RUN))


def x9_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Per detector the mean of the lesser of sensitivity and PPV, and whether it reaches 0.90."""
    counts = ma.detection_counts(*_matches(spark, folder), SESSION, RUN_ONLY)
    g = counts.groupBy("detector").agg(F.count("*").alias("n_runs"), F.avg(F.least("sensitivity", "ppv")).alias("agreement"))
    return _rounded(g.withColumn("good", F.col("agreement") >= 0.90))


def x11_best_case(spark: SparkSession, folder: str) -> DataFrame:
    """The run with the best F1 of each detector; ties go to the first record and session."""
    counts = ma.detection_counts(*_matches(spark, folder), SESSION, RUN_ONLY).where("f1 is not null")
    best = counts.withColumn("f1", F.round("f1", 9)).groupBy("detector").agg(F.min(F.struct((-F.col("f1")).alias("f"), "record", "session_id")).alias("m"))
    return _rounded(best.select("detector", F.col("m.record").alias("record"), F.col("m.session_id").alias("session_id"), (-F.col("m.f")).alias("f1")))


def x4_strategies(spark: SparkSession, folder: str) -> DataFrame:
    """Time-domain indices of each run under each correction strategy."""
    raw = _numbered(spark, folder)
    out = None
    for name, strategy in cr.CORRECTIONS.items():
        fixed = number(strategy(raw, RUN).select(*RUN, F.col("n").alias("k"), "ibi_s"), RUN, ["k"], "n")
        one = hrv.time_domain(fixed, RUN).withColumn("strategy", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return _rounded(out)


def m1_delay(spark: SparkSession, folder: str) -> DataFrame:
    """The delay of every run as its beats show it."""
    ref = reference_beats(spark, folder).select(*SESSION, "ref_idx", F.col("t").alias("rt"))
    test = detected_beats(spark, folder).select(*RUN, F.col("t").alias("tt"))
    return _rounded(ma.grid_delay(ref, test, SESSION, RUN_ONLY))


def m2_matches(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_matches(spark, folder)[0])


def m3_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(ma.detection_counts(*_matches(spark, folder), SESSION, RUN_ONLY))


def m3_missed(spark: SparkSession, folder: str) -> DataFrame:
    """Reference beats that a run of the session has no match for."""
    matches, ref, test = _matches(spark, folder)
    runs = test.select(*RUN).distinct()
    return ref.join(runs, SESSION).select(*RUN, "ref_idx").join(matches, [*RUN, "ref_idx"], "left_anti")


def m4_paired_intervals(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_pairs(spark, folder))


def l2_interval_error(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(ma.interval_error(_pairs(spark, folder), RUN))


def l3_bland_altman(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(ma.bland_altman(_pairs(spark, folder), RUN, "rr_s", "pp_s"))


def l4_concordance(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(ma.concordance(_pairs(spark, folder), RUN, "rr_s", "pp_s"))


def l5_equivalence(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(ma.equivalence(_pairs(spark, folder), RUN, "rr_s", "pp_s"))


def l6_hrv_error(spark: SparkSession, folder: str) -> DataFrame:
    """Each time-domain index of a run against that of the session's reference beats: one row per index."""
    ref = reference_beats(spark, folder)
    w = Window.partitionBy(*SESSION).orderBy("k")
    own = ref.select(*SESSION, "k", (F.col("t") - F.lag("t").over(w)).alias("ibi_s")).where(F.col("ibi_s").between(0.30, 2.00))
    keys = ["mean_nn", "sdnn", "rmssd", "pnn50", "sdsd"]
    truth = hrv.time_domain(number(own, SESSION, ["k"], "n"), SESSION).select(*SESSION, *[F.col(k).alias(f"{k}_ref") for k in keys])
    test = hrv.time_domain(screened(spark, folder), RUN).select(*RUN, *keys)
    both = test.join(truth, SESSION)
    rows = both.select(*RUN, F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"{k}_ref").alias("ref"), F.col(k).alias("test")) for k in keys])).alias("e")).select(*RUN, "e.*")
    err = F.col("test") - F.col("ref")
    return _rounded(rows.select(*RUN, "key", "ref", "test", err.alias("err"), F.abs(err).alias("abserr"), F.try_divide(100.0 * err, F.col("ref")).alias("pcterr")))


def l7_consensus_floor(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(ma.consensus_floor(_pairs(spark, folder), SESSION))


def _run_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The result row of each run: counts, F1, the delay taken off, and the errors of its paired intervals."""
    found = ma.with_delay(reference_beats(spark, folder).select(*SESSION, "ref_idx", F.col("t").alias("rt")), detected_beats(spark, folder), SESSION, RUN_ONLY, "lag_s")
    lag = found.groupBy(*RUN).agg((F.min("lag_s") * 1000.0).alias("lag_ms"))
    matches, ref, test = _matches(spark, folder)
    matches = written(matches, "matches")  # read for the counts and for the intervals
    counts = ma.detection_counts(matches, ref, test, SESSION, RUN_ONLY)
    errors = ma.interval_error(ma.paired_intervals(matches, ref, test, SESSION, RUN_ONLY), RUN)
    return counts.join(lag, RUN).join(errors, RUN, "left")


def x1_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The result row of each run of the given detections."""
    return _rounded(_run_rows(spark, folder))


def a2_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Leaderboard: per detector label the records, medians over runs of F1 and interval errors, and the median cost of that label."""
    label = F.lit(None).cast("string")
    for key, (name, *_) in REGISTRY.items():
        label = F.when(F.col("detector") == key, F.lit(name)).otherwise(label)
    rows = _run_rows(spark, folder).withColumn("label", label)
    g = rows.groupBy("label").agg(F.countDistinct("record").alias("n_records"), (100.0 * F.median("f1")).alias("f1_pct"), F.median("ibi_mae").alias("ibi_mae_ms"), F.median("ibi_rmse").alias("ibi_rmse_ms"))
    cost = costs(spark, folder).groupBy("label").agg(F.median("cost").alias("cost_s_per_min"))
    return _rounded(g.join(cost, "label", "left"))


def c1_screen(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(cr.screen(intervals(spark, folder)).select(*RUN, "k", "ibi_s"))


def _numbered(spark: SparkSession, folder: str) -> DataFrame:
    return number(intervals(spark, folder), RUN, ["k"], "n").select(*RUN, "k", "n", "ibi_s")


def c2_median_mad(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(cr.median_mad(_numbered(spark, folder), RUN).select(*RUN, "k", "ibi_s"))


def c3_adaptive(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(cr.adaptive(_numbered(spark, folder), RUN))


def c4_fraction_corrected(spark: SparkSession, folder: str) -> DataFrame:
    """Share of a run's intervals that each filter takes out."""
    raw = _numbered(spark, folder)
    totals = raw.groupBy(*RUN).agg(F.count("*").alias("n_input"))
    kept = [f(raw, RUN).groupBy(*RUN).agg(F.count("*").alias(f"kept_{name}")) for name, f in cr.CORRECTIONS.items() if name != "adaptive"]
    for k in kept:
        totals = totals.join(k, RUN, "left")
    share = lambda name: cr.fraction_corrected(F.col("n_input") - F.coalesce(f"kept_{name}", F.lit(0)), F.col("n_input")).alias(name)
    return _rounded(totals.select(*RUN, "n_input", share("none"), share("median_mad")))


def x6_integrity(spark: SparkSession, folder: str) -> DataFrame:
    """Reference rhythm of each session: share of intervals a heart cannot have, flagged above 2 %, and the rate."""
    w = Window.partitionBy(*SESSION).orderBy("k")
    rr = reference_beats(spark, folder).select(*SESSION, (F.col("t") - F.lag("t").over(w)).alias("rr")).where("rr is not null")
    odd = (~F.col("rr").between(0.30, 2.00)).cast("double")
    g = rr.groupBy(*SESSION).agg(F.avg(odd).alias("implausible"), F.median(F.try_divide(F.lit(60.0), F.col("rr"))).alias("rate"))
    return _rounded(g.withColumn("flagged", F.col("implausible") > 0.02))


def s3_annotations(spark: SparkSession, folder: str) -> DataFrame:
    """Beats among the annotations by their symbol, with their time from the sample number."""
    a = table(spark, folder, "ref_beats", *SESSION, "sample_no", "symbol").distinct()
    # The annotation symbols that mark beats.
    beats = list("NLRBAaJSVrFejnE/fQ?")
    return a.where(F.col("symbol").isin(beats)).select(*SESSION, "symbol", F.round(F.col("sample_no") / 500.0, 6).alias("t"))


QUERIES = {
    "j1_band_join": j1_band_join,
    "j3_nearest": j3_nearest,
    "x4_strategies": x4_strategies,
    "x9_agreement": x9_agreement,
    "x11_best_case": x11_best_case,
    "m1_delay": m1_delay,
    "m2_matches": m2_matches,
    "m3_counts": m3_counts,
    "m3_missed": m3_missed,
    "m4_paired_intervals": m4_paired_intervals,
    "l2_interval_error": l2_interval_error,
    "l3_bland_altman": l3_bland_altman,
    "l4_concordance": l4_concordance,
    "l5_equivalence": l5_equivalence,
    "l6_hrv_error": l6_hrv_error,
    "l7_consensus_floor": l7_consensus_floor,
    "x1_runs": x1_runs,
    "a2_accuracy": a2_accuracy,
    "c1_screen": c1_screen,
    "c2_median_mad": c2_median_mad,
    "c3_adaptive": c3_adaptive,
    "c4_fraction_corrected": c4_fraction_corrected,
    "x6_integrity": x6_integrity,
    "s3_annotations": s3_annotations,
}


def _delay(runs: str, p: str) -> str:
    """The delay of each run of ``runs`` in SQL, as ``{p}delay``."""
    return f"""{p}pr AS (SELECT r.record, r.session_id, d.detector, r.ref_idx, d.t - r.t AS d FROM ref r JOIN {runs} d ON r.record = d.record AND r.session_id = d.session_id AND d.t - r.t BETWEEN -0.150000001 AND 0.650000001),
{p}gr AS (SELECT unnest(range(140)) AS g), {p}v AS (SELECT record, session_id, detector, g, count(DISTINCT ref_idx) AS n FROM {p}pr, {p}gr WHERE abs(d - (g * 0.005 - 0.10)) <= 0.05 + 5e-9 GROUP BY ALL),
{p}b AS (SELECT record, session_id, detector, g * 0.005 - 0.10 AS coarse FROM {p}v QUALIFY row_number() OVER (PARTITION BY record, session_id, detector ORDER BY n DESC, g) = 1),
{p}nr AS (SELECT {p}pr.record, {p}pr.session_id, {p}pr.detector, coarse, round(d - coarse, 9) AS r FROM {p}pr JOIN {p}b USING (record, session_id, detector) QUALIFY row_number() OVER (PARTITION BY {p}pr.record, {p}pr.session_id, {p}pr.detector, ref_idx ORDER BY abs(round(d - coarse, 9)), round(d - coarse, 9)) = 1),
{p}f AS (SELECT record, session_id, detector, coarse + CASE WHEN count(*) >= 3 THEN median(r) ELSE 0 END AS delay FROM {p}nr WHERE abs(r) <= 0.05 GROUP BY record, session_id, detector, coarse),
{p}s AS (SELECT record, session_id, detector, count(*) AS n FROM {runs} GROUP BY ALL), {p}rs AS (SELECT record, session_id, count(*) AS nr FROM ref GROUP BY ALL),
{p}delay AS (SELECT record, session_id, detector, CASE WHEN n >= 3 AND nr >= 3 THEN coalesce(delay, 0) ELSE 0 END AS delay FROM {p}s LEFT JOIN {p}f USING (record, session_id, detector) LEFT JOIN {p}rs USING (record, session_id))"""


_PAIRS = f"""WITH {SQL['ref']}, {SQL['det']}, untold AS (SELECT * FROM det WHERE lag_s IS NULL OR isnan(lag_s)), {_delay('untold', 'u_')},
test AS (SELECT record, session_id, detector, test_idx, round(t - coalesce(CASE WHEN NOT isnan(lag_s) THEN lag_s END, delay), 9) AS tt, k AS tk FROM det LEFT JOIN u_delay USING (record, session_id, detector)),
pr AS (SELECT r.record, r.session_id, d.detector, r.ref_idx, d.test_idx, round(abs(d.tt - r.t), 9) AS d, d.tt - r.t AS apart FROM ref r JOIN test d ON r.record = d.record AND r.session_id = d.session_id AND d.tt BETWEEN r.t - 0.150000001 AND r.t + 0.150000001)"""


def _rounds(n: int) -> str:
    """Greedy matching as rounds: pairs that come first both for their reference and for their detection are taken."""
    out = ", c0 AS (SELECT * FROM pr)"
    for i in range(n):
        out += f""", b{i} AS (SELECT *, row_number() OVER (PARTITION BY record, session_id, detector, ref_idx ORDER BY d, ref_idx, test_idx) AS a, row_number() OVER (PARTITION BY record, session_id, detector, test_idx ORDER BY d, ref_idx, test_idx) AS b FROM c{i}),
t{i} AS (SELECT record, session_id, detector, ref_idx, test_idx, d FROM b{i} WHERE a = 1 AND b = 1),
c{i + 1} AS (SELECT * FROM c{i} ANTI JOIN t{i} USING (record, session_id, detector, ref_idx) ANTI JOIN t{i} x USING (record, session_id, detector, test_idx))"""
    return out + ", m AS (" + " UNION ALL ".join(f"SELECT * FROM t{i}" for i in range(n)) + ")"


_M = _PAIRS + _rounds(5)
_PI = _M + """, pl AS (SELECT m.record, m.session_id, m.detector, m.ref_idx, r.t AS rt, r.k AS rk, d.tt, d.tk FROM m JOIN ref r ON m.record = r.record AND m.session_id = r.session_id AND m.ref_idx = r.ref_idx JOIN test d ON m.record = d.record AND m.session_id = d.session_id AND m.detector = d.detector AND m.test_idx = d.test_idx),
pi AS (SELECT record, session_id, detector, ref_idx, lead(rt) OVER w - rt AS rr_s, lead(tt) OVER w - tt AS pp_s, lead(rk) OVER w - rk AS dr, lead(tk) OVER w - tk AS dt FROM pl WINDOW w AS (PARTITION BY record, session_id, detector ORDER BY rk)),
pi2 AS (SELECT record, session_id, detector, ref_idx, rr_s, pp_s FROM pi WHERE dr = 1 AND dt = 1)"""
_C2 = f"""WITH {SQL['tach']}, nn AS (SELECT record, session_id, detector, k, ibi_s, row_number() OVER (PARTITION BY record, session_id, detector ORDER BY k) - 1 AS n, count(*) OVER (PARTITION BY record, session_id, detector) AS many FROM tach),
w AS (SELECT a.record, a.session_id, a.detector, a.k, a.n, a.many, a.ibi_s, b.ibi_s AS v FROM nn a, (SELECT unnest(range(-4, 5)) AS o) o, nn b WHERE a.record = b.record AND a.session_id = b.session_id AND a.detector = b.detector AND b.n = least(greatest(a.n + o.o, 0), a.many - 1)),
md AS (SELECT record, session_id, detector, k, many, ibi_s, median(v) AS m, list(v) AS vs FROM w GROUP BY ALL),
dv AS (SELECT *, list_median(list_transform(vs, lambda v: abs(v - m))) AS mad FROM md),
c2 AS (SELECT record, session_id, detector, k, ibi_s FROM dv WHERE ibi_s BETWEEN 0.30 AND 2.00 AND (many < 9 OR abs(ibi_s - m) <= 5 * 1.4826 * CASE WHEN mad = 0 THEN 2.220446049250313e-16 ELSE mad END))"""
_TD = """SELECT {k}, count(*) AS n, avg(v) AS mean_nn, stddev_samp(v) AS sdnn, sqrt(avg(d * d)) AS rmssd, avg(CASE WHEN abs(d) > 50 THEN 1e0 WHEN d IS NOT NULL THEN 0e0 END) * 100 AS pnn50, stddev_samp(d) AS sdsd FROM {t} GROUP BY ALL HAVING count(*) >= 3"""

_COUNTS = _M + """, nt AS (SELECT record, session_id, detector, count(*) AS n_test FROM test GROUP BY ALL), nr AS (SELECT record, session_id, count(*) AS n_ref FROM ref GROUP BY ALL), tp AS (SELECT record, session_id, detector, count(*) AS tp FROM m GROUP BY ALL),
c AS (SELECT record, session_id, detector, coalesce(tp, 0) AS tp, n_test, n_ref FROM nt JOIN nr USING (record, session_id) LEFT JOIN tp USING (record, session_id, detector))"""

_RUNS = _COUNTS + _PI[len(_M) :] + """, lg AS (SELECT record, session_id, detector, 1000 * min(coalesce(CASE WHEN NOT isnan(lag_s) THEN lag_s END, delay)) AS lag_ms FROM det LEFT JOIN u_delay USING (record, session_id, detector) GROUP BY ALL),
ie AS (SELECT record, session_id, detector, (pp_s - rr_s) * 1000 AS e FROM pi2), ig AS (SELECT record, session_id, detector, avg(abs(e)) AS ibi_mae, sqrt(avg(e * e)) AS ibi_rmse, avg(e) AS ibi_bias, stddev_samp(e) AS ibi_sd, count(*) AS n_ibi FROM ie GROUP BY ALL HAVING count(*) >= 2),
rr AS (SELECT record, session_id, detector, tp, n_test - tp AS fp, n_ref - tp AS fn, tp / n_ref AS sensitivity, tp / n_test AS ppv, CASE WHEN tp > 0 THEN 2 * (tp / n_ref) * (tp / n_test) / (tp / n_ref + tp / n_test) END AS f1, lag_ms, ibi_mae, ibi_rmse, ibi_bias, ibi_sd, n_ibi FROM c JOIN lg USING (record, session_id, detector) LEFT JOIN ig USING (record, session_id, detector))"""

ORACLES = {
    "x1_runs": _RUNS + " SELECT record, session_id, detector, tp, fp, fn, n_ibi, " + ", ".join(f"round({c}, 6) + 0e0 AS {c}" for c in ("sensitivity", "ppv", "f1", "lag_ms", "ibi_mae", "ibi_rmse", "ibi_bias", "ibi_sd")) + " FROM rr",
    "a2_accuracy": _RUNS + ", lbl(detector, label) AS (VALUES " + ", ".join(f"('{k}', '{v[0]}')" for k, v in REGISTRY.items()) + f"""), ag AS (SELECT label, count(DISTINCT record) AS n_records, 100 * median(f1) AS f1_pct, median(ibi_mae) AS ibi_mae_ms, median(ibi_rmse) AS ibi_rmse_ms FROM rr JOIN lbl USING (detector) GROUP BY ALL)
SELECT label, n_records, round(f1_pct, 6) AS f1_pct, round(ibi_mae_ms, 6) AS ibi_mae_ms, round(ibi_rmse_ms, 6) AS ibi_rmse_ms, round(cost, 6) AS cost_s_per_min FROM ag LEFT JOIN ({COST_SQL} SELECT label, median(cost) AS cost FROM c GROUP BY ALL) USING (label)""",
    "j3_nearest": _PAIRS + """, d AS (SELECT r.record, r.session_id, t.detector, r.ref_idx, t.test_idx, round(abs(t.tt - r.t), 9) AS distance, t.tt FROM ref r JOIN test t ON r.record = t.record AND r.session_id = t.session_id)
SELECT record, session_id, detector, ref_idx, test_idx, round(distance, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY record, session_id, detector, ref_idx ORDER BY distance, tt, test_idx) = 1""",
    "x9_agreement": _COUNTS + " SELECT detector, count(*) AS n_runs, round(avg(least(tp / n_ref, tp / n_test)), 6) AS agreement, avg(least(tp / n_ref, tp / n_test)) >= 0.90 AS good FROM c GROUP BY ALL",
    "x11_best_case": _COUNTS + " SELECT detector, record, session_id, round(2 * (tp / n_ref) * (tp / n_test) / (tp / n_ref + tp / n_test), 6) AS f1 FROM c WHERE tp > 0 QUALIFY row_number() OVER (PARTITION BY detector ORDER BY round(2 * (tp / n_ref) * (tp / n_test) / (tp / n_ref + tp / n_test), 9) DESC, record, session_id) = 1",
    "j1_band_join": _PAIRS + " SELECT record, session_id, detector, ref_idx, test_idx, round(apart, 6) + 0e0 AS apart FROM pr",
    "m1_delay": f"WITH {SQL['ref']}, {SQL['det']}, {_delay('det', '')} SELECT record, session_id, detector, round(delay, 6) AS delay FROM delay",
    "m2_matches": _M + " SELECT record, session_id, detector, ref_idx, test_idx, round(d, 6) AS distance FROM m",
    "m3_counts": _M + """, nt AS (SELECT record, session_id, detector, count(*) AS n_test FROM test GROUP BY ALL), nr AS (SELECT record, session_id, count(*) AS n_ref FROM ref GROUP BY ALL), tp AS (SELECT record, session_id, detector, count(*) AS tp FROM m GROUP BY ALL),
c AS (SELECT record, session_id, detector, coalesce(tp, 0) AS tp, n_test, n_ref FROM nt JOIN nr USING (record, session_id) LEFT JOIN tp USING (record, session_id, detector))
SELECT record, session_id, detector, tp, n_test - tp AS fp, n_ref - tp AS fn, round(tp / n_ref, 6) AS sensitivity, round(tp / n_test, 6) AS ppv, CASE WHEN tp > 0 THEN round(2 * (tp / n_ref) * (tp / n_test) / (tp / n_ref + tp / n_test), 6) END AS f1 FROM c""",
    "m3_missed": _M + " SELECT t.record, t.session_id, t.detector, r.ref_idx FROM ref r JOIN (SELECT DISTINCT record, session_id, detector FROM test) t USING (record, session_id) ANTI JOIN m ON m.record = t.record AND m.session_id = t.session_id AND m.detector = t.detector AND m.ref_idx = r.ref_idx",
    "m4_paired_intervals": _PI + " SELECT record, session_id, detector, ref_idx, round(rr_s, 6) AS rr_s, round(pp_s, 6) AS pp_s FROM pi2",
    "l2_interval_error": _PI + ", e AS (SELECT record, session_id, detector, (pp_s - rr_s) * 1000 AS e FROM pi2) SELECT record, session_id, detector, CASE WHEN count(*) >= 2 THEN round(avg(abs(e)), 6) END AS ibi_mae, CASE WHEN count(*) >= 2 THEN round(sqrt(avg(e * e)), 6) END AS ibi_rmse, CASE WHEN count(*) >= 2 THEN round(avg(e), 6) + 0e0 END AS ibi_bias, round(stddev_samp(e), 6) AS ibi_sd, CASE WHEN count(*) >= 2 THEN count(*) END AS n_ibi FROM e GROUP BY ALL",
    "l3_bland_altman": _PI + ", g AS (SELECT record, session_id, detector, count(*) AS n, avg(pp_s - rr_s) AS m, stddev_samp(pp_s - rr_s) AS s FROM pi2 GROUP BY ALL) SELECT record, session_id, detector, n, CASE WHEN n >= 3 THEN round(m, 6) + 0e0 END AS bias, CASE WHEN n >= 3 THEN round(m - 1.96 * s, 6) + 0e0 END AS lower, CASE WHEN n >= 3 THEN round(m + 1.96 * s, 6) + 0e0 END AS upper FROM g",
    "l4_concordance": _PI + ", g AS (SELECT record, session_id, detector, count(*) AS n, covar_samp(rr_s, pp_s) AS c, var_samp(rr_s) + var_samp(pp_s) + (avg(rr_s) - avg(pp_s)) ** 2 AS low FROM pi2 GROUP BY ALL) SELECT record, session_id, detector, n, CASE WHEN n >= 3 AND low > 0 THEN round(2 * c / low, 6) END AS ccc FROM g",
    "l6_hrv_error": f"""WITH {SQL['ref']}, {SQL['scr']}, rv AS (SELECT record, session_id, k, (t - lag(t) OVER (PARTITION BY record, session_id ORDER BY k)) AS ibi_s FROM ref),
rd AS (SELECT record, session_id, ibi_s * 1000 AS v, ibi_s * 1000 - lag(ibi_s * 1000) OVER (PARTITION BY record, session_id ORDER BY k) AS d FROM rv WHERE ibi_s BETWEEN 0.30 AND 2.00),
sd AS (SELECT record, session_id, detector, ibi_s * 1000 AS v, ibi_s * 1000 - lag(ibi_s * 1000) OVER (PARTITION BY record, session_id, detector ORDER BY n) AS d FROM scr),
r AS ({_TD.format(k='record, session_id', t='rd')}), s AS ({_TD.format(k='record, session_id, detector', t='sd')}),
ru AS (UNPIVOT r ON mean_nn, sdnn, rmssd, pnn50, sdsd INTO NAME key VALUE ref), su AS (UNPIVOT s ON mean_nn, sdnn, rmssd, pnn50, sdsd INTO NAME key VALUE test)
SELECT su.record, su.session_id, su.detector, key, round(ref, 6) AS ref, round(test, 6) AS test, round(test - ref, 6) + 0e0 AS err, round(abs(test - ref), 6) AS abserr, CASE WHEN ref <> 0 THEN round(100 * (test - ref) / ref, 6) + 0e0 END AS pcterr FROM su JOIN ru USING (record, session_id, key)""",
    "l7_consensus_floor": _PI + """, ab AS (SELECT *, count(*) OVER (PARTITION BY record, session_id, detector) AS mine FROM pi2 QUALIFY mine > 5), pn AS (SELECT record, session_id, count(DISTINCT detector) AS n_detectors FROM ab GROUP BY ALL HAVING count(DISTINCT detector) >= 3),
md AS (SELECT record, session_id, ref_idx, (median(pp_s) - min(rr_s)) * 1000 AS e FROM ab GROUP BY ALL HAVING count(*) >= 3)
SELECT record, session_id, CASE WHEN count(*) >= 5 THEN round(sqrt(avg(e * e)), 6) END AS floor_rmse, CASE WHEN count(*) >= 5 THEN round(avg(abs(e)), 6) END AS floor_mae, count(*) AS n_intervals, n_detectors FROM md JOIN pn USING (record, session_id) GROUP BY record, session_id, n_detectors""",
    "c1_screen": f"WITH {SQL['tach']} SELECT record, session_id, detector, k, round(ibi_s, 6) AS ibi_s FROM tach WHERE ibi_s BETWEEN 0.30 AND 2.00",
    "c2_median_mad": _C2 + " SELECT record, session_id, detector, k, round(ibi_s, 6) AS ibi_s FROM c2",
    "c4_fraction_corrected": _C2 + """, a AS (SELECT record, session_id, detector, count(*) AS n_input, count(*) FILTER (ibi_s BETWEEN 0.30 AND 2.00) AS k1 FROM tach GROUP BY ALL), b AS (SELECT record, session_id, detector, count(*) AS k2 FROM c2 GROUP BY ALL)
SELECT record, session_id, detector, n_input, round((n_input - k1) / n_input, 6) AS none, round((n_input - coalesce(k2, 0)) / n_input, 6) AS median_mad FROM a LEFT JOIN b USING (record, session_id, detector)""",
    "x6_integrity": f"WITH {SQL['ref']}, r AS (SELECT record, session_id, t - lag(t) OVER (PARTITION BY record, session_id ORDER BY k) AS rr FROM ref) SELECT record, session_id, round(avg(CASE WHEN rr BETWEEN 0.30 AND 2.00 THEN 0e0 ELSE 1e0 END), 6) AS implausible, round(median(CASE WHEN rr <> 0 THEN 60 / rr END), 6) AS rate, avg(CASE WHEN rr BETWEEN 0.30 AND 2.00 THEN 0e0 ELSE 1e0 END) > 0.02 AS flagged FROM r WHERE rr IS NOT NULL GROUP BY ALL",
    "s3_annotations": "SELECT record, session_id, symbol, round(sample_no / 500.0, 6) AS t FROM (SELECT DISTINCT record, session_id, sample_no, symbol FROM ref_beats) WHERE contains('NLRBAaJSVrFejnE/fQ?', symbol) AND symbol <> ''",
}
# Names under which the queries over every run were registered when the others took runs with a stated delay only.
for _name in ("j1_band_join", "j3_nearest", "m2_matches", "m3_counts", "m3_missed", "m4_paired_intervals", "l2_interval_error", "l3_bland_altman", "l4_concordance", "l7_consensus_floor", "x9_agreement", "x11_best_case"):
    QUERIES[f"{_name}_every_run"], ORACLES[f"{_name}_every_run"] = QUERIES[_name], ORACLES[_name]
