"""Variability indices over the screened tachograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from beatloom.functions.numbers import six
from beatloom.operators import hrv, spectrum
from beatloom.sources.adapters import RUN, SQL, screened


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[six(df[c], c) if kind == "double" else c for c, kind in df.dtypes])


def _query(operator):
    return lambda spark, folder: _rounded(operator(screened(spark, folder), RUN))


def h11_lomb_scargle(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(hrv.lomb_scargle(screened(spark, folder), RUN))


def h12_band_power(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(hrv.band_power(hrv.lomb_scargle(screened(spark, folder), RUN, below=hrv.TOTAL[1]), RUN))


QUERIES = {
    "h1_time_domain": _query(hrv.time_domain),
    "h6_poincare": _query(hrv.poincare),
    "h7_sample_entropy": _query(hrv.sample_entropy),
    "h8_dfa_alpha1": _query(hrv.dfa_alpha1),
    "h10_welch_spectrum": _query(spectrum.interval_spectrum),
    "h10_welch_bands": _query(spectrum.interval_bands),
    "h11_lomb_scargle": h11_lomb_scargle,
    "h12_band_power": h12_band_power,
    "h15_all_indices": _query(hrv.all_indices),
}

_D = f"WITH {SQL['scr']}, d AS (SELECT *, ibi_s * 1000 AS v, ibi_s * 1000 - lag(ibi_s * 1000) OVER (PARTITION BY record, session_id, detector ORDER BY n) AS d FROM scr)"
_TD = """td AS (SELECT record, session_id, detector, count(*) AS n_intervals, avg(v) AS m, stddev_samp(v) AS s, sqrt(avg(d * d)) AS r, avg(CASE WHEN abs(d) > 50 THEN 1e0 WHEN d IS NOT NULL THEN 0e0 END) * 100 AS p, stddev_samp(d) AS sd FROM d GROUP BY ALL)"""
_TD_OUT = "CASE WHEN n_intervals >= 3 THEN round(m, 6) END AS mean_nn, CASE WHEN n_intervals >= 3 THEN round(60000 / m, 6) END AS mean_hr, CASE WHEN n_intervals >= 3 THEN round(s, 6) END AS sdnn, CASE WHEN n_intervals >= 3 THEN round(r, 6) END AS rmssd, CASE WHEN n_intervals >= 3 THEN round(p, 6) END AS pnn50, CASE WHEN n_intervals >= 3 THEN round(sd, 6) END AS sdsd"
_PC = "pc AS (SELECT record, session_id, detector, n_intervals, CASE WHEN n_intervals >= 10 THEN sqrt(0.5) * sd END AS sd1, CASE WHEN n_intervals >= 10 AND 2 * s * s - 0.5 * sd * sd > 0 THEN sqrt(2 * s * s - 0.5 * sd * sd) END AS sd2 FROM td)"
_SE = """se AS (SELECT g.record, g.session_id, g.detector, g.n_intervals, CASE WHEN a > 0 AND b > 0 THEN -ln(a / b) END AS sampen FROM (SELECT record, session_id, detector, count(*) AS n_intervals FROM scr GROUP BY ALL) g LEFT JOIN (
    SELECT record, session_id, detector, CAST(count(*) AS DOUBLE) AS b, CAST(count(*) FILTER (abs(x2 - y2) <= r) AS DOUBLE) AS a FROM (
        SELECT p.record, p.session_id, p.detector, p.x2, q.x2 AS y2, p.r FROM e p JOIN e q ON p.record = q.record AND p.session_id = q.session_id AND p.detector = q.detector AND p.n < q.n AND abs(p.x0 - q.x0) <= p.r AND abs(p.x1 - q.x1) <= p.r WHERE p.many >= 10 AND p.r > 0) GROUP BY ALL) c USING (record, session_id, detector))"""
_E = """e AS (SELECT * FROM (SELECT record, session_id, detector, n, ibi_s * 1000 AS x0, lead(ibi_s * 1000, 1) OVER w AS x1, lead(ibi_s * 1000, 2) OVER w AS x2, 0.2 * stddev_samp(ibi_s * 1000) OVER (PARTITION BY record, session_id, detector) AS r, count(*) OVER (PARTITION BY record, session_id, detector) AS many FROM scr WINDOW w AS (PARTITION BY record, session_id, detector ORDER BY n)) WHERE x1 IS NOT NULL)"""
_DFA = """pr AS (SELECT record, session_id, detector, n, many, sum(c) OVER (PARTITION BY record, session_id, detector ORDER BY n) AS y FROM (SELECT *, ibi_s - avg(ibi_s) OVER (PARTITION BY record, session_id, detector) AS c, count(*) OVER (PARTITION BY record, session_id, detector) AS many FROM scr) WHERE many >= 32),
sg AS (SELECT *, n // s AS seg, CAST(n % s AS DOUBLE) AS p FROM pr, (SELECT unnest(range(4, 17)) AS s)),
ff AS (SELECT record, session_id, detector, s, sqrt(avg(greatest(syy - sxy * sxy / sxx, 0) / s)) AS f FROM (SELECT record, session_id, detector, s, seg, regr_syy(y, p) AS syy, regr_sxy(y, p) AS sxy, regr_sxx(y, p) AS sxx FROM sg WHERE seg < many // s GROUP BY ALL) GROUP BY ALL),
df AS (SELECT record, session_id, detector, count(*) AS n_scales, CASE WHEN count(*) >= 3 THEN regr_slope(ln(f), ln(s)) END AS dfa_alpha1 FROM ff WHERE f > 0 GROUP BY ALL)"""
_LS = """ls0 AS (SELECT record, session_id, detector, n, ibi_s, sum(ibi_s) OVER (PARTITION BY record, session_id, detector ORDER BY n) AS t FROM scr),
ls1 AS (SELECT record, session_id, detector, t, (ibi_s - avg(ibi_s) OVER g) * 1000 AS v, count(*) OVER g AS many, max(t) OVER g - min(t) OVER g AS span FROM ls0 WINDOW g AS (PARTITION BY record, session_id, detector)),
ls2 AS (SELECT record, session_id, detector, f, v, 2 * pi() * f * t AS a FROM ls1, (SELECT 0.01e0 + q * ((0.5e0 - 0.01e0) / 499) AS f FROM range(500) r(q)) WHERE many >= 20 AND span >= 60),
ls3 AS (SELECT record, session_id, detector, f, count(*) AS many, sum(v * cos(a)) AS vc, sum(v * sin(a)) AS vs, sum(cos(a) * cos(a)) AS cc, sum(sin(a) * sin(a)) AS ss, sum(sin(a) * cos(a)) AS sc FROM ls2 GROUP BY ALL),
ls4 AS (SELECT *, cos(atan2(2 * sc, cc - ss) / 2) AS ct, sin(atan2(2 * sc, cc - ss) / 2) AS st FROM ls3),
ls AS (SELECT record, session_id, detector, f, 0.5 * ((vc * ct + vs * st) * (vc * ct + vs * st) / (ct * ct * cc + 2 * ct * st * sc + st * st * ss) + (vs * ct - vc * st) * (vs * ct - vc * st) / (ct * ct * ss - 2 * ct * st * sc + st * st * cc)) * 2 / many AS p FROM ls4)"""
_BP = """ar AS (SELECT record, session_id, detector, band, (f - lag(f) OVER w) * (p + lag(p) OVER w) / 2 AS area FROM ls JOIN (VALUES ('lf', 0.04e0, 0.15e0), ('hf', 0.15e0, 0.40e0), ('total_power', 0.0033e0, 0.40e0)) b(band, lo, hi) ON f >= lo AND f < hi WINDOW w AS (PARTITION BY record, session_id, detector, band ORDER BY f)),
bp AS (SELECT record, session_id, detector, sum(area) FILTER (band = 'lf') AS lf, sum(area) FILTER (band = 'hf') AS hf, sum(area) FILTER (band = 'total_power') AS total_power FROM ar GROUP BY ALL)"""

ORACLES = {
    "h1_time_domain": f"{_D}, {_TD} SELECT record, session_id, detector, n_intervals, {_TD_OUT} FROM td",
    "h6_poincare": f"{_D}, {_TD}, {_PC} SELECT record, session_id, detector, n_intervals, round(sd1, 6) AS sd1, round(sd2, 6) AS sd2, round(sd1 / sd2, 6) AS sd1_sd2 FROM pc",
    "h7_sample_entropy": f"WITH {SQL['scr']}, {_E}, {_SE} SELECT record, session_id, detector, n_intervals, round(sampen, 6) AS sampen FROM se",
    "h8_dfa_alpha1": f"WITH {SQL['scr']}, {_DFA} SELECT record, session_id, detector, n_scales, round(dfa_alpha1, 6) AS dfa_alpha1 FROM df",
    "h11_lomb_scargle": f"WITH {SQL['scr']}, {_LS} SELECT record, session_id, detector, round(f, 6) AS f, round(p, 6) AS p FROM ls",
    "h12_band_power": f"WITH {SQL['scr']}, {_LS}, {_BP} SELECT record, session_id, detector, round(lf, 6) AS lf, round(hf, 6) AS hf, round(total_power, 6) AS total_power, CASE WHEN hf > 0 THEN round(lf / hf, 6) END AS lf_hf FROM bp",
    "h15_all_indices": f"""{_D}, {_TD}, {_PC}, {_E}, {_SE}, {_DFA}, {_LS}, {_BP}
SELECT record, session_id, detector, td.n_intervals, {_TD_OUT}, round(sd1, 6) AS sd1, round(sd2, 6) AS sd2, round(sd1 / sd2, 6) AS sd1_sd2, round(sampen, 6) AS sampen, round(dfa_alpha1, 6) AS dfa_alpha1, round(lf, 6) AS lf_ls, round(hf, 6) AS hf_ls, round(total_power, 6) AS total_power_ls, CASE WHEN hf > 0 THEN round(lf / hf, 6) END AS lf_hf_ls
FROM td LEFT JOIN pc USING (record, session_id, detector) LEFT JOIN se USING (record, session_id, detector) LEFT JOIN df USING (record, session_id, detector) LEFT JOIN bp USING (record, session_id, detector)""".replace("td.n_intervals, CASE WHEN n_intervals", "td.n_intervals, CASE WHEN td.n_intervals").replace("CASE WHEN n_intervals >= 3", "CASE WHEN td.n_intervals >= 3"),
}
