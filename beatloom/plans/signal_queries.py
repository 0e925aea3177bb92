"""Conditioning, quality, detectors and fiducial points over the raw pulse samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from beatloom.functions.numbers import six
from beatloom.operators import conditioning as co
from beatloom.operators import detectors as de
from beatloom.operators import fiducial as fi
from beatloom.operators import matching as ma
from beatloom.operators import quality as qu
from beatloom.operators import spectrum
from beatloom.session import ensure_checkpoint_dir
from beatloom.sources import files
from beatloom.sources.adapters import SESSION, SQL, reference_beats, signal
from beatloom.sources.tables import table

WINDOW_S = 2.0


def _out(df: DataFrame, *columns: str) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[six(df[c], c) if kinds[c] == "double" else c for c in columns])


def sp1_dc_removal(spark: SparkSession, folder: str) -> DataFrame:
    return _out(co.remove_mean(signal(spark, folder), SESSION), *SESSION, "i", "x")


def sp2_decimate(spark: SparkSession, folder: str) -> DataFrame:
    return co.decimate(signal(spark, folder), SESSION, 5).select(*SESSION, "i", (F.round("x", 3) + 0.0).alias("x"))


def sp3_resample(spark: SparkSession, folder: str) -> DataFrame:
    return co.resample(signal(spark, folder), SESSION, 2, 5).select(*SESSION, "i", (F.round("x", 3) + 0.0).alias("x"))


def sp4_detrend(spark: SparkSession, folder: str) -> DataFrame:
    return _out(co.detrend(signal(spark, folder), SESSION), *SESSION, "i", "x")


def sp5_band_pass(spark: SparkSession, folder: str) -> DataFrame:
    return _out(co.band_pass(signal(spark, folder), SESSION), *SESSION, "i", "x")


def sp6_normalise(spark: SparkSession, folder: str) -> DataFrame:
    return _out(co.normalise(signal(spark, folder), SESSION), *SESSION, "i", "x")


def sp7_prepare(spark: SparkSession, folder: str) -> DataFrame:
    return _out(co.prepare(signal(spark, folder), SESSION), *SESSION, "i", "x")


def sp8_low_pass(spark: SparkSession, folder: str) -> DataFrame:
    return _out(co.band_pass(signal(spark, folder), SESSION, order=2, low=None, high=16.0), *SESSION, "i", "x")


def sp9_polarity(spark: SparkSession, folder: str) -> DataFrame:
    """Of the raw samples; co.band_pass comes first in the full chain."""
    return co.polarity(signal(spark, folder), SESSION)


def sp10_motion_index(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors as 21 samples of three axes, in blocks of 7."""
    e = table(spark, folder, "embeddings", "vec_id", "embedding")
    axes = [F.slice("embedding", 1 + 21 * a, 21) for a in range(3)]
    rows = e.select("vec_id", F.posexplode(F.arrays_zip(*[a.alias(n) for a, n in zip(axes, "xyz")])).alias("i", "v"))
    long = rows.select("vec_id", F.col("i").cast("long").alias("i"), *[F.col("v")[n].cast("double").alias(f"g{n}") for n in "xyz"])
    return _out(co.motion_index(long, ["vec_id"], ("gx", "gy", "gz"), 7), "vec_id", "block", "rms")


def sp11_clip_square(spark: SparkSession, folder: str) -> DataFrame:
    return _out(co.clip_square(co.normalise(signal(spark, folder), SESSION)), *SESSION, "i", "sq")


def q2_quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _out(qu.scores(signal(spark, folder), SESSION, WINDOW_S), *SESSION, "w", "score", "perfusion")


def _gated(spark: SparkSession, folder: str, fraction: float) -> DataFrame:
    scored = qu.scores(signal(spark, folder), SESSION, WINDOW_S)
    return qu.coverage_gate(scored.withColumn("score", F.round("score", 9)), SESSION, fraction)


def q6_coverage_gate(spark: SparkSession, folder: str) -> DataFrame:
    return _gated(spark, folder, 0.75).select(*SESSION, "w", "kept")


def q8_gated_beats(spark: SparkSession, folder: str) -> DataFrame:
    """Reference beats in the windows kept at coverage 0.75."""
    kept = qu.spans(_gated(spark, folder, 0.75), SESSION, WINDOW_S)
    return qu.beats_in_spans(reference_beats(spark, folder), kept, SESSION, "t", WINDOW_S).select(*SESSION, "ref_idx", "t")


def l8_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Share of each session's samples that lie in kept windows."""
    s = signal(spark, folder).groupBy(*SESSION).agg(F.count("*").alias("n"), F.first("fs").alias("fs"))
    kept = _gated(spark, folder, 0.75).where("kept").groupBy(*SESSION).agg((F.count("*") * WINDOW_S).alias("sec"))
    return _out(s.join(kept, SESSION).withColumn("coverage", F.col("sec") * F.col("fs") / F.col("n")), *SESSION, "coverage")


def _rates(spark: SparkSession, folder: str) -> list[float]:
    """Sampling rates in the table: a handful, whatever its size."""
    return sorted(r[0] for r in table(spark, folder, "ppg_samples", "fs").where("fs > 0").distinct().collect())


def d2_terma_averages(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of the two moving averages: first argmax and width, before the refractory rule."""
    return de.terma_blocks(co.normalise(signal(spark, folder), SESSION), SESSION).select(*SESSION, "wide", "idx")


def _prepared(spark: SparkSession, folder: str) -> DataFrame:
    return co.prepare(signal(spark, folder), SESSION)


def d2_terma(spark: SparkSession, folder: str) -> DataFrame:
    return de.terma(_prepared(spark, folder), SESSION)


def d8_anchors(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors of all six detectors, with label and kind."""
    ensure_checkpoint_dir(spark)
    prepared = _prepared(spark, folder).checkpoint()  # read by the numpy detectors and by TERMA
    return de.detect(prepared, SESSION).join(F.broadcast(de.registry(spark)), "detector").select(*SESSION, "detector", "detector_label", "anchor", "idx")


def _around(s: DataFrame, pick: Callable[[str], Column]) -> DataFrame:
    """``pick`` of the 0.3 s before (``a``) and after (``b``) each sample; frames are in microseconds, so any rate will do."""
    w = Window.partitionBy(*SESSION).orderBy("us")
    timed = s.withColumn("us", F.round(F.col("i") * 1e6 / F.col("fs")).cast("long"))
    return timed.withColumn("a", pick("x").over(w.rangeBetween(-300_000, -1))).withColumn("b", pick("x").over(w.rangeBetween(1, 300_000)))


def _tops(spark: SparkSession, folder: str) -> DataFrame:
    """Samples that are the first greatest of the 0.3 s on both sides: anchors that SQL can name."""
    return _around(signal(spark, folder), F.max).where("x > a and x >= b").select(*SESSION, F.col("i").alias("idx"))


def f2_pulses(spark: SparkSession, folder: str) -> DataFrame:
    return fi.pulses(signal(spark, folder), _tops(spark, folder), SESSION).select(*SESSION, "onset", "peak")


def f3_onset_pulses(spark: SparkSession, folder: str) -> DataFrame:
    """Pulses from onsets: samples that are the first least of the 0.3 s on both sides."""
    s = signal(spark, folder)
    lows = _around(s, F.min).where("x < a and x <= b")
    return fi.pulses_from_onsets(s, lows.select(*SESSION, F.col("i").alias("idx")), SESSION).select(*SESSION, "onset", "peak")


def q4_motion_quality(spark: SparkSession, folder: str) -> DataFrame:
    """As sp10, but vectors without a full block of 30 samples have none."""
    e = table(spark, folder, "embeddings", "vec_id", "embedding")
    rows = e.select("vec_id", F.posexplode("embedding").alias("i", "v")).select("vec_id", F.col("i").cast("long").alias("i"), F.col("v").cast("double").alias("gx"), F.lit(0.0).alias("gy"), F.lit(0.0).alias("gz"))
    return _out(co.motion_index(rows, ["vec_id"], ("gx", "gy", "gz"), 30, short=False), "vec_id", "block", "rms")


def _fiducial(kind: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        s = signal(spark, folder)
        found = fi.locate(s, fi.pulses(s, _tops(spark, folder), SESSION), SESSION, kind)
        return found.select(*SESSION, "peak", F.round("t", 9).alias("t"))

    return query


def f9_snapped(spark: SparkSession, folder: str) -> DataFrame:
    """Peaks with their times put back on the sampling grid."""
    s = signal(spark, folder)
    found = fi.locate(s, fi.pulses(s, _tops(spark, folder), SESSION), SESSION, "peak", sub_sample=False)
    return found.select(*SESSION, "peak", F.round("t", 9).alias("t"))


def d3_slope_sum(spark: SparkSession, folder: str) -> DataFrame:
    """Rises of the last 0.128 s summed, and the threshold they start from."""
    return _out(de.slope_sums(signal(spark, folder), SESSION), *SESSION, "i", "z", "seed")


def s10_pulse_train(spark: SparkSession, folder: str) -> DataFrame:
    """The pulse signal that each session's reference beats would make, up to its last beat, at 25 Hz."""
    beats = reference_beats(spark, folder).select(*SESSION, "t")
    return _out(files.pulse_train(beats, SESSION, 25.0), *SESSION, "i", "x")


def x7_snr(spark: SparkSession, folder: str) -> DataFrame:
    """Signal-to-noise ratio of each excerpt about the session's pulse rate."""
    w = Window.partitionBy(*SESSION).orderBy("k")
    rr = reference_beats(spark, folder).select(*SESSION, (F.col("t") - F.lag("t").over(w)).alias("rr")).where("rr between 0.30 and 2.00")
    rates = rr.groupBy(*SESSION).agg((60.0 / F.median("rr")).alias("rate"))
    return _out(spectrum.pulse_snr(co.remove_mean(signal(spark, folder), SESSION), rates, SESSION), *SESSION, "snr_db")


def _slower(raw: DataFrame, q: int) -> DataFrame:
    """Each session at a ``q``-th of its own rate."""
    fs = raw.groupBy(*SESSION).agg((F.first("fs") / q).alias("fs"))
    return co.decimate(raw, SESSION, q).join(fs, SESSION)


def x3_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Pulse intervals of the excerpts at their own rate, half and a quarter of it, on the grid and between samples: spread per session."""
    ensure_checkpoint_dir(spark)
    raw = co.prepare(signal(spark, folder), SESSION).checkpoint()  # read by nine branches
    w = Window.partitionBy(*SESSION).orderBy("peak")
    out = None
    for q in (1, 2, 4):
        low = raw if q == 1 else _slower(raw, q)
        rate = low.groupBy(*SESSION).agg(F.first("fs").alias("rate"))
        pulse = fi.pulses(low, de.detect(low, SESSION, ["findpeaks"]).drop("detector"), SESSION).checkpoint()
        for sub in (True, False):
            d = fi.locate(low, pulse, SESSION, "peak", sub).withColumn("d", (F.col("t") - F.lag("t").over(w)) * 1000.0)
            g = d.groupBy(*SESSION).agg(F.count("d").alias("n"), F.stddev_samp("d").alias("sd_ms")).join(rate, SESSION).withColumn("sub_sample", F.lit(sub))
            out = g if out is None else out.unionByName(g)
    return _out(out, *SESSION, "rate", "sub_sample", "n", "sd_ms")


def x8_decimation_loss(spark: SparkSession, folder: str) -> DataFrame:
    """Share of a session's beats at its own rate that are not found within 0.05 s at a quarter of it, flagged above 2 %."""
    ensure_checkpoint_dir(spark)
    raw = co.prepare(signal(spark, folder), SESSION).checkpoint()
    fs = raw.groupBy(*SESSION).agg(F.first("fs").alias("fs"))
    full = de.detect(raw, SESSION, ["findpeaks"]).join(fs, SESSION).select(*SESSION, F.col("idx").alias("ref_idx"), (F.col("idx") / F.col("fs")).alias("rt"))
    test = de.detect(_slower(raw, 4), SESSION, ["findpeaks"]).join(fs, SESSION).select(*SESSION, "detector", F.col("idx").alias("test_idx"), (F.col("idx") * 4 / F.col("fs")).alias("tt"))
    tp = ma.match(full, test, SESSION, ["detector"], 0.05).groupBy(*SESSION).agg(F.count("*").alias("tp"))
    n = full.groupBy(*SESSION).agg(F.count("*").alias("n"))
    loss = n.join(tp, SESSION, "left").withColumn("loss", 1.0 - F.coalesce("tp", F.lit(0)) / F.col("n"))
    return _out(loss.withColumn("flagged", F.col("loss") > 0.02), *SESSION, "loss", "flagged")


QUERIES = {
    "s10_pulse_train": s10_pulse_train,
    "d3_slope_sum": d3_slope_sum,
    "f9_snapped": f9_snapped,
    "x3_rates": x3_rates,
    "x7_snr": x7_snr,
    "x8_decimation_loss": x8_decimation_loss,
    "sp1_dc_removal": sp1_dc_removal,
    "sp2_decimate": sp2_decimate,
    "sp3_resample": sp3_resample,
    "sp4_detrend": sp4_detrend,
    "sp5_band_pass": sp5_band_pass,
    "sp6_normalise": sp6_normalise,
    "sp7_prepare": sp7_prepare,
    "sp8_low_pass": sp8_low_pass,
    "sp9_polarity": sp9_polarity,
    "sp10_motion_index": sp10_motion_index,
    "sp11_clip_square": sp11_clip_square,
    "q2_quality_scores": q2_quality_scores,
    "q6_coverage_gate": q6_coverage_gate,
    "q8_gated_beats": q8_gated_beats,
    "l8_coverage": l8_coverage,
    "d2_terma_averages": d2_terma_averages,
    "d2_terma": d2_terma,
    "d8_anchors": d8_anchors,
    "f2_pulses": f2_pulses,
    "f3_onset_pulses": f3_onset_pulses,
    "q4_motion_quality": q4_motion_quality,
    **{f"f{n}_{kind}": _fiducial(kind) for n, kind in ((4, "peak"), (5, "foot"), (6, "mid_upslope"), (7, "max_slope"))},
}
_S = f"WITH {SQL['signal']}"
_G = "(PARTITION BY record, session_id)"
_Z = f"{_S}, z AS (SELECT record, session_id, fs, i, CASE WHEN stddev_pop(x) OVER {_G} > 0 THEN (x - avg(x) OVER {_G}) / stddev_pop(x) OVER {_G} ELSE x - avg(x) OVER {_G} END AS x FROM signal)"
_CENTRED = f"centred AS (SELECT record, session_id, i, x - avg(x) OVER {_G} AS x FROM signal)"
_W = f"""{_S}, win AS (SELECT *, i // CAST(round_even(fs * 2, 0) AS BIGINT) AS w, CAST(round_even(fs * 2, 0) AS BIGINT) AS size, max(i) OVER {_G} + 1 AS many FROM signal),
mom AS (SELECT *, avg(x) OVER (PARTITION BY record, session_id, w) AS m FROM win WHERE (w + 1) * size <= many),
sc AS (SELECT record, session_id, w, CASE WHEN avg((x - m) ** 2) > 0 THEN avg((x - m) ** 3) / avg((x - m) ** 2) ** 1.5 END AS skew, quantile_cont(x, 0.95) - quantile_cont(x, 0.05) AS ac, avg(abs(x)) AS dc FROM mom GROUP BY ALL)"""
_K = f"""{_W}, kept AS (SELECT record, session_id, w, rank() OVER (PARTITION BY record, session_id ORDER BY coalesce(round(skew, 9), '-infinity'::DOUBLE) DESC) <= greatest(1, round_even(0.75 * count(*) OVER {_G}, 0)) AS kept FROM sc)"""
_AROUND = "RANGE BETWEEN 300000 PRECEDING AND 1 PRECEDING", "RANGE BETWEEN 1 FOLLOWING AND 300000 FOLLOWING"


def _peaks(pick: str) -> str:
    before, after = (f"{pick}(x) OVER (PARTITION BY record, session_id ORDER BY us {frame})" for frame in _AROUND)
    return f"SELECT *, {before} AS a, {after} AS b FROM (SELECT *, CAST(round(i * 1e6 / fs) AS BIGINT) AS us FROM signal)"


_T = f"""{_S}, tops AS (SELECT record, session_id, fs, i AS idx, lag(i) OVER (PARTITION BY record, session_id ORDER BY i) AS prev FROM ({_peaks('max')}) WHERE x > a AND x >= b),
pul AS (SELECT record, session_id, fs, idx AS peak, arg_min(i, (x, i)) AS onset FROM (SELECT t.record, t.session_id, t.fs, t.idx, s.i, s.x FROM tops t JOIN signal s ON t.record = s.record AND t.session_id = s.session_id AND s.i BETWEEN greatest(coalesce(t.prev, 0), t.idx - CAST(round_even(t.fs * 0.4, 0) AS BIGINT), 0) AND t.idx) GROUP BY ALL HAVING arg_min(i, (x, i)) < idx)"""
_N = """, nb AS (SELECT record, session_id, i, x, lag(x) OVER w AS b, lead(x) OVER w AS a FROM signal WINDOW w AS (PARTITION BY record, session_id ORDER BY i))"""


def _vertex(b: str, x: str, a: str, i: str) -> str:
    return f"CASE WHEN {b} IS NULL OR {a} IS NULL OR {b} - 2 * {x} + {a} = 0 OR abs(0.5 * ({b} - {a}) / ({b} - 2 * {x} + {a})) > 1 THEN CAST({i} AS DOUBLE) ELSE {i} + 0.5 * ({b} - {a}) / ({b} - 2 * {x} + {a}) END"


_TAPS3 = ", ".join(repr(v) for v in co.kaiser_taps(2, 5))
ORACLES = {
    "s10_pulse_train": f"""WITH {SQL['ref']}, g AS (SELECT record, session_id, t, unnest(range(greatest(0, CAST(ceil(t * 25) AS BIGINT)), CAST(floor((t + 2) * 25) AS BIGINT) + 1)) AS i FROM ref), n AS (SELECT record, session_id, i, i / 25.0 - t AS u FROM g)
SELECT record, session_id, i, round(sum(CASE WHEN u < 0.12 THEN 0.5 * (1 - cos(pi() * u / 0.12)) ELSE exp(-(u - 0.12) / 0.35) END + 0.25 * exp(-0.5 * ((u - 0.40) / 0.05) ** 2)), 6) + 0e0 AS x FROM n GROUP BY ALL""",
    "d3_slope_sum": f"""{_S}, u AS (SELECT record, session_id, fs, i, coalesce(greatest(x - lag(x) OVER (PARTITION BY record, session_id ORDER BY i), 0), 0) AS up, greatest(1, CAST(round_even(0.128 * fs, 0) AS BIGINT)) AS w FROM signal),
z AS (SELECT record, session_id, fs, i, sum(up) OVER (PARTITION BY record, session_id ORDER BY i ROWS BETWEEN (w - 1) PRECEDING AND CURRENT ROW) AS z FROM u),
h AS (SELECT *, avg(CASE WHEN i < round_even(10 * fs, 0) THEN z END) OVER {_G} AS head, max(z) OVER {_G} AS top FROM z)
SELECT record, session_id, i, round(z, 6) + 0e0 AS z, round(CASE WHEN head > 0 THEN 3 * head ELSE 0.2 * top END, 6) + 0e0 AS seed FROM h""",
    "f9_snapped": f"{_T}{_N} SELECT record, session_id, peak, round(round_even(({_vertex('b', 'x', 'a', 'i')}) / fs * fs, 0) / fs, 9) AS t FROM pul JOIN nb USING (record, session_id) WHERE i = peak",
    "sp1_dc_removal": f"{_S} SELECT record, session_id, i, round(x - avg(x) OVER {_G}, 6) + 0e0 AS x FROM signal",
    "sp2_decimate": f"""{_S}, {_CENTRED}, raw AS (SELECT k, CASE WHEN k = 0 THEN 1e0 ELSE sin(pi() * k / 5) / (pi() * k / 5) END * (0.54 + 0.46 * cos(pi() * k / 50)) AS h FROM (SELECT unnest(range(-50, 51)) AS k)),
taps AS (SELECT k, h / (SELECT sum(h) FROM raw) AS h FROM raw),
ends AS (SELECT record, session_id, max(i) AS last FROM signal GROUP BY ALL),
o AS (SELECT record, session_id, unnest(range(0, last // 5 + 1)) AS j FROM ends)
SELECT o.record, o.session_id, o.j AS i, round(sum(s.x * t.h), 3) + 0e0 AS x FROM o, taps t, centred s WHERE s.record = o.record AND s.session_id = o.session_id AND s.i = o.j * 5 + t.k GROUP BY ALL""",
    "sp3_resample": f"""{_S}, {_CENTRED}, half AS (SELECT unnest([{_TAPS3}]) AS h, unnest(range(0, 51)) AS k), taps AS (SELECT k, h FROM half UNION ALL SELECT -k, h FROM half WHERE k > 0),
ends AS (SELECT record, session_id, max(i) AS last FROM signal GROUP BY ALL),
o AS (SELECT record, session_id, unnest(range(0, CAST(ceil((last + 1) * 2 / 5.0) AS BIGINT))) AS j FROM ends)
SELECT o.record, o.session_id, o.j AS i, round(sum(s.x * t.h), 3) + 0e0 AS x FROM o, taps t, centred s WHERE (o.j * 5 - t.k) % 2 = 0 AND s.record = o.record AND s.session_id = o.session_id AND s.i = (o.j * 5 - t.k) // 2 GROUP BY ALL""",
    "sp4_detrend": f"{_S} SELECT record, session_id, i, round(x - avg(x) OVER {_G} - coalesce(covar_pop(x, i) OVER {_G} / nullif(var_pop(i) OVER {_G}, 0), 0) * (i - avg(i) OVER {_G}), 6) + 0e0 AS x FROM signal",
    "sp6_normalise": f"{_Z} SELECT record, session_id, i, round(x, 6) + 0e0 AS x FROM z",
    "sp9_polarity": f"{_S}, d AS (SELECT record, session_id, x - lag(x) OVER (PARTITION BY record, session_id ORDER BY i) AS d FROM signal), m AS (SELECT *, avg(d) OVER {_G} AS m FROM d) SELECT record, session_id, CASE WHEN coalesce(avg((d - m) ** 3), 0) >= 0 THEN 1 ELSE -1 END AS polarity FROM m GROUP BY ALL",
    "sp10_motion_index": """WITH n AS (SELECT vec_id, i, sqrt(CAST(embedding[1 + i] AS DOUBLE) ** 2 + CAST(embedding[22 + i] AS DOUBLE) ** 2 + CAST(embedding[43 + i] AS DOUBLE) ** 2) AS s FROM embeddings, (SELECT unnest(range(0, 21)) AS i)),
m AS (SELECT vec_id, i // 7 AS block, s - median(s) OVER (PARTITION BY vec_id) AS m FROM n) SELECT vec_id, block, round(sqrt(avg(m * m)), 6) AS rms FROM m GROUP BY ALL""",
    "sp11_clip_square": f"{_Z} SELECT record, session_id, i, round(greatest(x, 0) ** 2, 6) AS sq FROM z",
    "q2_quality_scores": f"{_W} SELECT record, session_id, w, round(skew, 6) + 0e0 AS score, round(CASE WHEN dc > 0 THEN ac / dc ELSE 0 END, 6) AS perfusion FROM sc",
    "q6_coverage_gate": f"{_K} SELECT * FROM kept",
    "q8_gated_beats": f"{_K}, {SQL['ref']} SELECT record, session_id, ref_idx, t FROM ref SEMI JOIN (SELECT record, session_id, w FROM kept WHERE kept) k ON ref.record = k.record AND ref.session_id = k.session_id AND floor(ref.t / 2) = k.w",
    "l8_coverage": f"{_K}, k AS (SELECT record, session_id, count(*) * 2.0 AS sec FROM kept WHERE kept GROUP BY ALL), n AS (SELECT record, session_id, count(*) AS n, min(fs) AS fs FROM signal GROUP BY ALL) SELECT record, session_id, round(sec * fs / n, 6) AS coverage FROM n JOIN k USING (record, session_id)",
    "d2_terma_averages": f"""{_Z}, s AS (SELECT record, session_id, fs, i, x, greatest(x, 0) ** 2 AS sq, greatest(1, CAST(round_even(0.111 * fs, 0) AS BIGINT)) AS p, greatest(1, CAST(round_even(0.667 * fs, 0) AS BIGINT)) AS q FROM z QUALIFY count(*) OVER {_G} >= floor(2 * fs)),
a AS (SELECT *, round(sum(sq) OVER (PARTITION BY record, session_id ORDER BY i ROWS BETWEEN (p // 2) PRECEDING AND ((p - 1) // 2) FOLLOWING) / p - sum(sq) OVER (PARTITION BY record, session_id ORDER BY i ROWS BETWEEN (q // 2) PRECEDING AND ((q - 1) // 2) FOLLOWING) / q - 0.02 * avg(sq) OVER {_G}, 9) > 0 AS gap FROM s),
e AS (SELECT *, CAST(gap <> coalesce(lag(gap) OVER (PARTITION BY record, session_id ORDER BY i), false) AS INT) AS e FROM a), b AS (SELECT *, sum(e) OVER (PARTITION BY record, session_id ORDER BY i) AS b FROM e)
SELECT record, session_id, wide, idx FROM (SELECT record, session_id, p, b, count(*) AS wide, arg_max(i, (x, -i)) AS idx FROM b WHERE gap GROUP BY ALL) WHERE wide >= round_even(p, 0)""",
    "f3_onset_pulses": f"""{_S}, lows AS (SELECT record, session_id, fs, i AS idx, lead(i) OVER (PARTITION BY record, session_id ORDER BY i) AS nxt FROM ({_peaks('min')}) WHERE x < a AND x <= b),
e AS (SELECT record, session_id, max(i) + 1 AS n FROM signal GROUP BY ALL),
l AS (SELECT lows.*, least(n, idx + CAST(round_even(fs * 0.4, 0) AS BIGINT) + 1, coalesce(nxt, n)) AS stop FROM lows JOIN e USING (record, session_id))
SELECT record, session_id, onset, peak FROM (SELECT l.record, l.session_id, l.idx AS onset, arg_max(s.i, (s.x, -s.i)) AS peak FROM l JOIN signal s ON l.record = s.record AND l.session_id = s.session_id AND s.i BETWEEN l.idx AND l.stop - 1 WHERE stop - idx > 1 GROUP BY ALL) WHERE peak > onset""",
    "q4_motion_quality": """WITH n AS (SELECT vec_id, unnest(range(0, 64)) AS i, abs(CAST(unnest(embedding) AS DOUBLE)) AS s FROM embeddings), m AS (SELECT vec_id, i // 30 AS block, s - median(s) OVER (PARTITION BY vec_id) AS m FROM n) SELECT vec_id, block, round(sqrt(avg(m * m)), 6) AS rms FROM m WHERE block < 2 GROUP BY ALL""",
    "f2_pulses": f"{_T} SELECT record, session_id, onset, peak FROM pul",
    "f4_peak": f"{_T}{_N} SELECT record, session_id, peak, round(({_vertex('b', 'x', 'a', 'i')}) / fs, 9) AS t FROM pul JOIN nb USING (record, session_id) WHERE i = peak",
    "f5_foot": f"{_T}{_N} SELECT record, session_id, peak, round(({_vertex('b', 'x', 'a', 'i')}) / fs, 9) AS t FROM pul JOIN nb USING (record, session_id) WHERE i = onset",
    "f6_mid_upslope": f"""{_T}{_N}, tg AS (SELECT p.*, 0.5 * (o.x + k.x) AS target FROM pul p JOIN signal o ON p.record = o.record AND p.session_id = o.session_id AND o.i = p.onset JOIN signal k ON p.record = k.record AND p.session_id = k.session_id AND k.i = p.peak),
h AS (SELECT tg.*, nb.i, nb.x, nb.b FROM tg JOIN nb ON tg.record = nb.record AND tg.session_id = nb.session_id AND nb.i BETWEEN onset AND peak AND nb.x >= target QUALIFY row_number() OVER (PARTITION BY tg.record, tg.session_id, peak ORDER BY nb.i) = 1)
SELECT record, session_id, peak, round(CASE WHEN i > onset AND x > b THEN i - 1 + (target - b) / (x - b) ELSE i END / fs, 9) AS t FROM h""",
    "f7_max_slope": f"""{_T}{_N}, g AS (SELECT record, session_id, i, CASE WHEN b IS NULL THEN a - x WHEN a IS NULL THEN x - b ELSE (a - b) / 2 END AS g FROM nb),
gg AS (SELECT *, lag(g) OVER w AS gb, lead(g) OVER w AS ga FROM g WINDOW w AS (PARTITION BY record, session_id ORDER BY i)),
h AS (SELECT p.*, gg.i, gg.g, gg.gb, gg.ga FROM pul p JOIN gg ON p.record = gg.record AND p.session_id = gg.session_id AND gg.i BETWEEN onset AND peak QUALIFY row_number() OVER (PARTITION BY p.record, p.session_id, peak ORDER BY gg.g DESC, gg.i) = 1)
SELECT record, session_id, peak, round(({_vertex('gb', 'g', 'ga', 'i')}) / fs, 9) AS t FROM h""",
}
# Names under which the whole queries were registered when the others took sessions at 100 Hz, or 20 s of a session.
for _name in ("d2_terma_averages", "d3_slope_sum", "f2_pulses", "f3_onset_pulses", "f4_peak", "f5_foot", "f6_mid_upslope", "f7_max_slope", "f9_snapped"):
    QUERIES[f"{_name}_all_rates"], ORACLES[f"{_name}_all_rates"] = QUERIES[_name], ORACLES[_name]
QUERIES["s10_pulse_train_whole"], ORACLES["s10_pulse_train_whole"] = QUERIES["s10_pulse_train"], ORACLES["s10_pulse_train"]
