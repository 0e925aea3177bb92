"""Known answers for indices, corrections, matching, metrics, detectors and files."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from beatloom.functions.student import _upper_tail
from beatloom.operators import conditioning as co
from beatloom.operators import correction as cr
from beatloom.operators import detectors as de
from beatloom.operators import fiducial as fi
from beatloom.operators import hrv
from beatloom.operators import matching as ma
from beatloom.operators import quality as qu
from beatloom.operators import spectrum
from beatloom.sources import files

S = ["s"]


def series(spark, *lists):
    rows = [(f"g{g}", i, float(v)) for g, xs in enumerate(lists) for i, v in enumerate(xs)]
    return spark.createDataFrame(rows, "s string, n long, ibi_s double")


def by_group(df):
    return {r["s"]: r.asDict() for r in df.collect()}


def test_time_domain(spark):
    r = by_group(hrv.time_domain(series(spark, [0.8, 0.82, 0.78, 0.81, 0.79], [0.85] * 50, [0.8, 0.9] * 25, [0.8, 0.9]), S))
    x = np.array([800, 820, 780, 810, 790.0])
    assert r["g0"]["mean_nn"] == pytest.approx(800) and r["g0"]["sdnn"] == pytest.approx(x.std(ddof=1))
    assert r["g0"]["rmssd"] == pytest.approx(np.sqrt((np.diff(x) ** 2).mean())) and r["g0"]["mean_hr"] == pytest.approx(75)
    assert r["g1"]["rmssd"] == pytest.approx(0, abs=1e-9) and r["g1"]["pnn50"] == 0
    assert r["g2"]["pnn50"] == pytest.approx(100)
    assert r["g3"]["mean_nn"] is None


def test_poincare_identity_and_spectrum(spark):
    rng = np.random.default_rng(5)
    x = 0.8 + 0.03 * np.sin(2 * np.pi * 0.25 * np.cumsum(np.full(500, 0.8)))
    df = series(spark, 0.8 + rng.normal(0, 0.03, 200), x)
    p, t = by_group(hrv.poincare(df, S)), by_group(hrv.time_domain(df, S))
    assert p["g0"]["sd1"] ** 2 + p["g0"]["sd2"] ** 2 == pytest.approx(2 * t["g0"]["sdnn"] ** 2)
    b = by_group(hrv.band_power(hrv.lomb_scargle(df, S), S))
    assert b["g1"]["hf"] > 5 * b["g1"]["lf"]


def test_sample_entropy_orders_regular_before_random(spark):
    rng = np.random.default_rng(6)
    r = by_group(hrv.sample_entropy(series(spark, 0.8 + 0.05 * np.sin(np.arange(200) / 3), 0.8 + rng.normal(0, 0.05, 200)), S))
    assert r["g0"]["sampen"] < r["g1"]["sampen"]


def test_median_mad_and_screen(spark):
    x = [0.85] * 40 + [1.20] + [0.85] * 40
    x = [v + 0.002 * math.sin(i) for i, v in enumerate(x)]
    kept = cr.median_mad(series(spark, x, [0.1, 0.2, 0.85]), S).groupBy("s").agg(F.max("ibi_s").alias("m"), F.count("*").alias("n")).collect()
    got = {r["s"]: (r["m"], r["n"]) for r in kept}
    assert got["g0"][0] < 1.15 and got["g0"][1] >= 78
    assert got["g1"] == (0.85, 1)


def test_adaptive_correction():
    rng = np.random.default_rng(7)
    x = 0.85 + 0.03 * np.sin(np.arange(120) / 6) + rng.normal(0, 0.002, 120)
    clean, none = cr.correct_series(x)
    assert none <= 2 and len(clean) == 120
    missed = np.r_[x[:50], x[50] + x[51], x[52:]]
    fixed, many = cr.correct_series(missed)
    assert 1 <= many <= 3 and len(fixed) == 120
    ectopic = x.copy()
    ectopic[60] -= 0.25
    ectopic[61] += 0.25
    fixed, many = cr.correct_series(ectopic)
    assert many >= 1 and fixed.max() < 1.0


def test_vertex(spark):
    rows = [(i, -((i - 10.37) ** 2)) for i in range(20)]
    df = spark.createDataFrame(rows, "i long, x double").where("i between 9 and 11").groupBy().agg(*[F.max(F.when(F.col("i") == k, F.col("x"))).alias(f"x{k}") for k in (9, 10, 11)])
    at = df.select(fi.vertex(F.col("x9"), F.col("x10"), F.col("x11"), F.lit(10)).alias("v")).collect()[0]["v"]
    assert at == pytest.approx(10.37)
    with pytest.raises(ValueError):
        fi.locate(df, df, [], "nose")


def sides(spark, ref, test):
    r = spark.createDataFrame([("e", i, float(t), i) for i, t in enumerate(ref)], "e string, ref_idx long, rt double, rk long")
    t = spark.createDataFrame([("e", "d", i, float(t), i) for i, t in enumerate(test)], "e string, d string, test_idx long, tt double, tk long")
    return r, t


@pytest.mark.parametrize("lag", [0.05, 0.25, 0.40])
def test_delay(spark, lag):
    t = np.cumsum(np.full(120, 0.85) + 0.02 * np.sin(np.arange(120)))
    r, d = sides(spark, t, t + lag)
    assert ma.grid_delay(r, d, ["e"], ["d"]).collect()[0]["delay"] == pytest.approx(lag, abs=0.005)


def test_one_to_one_and_pairs(spark):
    t = np.arange(50) * 0.85
    r, d = sides(spark, t, np.sort(np.r_[t, t + 0.01]))
    m = ma.match(r, d, ["e"], ["d"], 0.15)
    c = ma.detection_counts(m, r, d, ["e"], ["d"]).collect()[0]
    assert (c["tp"], c["fp"], c["fn"]) == (50, 50, 0)
    t = np.arange(30) * 0.8
    r, d = sides(spark, t, np.delete(t, 10))
    pairs = {x["ref_idx"] for x in ma.paired_intervals(ma.match(r, d, ["e"], ["d"], 0.15), r, d, ["e"], ["d"]).collect()}
    assert len(pairs) == 27 and not {9, 10} & pairs
    r, d = sides(spark, np.arange(100) * 0.8, np.arange(90) * 0.8)
    c = ma.detection_counts(ma.match(r, d, ["e"], ["d"], 0.15), r, d, ["e"], ["d"]).collect()[0]
    assert (c["tp"], c["fn"], c["fp"]) == (90, 10, 0) and c["f1"] == pytest.approx(1.8 / 1.9)


def test_agreement(spark):
    df = spark.createDataFrame([("e", float(i), 0.0, 3.0 if i % 2 else 5.0) for i in range(200)], "e string, k double, a double, b double")
    r = ma.bland_altman(df, ["e"], "a", "b").collect()[0]
    assert r["bias"] == pytest.approx(4) and r["upper"] == pytest.approx(5.96, abs=0.02)
    same = spark.createDataFrame([("e", float(i), float(i)) for i in range(20)], "e string, a double, b double")
    assert ma.concordance(same, ["e"], "a", "b").collect()[0]["ccc"] == pytest.approx(1)
    assert ma.equivalence(same, ["e"], "a", "b").collect()[0]["p"] == 0.0


def test_student_tail():
    assert _upper_tail(0.0, 7) == pytest.approx(0.5)
    assert _upper_tail(2.015048, 5) == pytest.approx(0.05, abs=1e-6)
    assert _upper_tail(-2.015048, 5) == pytest.approx(0.95, abs=1e-6)
    assert _upper_tail(1.644854, 1e7) == pytest.approx(0.05, abs=1e-5)


def test_coverage_gate_with_ties(spark):
    df = spark.createDataFrame([("a", w, float(v)) for w, v in enumerate([5, 1, 4, 2, 3])] + [("b", w, 1.0) for w in range(4)], "s string, w long, score double")
    got = {(r["s"], r["w"]): r["kept"] for r in qu.coverage_gate(df, S, 0.6).collect()}
    assert [got[("a", w)] for w in range(5)] == [True, False, True, False, True]
    assert all(got[("b", w)] for w in range(4))


def pulse(spark, rate=72, seconds=60, fs=100):
    t = np.arange(1.0, seconds - 1.0, 60 / rate)
    beats = spark.createDataFrame([("r", float(v)) for v in t], "record string, t double")
    every = spark.range(int(seconds * fs)).select(F.lit("r").alias("record"), F.col("id").alias("i"))
    x = files.pulse_train(beats, ["record"], fs, seconds)
    return every.join(x, ["record", "i"], "left").select(F.col("record").alias("s"), "i", F.coalesce("x", F.lit(0.0)).alias("x"), F.lit(float(fs)).alias("fs")), len(t)


def test_detectors_count_beats(spark):
    signal, n = pulse(spark)
    found = de.detect(co.prepare(signal, S), S).groupBy("detector").agg(F.count("*").alias("n"), F.countDistinct("idx").alias("u")).collect()
    counts = {r["detector"]: r["n"] for r in found}
    assert set(counts) == set(de.REGISTRY)
    for name, many in counts.items():
        assert abs(many - n) <= max(3, 0.06 * n), (name, many, n)
    assert all(r["n"] == r["u"] for r in found)


def test_detectors_on_nothing():
    flat = np.zeros(3000)
    for _, _, f in de.REGISTRY.values():
        if f:
            assert len(f(flat, 100.0)) < 50 and len(f(np.zeros(3), 100.0)) == 0


def test_scalogram_window_against_its_definition():
    rng = np.random.default_rng(8)
    for n in (4, 5, 7, 16, 37, 120):
        x = rng.normal(size=n)
        y = x - np.polyval(np.polyfit(np.arange(n), x, 1), np.arange(n))
        most = -(-n // 2) - 1
        table = [[k + 1 <= j < n - k and y[j] > y[j - k] and y[j] > y[j + k] for j in range(n)] for k in range(1, most)] + [[False] * n]
        rows = [sum(r) for r in table]
        lam = rows.index(max(rows))
        assert de.msptd_window(x).tolist() == [j for j in range(n) if all(table[k][j] for k in range(lam + 1))]


def test_band_pass_keeps_phase_and_drops_the_level():
    t = np.arange(6000) / 100
    wave = np.sin(2 * np.pi * 1.5 * t)
    y = co.zero_phase(wave * 150 + 74000, 100, 4, 0.5, 8.0)
    mid = slice(1000, 5000)
    assert abs(y[mid].mean()) < 0.5 and np.corrcoef(y[mid], wave[mid])[0, 1] > 0.999
    edge = co.zero_phase(np.sin(2 * np.pi * 8.0 * t), 100, 4, 0.5, 8.0)
    assert edge[mid].std() / np.sqrt(0.5) == pytest.approx(0.5, abs=0.02)  # -3 dB twice


def test_spectra(spark):
    t = np.cumsum(np.full(300, 0.8))
    x = 0.8 + 0.03 * np.sin(2 * np.pi * 0.25 * t)
    b = by_group(spectrum.interval_bands(series(spark, x, [0.8] * 10), S))
    assert b["g0"]["hf"] > 5 * b["g0"]["lf"] and "g1" not in b
    assert b["g0"]["hf"] == pytest.approx(30**2 / 2, rel=0.1)
    at = np.linspace(0.1, 8.9, 50)
    knots = np.arange(10.0)
    assert np.allclose(spectrum.pchip(knots, 2 * knots, at), 2 * at)
    step = spectrum.pchip(knots, (knots > 4).astype(float), at)
    assert step.min() >= 0 and step.max() <= 1
    f, p = spectrum.welch(np.random.default_rng(1).normal(size=50_000), 10.0, 500)
    assert (p[1:] * np.diff(f)).sum() == pytest.approx(1, abs=0.05)


def test_files(spark, tmp_path):
    head = spark.createDataFrame([("<age>: 31 <bmi>: 22.5 <age>: 32",), ("",), (None,)], "h string")
    got = [r["m"] for r in head.select(files.header_fields(F.col("h")).alias("m")).collect()]
    assert got[0] == {"age": "32", "bmi": "22.5"} and got[1] == {} and not got[2]
    for name, size in (("a.dat", 10), ("a.hea", 2), ("b.dat", 3), ("b.hea", 2)):
        (tmp_path / name).write_bytes(b"x" * size)
    listed = files.listing(spark, str(tmp_path / "*"))
    assert [r[0] for r in files.complete_records(listed, ["dat", "hea"], {"dat": 5}).collect()] == ["a"]
    manifest = spark.createDataFrame([("a.dat", hashlib.sha256(b"x" * 10).hexdigest()), ("b.dat", "0"), ("c.dat", "0")], "name string, sha256 string")
    status = {r["name"]: r["status"] for r in files.checksums(spark, str(tmp_path / "*.dat"), manifest).collect()}
    assert status == {"a.dat": "ok", "b.dat": "differs", "c.dat": "missing"}
    files.write_json(spark.range(3), str(tmp_path / "out"))
    assert files.read_json(spark, str(tmp_path / "out"), "id long").count() == 3


@pytest.mark.parametrize("n", [1, 5, 60, 91, 300])
def test_rolling_quartiles_against_one_by_one(n):
    from beatloom.operators.correction import _quartile_deviation

    x = np.random.default_rng(n).normal(size=n)
    want = [max(float(np.subtract(*np.quantile(np.abs(x[max(0, i - 45) : i + 46]), [0.75, 0.25]))) / 2, 1e-6) for i in range(n)]
    assert np.allclose(_quartile_deviation(x), want)


def test_a_level_leaves_no_trace_at_the_ends(spark):
    """A constant of 74,000 comes out as 0 from decimation and resampling, and a wave keeps its size beside it."""
    flat = spark.range(500).select(F.lit("s").alias("s"), F.col("id").alias("i"), F.lit(100.0).alias("fs"), F.lit(74_000.0).alias("x"))
    for out in (co.decimate(flat, ["s"], 5), co.resample(flat, ["s"], 2, 5), co.to_rate(flat, ["s"], 30.0, [100.0])):
        assert max(abs(r["x"]) for r in out.collect()) < 1e-6
    wave = flat.withColumn("x", F.col("x") + 150 * F.sin(F.col("i") / 16))
    assert all(abs(r["x"]) < 160 for r in co.decimate(wave, ["s"], 5).collect())


def test_to_rate_takes_every_rate(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("s"), F.floor(F.col("id") / 2).alias("i"), F.when(F.col("id") % 2 == 0, 50.0).otherwise(125.0).alias("fs"), F.rand(1).alias("x"))
    got = {r["s"]: r["count"] for r in co.to_rate(df, ["s"], 100.0, [50.0, 125.0]).groupBy("s").count().collect()}
    assert got == {0: 1000, 1: 400}


@pytest.mark.parametrize("fs", [64, 100, 128, 200, 256])
def test_terma_at_any_rate(spark, fs):
    """One beat a second for 20 s: as many peaks at every rate."""
    t = F.col("id") / fs
    wave = spark.range(20 * fs).select(F.lit("s").alias("s"), F.col("id").alias("i"), F.lit(float(fs)).alias("fs"), F.exp(-0.5 * F.pow((t - F.floor(t) - 0.5) / 0.06, F.lit(2))).alias("x"))
    assert de.terma(co.normalise(wave, ["s"]), ["s"]).count() == 20


def test_entropy_needs_spread_and_ten_intervals(spark):
    rows = [("flat", n, 0.85) for n in range(50)] + [("few", n, 0.8 + 0.05 * (n % 2)) for n in range(9)] + [("ten", n, 0.8 + 0.05 * (n % 2)) for n in range(10)]
    got = {r["s"]: r["sampen"] for r in hrv.sample_entropy(spark.createDataFrame(rows, "s string, n long, ibi_s double"), ["s"]).collect()}
    assert got["flat"] is None and got["few"] is None and got["ten"] is not None


def test_delay_needs_three_references(spark):
    ref = lambda k: spark.createDataFrame([("e", i, float(i)) for i in range(k)], "e string, ref_idx long, rt double")
    test = spark.createDataFrame([("e", "d", float(i) + 0.25) for i in range(4)], "e string, d string, tt double")
    delay = lambda k: ma.grid_delay(ref(k), test, ["e"], ["d"]).collect()[0]["delay"]
    assert delay(2) == 0.0 and delay(0) == 0.0 and abs(delay(3) - 0.25) < 1e-6


def test_samples_stay_on_their_grid(spark, tmp_path):
    rows = [("r", 1, "c", 100.0, i, x) for i, x in [(1, 10.0), (2, 20.0), (4, 40.0), (5, None), (6, 0.0), (7, 70.0), (7, 70.0), (9, 262143.0)]]
    spark.createDataFrame(rows, "record string, session_id long, channel string, fs double, i long, x double").write.parquet(str(tmp_path / "ppg_samples.parquet"))
    from beatloom.sources.adapters import signal

    got = [(r["i"], r["x"]) for r in signal(spark, str(tmp_path)).orderBy("i").collect()]
    assert got == [(0, 10.0), (1, 10.0), (2, 20.0), (3, 30.0), (4, 40.0), (5, 50.0), (6, 60.0), (7, 70.0)]
