"""Queries over sessions of several sampling rates."""

import math

import pytest

from beatloom.plans import signal_queries as sq

RATES = (50.0, 64.0, 100.0, 125.0)
SECONDS = 20


@pytest.fixture(scope="module")
def mixed(spark, tmp_path_factory):
    """One session a rate, all with the same pulse of 1.25 beats a second."""
    folder = str(tmp_path_factory.mktemp("rates"))
    rows = [(f"r{int(fs)}", "s", fs, i, 60_000.0 + 900 * math.sin(2 * math.pi * 1.25 * i / fs) + i % 3 * 0.01) for fs in RATES for i in range(int(SECONDS * fs))]
    spark.createDataFrame(rows, "record string, session_id string, fs double, i long, x double").write.parquet(f"{folder}/ppg_samples.parquet")
    return folder


@pytest.mark.parametrize("name", ["f2_pulses", "f3_onset_pulses", "f4_peak", "f5_foot", "f6_mid_upslope", "f7_max_slope", "f9_snapped", "d2_terma_averages"])
def test_pulses_of_every_rate(spark, mixed, name):
    n = {r["record"]: r["count"] for r in sq.QUERIES[name](spark, mixed).groupBy("record").count().collect()}
    assert set(n) == {f"r{int(fs)}" for fs in RATES} and all(23 <= v <= 26 for v in n.values())
    assert sq.QUERIES[f"{name}_all_rates"] is sq.QUERIES[name]


def test_slope_sum_of_every_rate(spark, mixed):
    rows = sq.QUERIES["d3_slope_sum_all_rates"](spark, mixed).collect()
    raw = {}
    for r in spark.read.parquet(f"{mixed}/ppg_samples.parquet").orderBy("i").collect():
        raw.setdefault(r["record"], []).append(r["x"])
    for fs in RATES:
        x, mine = raw[f"r{int(fs)}"], sorted((r["i"], r["z"], r["seed"]) for r in rows if r["record"] == f"r{int(fs)}")
        up = [0.0] + [max(b - a, 0.0) for a, b in zip(x, x[1:])]
        w = round(0.128 * fs)
        z = [sum(up[max(0, i - w + 1) : i + 1]) for i in range(len(x))]
        assert [v for _, v, _ in mine] == pytest.approx(z, abs=1e-5)
        assert mine[0][2] == pytest.approx(3 * sum(z[: round(10 * fs)]) / round(10 * fs), abs=1e-5)


def test_sweeps_take_each_session_at_its_own_rate(spark, mixed):
    rates = {(r["record"], r["rate"]) for r in sq.x3_rates(spark, mixed).collect()}
    assert rates == {(f"r{int(fs)}", fs / q) for fs in RATES for q in (1, 2, 4)}
    assert {(r["record"], r["flagged"]) for r in sq.x8_decimation_loss(spark, mixed).collect()} == {(f"r{int(fs)}", False) for fs in RATES}
