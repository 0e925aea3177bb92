"""Series longer than a chunk are judged as a whole."""

import numpy as np
import pandas as pd
import pytest

from beatloom.operators.series import dense, exact_quantiles
from beatloom.operators.spikes import INTERVALS, SAMPLES, faulty_beats, faulty_levels, judge_level


def whole(x, rule):
    return np.flatnonzero(judge_level(x, np.zeros(len(x), int), rule)).tolist()


@pytest.mark.parametrize("rule", [INTERVALS, SAMPLES])
@pytest.mark.parametrize("length", [100, 333, 5_000])
def test_same_for_every_length(spark, rule, length):
    rng = np.random.default_rng(3)
    low, wide = (0.8, 0.02) if rule is INTERVALS else (60_000.0, 300.0)
    x = low + wide * rng.normal(size=1400)
    x[400:720] = x[400]  # stuck for whole chunks and their margins
    x[800:1000] = low + wide / 50 * rng.normal(size=200)  # a quiet chunk
    x[[100, 850, 900]] += 40 * wide
    k = np.cumsum(rng.integers(1, 40, len(x)))  # places that skip
    rows = [(s, int(i), float(v)) for s in ("a", None) for i, v in zip(k, x)]
    df = spark.createDataFrame(rows + rows[:300], "s string, k long, x double")
    got = sorted((str(r[0]), r[1]) for r in faulty_levels(df, ["s"], "k", "x", rule, length=length).collect())
    want = whole(x, rule)
    assert set(range(400, 720)) | {100, 850, 900} <= set(want)
    assert got == sorted((str(s), int(k[i])) for s in ("a", None) for i in want)


def test_stuck_for_many_chunks(spark):
    """60,000 stuck samples in a varying series, in chunks of 10,000: all of them are flagged."""
    x = 60_000 + 300 * np.random.default_rng(4).normal(size=70_000)
    x[4_000:64_000] = x[4_000]
    df = spark.createDataFrame(pd.DataFrame({"s": "a", "k": np.arange(len(x)), "x": x}))
    assert sorted(r["k"] for r in faulty_levels(df, ["s"], "k", "x", SAMPLES, length=10_000).collect()) == list(range(4_000, 64_000))


def test_exact_quantiles(spark):
    rng = np.random.default_rng(5)
    parts = {"a": rng.normal(size=999), "b": np.round(rng.normal(size=500), 1), None: np.array([3.0]), "c": np.full(50, 7.0), "d": np.r_[1e9, rng.normal(size=200)]}
    rows = [(s, float(v)) for s, values in parts.items() for v in values] + [("e", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "s string, x double")
    for bins in (4, 4_096):
        got = {r["s"]: r["quantiles"] for r in exact_quantiles(df, ["s"], "x", [0.0, 0.1, 0.5, 1.0], bins).collect()}
        assert set(got) == set(parts)
        for s, values in parts.items():
            assert np.allclose(got[s], np.quantile(values, [0.0, 0.1, 0.5, 1.0]))


def test_dense(spark):
    df = spark.createDataFrame([(s, int(k)) for s in ("a", None) for k in np.cumsum(np.arange(1, 60))], "s string, k long")
    for length in (7, 100, 10_000):
        got = sorted((str(r["s"]), r["k"], r["n"]) for r in dense(df, ["s"], "k", "n", length).collect())
        assert [g[2] for g in got] == 2 * list(range(59))


def test_beats_stuck_for_a_chunk(spark):
    t = [0.8 * i for i in range(600)]
    t[150:450] = [t[150]] * 300
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(t)], "s string, k long, t double")
    assert set(range(150, 450)) <= {r["k"] for r in faulty_beats(df, ["s"], "k", "t", length=100).collect()}
