import math
import random

import numpy as np

from beatloom.operators.spikes import INTERVALS, SAMPLES, LevelRule, faulty_beats, faulty_levels, judge_level, judge_rhythm, rolling_median

SCHEMA = "s string, k long, x double, chunk string"


def flagged(spark, rows, rule, **kw):
    return {(r[0], r[1]) for r in faulty_levels(spark.createDataFrame(rows, SCHEMA), ["s"], "k", "x", rule, **kw).collect()}


def steady(n, seed=1):
    rng = random.Random(seed)
    return [0.8 + 0.01 * math.sin(i / 5) + rng.gauss(0, 0.004) for i in range(n)]


def test_rolling_median_against_sorting():
    rng = np.random.default_rng(0)
    x, g = rng.normal(size=200), np.repeat([0, 1, 2], [90, 3, 107])
    want = [np.median([x[j] for j in range(max(0, i - 4), min(200, i + 5)) if g[j] == g[i]]) for i in range(200)]
    assert np.allclose(rolling_median(x, g, 4), want)


def test_intervals(spark):
    x = steady(120)
    x[30], x[31], x[60], x[70] = 1.5, 1.4, 0.1, 2.5
    x[90:102] = [x[90]] * 12
    x[80] = float("nan")
    rows = [("a", i, v, "c") for i, v in enumerate(x)] + [("a", 30, 1.5, "c"), ("a", None, 9.9, "c"), ("a", 200, None, "c")]
    assert flagged(spark, rows, INTERVALS) == {("a", k) for k in (30, 31, 60, 70, *range(90, 102))}


def test_slow_and_lasting_changes_are_no_fault(spark):
    rows = [("a", i, v * (1 + i / 400) + (0.15 if i > 60 else 0.0), "") for i, v in enumerate(steady(120, 2))]
    assert flagged(spark, rows, INTERVALS) == set()


def test_constant_series_and_empty_table(spark):
    assert flagged(spark, [("a", i, 0.8, "") for i in range(40)], INTERVALS) == set()
    assert flagged(spark, [], INTERVALS) == set()
    assert flagged(spark, [(None, 0, 0.1, "")], INTERVALS) == {(None, 0)}


def test_samples(spark):
    x = [60_000 + 400 * math.sin(i / 8) + (i * 7919 % 13) for i in range(400)]
    x[50], x[51], x[200], x[300] = 65_000, 65_010, 0.0, 262_143.0
    x[100:130] = [x[100]] * 30
    rows = [("a", i, float(v), "") for i, v in enumerate(x)]
    assert flagged(spark, rows, SAMPLES) == {("a", k) for k in (50, 51, 200, 300, *range(100, 130))}


def test_chunks_see_their_neighbours(spark):
    x = steady(600, 3)
    x[99], x[100], x[401] = 1.4, 1.4, 0.5
    rows = [("a", i, v, "") for i, v in enumerate(x)]
    assert flagged(spark, rows, INTERVALS, length=100) == {("a", 99), ("a", 100), ("a", 401)}


def beats(n=80, step=0.8, seed=4):
    rng = random.Random(seed)
    t, out = 0.5, []
    for _ in range(n):
        out.append(round(t, 3))
        t += step + rng.gauss(0, 0.01)
    return out


def off(t):
    return set(np.flatnonzero(judge_rhythm(np.array(t, float), np.zeros(len(t), int))).tolist())


def test_rhythm():
    t = beats()
    assert off(t) == set()
    moved = t[:]
    moved[20] += 0.3
    moved[40] = t[41] + 0.5
    moved[60] = -1.0
    moved[79] = 1e6
    assert off(moved) == {20, 40, 60, 79}
    extra = t[:30] + [(t[29] + t[30]) / 2] + t[30:]
    assert off(extra) == {30}
    stuck = t[:]
    stuck[10:15] = [t[10]] * 5
    assert off(stuck) == set(range(10, 15))
    gap = t[:40] + [v + 14.7 for v in t[40:]]
    assert off(gap) == set()
    missing = t[:25] + t[26:]
    assert off(missing) == set()
    null = t[:]
    null[33] = float("nan")
    assert off(null) == set()


def test_faulty_beats(spark):
    t = beats()
    t[20] += 0.3
    rows = [("a", i, v, "") for i, v in enumerate(t)] + [("a", 20, t[20], ""), ("a", None, 5.0, ""), ("b", 0, 1.0, "")]
    got = {(r[0], r[1]) for r in faulty_beats(spark.createDataFrame(rows, SCHEMA), ["s"], "k", "x").collect()}
    assert got == {("a", 20)}


def test_rule_bounds_are_closed_or_open():
    open_rule = LevelRule(0.0, 1.0, False, 2, 50.0, "residual", 9, 1.0)
    closed = LevelRule(0.0, 1.0, True, 2, 50.0, "residual", 9, 1.0)
    x, g = np.array([0.0, 0.5, 0.6, 1.0, 0.4]), np.zeros(5, int)
    assert judge_level(x, g, open_rule).tolist() == [False] * 5
    assert judge_level(x, g, closed).tolist() == [True, False, False, True, False]
