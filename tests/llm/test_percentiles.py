import math
import random

import numpy as np
import pytest

from beatloom.llm import percentiles

SCHEMA = "g string, part string, v double, n string, rank long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA)


def want(values, share):
    s = sorted(values)
    return s[max(1, math.ceil(round(share * len(s), 9))) - 1]


def test_exact_through_many_rounds(spark):
    rng = random.Random(3)
    rows = [("hot", "a", rng.lognormvariate(0, 2)) for _ in range(6000)] + [("ties", "a", float(rng.randint(0, 3))) for _ in range(4000)] + [(None, "b", float(i)) for i in range(10)]
    got = percentiles.multi_select(frame(spark, rows).repartition(7), ["g"], "v", [0.0, 0.1, 0.5, 0.99, 1.0], bound=100).collect()
    assert len(got) == 15
    for r in got:
        mine = [v for g, _, v in rows if g == r["g"]]
        assert r["n"] == len(mine) and r["value"] == want(mine, r["share"])


def test_values_that_are_none(spark):
    rows = [("a", "p", None), ("a", "p", math.nan), ("a", "p", math.inf), ("b", "p", -math.inf), ("a", "p", 2.0), ("a", "p", 2.0)]
    got = [(r["g"], r["n"], r["value"]) for r in percentiles.multi_select(frame(spark, rows), ["g"], "v", [0.5]).collect()]
    assert got == [("a", 2, 2.0)]
    assert percentiles.multi_select(frame(spark, []), ["g"], "v", [0.5]).collect() == []


def test_parts_put_together_within_the_stated_error(spark):
    rng = random.Random(4)
    rows = [("g", f"day{i % 5}", rng.gauss(i % 5, 1.0)) for i in range(5000)] + [("g", "tiny", 100.0)]
    parts = percentiles.summaries(frame(spark, rows), ["g"], "part", "v", points=50)
    values = np.sort([v for _, _, v in rows])
    for r in percentiles.combine(parts, ["g"], [0.1, 0.5, 0.9], points=50).collect():
        rank = np.searchsorted(values, r["value"], side="right") / len(values)
        assert r["n"] == 5001 and abs(rank - r["share"]) <= r["rank_error"] == pytest.approx(0.02)
