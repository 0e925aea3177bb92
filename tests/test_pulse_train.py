"""The pulse signal up to the last beat."""

import math

import pytest

from beatloom.plans import signal_queries as sq


def test_goes_on_to_the_last_beat(spark, tmp_path):
    beats = {"a": [0.5, 19.5, 20.5, 61.25], "b": [3.0]}
    rows = [(r, "s", i, t) for r, ts in beats.items() for i, t in enumerate(ts)]
    spark.createDataFrame(rows, "record string, session_id string, ref_idx long, t double").write.parquet(f"{tmp_path}/ref_beats.parquet")
    want = {}
    for r, ts in beats.items():
        for t in ts:
            for i in range(math.ceil(t * 25), math.floor((t + 2) * 25) + 1):
                u = i / 25 - t
                x = (0.5 * (1 - math.cos(math.pi * u / 0.12)) if u < 0.12 else math.exp(-(u - 0.12) / 0.35)) + 0.25 * math.exp(-0.5 * ((u - 0.40) / 0.05) ** 2)
                want[r, i] = want.get((r, i), 0) + x
    got = {(r["record"], r["i"]): r["x"] for r in sq.s10_pulse_train(spark, str(tmp_path)).collect()}
    assert got == {k: pytest.approx(v, abs=2e-6) for k, v in want.items()}
