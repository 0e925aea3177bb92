"""Matching queries over runs that state no delay."""

import pytest

from beatloom.plans import registry

Q = registry.queries()


@pytest.fixture(scope="module")
def beats(spark, tmp_path_factory):
    """Sixty beats and three detectors behind them by 0.25 s; "stated" says so, "null" and "nan" do not."""
    folder = str(tmp_path_factory.mktemp("runs"))
    t = [0.85 * i + 0.05 * (i % 7) for i in range(60)]
    spark.createDataFrame([("r", "s", i, v) for i, v in enumerate(t)], "record string, session_id string, ref_idx long, t double").write.parquet(f"{folder}/ref_beats.parquet")
    lags = {"stated": 0.25, "null": None, "nan": float("nan")}
    rows = [("r", "s", d, i, v + 0.25, lag) for d, lag in lags.items() for i, v in enumerate(t)]
    spark.createDataFrame(rows, "record string, session_id string, detector string, test_idx long, t double, lag_s double").write.parquet(f"{folder}/det_beats.parquet")
    return folder


@pytest.mark.parametrize("name", ["j1_band_join", "j3_nearest", "m2_matches", "m4_paired_intervals"])
def test_runs_without_a_delay_are_like_the_one_that_states_it(spark, beats, name):
    n = {r["detector"]: r["count"] for r in Q[f"{name}_every_run"](spark, beats).groupBy("detector").count().collect()}
    assert n == dict.fromkeys(("stated", "null", "nan"), 59 if name.startswith("m4") else 60)


def test_accuracy_of_every_run(spark, beats):
    assert {(r["detector"], r["tp"], r["fp"], r["fn"]) for r in Q["m3_counts_every_run"](spark, beats).collect()} == {(d, 60, 0, 0) for d in ("stated", "null", "nan")}
    assert Q["m3_missed_every_run"](spark, beats).count() == 0
    for name in ("l2_interval_error", "l3_bland_altman", "l4_concordance", "x9_agreement", "x11_best_case"):
        assert Q[f"{name}_every_run"](spark, beats).count() == 3
    assert Q["l5_equivalence"](spark, beats).count() == 3
    assert Q["l7_consensus_floor_every_run"](spark, beats).collect()[0]["n_detectors"] == 3
