import itertools
import math
import random

import pytest

from beatloom.llm import nearest

L = "e string, run string, lid long, t double, lag double, rt double, note string"
R = "e string, rid long, t double, lag double, note string"


def greedy(pairs):
    used_l, used_r, out = set(), set(), set()
    for _, rid, lid in sorted(pairs):
        if rid not in used_r and lid not in used_l:
            used_r.add(rid)
            used_l.add(lid)
            out.add((rid, lid))
    return out


def brute(left, right, tol):
    want = set()
    for key in {(x[0], x[1]) for x in left if x[0] is not None}:
        mine = {x[2]: x[3] - x[4] for x in left if (x[0], x[1]) == key and x[3] is not None and x[2] is not None}
        theirs = {x[1]: x[2] for x in right if x[0] == key[0] and x[2] is not None and x[1] is not None}
        pairs = [(round(abs(a - b), 6), r, i) for (i, a), (r, b) in itertools.product(mine.items(), theirs.items()) if abs(a - b) <= tol + 1e-9]
        want |= {(*key, r, i) for r, i in greedy(pairs)}
    return want


def matched(spark, left, right, tol=0.15):
    a, b = spark.createDataFrame(left, L), spark.createDataFrame(right, R)
    return [tuple(r) for r in nearest.match_runs(a, b, ["e"], ["run"], "lid", "rid", "t", "t", "lag", tol).collect()]


def test_against_brute_force_on_crowded_beats(spark):
    rng = random.Random(1)
    left = [(f"e{i % 3}", f"r{i % 2}", i, round(rng.uniform(0, 30), 3), 0.25, None, "n") for i in range(400)]
    right = [(f"e{i % 3}", i, round(rng.uniform(0, 30), 3), None, "m") for i in range(300)]
    got = matched(spark, left, right)
    assert len(got) == len(set(got)) and set(got) == brute(left, right, 0.15)


def test_ties_repeats_nulls_and_edges(spark):
    left = [("e", "d", 1, 1.1, 0.0, None, ""), ("e", "d", 1, 1.1, 0.0, None, ""), ("e", "d", 2, 5.15, 0.0, None, ""), ("e", "d", 3, None, 0.0, None, ""), (None, "d", 4, 1.0, 0.0, None, ""), ("e", "d", 5, math.nan, 0.0, None, ""), ("e", "d", None, 1.0, 0.0, None, ""), ("e", "d", 6, 9.0, 0.0, None, "")]
    right = [("e", 1, 1.0, None, ""), ("e", 0, 1.2, None, ""), ("e", 2, 5.0, None, ""), ("e", 2, 5.0, None, ""), ("e", None, 9.0, None, ""), ("e", 7, None, None, ""), ("e", 8, 9.151, None, "")]
    assert sorted(matched(spark, left, right)) == [("e", "d", 0, 1), ("e", "d", 2, 2)]
    assert matched(spark, [], right) == [] and matched(spark, left, []) == []


def test_delay_is_found_where_it_is_not_given(spark):
    rng = random.Random(2)
    t, beats = 0.5, []
    for _ in range(120):
        beats.append(t)
        t += 0.8 + rng.gauss(0, 0.03)
    right = [("e", i, round(v, 3), None, "") for i, v in enumerate(beats)]
    for lag in (0.02, 0.23, 0.55):
        left = [("e", "d", i, round(v + lag + rng.gauss(0, 0.008), 6), None, None, "") for i, v in enumerate(beats)]
        assert {(r, i) for _, _, r, i in matched(spark, left, right)} == {(i, i) for i in range(120)}


def test_nearest_pairs(spark):
    left = spark.createDataFrame([("e", "d", 1, 1.0, 0.0, None, ""), ("e", "d", 1, 1.0, 0.0, None, ""), ("e", "d", 2, 3.0, 0.0, None, ""), ("e", "d", 3, None, 0.0, None, "")], L)
    right = spark.createDataFrame([("e", 9, 1.1, None, ""), ("e", 8, 0.9, None, ""), ("e", 7, 3.2, None, ""), ("f", 6, 3.0, None, "")], R)
    got = [tuple(r) for r in nearest.nearest_pairs(left, right, ["e"], ["run", "lid"], "rid", "t", "t", 0.15).collect()]
    assert got == [("e", "d", 1, 8, 0.1)]


def test_dense_run_across_blocks(spark):
    """Beats closer than the tolerance over several blocks: one chain of overlapping pairs without a pause."""
    rng = random.Random(5)
    left = [("e", "d", i, round(0.09 * i + rng.uniform(0, 0.05), 3), 0.0, None, "") for i in range(330)]
    right = [("e", i, round(0.1 * i + rng.uniform(0, 0.05), 3), None, "") for i in range(300)]
    got = matched(spark, left, right)
    assert len(got) == len(set(got)) and set(got) == brute(left, right, 0.15)


def test_a_chain_of_refusals(spark):
    """Each right record lets go of the one it holds for a nearer one, all along the chain."""
    left = [("e", "d", i, round(0.2 * i + 0.001 * i, 4), 0.0, None, "") for i in range(12)] + [("e", "d", 99, 0.001, 0.0, None, "")]
    right = [("e", i, round(0.2 * i + 0.11 - 0.005 * i, 4), None, "") for i in range(12)]
    got = matched(spark, left, right)
    assert set(got) == brute(left, right, 0.15) and len(got) == len(set(got))


def test_hot_run_and_null_run(spark):
    rng = random.Random(6)
    left = [("hot", None, i, round(0.8 * i + rng.gauss(0, 0.05), 4), 0.0, None, "") for i in range(2000)]
    left += [("hot", None, 5000 + i, round(0.8 * i + rng.gauss(0, 0.05), 4), 0.0, None, "") for i in range(0, 2000, 7)]
    left += [(f"e{k}", "d", i, round(0.8 * i + 0.02, 4), None, None, "") for k in range(5) for i in range(40)]
    right = [("hot", i, round(0.8 * i, 4), None, "") for i in range(2000)] + [(f"e{k}", i, round(0.8 * i, 4), None, "") for k in range(5) for i in range(40)]
    got = matched(spark, left, right)
    hot = {g for g in got if g[0] == "hot"}
    assert hot == {g for g in brute([x for x in left if x[0] == "hot"], right, 0.15)}
    assert {g for g in got if g[0] != "hot"} == {(f"e{k}", "d", i, i) for k in range(5) for i in range(40)}


@pytest.mark.parametrize("tick", [0.002, 0.15, 0.3, 7.0])
def test_nearest_is_the_same_for_every_tick(spark, tick):
    rng = random.Random(7)
    left = [("e", "d", i, round(rng.uniform(-5, 5), 4), 0.0, None, "") for i in range(300)] + [("e", "d", 900, 1e13, 0.0, None, ""), ("e", "d", 901, -0.3, 0.0, None, ""), ("e", "d", 902, 8.9e12, 0.0, None, "")]
    right = [("e", i, round(rng.uniform(-5, 5), 3), None, "") for i in range(60)] + [("e", 70, 1.0, None, ""), ("e", 69, 1.0, None, ""), ("e", 71, 1e13, None, ""), ("e", 72, 8.9e12, None, "")]
    got = {r["lid"]: (r["rid"], r["distance"]) for r in nearest.nearest_pairs(spark.createDataFrame(left, L), spark.createDataFrame(right, R), ["e"], ["run", "lid"], "rid", "t", "t", 0.15, tick).collect()}
    want = {}
    for _, _, i, t, *_ in left:
        d, r = min((abs(round(t * 1e6) - round(u * 1e6)), r) for _, r, u, *_ in right if abs(u) < 9e12)
        if d <= 150_000 and abs(t) < 9e12:
            want[i] = (r, d / 1e6)
    assert got == want and got[902] == (72, 0.0)


def test_only_the_nearest_of_a_tick_is_kept(spark):
    """Of right records from before and after a tick one each is kept, and of those inside one for each time."""
    rows = [("e", i, t) for i, t in enumerate([10, 20, 30, 110, 110, 150, 210, 220, 290])]
    ticks = nearest.nearest_ticks(spark.createDataFrame(rows, "e string, __rid long, __r long"), ["e"], 100, 100).collect()
    assert sorted((r["__rid"], r["__r"]) for r in ticks if r[nearest.TICK] == 1) == [(2, 30), (3, 110), (5, 150), (6, 210)]


def test_runs_without_a_delay_are_like_the_one_that_states_it(spark, tmp_path):
    from beatloom.llm.queries import p1_nearest_every_run

    t = [0.85 * i + 0.05 * (i % 7) for i in range(60)]
    spark.createDataFrame([("r", "s", i, v) for i, v in enumerate(t)], "record string, session_id string, ref_idx long, t double").write.parquet(f"{tmp_path}/ref_beats.parquet")
    lags = {"stated": 0.25, "null": None, "nan": float("nan")}
    rows = [("r", "s", d, i, v + 0.25, lag) for d, lag in lags.items() for i, v in enumerate(t)]
    spark.createDataFrame(rows, "record string, session_id string, detector string, test_idx long, t double, lag_s double").write.parquet(f"{tmp_path}/det_beats.parquet")
    n = {r["detector"]: r["count"] for r in p1_nearest_every_run(spark, str(tmp_path)).groupBy("detector").count().collect()}
    assert n == dict.fromkeys(lags, 60)
