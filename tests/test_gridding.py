import math

from beatloom.operators import gridding
from beatloom.operators.gridding import regular_grid

SCHEMA = "s string, t double, v double, cell string, status long"


def grid(spark, rows, limit=20.0):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return {(r.s, r.cell): (r.n_readings, None if r.grid_value is None else round(r.grid_value, 6), r.status) for r in regular_grid(df, ["s"], "t", "v", 5.0, limit).collect()}


def test_filled_and_gap(spark):
    got = grid(spark, [("a", 1.0, 1.0), ("a", 2.0, 3.0), ("a", 2.0, 3.0), ("a", 21.0, 7.0), ("a", 60.0, 8.0), ("a", None, 1.0), ("a", 3.0, None), ("a", math.nan, 1.0), ("a", 4.0, math.nan)])
    assert got[("a", 0)] == (2, 2.0, "read")
    assert got[("a", 1)] == (0, round(3 + 4 * 5.5 / 19, 6), "filled")
    assert got[("a", 4)] == (1, 7.0, "read")
    assert got[("a", 5)] == (0, None, "gap")
    assert set(c for _, c in got) == set(range(13))


def test_empty_single_and_negative(spark):
    assert grid(spark, []) == {}
    assert grid(spark, [("a", 7.0, 1.0)]) == {("a", 1): (1, 1.0, "read")}
    assert set(grid(spark, [(None, -7.0, 1.0), (None, 3.0, 2.0)])) == {(None, -2), (None, -1), (None, 0)}


def test_long_stretch_comes_in_blocks(spark):
    n = 3 * gridding.BLOCK + 5
    got = grid(spark, [("a", 0.0, 1.0), ("a", 5.0 * (n + 1), 1.0)])
    assert len(got) == n + 2
