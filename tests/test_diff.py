import math

import pytest

from beatloom.operators.diff import Field, latest, table_diff, tree_depth

SCHEMA = "k string, j long, x double, n long, extra string"
FIELDS = [Field("x", 1e-6), Field("n")]


def cases(spark, a, b):
    da, db = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    return {tuple(r) for r in table_diff(da, db, ["k", "j"], FIELDS).collect()}


def test_kinds(spark):
    a = [("a", 1, 1.0, 5, "u"), ("b", 1, 1.0, 5, "u"), ("c", None, 1.0, 5, "u"), (None, 3, 2.0, None, "u"), ("d", 1, math.nan, 5, "u"), ("e", 1, math.nan, 5, "u")]
    b = [("a", 1, 1.0 + 5e-7, 5, "v"), ("b", 1, 1.1, 6, "v"), ("c", None, 1.0, 5, "v"), (None, 3, 2.0, 1, "v"), ("f", 1, 0.0, 0, "v"), ("d", 1, None, 5, "v"), ("e", 1, 3.0, 5, "v")]
    assert cases(spark, a, b) == {("b", 1, "differs", "x"), ("b", 1, "differs", "n"), (None, 3, "differs", "n"), ("f", 1, "only_b", ""), ("e", 1, "differs", "x")}


def test_noise_over_a_cell_boundary_is_no_difference(spark):
    a, b = [("a", 1, 0.99999999e-6, 1, "")], [("a", 1, 1.00000001e-6, 1, "")]
    assert cases(spark, a, b) == set()
    assert cases(spark, [("a", 1, 1.0, 1, "")], [("a", 1, 1.0 + 2e-6, 1, "")]) == {("a", 1, "differs", "x")}


@pytest.mark.parametrize("x, y, apart", [(1e14, 2e14, True), (1e300, -1e300, True), (9e15, 9e15 + 2, True), (math.inf, math.inf, False), (math.inf, -math.inf, True), (math.inf, 1e18, True), (1e14, 1e14, False), (2.0**53 * 1e-6, 2.0**53 * 1e-6 + 1e-5, True)])
def test_values_of_any_size(spark, x, y, apart):
    assert cases(spark, [("a", 1, x, 1, "")], [("a", 1, y, 1, "")]) == ({("a", 1, "differs", "x")} if apart else set())


def test_whole_numbers_of_any_size(spark):
    fields = [Field("n", 1e-6)]
    run = lambda m, n: table_diff(*[spark.createDataFrame([("a", 1, 0.0, v, "")], SCHEMA) for v in (m, n)], ["k", "j"], fields).count()
    assert [run(2**63 - 1, -(2**63)), run(2**53 + 1, 2**53), run(2**62, 2**62)] == [1, 1, 0]


def test_nulls_in_other_columns_are_another_row(spark):
    assert cases(spark, [("a", 1, None, 5, "")], [("a", 1, 5.0, None, "")]) == {("a", 1, "differs", "x"), ("a", 1, "differs", "n")}
    one, other = [(None, 7, 1.0, 1, "")], [("7", None, 1.0, 1, "")]
    assert cases(spark, one, other) == {(None, 7, "only_a", ""), ("7", None, "only_b", "")}


def test_depth_follows_rows():
    assert [tree_depth(n, 5) for n in (0, 64, 65, 64 * 32, 64 * 33, 10**11)] == [1, 1, 1, 1, 2, 7]
    for n in (10**6, 10**9, 10**12):
        assert n / 32 ** tree_depth(n, 5) <= 64 < n / 32 ** (tree_depth(n, 5) - 1)


def test_empty(spark):
    one = [("a", 1, 1.0, 1, "")]
    assert cases(spark, [], []) == set()
    assert cases(spark, one, []) == {("a", 1, "only_a", "")}


def test_many_rows_against_brute_force(spark):
    a = [(f"k{i}", i % 7, float(i), i, "") for i in range(3000)]
    b = [(f"k{i}", i % 7, float(i) + (0.5 if i % 97 == 0 else 0.0), i + (i % 101 == 0), "") for i in range(3000) if i % 103]
    want = {(f"k{i}", i % 7, "only_a", "") for i in range(3000) if i % 103 == 0}
    want |= {(f"k{i}", i % 7, "differs", "x") for i in range(3000) if i % 103 and i % 97 == 0}
    want |= {(f"k{i}", i % 7, "differs", "n") for i in range(3000) if i % 103 and i % 101 == 0}
    assert cases(spark, a, b) == want


def test_latest(spark):
    rows = [("a", 1, 1.0, 1, None), ("a", 1, 2.0, 2, "2024"), ("a", 1, 2.0, 2, "2024"), ("a", 1, 3.0, 3, "2023")]
    got = latest(spark.createDataFrame(rows, SCHEMA), ["k", "j"], "extra", ["x", "n"]).collect()
    assert [tuple(r) for r in got] == [("a", 1, 2.0, 2)]
