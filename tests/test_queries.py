"""Every core query against its SQL on the smallest tables; those without SQL must run."""

import pytest
from compare import duck, rows_of, rows_of_sql
from pyspark.sql import functions as F

from beatloom.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracles()
#: Each query once, under the first of its names.
FIRST = {id(query): name for name, query in reversed(QUERIES.items())}.values()
#: Queries without SQL that may have no row on small tables.
MAYBE_NONE = {"st_band_join"}


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


@pytest.mark.parametrize("name", sorted(set(ORACLES) & set(FIRST)))
def test_same_as_sql(spark, folder, con, name):
    assert rows_of(QUERIES[name](spark, folder)) == rows_of_sql(con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(FIRST) - set(ORACLES)))
def test_gives_whole_rows(spark, folder, name):
    """Without SQL: there are rows, none of them twice, and no number is NaN or infinite."""
    df = QUERIES[name](spark, folder).cache()
    assert df.count() > 0 or name in MAYBE_NONE
    assert df.distinct().count() == df.count()
    for c, kind in df.dtypes:
        if kind == "double":
            assert df.where(F.isnan(c) | (F.abs(c) == float("inf"))).count() == 0
    df.unpersist()


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
