import pytest
from compare import duck, rows_of, rows_of_sql

from beatloom.llm import queries

COLUMNS = {
    "p1_found": ["record", "session_id", "detector", "ref_idx", "test_idx"],
    "p7_found": ["doc_id", "item_id"],
    "p8_found": ["doc_id", "lang"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, folder, name):
    df = queries.QUERIES[name](spark, folder)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    if name in queries.ORACLES:
        assert rows_of(df) == rows_of_sql(duck(folder), queries.ORACLES[name])
    else:
        rows = df.collect()
        assert rows and len({tuple(map(str, r)) for r in rows}) == len(rows)
