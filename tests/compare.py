"""Rows of a query in Spark and of its SQL in DuckDB, in one comparable form."""

from pathlib import Path

import duckdb


def canon(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return str([canon(x) for x in v])
    return str(v)


def duck(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(canon(v) for v in r) for r in df.select(*cols).collect())


def rows_of_sql(con, sql):
    con.execute(sql)
    head = [d[0] for d in con.description]
    order = sorted(range(len(head)), key=head.__getitem__)
    return sorted(head), sorted(tuple(canon(r[i]) for i in order) for r in con.fetchall())
