"""Comparison of a query's rows with DuckDB's."""

import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(folder):
        path = f"{folder}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def normal(columns: list[str], found) -> list[tuple]:
    """Rows as sorted tuples of text, columns by name."""
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def text(v) -> str:
        return "null" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)

    return sorted(tuple(text(r[i]) for i in order) for r in found)


def check(df, con, sql: str) -> None:
    """Assert that a Spark frame has the columns and rows of a DuckDB query."""
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert normal(df.columns, df.collect()) == normal(columns, cursor.fetchall())
