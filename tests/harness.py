"""Rows of a DataFrame and of DuckDB over the same tables, in a form that can be compared."""

from __future__ import annotations

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if v is None or v != v:
        return "null"
    return repr(round(v, 7)) if isinstance(v, float) else str(v).lower() if isinstance(v, bool) else str(v)


def rows(columns, values) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in values)


def of_spark(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), rows(df.columns, [tuple(r) for r in df.collect()])


def of_duckdb(sql: str, tables: dict) -> tuple[list[str], list[tuple]]:
    """sql over tables: paths of Parquet files, or DataFrames."""
    import duckdb

    con = duckdb.connect()
    for name, t in tables.items():
        if isinstance(t, str):
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{t}'")
        else:
            con.register(name, t.toArrow())
    out = con.sql(sql)
    return sorted(out.columns), rows(out.columns, out.fetchall())
