"""Comparison of a Spark result with DuckDB's answer to its SQL."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows, columns, order):
    at = [columns.index(c) for c in order]

    def value(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        if isinstance(v, float):
            return f"{v:.9g}"
        return str(v)

    return sorted(tuple(value(r[i]) for i in at) for r in rows)


def answers(sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    out = con.execute(sql)
    return [d[0] for d in out.description], out.fetchall()


def assert_same(df, sql, sf):
    columns, rows = answers(sql, sf)
    assert sorted(df.columns) == sorted(columns)
    got = canonical([tuple(r) for r in df.collect()], df.columns, sorted(columns))
    assert got == canonical(rows, columns, sorted(columns))
