"""Comparison of a Spark result with DuckDB's, the way the queries are checked."""

import duckdb

TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}


def connect(folder, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def cell(v):
    if v is None:
        return "\0"
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


def check(df, con, sql):
    names = sorted(df.columns)
    rel = con.sql(sql)
    assert sorted(rel.columns) == names
    types = dict(zip(rel.columns, map(str, rel.types)))
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        assert types[f.name] == TYPES.get(kind, kind), f.name
    mine = sorted(tuple(map(cell, r)) for r in df.select(*names).collect())
    theirs = sorted(
        tuple(map(cell, r)) for r in rel.select(*[duckdb.ColumnExpression(n) for n in names]).fetchall()
    )
    assert len(mine) == len(theirs)
    assert mine == theirs
