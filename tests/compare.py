"""Comparison of a Spark result with DuckDB: same columns, types of the same kind, same rows."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

_KINDS = {
    "BIGINT": "bigint", "HUGEINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "FLOAT": "float",
    "VARCHAR": "string", "BOOLEAN": "boolean",
}


def connect(path: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet'")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def _same(a: object, b: object) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b)) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1.5e-6)
    return a == b


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs, or None."""
    got = df.collect()
    result = con.execute(sql)
    types = {d[0]: _KINDS.get(str(d[1]), str(d[1]).lower()) for d in result.description}
    names = sorted(df.columns)
    if names != sorted(types):
        return f"columns {names} and {sorted(types)}"
    kinds = dict(df.dtypes)
    odd = {n: (kinds[n], types[n]) for n in names if kinds[n] != types[n]}
    place = [list(types).index(n) for n in names]
    ours = sorted((tuple(r[n] for n in names) for r in got), key=_key)
    theirs = sorted((tuple(r[i] for i in place) for r in result.fetchall()), key=_key)
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows"
    if odd:
        return f"types {odd}"
    exact = ours == theirs
    for a, b in zip(ours, theirs):
        if not all(_same(x, y) for x, y in zip(a, b)):
            return f"row {a} and {b}"
    return None if exact else "float noise"
