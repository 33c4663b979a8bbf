"""Holds a Spark result against DuckDB's for the same tables."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _value(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return list(map(_value, x)) if isinstance(x, (list, tuple)) else x


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, round(x, 5) if isinstance(x, float) else x if not isinstance(x, list) else str(x)) for x in r))


def _same(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return type(a) is type(b) and a == b


def differences(df, sql: str, con) -> list[str]:
    """What differs, a few lines at most; empty if nothing does."""
    got = con.execute(sql)
    names, kinds = [d[0] for d in got.description], [str(d[1]) for d in got.description]
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    other = dict(zip(names, kinds))
    wrong = [f"type of {n}: {k} and {other[n]}" for n, k in df.dtypes if KINDS.get(k, other[n]) != other[n]]
    mine, theirs = _rows(df.collect(), df.columns), _rows(got.fetchall(), names)
    if len(mine) != len(theirs):
        return [*wrong, f"{len(mine)} rows and {len(theirs)}"]
    bad = [(a, b) for a, b in zip(mine, theirs) if not all(map(_same, a, b))]
    return [*wrong, *[f"{a} and {b}" for a, b in bad[:3]], *([f"{len(bad)} rows differ"] if bad else [])]
