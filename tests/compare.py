"""Compare a Spark result with DuckDB's answer to the oracle SQL."""

from __future__ import annotations

import math

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _key(value):
    if value is None:
        return (0, "")
    if isinstance(value, float):
        return (1, f"{value:.4f}")
    return (2, str(value))


def differences(found: DataFrame, con, sql: str, tolerance: float = 2e-6) -> list[str]:
    """Empty when both sides hold the same rows, order aside."""
    names = sorted(found.columns)
    cursor = con.execute(sql)
    sql_names = [d[0] for d in cursor.description]
    expected_rows = cursor.fetchall()
    if sorted(sql_names) != names:
        return [f"columns {names} != {sorted(sql_names)}"]
    order = [sql_names.index(n) for n in names]
    expected = [tuple(r[i] for i in order) for r in expected_rows]
    got = [tuple(r[n] for n in names) for r in found.collect()]
    if len(got) != len(expected):
        return [f"rows {len(got)} != {len(expected)}"]
    got.sort(key=lambda r: tuple(map(_key, r)))
    expected.sort(key=lambda r: tuple(map(_key, r)))
    out = []
    for g, e in zip(got, expected):
        for n, a, b in zip(names, g, e):
            if type(a) is not type(b):
                out.append(f"{n}: {a!r} ({type(a).__name__}) != {b!r} ({type(b).__name__})")
            elif isinstance(a, float):
                if not (a == b or (math.isnan(a) and math.isnan(b)) or abs(a - b) <= tolerance * max(1.0, abs(a))):
                    out.append(f"{n}: {a!r} != {b!r}")
            elif a != b:
                out.append(f"{n}: {a!r} != {b!r}")
    return out
