"""Compare a Spark result with DuckDB, value by value and independent of row order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{folder}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def differences(spark_df, con, sql: str) -> list[str]:
    """Empty when both sides agree."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    wanted, kinds = result.fetchall(), [str(d[1]) for d in result.description]
    got = spark_df.collect()
    found = []
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} against {sorted(names)}"]
    spark_kinds = dict(spark_df.dtypes)
    family = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}
    for name, kind in zip(names, kinds):
        if family.get(spark_kinds[name], spark_kinds[name]) not in (kind, {"NUMBER": "BIGINT", "STRING": "VARCHAR"}.get(kind)):
            found.append(f"type of {name}: {spark_kinds[name]} against {kind}")
    if len(got) != len(wanted):
        found.append(f"{len(got)} rows against {len(wanted)}")
    a, b = _rows(spark_df.columns, got), _rows(names, wanted)
    off = [(x, y) for x, y in zip(a, b) if x != y]
    if off:
        found.append(f"{len(off)} rows differ, first {off[0][0]} against {off[0][1]}")
    return found
