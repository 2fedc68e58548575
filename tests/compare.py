"""Run a registered query and its oracle side by side and compare whole results."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal

import duckdb

VIEWS = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
FAMILY = {
    "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in VIEWS:
        con.execute(f"CREATE VIEW {name} AS FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}") + 0.0
    return value


def _rows(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Empty when names, types and all rows agree."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    found = []
    types = {n: str(t) for n, t in zip(names, [d[1] for d in cursor.description])}
    mine = {f.name: FAMILY.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema.fields}
    if set(mine) != set(names):
        return [f"columns {sorted(set(mine) ^ set(names))}"]
    for n in names:
        if types[n] not in (mine[n], "NULL"):
            found.append(f"type of {n}: {mine[n]} / {types[n]}")
    theirs = _rows(names, cursor.fetchall())
    ours = _rows(df.columns, [tuple(r) for r in df.collect()])
    if ours != theirs:
        extra, missing = ours - theirs, theirs - ours
        found.append(
            f"rows {sum(ours.values())} / {sum(theirs.values())}; ours only {sum(extra.values())}: {list(extra)[:2]}; "
            f"theirs only: {list(missing)[:2]}; columns {sorted(names)}"
        )
    return found
