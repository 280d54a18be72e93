"""Compare a Spark result with DuckDB's on the same tables."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {file.stem} as select * from '{file}'")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    return value


# DuckDB type of each Spark type that the queries return.
TYPES = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
}


def spark_rows(df) -> tuple[dict[str, str], Counter]:
    names = sorted(df.columns)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    types = {n: TYPES.get(kinds[n], kinds[n].upper()) for n in names}
    return types, Counter(tuple(_plain(r[n]) for n in names) for r in df.collect())


def duck_rows(con, sql: str) -> tuple[dict[str, str], Counter]:
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    rows = Counter(tuple(_plain(r[i]) for i in order) for r in cur.fetchall())
    return {cols[i]: kinds[cols[i]] for i in order}, rows


def difference(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    types, got = spark_rows(df)
    want_types, want = duck_rows(con, sql)
    if list(types) != list(want_types):
        return f"columns {list(types)} != {list(want_types)}"
    if types != want_types:
        return f"types {types} != {want_types}"
    if got != want:
        extra, missing = list((got - want).items())[:3], list((want - got).items())[:3]
        return f"{sum(got.values())} rows against {sum(want.values())}; extra {extra}; missing {missing}"
    return None
