"""Run a registered query and its SQL on the same tables and compare the rows."""

import datetime
import math
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "NULL" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, datetime.datetime):
        return v.strftime("%Y-%m-%d %H:%M:%S.%f")
    return "NULL" if v is None else str(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


_SAME = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP",
}


def difference(spark, con, query, sql, sf_dir):
    """None when equal, else a short description."""
    df = query(spark, sf_dir)
    got_rows = [tuple(r) for r in df.collect()]
    res = con.execute(sql)
    columns = [d[0] for d in res.description]
    want_rows = res.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}"
    kinds = {d[0]: str(d[1]) for d in res.description}
    odd = [
        (c, k, kinds[c]) for c, k in df.dtypes if _SAME.get(k, kinds[c]) != kinds[c]
    ]
    got, want = canonical(df.columns, got_rows), canonical(columns, want_rows)
    if got != want:
        left = [g for g in got if g not in set(want)][:3]
        right = [w for w in want if w not in set(got)][:3]
        return f"rows {len(got)} vs {len(want)}; only spark {left}; only sql {right}"
    if odd:
        return f"types {odd}"
    return None
