"""Runs a query and its SQL side by side."""

from __future__ import annotations

from pathlib import Path

import duckdb


def _plain(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return f"{v:.6f}"
    return str(v)


def rows(records, columns) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(_plain(r[k]) for k in order) for r in records)


def same(spark, query, sql: str, folder: str) -> None:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got = query(spark, folder)
    cur = con.execute(sql)
    want_columns = [c[0] for c in cur.description]
    assert sorted(got.columns) == sorted(want_columns)
    want = cur.fetchall()
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want, want_columns)
