"""Comparison of a query with its SQL on DuckDB."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(None if r[i] is None else repr(float(r[i])) if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else str(r[i]) for i in order) for r in rows)


def agree(spark, query, sql: str, sf_dir: str) -> None:
    got = query(spark, sf_dir)
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    a, b = rows_of(got.columns, got.collect()), rows_of(names, want.fetchall())
    assert a == b, f"only here: {list((a - b).items())[:3]}; only in SQL: {list((b - a).items())[:3]}"
