"""Runs a registered query and its SQL on the same files and compares all values."""

from __future__ import annotations

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float) and v == 0:
        return 0.0
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, fn, text, sf_dir):
    """None when equal, else a short description of the difference."""
    df = fn(spark, sf_dir)
    names, mine = _rows(df.columns, [tuple(x) for x in df.collect()])
    res = con.execute(text)
    other, theirs = _rows([d[0] for d in res.description], res.fetchall())
    if names != other:
        return f"columns {names} against {other}"
    if not mine:
        return "no rows"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows against {len(theirs)}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return f"{len(bad)} of {len(mine)} rows differ, first {bad[0]} on {names}" if bad else None
