"""Runs a registered query and its SQL twin and compares them as the driver does."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def plain(v):
    import datetime
    import decimal

    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return None if v != v else round(float(v), 4)
    if isinstance(v, int):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def difference(spark, con, query, sql, sf_dir):
    """None if both agree, else a short account."""
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    cols = [x[0] for x in cur.description]
    want = rows(cols, cur.fetchall())
    if not got:
        return "no rows"
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} and {sorted(cols)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(bad)} of {len(got)} rows differ, first {bad[0]}" if bad else None
