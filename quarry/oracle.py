"""Run a registered query in Spark and its SQL oracle in DuckDB; compare.

The comparison mirrors the project's correctness gate: columns sorted by
name, rows compared as a multiset of exact values (floats included).
Used by the tests and by hand while developing.
"""

from __future__ import annotations

import math
from collections import Counter

from quarry.sources.tables import TABLE_NAMES


def duckdb_views(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return 0.0 if v == 0 else v
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            return _norm(v.item())
        except Exception:
            pass
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of_spark(df):
    cols = sorted(df.columns)
    out = [tuple(_norm(r[c]) for c in cols) for r in df.select(*cols).collect()]
    return cols, out


def rows_of_duckdb(con, sql):
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    data = rel.fetchall()
    return [names[i] for i in order], [tuple(_norm(r[i]) for i in order) for r in data]


def compare(spark, con, q, sf_dir):
    """Return (ok, message)."""
    df = q.build(spark, sf_dir)
    scols, srows = rows_of_spark(df)
    if q.oracle is None:
        return True, f"rows-only: {len(srows)}"
    dcols, drows = rows_of_duckdb(con, q.oracle)
    if scols != dcols:
        return False, f"columns differ: spark={scols} duckdb={dcols}"
    if len(srows) != len(drows):
        return False, f"row count spark={len(srows)} duckdb={len(drows)}"
    cs, cd = Counter(map(repr, srows)), Counter(map(repr, drows))
    if cs != cd:
        only_s = list((cs - cd).elements())[:3]
        only_d = list((cd - cs).elements())[:3]
        return False, f"values differ; spark-only {only_s} duckdb-only {only_d}"
    return True, f"{len(srows)} rows"
