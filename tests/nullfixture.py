"""Build a NULL-bearing copy of a fixture scale (tests only).

The given tables hold no NULL anywhere; SQL semantics differ most exactly
there (NULL keys in joins and groups, NULL sort keys, empty aggregates), so
every registered query is also checked against its oracle on this copy.
"""

from __future__ import annotations

import os

import duckdb

# (table, column) pairs nulled on ~8 % of rows, chosen by a hash of the row.
NULLED = {
    "customer": ["c_nationkey", "c_mktsegment", "c_acctbal", "c_name"],
    "supplier": ["s_nationkey", "s_acctbal"],
    "part": ["p_type", "p_brand", "p_name"],
    "orders": ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_returnflag", "l_shipdate", "l_quantity", "l_discount", "l_suppkey"],
    "events": ["user_id", "event_type", "value", "props", "ts"],
    "conversations": ["role"],
    "labels": ["quality", "toxic"],
    "documents": ["n_chars"],
    "pages": ["url"],
}


def build(src: str, dst: str) -> str:
    os.makedirs(dst, exist_ok=True)
    con = duckdb.connect()
    for f in sorted(os.listdir(src)):
        if not f.endswith(".parquet"):
            continue
        t = f[:-8]
        cols = [r[0] for r in con.execute(f"DESCRIBE SELECT * FROM read_parquet('{src}/{f}')").fetchall()]
        sel = []
        for i, c in enumerate(cols):
            if c in NULLED.get(t, []):
                sel.append(f"CASE WHEN hash(rowid_ * 31 + {i}) % 100 < 8 THEN NULL ELSE {c} END AS {c}")
            else:
                sel.append(c)
        con.execute(f"""COPY (SELECT {', '.join(sel)} FROM (SELECT *, row_number() OVER () AS rowid_
                        FROM read_parquet('{src}/{f}'))) TO '{dst}/{f}' (FORMAT PARQUET)""")
    return dst
