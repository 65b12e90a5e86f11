"""Connected components by alternating large-star and small-star steps.

Each step is one aggregation (combined before its shuffle) and one join on
the node; a node with very many links only makes that join skewed, which
adaptive execution splits. Edges are written after each round, so the
lineage stays short and a lost executor repeats one round at most.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import materialise


def _spanning(batches):
    """The edges of a partition reduced to a spanning forest (at most one a node)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 1 << 20:
            yield from _stars(parent, root)
            parent.clear()
    yield from _stars(parent, root)


def _stars(parent, root):
    pairs = [(x, root(x)) for x in list(parent)]
    pairs = [(u, v) for u, v in pairs if u != v]
    if pairs:
        u, v = zip(*pairs, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)))
                 .first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v: long, not null), the
    component being its smallest node. Direction, repetitions and loops do not matter."""
    e = materialise(edges.select("u", "v").filter("u != v").mapInArrow(_spanning, "u long, v long").distinct())
    before = _state(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        pairs = F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                                  F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        e = materialise(joined.select(pairs.alias("p")).select("p.*").filter("u != v").distinct())
        after = _state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
