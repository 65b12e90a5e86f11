"""Breadth-first expansion over an edge table by repeated joins.

Edges are written once, dealt by (source, salt): a source with more than
``HUB`` edges has them spread over as many salts, so a hub's edges never meet
in one task. A frontier node asks for all salts of its hub (one small row
each); hubs are a table of their own, at most edges / ``HUB`` rows.

Each hop joins the frontier with the edges and anti-joins the visited set, so
only new nodes move on. Every new frontier is written to the shared checkpoint
folder (``spark.checkpoint.dir``): the lineage never grows with the hop count, a
lost executor repeats one hop at most, and the empty test that ends the
search reads the written frontier.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import materialise

HUB = 10_000      # edges of one source in a salt, about


def salted(edges: DataFrame, hub: int = HUB) -> tuple[DataFrame, DataFrame]:
    """(src, salt, dst) written, and (node, salts) of the sources with more than ``hub`` edges."""
    edges = materialise(edges.select("src", "dst").filter(F.col("src").isNotNull() & F.col("dst").isNotNull()))
    hubs = materialise(edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hub)
                       .select(F.col("src").alias("node"), F.ceil(F.col("n") / hub).cast("int").alias("salts")))
    spread = edges.join(hubs.withColumnRenamed("node", "src"), "src", "left")
    salt = F.coalesce(F.pmod(F.xxhash64("dst"), F.col("salts")), F.lit(0)).cast("int")
    return materialise(spread.select("src", salt.alias("salt"), "dst")), hubs


def _first(nodes: DataFrame, n: int | None) -> DataFrame:
    """The n smallest nodes; None: all."""
    return nodes if n is None else nodes.orderBy("node").limit(n)


def bfs(seeds: DataFrame, edges: DataFrame, max_hops: int | None = None, max_total: int | None = None,
        hub: int = HUB) -> DataFrame:
    """seeds: (node); edges: (src, dst), directed (add both directions for an
    undirected graph). Returns (node, hop) with the smallest hop per node. Runs
    until a hop finds nothing new, for ``max_hops`` hops, or until ``max_total`` nodes,
    seeds included, are found: nearer nodes first, within a hop by name."""
    edges, hubs = salted(edges, hub)
    frontier = materialise(_first(seeds.select("node").filter(F.col("node").isNotNull()).distinct(), max_total))
    parts, visited, hop = [frontier.withColumn("hop", F.lit(0))], frontier, 0
    room = None if max_total is None else max_total - frontier.count()
    while (max_hops is None or hop < max_hops) and room != 0:
        hop += 1
        asked = (frontier.join(hubs, "node", "left").select(
            F.col("node").alias("src"), F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt")))
        found = (asked.join(edges, ["src", "salt"]).select(F.col("dst").alias("node")).distinct()
                 .join(visited, "node", "left_anti"))
        frontier = materialise(_first(found, room))
        if frontier.isEmpty():
            break
        parts.append(frontier.withColumn("hop", F.lit(hop)))
        visited = visited.unionByName(frontier)
        room = None if room is None else room - frontier.count()
    return reduce(DataFrame.unionByName, parts)
