"""Collect a keyed table to the driver in bounded pieces.

Scorers that broadcast the query side (TF-IDF query matrix, kNN query
vectors) need it on the driver, but only up to a size bound. Beyond the
bound the table is split by a hash of its key (all rows of a key stay in one
piece) into pieces that each fit, each piece is scored on its own and the
results are unioned: per-query top-k does not depend on other queries, so
the union is exact. A piece holding a single key is never split further.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import materialise


def collect_in_batches(df: DataFrame, key: str, cost: Column, budget: int,
                       fits: Callable[[pd.DataFrame], bool] | None = None, seed: int = 0) -> list[pd.DataFrame]:
    """Pieces of ``df`` whose summed ``cost`` is within ``budget`` (and that
    pass ``fits``), split by ``xxhash64(key, seed)``. The size is measured by
    an aggregate before anything is collected."""
    total, n_keys = df.agg(F.coalesce(F.sum(cost), F.lit(0)), F.count_distinct(key)).first()
    if total <= budget or n_keys <= 1:
        pdf = df.toPandas()
        if n_keys <= 1 or fits is None or fits(pdf):
            return [pdf]
    if seed == 0:
        df = materialise(df)          # every piece filters the written rows, not the upstream plan
    n = int(min(n_keys, max(2, math.ceil(2 * total / max(1, budget)))))
    piece = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(n))
    out: list[pd.DataFrame] = []
    for i in range(n):
        out += collect_in_batches(df.filter(piece == i), key, cost, budget, fits, seed + 1)
    return [p for p in out if len(p)]
