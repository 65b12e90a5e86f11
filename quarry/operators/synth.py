"""Deterministic synthetic data as Spark expressions.

Random numbers come from md5 of (stream, seed, key), never ``rand()``: the
same (seed, key) gives the same value under any partitioning, retry or
executor loss, and DuckDB can compute the identical stream.
Distributions that need a table (Zipf, weighted categories) use cumulative
weights built from parameters (k, a) -- not from data -- as an array literal
searched by a higher-order function, so sampling is a projection: no join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.scalar import HASH_RANGE, hash_int, hash_uniform
from quarry.operators.windows import number_rows

TWO_PI = 2.0 * math.pi


def uniform(stream: str, seed: int, key: Column) -> Column:
    return hash_uniform(stream, seed, key)


def open_uniform(stream: str, seed: int, key: Column) -> Column:
    """Uniform in (0, 1): safe for log()."""
    return (hash_int(stream, seed, key) + F.lit(0.5)) / F.lit(HASH_RANGE)


def normal(stream: str, seed: int, key: Column) -> Column:
    """Standard normal by Box-Muller on two independent streams."""
    u1 = open_uniform(stream + ".1", seed, key)
    u2 = uniform(stream + ".2", seed, key)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(TWO_PI) * u2)


def lognormal_money(stream: str, seed: int, key: Column, mu: float, sigma: float,
                    precision: int = 14, scale: int = 2) -> Column:
    """exp(mu + sigma z), clipped to what numeric(precision, scale) holds, rounded."""
    cap = 10.0 ** (precision - scale) - 10.0 ** (-scale)
    return F.round(F.least(F.exp(F.lit(mu) + F.lit(sigma) * normal(stream, seed, key)), F.lit(cap)), scale)


def cumulative(weights: list[float]) -> list[float]:
    total = sum(weights)
    out, acc = [], 0.0
    for w in weights:
        acc += w
        out.append(acc / total)
    out[-1] = 1.0
    return out


def zipf_weights(k: int, a: float) -> list[float]:
    return [1.0 / (r ** a) for r in range(1, k + 1)]


def pick_index(u: Column, cdf: list[float]) -> Column:
    """1-based index i with cdf[i-1] <= u < cdf[i] (inverse CDF), i.e. 1 +
    the number of thresholds <= u. A balanced binary search written as
    nested CASE WHEN: ~log2(k) compiled comparisons per row, inside
    whole-stage codegen (a lambda over the threshold array is interpreted).
    A NULL draw picks index 1."""
    thr = cdf[:-1]

    def count_le(lo: int, hi: int) -> Column:      # thresholds below lo are <= u, from hi on > u
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(u < F.lit(thr[mid]), count_le(lo, mid)).otherwise(count_le(mid + 1, hi))

    return F.when(u.isNull(), F.lit(1)).otherwise(count_le(0, len(thr)) + 1)


def zipf_rank(u: Column, k: int, a: float) -> Column:
    """Bounded Zipf over ranks 1..k with weights rank^-a."""
    return pick_index(u, cumulative(zipf_weights(k, a)))


def weighted_choice(u: Column, values: list[str], weights: list[float]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), pick_index(u, cumulative(weights)))


def bernoulli(stream: str, seed: int, key: Column, p: float) -> Column:
    return uniform(stream, seed, key) < F.lit(p)


def seeded_uuid(stream: str, seed: int, key: Column) -> Column:
    h = F.md5(F.concat(F.lit(f"{stream}|{seed}|"), key.cast("string")))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def dense_index(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Add ``_idx`` (0..size-1, dense within ``group`` in ``order``, which must be
    total) and ``_cnt`` (group size); a written table.

    All rows are numbered once over ranges of (group, order); a group's first
    number and its size come from one aggregate, so a hot group is ranked by
    as many tasks as its rows fill and the index is built once for all readers.
    """
    numbered = number_rows(df, [F.asc_nulls_last(c) for c in group + order], "_n")
    if not group:
        return numbered.withColumn("_cnt", numbered.agg(F.count(F.lit(1))).scalar()) \
            .withColumn("_idx", F.col("_n") - 1).drop("_n")
    sizes = numbered.groupBy(*group).agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("_cnt"))
    return (numbered.join(sizes, [numbered[g].eqNullSafe(sizes[g]) for g in group]).drop(*[sizes[g] for g in group])
            .withColumn("_idx", F.col("_n") - F.col("_first")).drop("_n", "_first"))
