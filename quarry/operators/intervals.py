"""Interval overlap within a key (validity ranges, order windows).

Both operators avoid the self-join that enumerates every pair of a key:
a hot key would make that quadratic and put it in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.scalar import epoch_micros
from quarry.operators.windows import previous_max


def count_overlapping_pairs(df: DataFrame, key: str, start: str, tie: str, length_us: int) -> DataFrame:
    """Per key, the number of unordered pairs whose ``[start, start+length)``
    windows overlap (equal lengths: ``|s_a - s_b| < length``).

    Sorted by (start, tie), a row's later partners number
    ``count(start < s + length) - position``: a RANGE-frame count and a row
    number, so pairs are counted, never listed. It runs per (key, bucket)
    with ``bucket = floor(start / length)``: a window reaches at most the next
    bucket, so each bucket also sees a shadow copy of the next one, and a hot
    key is spread over its buckets.
    """
    s = (df.filter(F.col(key).isNotNull() & F.col(start).isNotNull())   # NULL never equals / overlaps
         .select(F.col(key).alias("_k"), epoch_micros(start).alias("_s"), F.col(tie).alias("_t")))
    bucket = F.floor(F.col("_s") / F.lit(length_us))
    places = F.explode(F.array(F.struct(bucket.alias("_b"), F.lit(True).alias("_own")),
                               F.struct((bucket - 1).alias("_b"), F.lit(False).alias("_own"))))
    both = s.select("_k", "_s", "_t", places.alias("_p")).select("_k", "_s", "_t", "_p._b", "_p._own")
    part = Window.partitionBy("_k", "_b")
    reach = part.orderBy("_s").rangeBetween(Window.unboundedPreceding, length_us - 1)
    pos = part.orderBy("_s", F.col("_own").desc(), "_t")
    return (both.withColumn("_reach", F.count(F.lit(1)).over(reach)).withColumn("_pos", F.row_number().over(pos))
            .filter("_own").groupBy("_k").agg(F.sum(F.col("_reach") - F.col("_pos")).alias("n_pairs"))
            .filter("n_pairs > 0").withColumnRenamed("_k", key))


def overlapping_rows(df: DataFrame, key: list[str], start: str, end: str, tie: str) -> DataFrame:
    """Rows whose ``[start, end)`` overlaps some earlier row of the same key.

    Sorted by (start, tie), a row overlaps an earlier one iff its start is
    below the largest end seen before it (NULL end = open-ended, i.e. +inf).
    The running maximum runs over ranges (see ``previous_max``).
    """
    far = F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")
    # A row without a start or without a key has no validity range to conflict.
    df = df.filter(F.col(start).isNotNull())
    for k in key:
        df = df.filter(F.col(k).isNotNull())
    flagged = previous_max(df, key, [start, tie], F.coalesce(F.col(end), far), "_prev_end")
    return flagged.filter(F.col(start) < F.col("_prev_end")).drop("_prev_end")
