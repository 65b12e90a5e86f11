"""Per-key running aggregates and row numbers that never send a hot key to one task.

A plain ``Window.partitionBy(key).orderBy(t)`` moves every row of a key into
one task. Here rows are range-partitioned on (key, order) instead and written
once with their range: a key of a third of the rows fills a third of the
ranges, NULL keys included. A window runs inside each (range, key), and what
earlier ranges hold of the same key is carried in: one row per range and key,
and only keys that reach over a range's end need it. One way for all keys;
the input is scanned once.

The written frame also makes row positions final: nothing below depends on
Spark computing a sort or a range exchange twice alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import materialise


def ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` range-partitioned on ``order`` with the range's number as ``_range``; written."""
    return materialise(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))


def _carried(rows: DataFrame, key: list[str], total: Column, merge) -> DataFrame:
    """Adds ``_carry``: ``merge`` of ``total`` over the key's earlier ranges (NULL if none)."""
    per = rows.groupBy(*key, "_range").agg(total.alias("_total"))
    # A key meets the ranges between its first and last one, so this window sees
    # one row per (key, range), at most keys + ranges in all.
    before = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = per.withColumn("_carry", merge(F.col("_total")).over(before)).filter("_carry IS NOT NULL")
    carry = carry.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)],
                         F.col("_range").alias("_r"), "_carry")
    # Only a range's first key can have been there before: one row per range at most.
    same = (F.col("_range") == F.col("_r"))
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(F.broadcast(carry), same, "left").drop("_r", *[f"_k{i}" for i in range(len(key))])


def running_sum(df: DataFrame, key: list[str], order: str, value: Column, out: str = "running") -> DataFrame:
    """``sum(value) OVER (PARTITION BY key ORDER BY order)`` with the default
    RANGE UNBOUNDED PRECEDING frame, NULL keys being one key. Peers (equal
    order values) share a range, so they share one running value."""
    by = [F.asc_nulls_last(k) for k in key] + [F.asc_nulls_last(order)]
    rows = _carried(ranged(df.withColumn("_v", value), by), key, F.sum("_v"), F.sum)
    w = Window.partitionBy("_range", *key).orderBy(F.asc_nulls_last(order))
    here = F.sum("_v").over(w)
    total = F.when(F.col("_carry").isNull(), here).otherwise(F.col("_carry") + F.coalesce(here, F.lit(0)))
    return rows.withColumn(out, total).drop("_v", "_carry", "_range")


def previous_max(df: DataFrame, key: list[str], order: list[str], value: Column, out: str = "prev_max") -> DataFrame:
    """``max(value)`` over all rows of the key strictly before this one in
    ``order`` (ROWS UNBOUNDED PRECEDING .. 1 PRECEDING); NULL for a key's first row."""
    by = [F.asc_nulls_last(c) for c in key + order]
    rows = _carried(ranged(df.withColumn("_v", value), by), key, F.max("_v"), F.max)
    w = (Window.partitionBy("_range", *key).orderBy(*[F.asc_nulls_last(o) for o in order])
         .rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn(out, F.greatest("_carry", F.max("_v").over(w))).drop("_v", "_carry", "_range")


def number_rows(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """``row_number() OVER (ORDER BY order)`` without moving every row into one task.

    ``order`` must be a total order (end it with a unique key), so a row's
    number does not depend on how rows arrive. Rows are range-partitioned and
    sorted, and written once with their range and position; a row's number is
    its position plus the rows of all earlier ranges. The offsets come from
    the written rows (one per range, so their broadcast is bounded by the
    number of partitions), never from a second run of the same exchange.
    """
    place = F.monotonically_increasing_id()        # (range << 33) + position in the sorted range
    rows = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order)
                       .withColumn("_range", F.shiftright(place, 33))
                       .withColumn("_at", place - F.shiftleft(F.shiftright(place, 33), 33)))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = (rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
             .select(F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")))
    return (rows.join(F.broadcast(first), F.col("_range") == F.col("_of"))
            .withColumn(out, (F.col("_first") + F.col("_at") + 1).cast("long"))
            .drop("_range", "_at", "_of", "_first"))


global_row_number = number_rows
