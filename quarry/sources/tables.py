"""Fixture table access.

Each table is one Parquet file under ``sf_dir``. Reads are lazy; Catalyst
prunes columns and pushes filters into the Parquet scan, so callers select
only what they need and never pre-materialise a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_NAMES = ("region nation customer supplier part orders lineitem events documents "
               "embeddings pages benchmark labels conversations").split()

# Reference dimensions whose row count is fixed by the schema, not by the
# scale factor (5 regions, 25 nations). Only these are broadcast by hint;
# everything else is left to AQE, which converts a join to broadcast only
# from the measured size of the finished stage.
FIXED_SIZE_DIMENSIONS = {"region": 5, "nation": 25}


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a narrow scan over every core before CPU-heavy per-row work
    (tokenising or regex over long texts).

    A Parquet row group is read by one task, so a small file feeds one core.
    Only a scan with fewer partitions than cores is spread; any large input
    already has many partitions per core and is returned as is, with no
    shuffle added.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores * 2)


class Tables:
    """Attribute access to the fixture tables: ``Tables(spark, d).orders``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def dim(self, name: str) -> DataFrame:
        """A fixed-size reference dimension, hinted for broadcast."""
        if name not in FIXED_SIZE_DIMENSIONS:
            raise ValueError(f"{name} is not a fixed-size dimension")
        return F.broadcast(self.read(name))

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLE_NAMES:
            return self.read(name)
        raise AttributeError(name)
