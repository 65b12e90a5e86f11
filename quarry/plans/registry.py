"""Query registry: name -> (DataFrame builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quarry.sources.tables import Tables

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    operator: str          # SURVEY §2 operator id, e.g. "J-ANTI"
    build: Builder
    oracle: str | None     # DuckDB SQL over the fixture views, None = rows-only check


REGISTRY: dict[str, Query] = {}


def query(name: str, operator: str, oracle: str | None = None):
    """Register ``fn(t: Tables) -> DataFrame`` under ``name``."""

    def deco(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")

        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        build.__name__ = fn.__name__
        build.__doc__ = fn.__doc__
        REGISTRY[name] = Query(name, operator, build, oracle.strip() if oracle else None)
        return fn

    return deco
