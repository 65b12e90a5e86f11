"""Every registered query against its DuckDB oracle on the fixture tables."""

import pytest

from quarry.oracle import compare
from quarry.plans import REGISTRY

NAMES = sorted(REGISTRY)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, sf_dir, name):
    ok, msg = compare(spark, duck, REGISTRY[name], sf_dir)
    assert ok, msg


def test_registry_covers_operator_ids():
    ops = {q.operator for q in REGISTRY.values()}
    for family in ("S-", "P-", "J-", "A-", "W-", "T-", "U-", "F-", "C-", "E-", "D-", "G-", "R-", "X-"):
        assert any(o.startswith(family) for o in ops), family


def test_oracle_keys_subset_of_queries():
    import __spark_entry__ as e
    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(REGISTRY) <= set(e.queries())      # the optional subpackage adds its own


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle_with_nulls(spark, null_duck, null_dir, name):
    """Same parity on a copy of the tables with ~8 % NULLs in keys, dates,
    measures and texts: join/group/sort/bag semantics around NULL."""
    ok, msg = compare(spark, null_duck, REGISTRY[name], null_dir)
    assert ok, msg


_TIME_QUERIES = sorted(n for n, q in REGISTRY.items() if q.oracle and __import__("re").search(
    r"(_ts\b|\bts\b|date|hour|month|epoch|year|time)", q.oracle))


@pytest.mark.parametrize("name", _TIME_QUERIES)
def test_time_queries_independent_of_session_zone(spark, duck, sf_dir, name):
    """Fixture timestamps are wall-clock (NTZ): results must not move with
    the session time zone a cluster happens to run in."""
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        ok, msg = compare(spark, duck, REGISTRY[name], sf_dir)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert ok, msg
