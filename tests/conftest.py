import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("QUARRY_TEST_SF", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark():
    from quarry.session import get_session
    s = get_session("local[*]", 8)
    yield s


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def duck(sf_dir):
    from quarry.oracle import duckdb_views
    return duckdb_views(sf_dir)


@pytest.fixture(scope="session")
def null_dir():
    """A NULL-bearing copy of sf0.001 in a fresh scratch folder."""
    import tempfile
    import nullfixture
    d = tempfile.mkdtemp(prefix="quarry-nulls-", dir="/tmp")
    return nullfixture.build("/root/testdata/sf0.001", d)


@pytest.fixture(scope="session")
def null_duck(null_dir):
    from quarry.oracle import duckdb_views
    return duckdb_views(null_dir)
