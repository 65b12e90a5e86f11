"""The query catalogue. Importing this package registers every query."""

from quarry.plans.registry import REGISTRY, Query, query
from quarry.plans import (  # noqa: F401  (imported for registration)
    relational, io, compare, scoring, quality, synth, generate, retrieval,
)

__all__ = ["REGISTRY", "Query", "query"]
