"""quarry: Spark jobs for query benchmarking over commerce-style tables.

Everything here builds lazy DataFrames. Sub-packages:

- ``sources``   table loading, JSON run files, multi-folder scans, sinks
- ``functions`` column-expression helpers (dates, text, hashing streams)
- ``operators`` reusable DataFrame -> DataFrame operators (comparison,
  skew-safe windows, interval overlap, top-k, text ranking, rules, synthesis)
- ``plans``     the query catalogue: one builder per registered query,
  each paired with an equivalent DuckDB SQL oracle where SQL can say it
- ``streaming`` intentionally empty (the reference has no streaming work)
"""

import sys as _sys

from quarry.session import get_session, checkpoint_dir

# Python UDFs (mapInPandas/applyInPandas) defined in this package are pickled
# by value, so executors need no copy of the package on their path.
try:
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older pyspark without the hook
    pass

__all__ = ["get_session", "checkpoint_dir"]
