"""Column-expression helpers; all JVM-side, none of them a Python UDF."""

from quarry.functions.scalar import *  # noqa: F401,F403
