"""weftline: weighted two-sample analytics and unfolding on Spark DataFrames.

Functions that run in Python workers are imported there by name, so importing
this package tells the workers of this process's Spark where it lies: through
the environment if the JVM isn't started yet, and through the running context
if it is.
"""

import os

from pyspark import SparkContext

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _add(environment) -> None:
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in known:
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, *known) if x)


_add(os.environ)
if SparkContext._active_spark_context is not None:
    _add(SparkContext._active_spark_context.environment)
