"""textlab: PySpark-native toolkit for labelling short texts and analysing
where the labels go wrong. Every operator takes and returns DataFrames."""

import sys as _sys

__version__ = "0.1.0"

# Functions that run in Python workers (mapInPandas / applyInPandas bodies and
# the helpers they call) are shipped by value with the task, so executors do
# not need this package installed or on their path.
try:
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle: ship with --py-files instead
    pass
