"""Tidewatch: operations analytics (metrics, alerts, logs, spans, predictions) on PySpark.

Operators are plain functions from DataFrames to a DataFrame.  None of them
opens a session or reads the clock: the reference time is always an argument
(``as_of``).
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python functions travel to the executors by value, so the package need not be
# installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
