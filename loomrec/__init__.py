"""Spark-native analytics for sparse user-item data.

Everything is expressed on long-form DataFrames; see README.md for the map of operators.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Kernels are shipped to Python workers by value, so executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__version__ = "0.1.0"
